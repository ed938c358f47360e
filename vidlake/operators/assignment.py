"""Matching kernels on small arrays: one frame, one video or one class at a time."""

from __future__ import annotations

import numpy as np


def min_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cheapest assignment of a rectangular cost matrix: one shortest augmenting path for each row, with potentials."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        c, r = min_cost(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    n, m = cost.shape
    u, w, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reach, col = i, 0.0, -1
        while True:
            through = reach + cost[row] - u[row] - w
            better = ~done & (through < dist)
            dist[better], prev[better] = through[better], col
            open_ = np.flatnonzero(~done)
            col = int(open_[np.argmin(dist[open_])])
            reach = dist[col]
            if row_of[col] < 0:
                break
            done[col] = True
            row = row_of[col]
        for j in np.flatnonzero(done):
            w[j] += dist[j] - reach
            u[row_of[j]] += reach - dist[j]
        u[i] += reach
        while col >= 0:
            back = int(prev[col])
            row_of[col] = i if back < 0 else row_of[back]
            col = back
    cols = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[cols])
    return row_of[cols][order], cols[order]


def max_score(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return min_cost(-np.asarray(score, float))


def most_pairs(seeds: list[int], edges: dict[int, list[int]]) -> dict[int, int]:
    """Matching with the most pairs: seeds in order, each along an augmenting path over its edges in order. Left to right."""
    left_of: dict[int, int] = {}
    for seed in seeds:
        tried: set[int] = set()
        # the path so far: a left node and the edges that it has not tried; taken: the right node that each goes to
        path, taken = [(seed, iter(edges.get(seed, ())))], []
        while path:
            j = next((x for x in path[-1][1] if x not in tried), None)
            if j is None:
                path.pop()
                if taken:
                    taken.pop()
                continue
            tried.add(j)
            taken.append(j)
            if j not in left_of:
                for (i, _), right in zip(path, taken, strict=True):
                    left_of[right] = i
                break
            path.append((left_of[j], iter(edges.get(left_of[j], ()))))
    return {i: j for j, i in left_of.items()}


def greedy(score_order: list[int], similarity: np.ndarray, least: float, next_best: bool) -> dict[int, int]:
    """Predictions in order take their most similar free truth; without ``next_best`` only the most similar counts."""
    taken: set[int] = set()
    out: dict[int, int] = {}
    for i in score_order:
        ranked = np.argsort(-similarity[i], kind="stable")
        for j in ranked if next_best else ranked[:1]:
            if similarity[i, j] < least:
                break
            if int(j) not in taken:
                taken.add(int(j))
                out[i] = int(j)
                break
    return out


def span_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Temporal IoU of every span of a with every one of b."""
    both = np.maximum(0.0, np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0]))
    union = (a[:, 1] - a[:, 0])[:, None] + (b[:, 1] - b[:, 0])[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def soft_nms(spans: np.ndarray, scores: np.ndarray, low: float, high: float, alpha: float, top: int) -> np.ndarray:
    """(start, end, score) rows: the best span is taken, and others that overlap it by more than a limit - between low and
    high, by its width - lose score as a Gaussian of the overlap. One row more than ``top`` comes back."""
    left, out = np.column_stack([spans, scores]).astype(float), []
    while len(left) and len(out) <= top:
        k = int(np.argmax(left[:, 2]))
        best = left[k]
        left = np.delete(left, k, 0)
        out.append(best)
        share = span_iou(left[:, :2], best[None, :2])[:, 0]
        limit = low + (high - low) * (best[1] - best[0])
        hit = share > limit
        left[hit, 2] *= np.exp(-share[hit] ** 2 / alpha)
    return np.array(out).reshape(-1, 3)


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box (x1, y1, x2, y2) of a with every one of b."""
    wh = np.maximum(0.0, np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]))
    both = wh.prod(axis=2)
    size = lambda x: np.maximum(0.0, x[:, 2:] - x[:, :2]).prod(axis=1)
    union = size(a)[:, None] + size(b)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def link_tubes(frames: list[tuple[int, np.ndarray, np.ndarray]], least: float = 0.5, min_length: int = 15) -> list[list[tuple[int, np.ndarray, float]]]:
    """Tubes of (frame, box, score) from detections frame by frame: live tubes, the best mean score first, take the surest
    detection that overlaps their last box; a tube without one ends."""
    live: list[list] = []
    ended: list[list] = []
    for frame, boxes, scores in frames:
        free = np.ones(len(boxes), bool)
        stay = []
        for tube in sorted(live, key=lambda t: -np.mean([s for *_, s in t])):
            near = box_iou(tube[-1][1][None], boxes)[0] if len(boxes) else np.zeros(0)
            fit = np.flatnonzero(free & (near >= least))
            if len(fit):
                k = fit[np.argmax(scores[fit])]
                free[k] = False
                tube.append((frame, boxes[k], float(scores[k])))
                stay.append(tube)
            else:
                ended.append(tube)
        live = stay + [[(frame, boxes[k], float(scores[k]))] for k in np.flatnonzero(free)]
    return [t for t in ended + live if len(t) >= min_length]


def complete_link(distance: dict[tuple[int, int], float], ids: list[int], most: float, blocked: set[tuple[int, int]], must: list[tuple[int, int]] = ()) -> dict[int, int]:
    """Group (smallest member) of each id: pairs by distance join two groups only if every pair across them is near enough and not blocked."""
    group = {i: {i} for i in ids}
    near = lambda a, b: (min(a, b), max(a, b)) not in blocked and distance.get((min(a, b), max(a, b)), np.inf) <= most

    def join(a: int, b: int) -> None:
        merged = group[a] | group[b]
        for i in merged:
            group[i] = merged

    for a, b in must:
        if any((min(x, y), max(x, y)) in blocked for x in group[a] for y in group[b]):
            raise ValueError(f"{a} and {b} must and cannot be joined")
        join(a, b)
    for (a, b), d in sorted(distance.items(), key=lambda p: (p[1], p[0])):
        if d <= most and group[a] is not group[b] and all(near(x, y) for x in group[a] for y in group[b]):
            join(a, b)
    return {i: min(group[i]) for i in ids}


#: Rows of a block of distances, and pairs that are sorted at once.
ROWS, EDGES = 1024, 1 << 22


def complete_link_vectors(unit: np.ndarray, apart: np.ndarray, most: float, digits: int = 12) -> np.ndarray:
    """complete_link of vectors of length one by 1 - cosine, without a table of all pairs: place of each one's group's first member.

    Those with equal ``apart`` are never joined, nor is a vector that is NaN. Pairs come in slices of distance of EDGES or so, found anew in blocks;
    what two groups may still be joined is kept as a bit for each two places. Distances are rounded, so that equal vectors are equally far.
    """
    n = len(unit)
    group = np.arange(n)
    fits = np.zeros((n, -(-n // 8)), np.uint8)

    def blocks():
        for lo in range(0, n, ROWS):
            d = np.round(1 - unit[lo : lo + ROWS] @ unit.T, digits)
            d[(apart[lo : lo + ROWS, None] == apart[None]) | ~(d <= most)] = np.inf
            yield lo, d

    least = -1e-9  # of vectors of length one, but for rounding
    edges = np.linspace(least, most, 4097)
    total = np.zeros(len(edges) - 1, np.int64)
    for lo, d in blocks():
        fits[lo : lo + len(d)] = np.packbits(np.isfinite(d), axis=1)
        total += np.histogram(np.minimum(np.maximum(d, least), 1e9), edges)[0]
    upto = np.cumsum(total) // 2
    cuts = [-np.inf, *(float(edges[1:][k]) for k in np.flatnonzero(np.diff(upto // EDGES) > 0)), np.inf]

    def may_join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (fits[a, b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 > 0

    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        met = []
        for lo, d in blocks():
            a, b = np.nonzero((d > low) & (d <= high) & np.isfinite(d) & (np.arange(n)[None] > np.arange(lo, lo + len(d))[:, None]))
            near = may_join(group[a + lo], group[b])
            a, b = a[near], b[near]
            met.append((d[a, b], a + lo, b))
        d, a, b = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        order = np.lexsort((b, a, d))
        a, b = a[order], b[order]
        for at in range(0, len(a), ROWS):
            x, y = a[at : at + ROWS], b[at : at + ROWS]
            left = (group[x] != group[y]) & may_join(group[x], group[y])
            for i, j in zip(x[left].tolist(), y[left].tolist(), strict=True):
                p, q = sorted((int(group[i]), int(group[j])))
                if p == q or not fits[p, q >> 3] >> (7 - (q & 7)) & 1:
                    continue
                group[group == q] = p
                fits[p] &= fits[q]
                bit = np.uint8(1 << (7 - (p & 7)))
                column = np.unpackbits(fits[p], count=n) > 0
                fits[:, p >> 3] = np.where(column, fits[:, p >> 3] | bit, fits[:, p >> 3] & ~bit)
    return group

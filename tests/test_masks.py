"""Masks on runs against pictures, and tracks of masks against a plain version."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.functions import masks as m
from vidlake.operators import segments as sg

H, W = 12, 9


def runs(dense):
    flat = dense.T.ravel().astype(np.int8)
    edges = np.flatnonzero(np.diff(flat)) + 1
    out = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist()
    return [0, *out] if flat[0] else out


def some(seed, share=0.4):
    return np.random.default_rng(seed).random((H, W)) < share


@pytest.mark.parametrize("seed", range(25))
def test_runs_and_pictures_agree(seed):
    a, b = some(seed, 0.1 + seed % 5 / 5), some(seed + 100)
    x, y = (m.spans(np.array(runs(d))) for d in (a, b))
    assert (m.picture(np.array(runs(a)), H, W) == a).all()
    assert m.common(x, y) == (a & b).sum() == m.common(y, x)
    assert (m.picture(m.runs_of(m.joined(x, y), H * W), H, W) == (a | b)).all()
    assert (m.picture(m.runs_of(m.without(x, y), H * W), H, W) == (a & ~b)).all()
    assert m.from_text(m.to_text(runs(a))) == runs(a)


def test_known_texts():
    assert m.to_text([0, 5, 3]) == "053" and m.from_text("053") == [0, 5, 3]
    assert m.from_text(m.to_text([100, 2000, 3, 1, 90_000, 7])) == [100, 2000, 3, 1, 90_000, 7]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_thickened_is_a_disk(radius):
    a = some(radius, 0.05)
    wanted = np.zeros_like(a)
    for y, x in zip(*np.nonzero(a), strict=True):
        for i in range(H):
            for j in range(W):
                wanted[i, j] |= (i - y) ** 2 + (j - x) ** 2 <= radius**2
    assert (m.thickened(a, radius) == wanted).all()


def test_boundaries():
    a = np.zeros((6, 6), bool)
    a[2:4, 2:4] = True
    edge = m.boundary(a)
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(edge), strict=True)} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)}
    assert m.boundary_f(a, a) == 1.0 and m.boundary_f(a, np.zeros_like(a)) == 0.0 and m.boundary_f(np.zeros_like(a), np.zeros_like(a)) == 1.0
    assert m.boundary_f(a, np.roll(a, 1, axis=1), 1) == pytest.approx(1.0)
    assert 0 < m.boundary_f(a, np.roll(a, 2, axis=1), 1) < 1


def frame(spark, rows):
    return spark.createDataFrame([(*r[:-1], (H, W, runs(r[-1]))) for r in rows], f"seq bigint, t int, id bigint, mask {m.MASK}")


def test_columns(spark):
    rows = frame(spark, [(1, 1, 1, some(1)), (1, 1, 2, some(2)), (1, 1, 3, np.zeros((H, W), bool)), (1, 1, 4, np.ones((H, W), bool))])
    got = {(r.a, r.b): r for r in rows.alias("p").join(rows.alias("q"), F.lit(True)).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), m.area(F.col("p.mask")).alias("area"), m.iou(F.col("p.mask"), F.col("q.mask")).alias("iou"), m.contour(F.col("p.mask"), F.col("q.mask")).alias("f")).collect()}
    dense = {1: some(1), 2: some(2), 3: np.zeros((H, W), bool), 4: np.ones((H, W), bool)}
    for (i, j), r in got.items():
        a, b = dense[i], dense[j]
        assert r.area == a.sum() and r.iou == pytest.approx((a & b).sum() / max((a | b).sum(), 1)) and r.f == pytest.approx(m.boundary_f(a, b))
    text = spark.createDataFrame([(m.to_text(runs(some(1))),), (None,)], "text string").select(m.read_text(F.col("text"), F.lit(H), F.lit(W)).alias("m")).collect()
    assert text[0].m.runs == runs(some(1)) and text[1].m is None


@pytest.mark.parametrize("corner", [(1, 2, 4, 7), (0, 0, 9, 12), (3, 0, 5, 12), (8, 11, 20, 20), (4, 4, 4, 9), (2, 3, 3, 4), (-3, -2, 2, 3)])
def test_rectangles(spark, corner):
    x1, y1, x2, y2 = corner
    made = spark.range(1).select(m.rectangle(H, W, *map(F.lit, corner)).alias("m")).first().m
    dense = np.zeros((H, W), bool)
    dense[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = True
    assert (m.picture(np.array(made.runs), H, W) == dense).all() and sum(made.runs) == H * W


def test_masks_of_a_frame_kept_apart(spark):
    dense = [some(k, 0.5) for k in range(5)]
    rows = frame(spark, [(1, 1, k, d) for k, d in enumerate(dense)]).withColumn("score", 1 - F.col("id") / 10)
    got = {r.id: m.picture(np.array(r.mask.runs), H, W) for r in sg.apart(rows, ["seq", "t"]).collect()}
    over = np.zeros((H, W), bool)
    for k, d in enumerate(dense):
        assert (got[k] == (d & ~over)).all()
        over |= d
    kept, wanted = {r.id for r in sg.apart(rows, ["seq", "t"], 0.34).collect()}, []
    for k, d in enumerate(dense):
        if all((d & dense[i]).sum() <= 0.34 * (d | dense[i]).sum() for i in wanted):
            wanted.append(k)
    assert kept == set(wanted) and 1 <= len(kept) < 5


@pytest.mark.parametrize("n_tracks", [1, 3])
def test_regions_and_boundaries_of_tracks(spark, n_tracks):
    T = 7
    gt = {(t, i): some(10 * t + i, 0.3) for t in range(1, T + 1) for i in range(2) if (t + i) % 4}
    tr = {(t, i): (gt[t, (i + 1) % 2] ^ some(t, 0.05) if (t, (i + 1) % 2) in gt and i < 2 else some(50 * t + i)) for t in range(1, T + 1) for i in range(n_tracks) if (t * 3 + i) % 5}
    frames = spark.createDataFrame([(1, T)], "seq bigint, frames int")
    rows = sg.j_and_f(frame(spark, [(1, t, i, d) for (t, i), d in gt.items()]), frame(spark, [(1, t, i, d) for (t, i), d in tr.items()]), frames, 1)
    got = {r.gt_id: r for r in rows.collect()}
    none = np.zeros((H, W), bool)

    def values(i, j):
        out = []
        for t in range(1, T + 1):
            a, b = gt.get((t, i), none), tr.get((t, j), none)
            out.append(((a & b).sum() / (a | b).sum() if (a | b).any() else 1.0, m.boundary_f(a, b, 1)))
        return np.array(out)

    names = [*range(n_tracks), *[None] * max(0, 2 - n_tracks)]
    best = max(permutations(names, 2), key=lambda p: sum(values(i, j).mean() for i, j in enumerate(p)))
    ids = np.round(np.linspace(1, T, 5) + 1e-10).astype(int) - 1
    for i, j in enumerate(best):
        v, r = values(i, j), got[i]
        assert r.tr_id == j
        assert (r.j_mean, r.f_mean) == pytest.approx(tuple(v.mean(axis=0))) and (r.j_recall, r.f_recall) == pytest.approx(tuple((v > 0.5).mean(axis=0)))
        assert (r.j_decay, r.f_decay) == pytest.approx(tuple(v[ids[0] : ids[1] + 1].mean(axis=0) - v[ids[3] : ids[4] + 1].mean(axis=0)))
    whole = sg.sequence_means(rows, ["seq"]).first()
    assert whole.n_truth == 2 and whole.j_and_f == pytest.approx(np.mean([(r.j_mean + r.f_mean) / 2 for r in got.values()]))


@pytest.mark.parametrize("cells", [m.CELLS, 1])
def test_all_pairs_of_a_frame_are_those_of_single_masks(monkeypatch, cells):
    monkeypatch.setattr(m, "CELLS", cells)
    draw = np.random.default_rng(4)
    height, width = 9, 13
    masks = [m.runs_of(np.sort(draw.choice(height * width, 2 * k, replace=False)).reshape(-1, 2), height * width) for k in (0, 1, 3, 9)] + [np.array([0, height * width])]
    j, f = m.all_pairs(masks, masks[::-1], height, width, 0.1)
    for x, a in enumerate(masks):
        for y, b in enumerate(masks[::-1]):
            p, q = m.picture(a, height, width), m.picture(b, height, width)
            assert j[x, y] == ((p & q).sum() / (p | q).sum() if (p | q).any() else 1.0)
            assert f[x, y] == m.boundary_f(p, q, 0.1)


def test_a_mask_is_drawn_once_a_frame_not_once_a_pair(monkeypatch):
    drawn = []
    whole = m.picture
    monkeypatch.setattr(m, "picture", lambda *x: drawn.append(1) or whole(*x))
    m.all_pairs([np.array([3, 9, 20])] * 30, [np.array([5, 4, 23])] * 30, 4, 8)
    assert len(drawn) == 60

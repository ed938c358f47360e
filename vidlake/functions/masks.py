"""Segmentation masks as run lengths.

A mask is a struct (height, width, runs): lengths of background and foreground in turn, background first, down the columns
from left to right, summing up to height x width. Areas and conversions are column expressions; what meets two masks works
on the runs of an Arrow batch and makes no picture, but for boundaries, which are two-dimensional.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "struct<height:int,width:int,runs:array<int>>"


def mask(height: Column, width: Column, runs: Column) -> Column:
    return F.struct(height.cast("int").alias("height"), width.cast("int").alias("width"), runs.cast("array<int>").alias("runs"))


def area(m: Column) -> Column:
    """Pixels of the foreground."""
    return F.aggregate(F.filter(m["runs"], lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def rectangle(height: int, width: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Mask of whole pixels x1 <= x < x2, y1 <= y < y2, cut at the picture's edges."""
    at = lambda c, most: F.greatest(F.lit(0), F.least(c.cast("int"), F.lit(most)))
    left, top = at(x1, width), at(y1, height)
    n, tall = F.greatest(at(x2, width) - left, F.lit(0)), F.greatest(at(y2, height) - top, F.lit(0))
    whole = F.lit(height * width)
    first = F.array(left * height + top, tall)
    more = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array(F.lit(height) - tall, tall)))
    runs = F.when((n < 1) | (tall < 1), F.array(whole)).when(tall == height, F.array(left * height, n * height, whole - (left + n) * height))
    last = F.array(whole - (left + n - 1) * height - top - tall)
    return mask(F.lit(height), F.lit(width), runs.otherwise(F.when(n == 1, F.concat(first, last)).otherwise(F.concat(first, more, last))))


def from_text(text: str) -> list[int]:
    """Runs of the compressed form: five bits of a number to a character, low ones first, the sixth says that more follow; from the fourth
    run on a number is what is added to the run two before."""
    runs: list[int] = []
    value = shift = 0
    for c in text:
        bits = ord(c) - 48
        value |= (bits & 31) << shift
        shift += 5
        if bits & 32:
            continue
        if bits & 16:
            value -= 1 << shift
        runs.append(value + runs[-2] if len(runs) > 2 else value)
        value = shift = 0
    return runs


def to_text(runs: list[int]) -> str:
    out = []
    for i, run in enumerate(runs):
        value = run - runs[i - 2] if i > 2 else run
        while True:
            bits, value = value & 31, value >> 5
            more = value != (-1 if bits & 16 else 0)
            out.append(chr(48 + bits + 32 * more))
            if not more:
                break
    return "".join(out)


def read_text(text: Column, height: Column, width: Column) -> Column:
    """Masks from their compressed form; null for null."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if t is None else from_text(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return F.when(text.isNotNull(), mask(height, width, F.arrow_udf(run, "array<int>")(text)))


def spans(runs: np.ndarray) -> np.ndarray:
    """Where foreground starts and ends: ends[0], ends[1] is the first span, and so on. Empty spans are left out."""
    edges = np.cumsum(runs)
    edges = edges[: len(edges) // 2 * 2].reshape(-1, 2)
    return edges[edges[:, 0] < edges[:, 1]]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels in both of two lists of spans."""
    if not len(a) or not len(b):
        return 0
    covered = np.append(0, np.cumsum(a[:, 1] - a[:, 0]))
    flat = a.ravel()

    def upto(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(flat, x, "right")  # odd: inside a span
        return covered[k // 2] + np.where(k % 2 == 1, x - flat[np.minimum(k - k % 2, len(flat) - 1)], 0)

    return int((upto(b[:, 1]) - upto(b[:, 0])).sum())


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans in either."""
    both = np.concatenate([a, b])
    if not len(both):
        return both
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.append(True, both[1:, 0] > reach[:-1])
    last = np.append(first[1:], True)
    return np.stack([both[first, 0], reach[last]], axis=1)


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans of a that are not in b."""
    if not len(a) or not len(b):
        return a
    b = joined(b, b[:0])
    gaps = np.stack([np.append(np.iinfo(np.int64).min, b[:, 1]), np.append(b[:, 0], np.iinfo(np.int64).max)], axis=1)
    low, high = np.searchsorted(gaps[:, 1], a[:, 0], "right"), np.searchsorted(gaps[:, 0], a[:, 1], "left")
    n = high - low
    which = np.repeat(np.arange(len(a)), n)
    gap = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    made = np.stack([np.maximum(a[which, 0], gaps[gap, 0]), np.minimum(a[which, 1], gaps[gap, 1])], axis=1)
    return made[made[:, 0] < made[:, 1]]


def runs_of(parts: np.ndarray, size: int) -> np.ndarray:
    """Run lengths of spans in a picture of so many pixels."""
    return np.diff(np.concatenate([[0], joined(parts, parts[:0]).ravel(), [size]])).astype(np.int64)


def picture(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mask as height x width truth values."""
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(width, height).T


def boundary(dense: np.ndarray) -> np.ndarray:
    """Pixels that differ from the one to the right, below, or below to the right; on the last row and column the one neighbour there is counts.

    dense: a picture, or a stack of them.
    """
    right, below, both = (np.zeros_like(dense) for _ in range(3))
    right[..., :-1], below[..., :-1, :], both[..., :-1, :-1] = dense[..., 1:], dense[..., 1:, :], dense[..., 1:, 1:]
    out = (dense != right) | (dense != below) | (dense != both)
    out[..., -1, :], out[..., -1] = dense[..., -1, :] != right[..., -1, :], dense[..., -1] != below[..., -1]
    out[..., -1, -1] = False
    return out


def thickened(dense: np.ndarray, radius: int) -> np.ndarray:
    """All pixels within a disk of the radius around those set, in a picture or each of a stack."""
    out = np.zeros_like(dense)
    *stack, height, width = dense.shape
    for down in range(-radius, radius + 1):
        half = math.isqrt(radius * radius - down * down)
        total = np.zeros((*stack, height, width + 2 * half + 2), np.int32)
        np.cumsum(np.pad(dense, (*[(0, 0)] * (dense.ndim - 1), (half, half + 1))), axis=-1, out=total[..., 1:])
        wide = total[..., 2 * half + 1 : 2 * half + 1 + width] > total[..., :width]
        if down >= 0:
            out[..., down:, :] |= wide[..., : max(height - down, 0), :]
        else:
            out[..., :down, :] |= wide[..., -down:, :]
    return out


def reach(share: float, height: int, width: int) -> int:
    """Pixels by which a boundary may be off: a share of the diagonal (pixels from 1 on)."""
    return int(share if share >= 1 else math.ceil(share * math.hypot(height, width)))


def boundary_f(a: np.ndarray, b: np.ndarray, share: float = 0.008) -> float:
    """F of two pictures' boundaries, each held against the other's thickened by a share of the diagonal (pixels from 1 on)."""
    edge_a, edge_b = boundary(a), boundary(b)
    n_a, n_b = int(edge_a.sum()), int(edge_b.sum())
    if not n_a or not n_b:
        return float(n_a == n_b)
    radius = reach(share, *a.shape)
    precision = (edge_a & thickened(edge_b, radius)).sum() / n_a
    recall = (edge_b & thickened(edge_a, radius)).sum() / n_b
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


#: Pixels of pictures that are held against others at once.
CELLS = 1 << 22


def _stacks(masks: list[np.ndarray], height: int, width: int, share: float) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Blocks of masks: which, their pictures, boundaries and thickened boundaries as rows of numbers, their areas and lengths of boundaries."""
    kind = np.float32 if height * width < 1 << 24 else np.float64  # holds all counts exactly
    step = max(1, CELLS // max(height * width, 1))
    for lo in range(0, len(masks), step):
        dense = np.stack([picture(x, height, width) for x in masks[lo : lo + step]])
        edge = boundary(dense)
        flat = [x.reshape(len(dense), -1).astype(kind) for x in (dense, edge, thickened(edge, reach(share, height, width)))]
        yield slice(lo, lo + len(dense)), flat, dense.sum(axis=(1, 2)), edge.sum(axis=(1, 2))


def all_pairs(a: list[np.ndarray], b: list[np.ndarray], height: int, width: int, share: float = 0.008) -> tuple[np.ndarray, np.ndarray]:
    """Overlap over union (1 for two empty masks) and F of the boundaries of each of a with each of b, all runs of one picture.

    Each mask is drawn once, its boundary found once; the counts of all pairs come as products.
    """
    j, f = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for here, (pa_, ea, ta), area_a, n_a in _stacks(a, height, width, share):
        for there, (pb, eb, tb), area_b, n_b in _stacks(b, height, width, share):
            both = (pa_ @ pb.T).astype(np.int64)
            union = area_a[:, None] + area_b[None] - both
            j[here, there] = np.divide(both, union, out=np.ones(both.shape), where=union > 0)
            some = (n_a[:, None] > 0) & (n_b[None] > 0)
            precision = np.divide((ea @ tb.T).astype(np.int64), n_a[:, None], out=np.zeros(both.shape), where=some)
            recall = np.divide((ta @ eb.T).astype(np.int64), n_b[None], out=np.zeros(both.shape), where=some)
            made = np.divide(2 * precision * recall, precision + recall, out=np.zeros(both.shape), where=precision + recall > 0)
            f[here, there] = np.where(some, made, n_a[:, None] == n_b[None])
    return j, f


def _rows(column: pa.StructArray) -> list[np.ndarray]:
    runs = column.field("runs")
    flat, at = runs.flatten().to_numpy(), np.append(0, np.cumsum(np.nan_to_num(pa.compute.list_value_length(runs).to_numpy(zero_copy_only=False)))).astype(int)
    return [flat[i:j].astype(np.int64) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def intersection(a: Column, b: Column) -> Column:
    """Pixels in both masks, from their runs."""
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.array([common(spans(x), spans(y)) for x, y in zip(_rows(left), _rows(right), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(a, b)


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 for two empty masks."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both.cast("double"), area(a) + area(b) - both), F.lit(0.0))


def contour(a: Column, b: Column, share: float = 0.008) -> Column:
    """F of the boundaries of two masks of one picture."""
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            sizes = zip(left.field("height").to_pylist(), left.field("width").to_pylist(), strict=True)
            yield pa.array([boundary_f(picture(x, *s), picture(y, *s), share) for x, y, s in zip(_rows(left), _rows(right), sizes, strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)

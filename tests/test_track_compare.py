"""Parity of two results and coverage of ways, on known cases and against plain versions."""

import math
from itertools import permutations

import numpy as np
import pytest

from vidlake.operators import track_compare as tc
from vidlake.operators import tracking_metrics as tm

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"


def table(spark, rows):
    """rows: (seq, t, id, x, y), boxes of 10 by 10."""
    return spark.createDataFrame([(s, t, i, (float(x), float(y), x + 10.0, y + 10.0)) for s, t, i, x, y in rows], f"seq bigint, t bigint, id bigint, box {BOX}")


def lanes(seq, n=3, frames=5):
    return [(seq, t, i, 100 * i + t, 7 * i) for t in range(frames) for i in range(n)]


def test_other_names_are_parity(spark):
    rows = lanes(1)
    got = tc.parity(table(spark, rows), table(spark, [(s, t, {0: 8, 1: 0, 2: 1}[i], x + 0.004, y) for s, t, i, x, y in rows])).first()
    assert got.equal and got.compared == 15 and got.ids == 3 and got.largest == pytest.approx(0.004)


def test_one_exchanged_box_is_named(spark):
    rows = lanes(1)
    swap = {0: 1, 1: 0}
    other = [(s, t, swap.get(i, i) if t == 3 else i, x, y) for s, t, i, x, y in rows]
    left, right = table(spark, rows), table(spark, other)
    got = tc.parity(left, right).first()
    assert (got.equal, got.moved, got.id_conflicts, got.count_mismatch_frames) == (False, 0, 2, 0)
    wrong = {(r.a, r.b, r.first) for r in tc.id_mapping(tc.same_boxes(left, right)).filter("not kept").collect()}
    assert wrong == {(0, 1, 3), (1, 0, 3)}


def test_moved_and_missing_boxes(spark):
    rows = lanes(1) + lanes(2)
    other = [(s, t, i, x + (5 if (s, t, i) == (1, 2, 1) else 0), y) for s, t, i, x, y in rows if (s, t, i) != (1, 4, 2)] + [(1, 9, 0, 0, 0)]
    got = {r.seq: r for r in tc.parity(table(spark, rows), table(spark, other)).collect()}
    assert (got[1].moved, got[1].count_mismatch_frames, got[1].compared, got[1].largest, got[1].equal) == (1, 2, 14, 5.0, False)
    assert got[2].equal


def test_known_way(spark):
    """A truth of length 4 that two tracks cover in turn: the longer part counts."""
    truth = [(1, t, 1, 10 * t, 0) for t in range(5)]
    tracks = [(1, t, 7 if t < 3 else 8, 10 * t, 0) for t in range(5)]
    got = tc.way_coverage(table(spark, truth), tm.similarities(table(spark, truth), table(spark, tracks))).first()
    assert (got.way, got.covered, got.share) == (40.0, 20.0, 0.5)
    mean = tc.mean_share(tc.way_coverage(table(spark, truth), tm.similarities(table(spark, truth), table(spark, tracks))), spark.createDataFrame([(1,), (2,)], "seq bigint")).first()
    assert mean.share == 0.25


@pytest.mark.parametrize("seed", range(3))
def test_ways_against_all_pairings(spark, seed):
    draw = np.random.default_rng(seed)
    truth = [(1, t, i, int(draw.integers(0, 40)), int(draw.integers(0, 4))) for t in range(8) for i in range(3) if draw.random() < 0.8]
    tracks = [(1, t, int(draw.permutation(3)[0]) + 10 * k, x + int(draw.integers(0, 4)), y) for k in range(2) for _, t, _, x, y in truth if draw.random() < 0.5]
    tracks = list({(s, t, i): (s, t, i, x, y) for s, t, i, x, y in tracks}.values())
    a, b = table(spark, truth), table(spark, tracks)
    got = tc.way_coverage(a, tm.similarities(a, b)).first()
    overlap = lambda p, q: max(0, 10 - abs(p[3] - q[3])) * max(0, 10 - abs(p[4] - q[4]))
    way = lambda rows: sum(math.dist(p[3:], q[3:]) for p, q in zip(rows, rows[1:], strict=False))
    ids, names = sorted({r[2] for r in truth}), sorted({r[2] for r in tracks})
    part = {(i, j): way([p for p in sorted(truth) if p[2] == i and any(q[1] == p[1] and q[2] == j and overlap(p, q) / (200 - overlap(p, q)) >= 0.5 for q in tracks)]) for i in ids for j in names}
    wide = [*names, *[None] * len(ids)]
    best = max(sum(part.get((i, j), 0) for i, j in zip(ids, p, strict=False)) for p in permutations(wide, len(ids)))
    assert got.covered == pytest.approx(best) and got.way == pytest.approx(sum(way(sorted(r for r in truth if r[2] == i)) for i in ids))

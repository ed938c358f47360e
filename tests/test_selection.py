"""Windows, boundary features, tracks with gaps, skeletons and the tracker's protocols against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.functions import skeletons as sk
from vidlake.operators import detection as det
from vidlake.operators import sampling as smp
from vidlake.streaming import tracker

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"


@pytest.mark.parametrize("seed", range(4))
def test_windows_that_do_not_overlap(spark, seed):
    draw = random.Random(seed)
    rows = [(v, k % 3, k, float(s), s + 5.0, draw.randint(1, 99) / 100, draw.random() < 0.8) for v in (1, 2) for k, s in enumerate(draw.sample(range(60), 14))]
    table = spark.createDataFrame(rows, "video int, stratum int, window int, start double, end double, score double, clear boolean")
    got = {}
    for r in smp.covering_windows(table, ["video"], 5).collect():
        got.setdefault(r.video, []).append(r)
    for v in (1, 2):
        own = sorted((r for r in rows if r[0] == v and r[6]), key=lambda r: (-r[5], r[3], r[2]))
        chosen = [next(r for r in own if r[1] == s) for s in {r[1] for r in own}]
        for r in own:
            if len(chosen) < 5 and all(r[4] <= c[3] or c[4] <= r[3] for c in chosen):
                chosen.append(r)
        assert [x.window for x in got[v]] == [c[2] for c in sorted(chosen, key=lambda c: c[3])]
        assert {x.enough for x in got[v]} == {len(chosen) == 5}


@pytest.mark.parametrize("seed", range(5))
def test_boundary_features_are_numpy_s(spark, seed):
    draw = np.random.default_rng(seed)
    n, gap = 12, 0.4
    curve = draw.random(n)
    start, end = sorted((draw.random(2) * n * gap * 1.2).tolist())
    points = np.concatenate([[-gap / 2], gap / 2 + gap * np.arange(n), [n * gap + gap / 2]])
    values = np.concatenate([[0], curve, [0]])

    def around(lo, hi, k):
        each = (hi - lo) / (k - 1)
        y = np.interp([lo - each / 2 + each / 3 * i for i in range(3 * k + 1)], points, values)
        return [y[3 * i : 3 * i + 4].mean() for i in range(k)]

    off = 0.2 * (end - start)
    wanted = around(start, end, 16) + around(start - off, start + off, 8) + around(end - off, end + off, 8)
    row = spark.createDataFrame([(curve.tolist(), start, end)], "curve array<double>, start double, end double")
    got = row.select(det.boundary_features(F.col("curve"), F.lit(gap), F.col("start"), F.col("end")).alias("f")).first().f
    assert len(got) == 32 and got == pytest.approx(wanted)


def boxes(spark, rows):
    return spark.createDataFrame([(1, f, (x, 0.0, x + 100.0, 100.0), s) for f, x, s in rows], f"video int, frame_idx bigint, box {BOX}, score double")


@pytest.mark.parametrize("gap, tracks", [(9, 1), (10, 2)])
def test_a_gap_joins_up_to_nine_frames(spark, gap, tracks):
    rows = [(f, 0.0, 0.9) for f in range(4)] + [(f, 10.0, 0.9) for f in range(4 + gap, 8 + gap)]
    got = det.gap_tracks(boxes(spark, rows), ["video"]).collect()
    assert len(got) == 8 and len({r.track_id for r in got}) == tracks


def test_one_box_of_a_frame_to_a_track(spark):
    got = det.gap_tracks(boxes(spark, [(0, 0.0, 0.9), (1, 0.0, 0.8), (1, 5.0, 0.9), (2, 300.0, 0.5)]), ["video"]).collect()
    assert sorted((r.frame_idx, r.box.x1, r.track_id) for r in got) == [(0, 0.0, 0), (1, 0.0, 1), (1, 5.0, 0), (2, 300.0, 2)]


def test_clean_up_and_fill(spark):
    rows = [(f, 430.0, 0.9) for f in range(1, 12) if f not in (4, 5, 6)] + [(f, 0.0, 0.9) for f in range(3)] + [(f, 2000.0, 0.9) for f in range(8)]
    tracks = det.solid(det.gap_tracks(boxes(spark, rows), ["video"]), ["video"])
    assert sorted(r.n for r in tracks.groupBy("track_id").agg(F.count("*").alias("n")).collect()) == [8, 8]
    frames = spark.createDataFrame([(1, 14)], "video int, frames bigint")
    got = {r.frame_idx: r for r in det.main_person(tracks, frames, ["video"], centre=(480.0, 50.0)).collect()}
    assert set(got) == set(range(14)) and {r.box.x1 for r in got.values()} == {430.0}
    assert {f for f, r in got.items() if r.filled} == {0, 4, 5, 6, 12, 13}


def points(seed, people=2, frames=3, joints=17, size=3):
    return np.random.default_rng(seed).random((people, frames, joints, size))


@pytest.mark.parametrize("layout, joints, size", [("coco", 17, 3), ("coco", 17, 2), ("openpose", 18, 3), ("nturgb+d", 25, 3)])
def test_skeletons(spark, layout, joints, size):
    a = points(1, joints=joints, size=size)
    row = spark.createDataFrame([(a.tolist(),)], "k array<array<array<array<double>>>>")
    got = row.select(sk.bones(F.col("k"), layout).alias("bones"), sk.motion(F.col("k"), layout).alias("motion"), sk.normalised(F.col("k"), F.lit(4.0), F.lit(2.0)).alias("near")).first()
    parents, scored = sk.PARENTS[layout], layout in sk.SCORED and size == 3
    assert len(parents) == joints
    bones, motion, near = a - a[:, :, parents], np.zeros_like(a), a.copy()
    motion[:, :-1] = a[:, 1:] - a[:, :-1]
    if scored:
        bones[..., 2] = (a[..., 2] + a[:, :, parents, 2]) / 2
        motion[:, :-1, :, 2] = (a[:, 1:, :, 2] + a[:, :-1, :, 2]) / 2
    near[..., 0], near[..., 1] = a[..., 0] - 1, a[..., 1] / 2 - 1
    for mine, wanted in ((got.bones, bones), (got.motion, motion), (got.near, near)):
        assert np.allclose(np.array(mine), wanted)
    both = row.select(sk.merged([F.col("k"), sk.bones(F.col("k"), layout)]).alias("m")).first().m
    assert np.allclose(np.array(both), np.concatenate([a, bones], axis=-1))


def test_protocols_differ():
    scores = np.array([[0.8, 0.6, 0.0], [0.9, 0.1, 0.0], [0.0, 0.55, 0.7]])
    assert sorted(tracker.by_assignment(scores, [0, 1], 0.5)) == [(0, 1), (1, 0)]
    assert tracker.by_object(scores, [0, 1], 0.5) == [(1, 0)]  # the third is newborn, the first asked for the second's label
    assert tracker.by_label(scores, [0, 1], 0.5) == [(0, 1), (1, 0)]
    assert tracker.by_label(np.array([[0.8, 0.6, 0.9], [0.1, 0.1, 0.0]]), [0, 1], 0.5) == []  # the newborn label won the detection
    assert tracker.by_object(scores, [1], 0.5) == [] and tracker.by_object(np.array([[0.9, 0.0], [0.9, 0.0]]), [0], 0.5) == [(0, 0)]


def test_newborns_under_each_protocol():
    for protocol, ids in (("assignment", {10: 1, 11: 0}), ("object", {11: 0, 10: 2}), ("label", {10: 1, 11: 0})):
        live = {0: (0, 0), 1: (1, 0)}
        out, _ = tracker.step(live, 2, 1, [10, 11], np.array([[0.8, 0.6, 0.1, 0.9 if protocol == "object" else 0.0], [0.9, 0.1, 0.1, 0.0]]), [0, 1, 2], 0.5, 0.5, 30, protocol)
        assert {d: t for d, t, _ in out} == ids


def test_boundary_features_of_many_curves_take_seconds(spark):
    import time

    curve = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") + i))
    rows = spark.range(4000).select(F.explode(det.boundary_features(curve, F.lit(0.5), F.col("id") % 7 * 1.5, F.col("id") % 7 * 1.5 + 4)).alias("v"))
    began = time.perf_counter()
    assert rows.agg(F.count("v")).first()[0] == 4000 * 32
    assert time.perf_counter() - began < 30


def test_boundary_features_of_missing_values_are_null(spark):
    rows = spark.createDataFrame([([1.0, None, 3.0], 0.5, 1.0), (None, 0.0, 1.0), ([1.0], None, 1.0)], "curve array<double>, start double, end double")
    first, *rest = [r.f for r in rows.select(det.boundary_features(F.col("curve"), F.lit(0.5), F.col("start"), F.col("end")).alias("f")).collect()]
    assert None in first and rest == [None, None]

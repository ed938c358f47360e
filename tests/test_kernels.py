"""Matching kernels and tracking metrics against exhaustive search and closed forms."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators import assignment as asg
from vidlake.operators import detection as det
from vidlake.operators import evaluation as evl


def test_assignment_is_the_cheapest():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        n, m = rnd.integers(1, 6, 2)
        cost = np.round(rnd.normal(size=(n, m)), 1)
        r, c = asg.min_cost(cost)
        small, wide = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(wide), len(small)))
        assert len(r) == min(n, m) and len(set(c)) == len(c) and cost[r, c].sum() == pytest.approx(best)
    assert asg.min_cost(np.zeros((0, 3)))[0].size == 0


def test_most_pairs():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        edges = {i: [int(j) for j in range(5) if rnd.random() < 0.4] for i in range(5)}
        best = max(sum(p[i] in edges[i] for i in range(5)) for p in permutations(range(5)))
        got = asg.most_pairs(list(range(5)), edges)
        assert len(got) == best and all(j in edges[i] for i, j in got.items())


def test_complete_link_does_not_chain():
    d = {(1, 2): 0.1, (2, 3): 0.1, (1, 3): 0.9}
    assert asg.complete_link(d, [1, 2, 3], 0.2, set()) == {1: 1, 2: 1, 3: 3}
    assert asg.complete_link(d, [1, 2, 3], 0.2, {(1, 2)}) == {1: 1, 2: 2, 3: 2}
    with pytest.raises(ValueError):
        asg.complete_link(d, [1, 2, 3], 0.2, {(1, 2)}, [(1, 2)])


def test_a_long_chain_of_pairs():
    """Each left node wants the right node of the one before: one path through all of them."""
    n = 100_000
    edges = {i: [i, i + 1] if i < n else [0] for i in range(n + 1)}
    got = asg.most_pairs(list(range(n + 1)), edges)
    assert len(got) == n + 1 and len(set(got.values())) == n + 1


def test_soft_suppression_keeps_the_best():
    out = asg.soft_nms(np.array([[0.0, 1.0], [0.0, 0.9], [2.0, 3.0]]), np.array([0.9, 0.8, 0.7]), 0.3, 0.3, 0.4, 10)
    assert out[0].tolist() == [0.0, 1.0, 0.9] and out[1].tolist() == [2.0, 3.0, 0.7] and out[2][2] == pytest.approx(0.8 * np.exp(-(0.9**2) / 0.4))


def test_tubes_and_baseline_tracks(spark):
    rows = [("v", f, float(x), 0.5 + k / 10) for f in range(20) for k, x in enumerate((f, 100 + f))]
    d = spark.createDataFrame(rows, "video string, frame_idx bigint, x double, score double").select("video", "frame_idx", g.box(F.col("x"), F.lit(0.0), F.col("x") + 20, F.lit(10.0)).alias("box"), "score")
    t = det.tubes(d, ["video"], min_length=15).groupBy("tube_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in t) == [20, 20]
    b = det.baseline_tracks(d, ["video"]).groupBy("track_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in b) == [20, 20]
    assert det.tubes(d.filter("false"), ["video"]).count() == 0


def test_next_best_truth(spark):
    pairs = spark.createDataFrame([("x", 1, 7, 0.9), ("x", 2, 7, 0.8), ("x", 2, 8, 0.6)], "label string, pred int, truth int, tiou double")
    preds = spark.createDataFrame([("x", 1, 0.9), ("x", 2, 0.5), ("x", 3, 0.4)], "label string, pred int, score double")
    out = {(r["pred"], r["threshold"]): r["hit"] for r in det.locked_hits(pairs, preds, ["label"], [0.5, 0.7]).collect()}
    assert out == {(1, 0.5): True, (2, 0.5): True, (3, 0.5): False, (1, 0.7): True, (2, 0.7): False, (3, 0.7): False}


def test_distractors_and_crowds(spark):
    box = lambda x: g.box(F.lit(float(x)), F.lit(0.0), F.lit(float(x + 10)), F.lit(10.0))
    one = spark.range(1).select(F.lit(1).alias("seq"), F.lit(1).alias("t"))
    truth = one.select("*", F.lit(1).alias("id"), box(0).alias("box"), F.lit(False).alias("distractor")).union(one.select("*", F.lit(2), box(50), F.lit(True)))
    tracks = one.select("*", F.lit(5).alias("id"), box(1).alias("box")).union(one.select("*", F.lit(6), box(51))).union(one.select("*", F.lit(7), box(200)))
    assert sorted(r["id"] for r in det.without_distractors(truth, tracks).collect()) == [5, 7]
    assert sorted(r["id"] for r in det.not_in_crowd(tracks, one.select("seq", "t", g.box(F.lit(190.0), F.lit(0.0), F.lit(300.0), F.lit(20.0)).alias("box"))).collect()) == [5, 6]


def test_candidates_and_curves(spark):
    s = spark.createDataFrame([("v", 1.0, 0.5), ("v", 8.0, 0.9)], "v string, t double, score double")
    got = {(r["start"], r["end"], r["score"]) for r in det.candidate_spans(s, s.withColumn("t", F.col("t") + 3), ["v"], 5.0).collect()}
    assert got == {(1.0, 4.0, 0.25), (8.0, 11.0, 0.81)}
    row = spark.range(1).select(det.at_positions(F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)), F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.0))).alias("v")).first()
    assert row["v"] == [0.0, 5.0, 20.0]
    hits = spark.createDataFrame([("x", 1, 0.9, True, 2), ("x", 2, 0.8, False, 2), ("x", 3, 0.7, True, 2)], "label string, pred int, score double, hit boolean, n int")
    assert det.track_precision(hits, ["label"], "n", [0.5, 1.0]).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_assigned_boxes(spark):
    box = lambda x: g.box(x, F.lit(0.0), x + 10, F.lit(10.0))
    p = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0), (1, 3, 100.0)], "k int, pred int, x double").select("k", "pred", box(F.col("x")).alias("box"))
    t = spark.createDataFrame([(1, 9, 0.0), (1, 10, 9.0)], "k int, truth int, x double").select("k", "truth", box(F.col("x")).alias("box"))
    assert {r["pred"]: r["assigned"] for r in det.best_truth(p, t, ["k"], 0.5, 0.4).collect()} == {1: 9, 2: 10, 3: None}


def test_nothing_scores_nothing(spark):
    empty = spark.createDataFrame([], "tp long, fp long, fn long")
    assert [r["f1"] for r in evl.micro(empty).collect()] == [None]


#: Known results: truths and proposals (start, end, score) by video, the number of proposals a video at which recall is 0.5 and 1, and the area.
KNOWN = [
    ({"a": [(0, 1), (1, 2)], "b": [(0, 1), (1, 2)]}, {"a": [(0, 1, 1), (1, 2, 1)], "b": [(0, 1, 1), (1, 2, 1)]}, [0.0] * 49 + [0.5] * 50 + [1.0], 0.02, 25.5),
    ({"a": [(0, 1), (1, 2)], "b": [(0, 1), (1, 2)]}, {"a": [(10, 11, 0.6), (11, 12, 0.4)], "b": [(10, 11, 0.6), (11, 12, 0.4)]}, [0.0] * 100, 0.02, 0.0),
    ({"a": [(0, 1)]}, {"a": [(i, i + 1, 1 / (i + 1)) for i in range(100)]}, [1.0] * 100, 1.0, 99.0),
]


@pytest.mark.parametrize("truths, proposals, recall, step, area", KNOWN)
def test_average_recall_of_known_cases(spark, truths, proposals, recall, step, area):
    t = spark.createDataFrame([(k, i, float(a), float(b)) for k, rows in truths.items() for i, (a, b) in enumerate(rows)], "video string, truth int, start double, end double")
    p = spark.createDataFrame([(k, i, float(a), float(b), float(s)) for k, rows in proposals.items() for i, (a, b, s) in enumerate(rows)], "video string, prop int, start double, end double, score double")
    curve = evl.average_recall(p, t, [round(0.5 + 0.05 * k, 2) for k in range(10)])
    rows = curve.collect()
    for threshold in {r.threshold for r in rows}:
        own = sorted((r for r in rows if r.threshold == threshold), key=lambda r: r.step)
        assert [r.recall for r in own] == recall
        assert [r.per_video for r in own] == pytest.approx([step * k for k in range(1, 101)])
    assert evl.recall_area(curve).first().auc == pytest.approx(area)

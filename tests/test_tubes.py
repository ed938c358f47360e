"""Whole tracks and tubes against plain versions that go through predictions one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import curves
from vidlake.operators import track_map as tmap
from vidlake.operators import tubelets as tb

RANGES = {"all": (0.0, math.inf, 0.0, math.inf), "small": (0.0, 50.0, 0.0, math.inf), "long": (0.0, math.inf, 4.0, 1e5)}
OVERLAPS, RECALLS = [0.3, 0.6], [k / 10 for k in range(11)]


def plain_track_map(pairs, truths, tracks, most):
    """By class, overlap and range: (ap, ar). pairs: {(seq, class, truth, track): iou}; truths, tracks: {(seq, class, id): facts}."""
    out = {}
    for label in {k[1] for k in truths} | {k[1] for k in tracks}:
        for overlap in OVERLAPS:
            for name, (a0, a1, l0, l1) in RANGES.items():
                good = {k: a0 <= t["area"] <= a1 and l0 <= t["length"] <= l1 and not t["crowd"] for k, t in truths.items() if k[1] == label}
                points, n = [], sum(good.values())
                for seq in {k[0] for k in tracks if k[1] == label}:
                    own = sorted((k for k in tracks if k[:2] == (seq, label)), key=lambda k: (-tracks[k]["score"], k))[: most or None]
                    taken = set()
                    for k in own:
                        t = tracks[k]
                        free = [(good[g], pairs[(*g, k[2])], g[2]) for g in good if g[0] == seq and g[2] not in taken and pairs.get((*g, k[2]), 0) >= overlap - 1e-12]
                        if any(f[0] for f in free):
                            free = [f for f in free if f[0]]
                        if free:
                            best = max(free, key=lambda f: (f[1], f[2]))
                            taken.add(best[2])
                            if best[0]:
                                points.append((-t["score"], seq, k[2], True))
                        elif t["exhaustive"] and a0 <= t["area"] <= a1 and l0 <= t["length"] <= l1:
                            points.append((-t["score"], seq, k[2], False))
                if not n:
                    continue
                hits = np.cumsum([p[3] for p in sorted(points)]) if points else np.zeros(0)
                precision = hits / np.arange(1, len(hits) + 1)
                top = np.maximum.accumulate(precision[::-1])[::-1]
                at = [next((top[i] for i in range(len(hits)) if hits[i] / n >= r - 1e-9), 0.0) for r in RECALLS]
                out[label, overlap, name] = (np.mean(at), hits[-1] / n if len(hits) else 0.0)
    return out


@pytest.mark.parametrize("most", [0, 3])
def test_track_map_with_ignored_truths(spark, most):
    draw = random.Random(most)
    truths, tracks, pairs = {}, {}, {}
    for seq in range(4):
        for label in (0, 1):
            for i in range(5):
                truths[seq, label, i] = {"area": draw.choice([10.0, 50.0, 90.0]), "length": draw.choice([2, 4, 9]), "crowd": draw.random() < 0.2}
                tracks[seq, label, i + 100] = {"area": draw.choice([10.0, 50.0, 90.0]), "length": draw.choice([2, 4, 9]), "score": draw.choice([0.2, 0.4, 0.6, 0.8]), "exhaustive": (seq + label) % 3 > 0}
            for i in range(5):
                for j in range(5):
                    if draw.random() < 0.6:
                        pairs[seq, label, i, j + 100] = draw.choice([0.1, 0.3, 0.45, 0.6, 0.75])
    got = tmap.track_map(
        spark.createDataFrame([(*k, v) for k, v in pairs.items()], "seq int, label int, truth int, id int, iou double"),
        spark.createDataFrame([(*k, t["area"], t["length"], t["crowd"]) for k, t in truths.items()], "seq int, label int, id int, area double, length int, crowd boolean"),
        spark.createDataFrame([(*k, t["score"], t["area"], t["length"], t["exhaustive"]) for k, t in tracks.items()], "seq int, label int, id int, score double, area double, length int, exhaustive boolean"),
        "seq", ["label"], most, OVERLAPS, RECALLS, RANGES)
    got = {(r.label, r.overlap, r.range): (r.ap, r.ar) for r in got.collect()}
    wanted = plain_track_map(pairs, truths, tracks, most)
    assert got.keys() == wanted.keys()
    for k, (ap, ar) in wanted.items():
        assert got[k] == (pytest.approx(ap), pytest.approx(ar)), k


def test_a_free_truth_that_counts_goes_before_a_better_ignored_one(spark):
    truths = spark.createDataFrame([(1, 0, 1, 100.0, 5, True), (1, 0, 2, 100.0, 5, False)], "seq int, label int, id int, area double, length int, crowd boolean")
    tracks = spark.createDataFrame([(1, 0, 7, 0.9, 100.0, 5, True), (1, 0, 8, 0.8, 100.0, 5, True)], "seq int, label int, id int, score double, area double, length int, exhaustive boolean")
    pairs = spark.createDataFrame([(1, 0, 1, 7, 0.9), (1, 0, 2, 7, 0.6), (1, 0, 1, 8, 0.9)], "seq int, label int, truth int, id int, iou double")
    rows = tmap.choices(pairs, truths, tracks, ["seq", "label"], [0.5], {"all": RANGES["all"]}).collect()
    assert {r.id: (r.hit, r.ignored) for r in rows} == {7: (True, False), 8: (False, True)}


def test_decay(spark):
    draw = np.random.default_rng(0)
    for frames in (1, 3):
        corner = draw.integers(0, 12, (9, 1, 2)) + draw.integers(0, 3, (9, frames, 2))
        boxes = np.concatenate([corner, corner + draw.integers(4, 10, (9, frames, 2))], axis=2).astype(float)
        scores = draw.permutation(9) / 10 + 0.05
        left, weight = sorted(range(9), key=lambda i: -scores[i]), [1.0] * 9
        while left:
            top = left.pop(0)
            for i in list(left):
                total = 0.0
                for k in range(frames):
                    w, h = (max(0.0, min(boxes[top, k, 2 + s], boxes[i, k, 2 + s]) - max(boxes[top, k, s], boxes[i, k, s]) + 1) for s in (0, 1))
                    area = [(boxes[x, k, 2] - boxes[x, k, 0] + 1) * (boxes[x, k, 3] - boxes[x, k, 1] + 1) for x in (top, i)]
                    total += w * h / (sum(area) - w * h)
                if total > 0.3 * frames:
                    weight[i] = 1 - total
                    left.remove(i)
        assert tb.decayed(boxes, scores, 0.3) == pytest.approx(scores * weight)
    rows = [(1, i, [(0.0, 0.0, 9.0 + i, 9.0)], 0.9 - i / 10) for i in range(3)] + [(2, 5, [(0.0, 0.0, 1.0, 1.0)], 0.5)]
    table = spark.createDataFrame(rows, "frame int, id int, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>, score double")
    kept = {(r.frame, r.id): (r.rank, r.score) for r in tb.suppressed(table, ["frame"], 0.3, 2).collect()}
    assert kept[1, 0] == (1, 0.9) and kept[2, 5] == (1, 0.5)
    assert kept[1, 2][0] == 2 and kept[1, 2][1] == pytest.approx(0.7 * (1 - 100 / 120))


def tube(video, i, label, first, last, x, score=None):
    return [(video, i, label, f, (x, 0.0, x + 10.0, 10.0), *([score] if score is not None else [])) for f in range(first, last + 1)]


BOX = "struct<x1: double, y1: double, x2: double, y2: double>"


def test_each_kind_of_error(spark):
    truth = tube(1, 1, "a", 0, 10, 0.0) + tube(1, 2, "b", 0, 10, 100.0) + tube(1, 3, "a", 20, 30, 200.0)
    said = [("hit", tube(1, 11, "a", 0, 10, 0.0, 0.9)), ("repeat", tube(1, 12, "a", 0, 10, 1.0, 0.8)), ("class", tube(1, 13, "a", 0, 10, 100.0, 0.7)), ("location", tube(1, 14, "a", 20, 30, 206.0, 0.6)),
            ("time", tube(1, 15, "a", 20, 23, 200.0, 0.5)), ("time_location", tube(1, 16, "a", 20, 23, 206.0, 0.4)), ("class_location", tube(1, 17, "b", 20, 30, 206.0, 0.35)),
            ("class_time", tube(1, 18, "b", 20, 23, 200.0, 0.3)), ("class_time_location", tube(1, 19, "b", 20, 23, 206.0, 0.2)), ("extra", tube(1, 20, "a", 50, 60, 0.0, 0.1)), ("extra", tube(2, 21, "a", 0, 10, 0.0, 0.05))]
    t = spark.createDataFrame(truth, f"video_id int, tube_id int, label string, frame_idx int, box {BOX}")
    p = spark.createDataFrame([r for _, rows in said for r in rows], f"video_id int, tube_id int, label string, frame_idx int, box {BOX}, score double")
    verdicts = tb.tube_verdicts(p, t, 0.5)
    assert {r.pred: r.kind for r in verdicts.collect()} == {rows[0][1]: kind for kind, rows in said}
    areas = tb.error_areas(verdicts, tb.truth_counts(t)).collect()
    for label, n in (("a", 2), ("b", 1)):
        own = {r.kind: r for r in areas if r.label == label}
        assert set(own) == {"hit", "missed", *tb.KINDS}
        assert sum(r.area for r in own.values()) == pytest.approx(1)
        assert own["missed"].n == n - own["hit"].n
    ap = {r.label: r.ap for r in tb.video_ap(p, t, [0.5]).collect()}
    assert ap == {"a": pytest.approx(0.5), "b": 0.0}
    means = {r.band: r.mean_ap for r in tb.band_means(tb.video_ap(p, t, [0.1, 0.5]), {"both": [0.1, 0.5], "high": [0.5]}).collect()}
    assert means["high"] == pytest.approx(0.25) and means["both"] >= 0.25


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_and_envelopes_over_many_tasks(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice(["a", "b", None]), k, draw.randint(0, 5)) for k in range(400)] + [("c", 1000, 3)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        at = curves.running(spark.createDataFrame(rows, "g string, k int, x int"), ["g"], [F.desc("k")], {"s": F.col("x"), "n": F.lit(1)})
        got = {r.k: r for r in curves.envelope(at, ["g"], {"top": F.col("x")}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        for i, r in enumerate(own):
            assert (got[r[1]].s, got[r[1]].n, got[r[1]].top) == (sum(x[2] for x in own[: i + 1]), i + 1, max(x[2] for x in own[i:]))


def test_sides_are_made_once(spark):
    """Queries read the sides of a comparison from what was saved, not from line items again for each use."""
    from vidlake.plans.track_queries import sides

    for side in sides(spark, "/root/testdata/sf0.001"):
        assert side.count() and "lineitem" not in side._jdf.queryExecution().toString()

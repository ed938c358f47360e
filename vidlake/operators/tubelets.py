"""Action tubes: suppression by decay, average precision of frames and of videos, and what false tubes are.

Tubes are tables of boxes (video_id, label, tube_id, frame_idx, box); scores are of tubes or of single boxes. A prediction
counts by its most similar truth alone: it is right if that is similar enough and no surer prediction has it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators import events as ev
from vidlake.operators.curves import envelope, running
from vidlake.operators.evaluation import argmax_hits, envelope_ap
from vidlake.operators.ordered import per_key

#: What a false tube is, in the order in which it is asked.
KINDS = ("repeat", "class", "location", "time", "time_location", "class_location", "class_time", "class_time_location", "extra")
#: Bands of thresholds over which video precision is averaged. Fixed values.
BANDS = {"0.05:0.45": [round(0.05 * k, 2) for k in range(1, 10)], "0.10:0.90": [round(0.1 * k, 1) for k in range(1, 10)], "0.50:0.95": [round(0.5 + 0.05 * k, 2) for k in range(10)]}


def decayed(boxes: np.ndarray, scores: np.ndarray, least: float) -> np.ndarray:
    """Scores of tubelets (n x frames x 4) after suppression: the surest left takes away all that overlap it by more than ``least``
    on average, each of which keeps 1 less the sum of its overlaps of its score. Pixels are counted, so a side is one longer."""
    n, frames = boxes.shape[:2]
    weight = np.ones(n)
    if not n:
        return weight
    size = np.prod(boxes[:, :, 2:] - boxes[:, :, :2] + 1, axis=2)
    left = np.argsort(-scores, kind="stable")
    while len(left):
        top, rest = left[0], left[1:]
        side = np.maximum(0, np.minimum(boxes[top, :, 2:], boxes[rest, :, 2:]) - np.maximum(boxes[top, :, :2], boxes[rest, :, :2]) + 1)
        both = side[:, :, 0] * side[:, :, 1]
        overlap = (both / (size[rest] + size[top] - both)).sum(axis=1)
        near = overlap > least * frames
        weight[rest[near]] = 1 - overlap[near]
        left = rest[~near]
    return scores * weight


def suppressed(tubelets: DataFrame, keys: list[str], least: float = 0.3, top: int | None = None) -> DataFrame:
    """Tubelets (keys, id, boxes, score) with decayed scores and their rank by these in each key; the first ``top`` if it is given.

    boxes is an array of boxes, as many in each row of a key; a key is one frame (or run of frames) of a label.
    """
    kinds, n = dict(tubelets.dtypes), len(keys)
    rows = tubelets.select(*keys, "id", "boxes", "score").withColumn("_order", -F.col("score"))

    def step(held: list[tuple]) -> list[tuple]:
        boxes = np.array([[[b["x1"], b["y1"], b["x2"], b["y2"]] for b in row[n + 1]] for row in held], float)
        scores = decayed(boxes, np.array([row[n + 2] for row in held], float), least)
        order = np.argsort(-scores, kind="stable")[:top]
        return [(*held[i][: n + 2], float(scores[i]), rank) for rank, i in enumerate(order.tolist(), 1)]

    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"id {kinds['id']}", f"boxes {kinds['boxes']}", "score double, rank int"])
    return per_key(rows, keys, ["_order", "id"], step, fields)


def frame_pairs(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, pred, truth, iou) of boxes of one label in one frame."""
    keys = ["video_id", "frame_idx", "label"]
    met = detections.select(*keys, "pred", F.col("box").alias("_p")).join(truth.select(*keys, "truth", F.col("box").alias("_t")), keys)
    return met.select("label", "pred", "truth", g.iou(F.col("_p"), F.col("_t")).alias("iou"))


def frame_ap(detections: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(label, ap) over single boxes, 0 without a prediction. detections: video_id, frame_idx, label, pred, box, score; truth: video_id, frame_idx, label, truth, box."""
    hits = argmax_hits(frame_pairs(detections, truth), detections.select("label", "pred", "score"), ["label"], "pred", "truth", "iou", "score", least)
    n = truth.groupBy("label").agg(F.count("*").alias("n_truth"))
    ap = envelope_ap(hits.join(n, "label"), ["label"], [F.desc("score"), F.col("pred")], "hit", "n_truth")
    return n.select("label").join(ap, "label", "left").na.fill(0.0, ["ap"])


def tube_pairs(tubes: DataFrame, truth: DataFrame) -> DataFrame:
    """(video_id, pred, truth, truth_label, spatial, temporal, iou) of tubes that share a frame, whatever their labels."""
    both = ev.tube_iou(tubes.select("video_id", "tube_id", "frame_idx", "box"), truth.select("video_id", "tube_id", "frame_idx", "box"), ["video_id"])
    labels = truth.select("video_id", F.col("tube_id").alias("b"), F.col("label").alias("truth_label")).distinct()
    out = both.join(labels, ["video_id", "b"])
    temporal = F.when(F.col("spatial") > 0, F.col("iou") / F.col("spatial")).otherwise(0.0)
    return out.select("video_id", F.col("a").alias("pred"), F.col("b").alias("truth"), "truth_label", "spatial", temporal.alias("temporal"), "iou")


def tube_heads(tubes: DataFrame) -> DataFrame:
    """A row for each predicted tube: its video, label and score."""
    return tubes.groupBy("video_id", F.col("tube_id").alias("pred")).agg(F.first("label").alias("label"), F.first("score").alias("score"))


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.select("video_id", "label", "tube_id").distinct().groupBy("label").agg(F.count("*").alias("n_truth"))


def video_ap(tubes: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(label, threshold, ap) of whole tubes; the pairs are made once for all thresholds."""
    heads, n = tube_heads(tubes), truth_counts(truth)
    pairs = tube_pairs(tubes, truth).join(heads, ["video_id", "pred"]).filter(F.col("label") == F.col("truth_label"))
    # the most similar truth is the same at every threshold
    near = pairs.groupBy("video_id", "pred", "label").agg(F.max_by(F.struct("truth", "iou"), F.struct("iou", -F.col("truth"))).alias("_b"))
    at = heads.join(near, ["video_id", "pred", "label"], "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    reached = at.filter(F.col("_b.iou") >= F.col("threshold"))
    first = reached.groupBy("video_id", "label", "threshold", F.col("_b.truth").alias("_t")).agg(F.min(F.struct((-F.col("score")).alias("_s"), "pred")).alias("_f"))
    hits = at.select("video_id", "pred", "label", "threshold", "score").join(first.select("video_id", "label", "threshold", F.col("_f.pred").alias("pred"), F.lit(True).alias("hit")), ["video_id", "label", "threshold", "pred"], "left")
    ranked = hits.select("label", "threshold", "score", F.struct("video_id", "pred").alias("pred"), F.coalesce("hit", F.lit(False)).alias("hit"))
    ap = envelope_ap(ranked.join(n, "label"), ["label", "threshold"], [F.desc("score"), F.col("pred")], "hit", "n_truth")
    every = n.select("label", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return every.join(ap, ["label", "threshold"], "left").na.fill(0.0, ["ap"])


def band_means(aps: DataFrame, bands: dict[str, list[float]] | None = None) -> DataFrame:
    """(band, mean_ap): labels' mean at each threshold, then the band's mean."""
    cells = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(t).alias("threshold")) for b, ts in (bands or BANDS).items() for t in ts)))
    by = aps.groupBy("threshold").agg(F.avg("ap").alias("ap"))
    return by.sparkSession.range(1).select(cells.alias("c")).select("c.*").join(by, "threshold").groupBy("band").agg(F.avg("ap").alias("mean_ap"))


def tube_verdicts(tubes: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(video_id, pred, label, score, kind) of each predicted tube: hit, or the first of KINDS that holds.

    repeat: its own label's most similar truth is similar enough, but taken. class: another label's is. Else the most
    similar of all tells: whether the extent or the boxes reach the root of the threshold, and whose label it is. extra:
    none shares a frame with it.
    """
    heads = tube_heads(tubes)
    pairs = tube_pairs(tubes, truth).join(heads, ["video_id", "pred"]).withColumn("same", F.col("label") == F.col("truth_label"))
    top = lambda c, on: F.max_by(F.struct(*c), F.when(on, F.struct("iou", -F.col("truth"))))
    near = pairs.groupBy("video_id", "pred").agg(top(["truth", "iou"], F.col("same")).alias("_own"), F.max(F.when(~F.col("same"), F.col("iou"))).alias("_other"), top(["iou", "temporal", "spatial", "same"], F.lit(True)).alias("_any"))
    at = heads.join(near, ["video_id", "pred"], "left")
    first = at.filter(F.col("_own.iou") >= threshold).groupBy("video_id", "label", F.col("_own.truth").alias("_t")).agg(F.min(F.struct((-F.col("score")).alias("_s"), "pred")).alias("_f"))
    at = at.join(first.select("video_id", F.col("_f.pred").alias("pred"), F.lit(True).alias("_hit")), ["video_id", "pred"], "left")
    root = math.sqrt(threshold)
    long, close, same = F.col("_any.temporal") >= root, F.col("_any.spatial") >= root, F.col("_any.same")
    where = F.when(same & long, "location").when(same & close, "time").when(same, "time_location").when(long, "class_location").when(close, "class_time").otherwise("class_time_location")
    kind = F.when(F.col("_hit"), "hit").when(F.col("_own.iou") >= threshold, "repeat").when(F.col("_other") >= threshold, "class").when(F.col("_any.iou") > 0, where).otherwise("extra")
    return at.select("video_id", "pred", "label", "score", kind.alias("kind"))


def error_areas(verdicts: DataFrame, n_truth: DataFrame) -> DataFrame:
    """(label, kind, n, area, enveloped) for hits, each kind of error, and missed truth.

    area is the share of the kind among predictions so far, over recall: all areas of a label, with that of missed truth,
    sum up to 1. enveloped takes the largest share from each point on instead, as average precision does of hits.
    """
    kinds = ("hit", *KINDS)
    order, named = [F.desc("score"), F.col("video_id"), F.col("pred")], {f"_k_{k}": F.col("kind") == k for k in kinds}
    at = running(verdicts.join(n_truth, "label"), ["label"], order, {"_n": F.lit(1), **{c: on.cast("long") for c, on in named.items()}})
    share = {k: F.col(f"_k_{k}") / F.col("_n") for k in kinds}
    at = envelope(at, ["label"], {f"_e_{k}": x for k, x in share.items()})
    right = F.col("kind") == "hit"
    cell = lambda k: F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("n"), F.sum(F.when(right, share[k] / F.col("n_truth")).otherwise(0.0)).alias("area"), F.sum(F.when(right, F.col(f"_e_{k}") / F.col("n_truth")).otherwise(0.0)).alias("enveloped"))
    by = at.groupBy("label", "n_truth").agg(F.array(*map(cell, kinds)).alias("_c"), F.count_if(right).alias("_hits"))
    every = n_truth.join(by.drop("n_truth"), "label", "left").withColumn("_missed", F.col("n_truth") - F.coalesce("_hits", F.lit(0)))
    missed = every.select("label", F.lit("missed").alias("kind"), F.col("_missed").alias("n"), (F.col("_missed") / F.col("n_truth")).alias("area"), (F.col("_missed") / F.col("n_truth")).alias("enveloped"))
    none = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("area"), F.lit(0.0).alias("enveloped")) for k in kinds))
    return every.select("label", F.explode(F.coalesce("_c", none)).alias("c")).select("label", "c.*").unionByName(missed)


#: Groups of labels by number: movements of a person, dealings with objects, and with other persons. Fixed values.
ACTION_GROUPS = {"overall": (1, 10**9), "person_movement": (1, 14), "object_manipulation": (15, 63), "person_interaction": (64, 10**9)}


def action_group_means(aps: DataFrame, groups: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(group, n_labels, mean_ap): mean over the labels of each group that have a value (label, ap)."""
    own = F.filter(F.array(*(F.when(F.col("label").between(lo, hi), F.lit(name)) for name, (lo, hi) in (groups or ACTION_GROUPS).items())), lambda x: x.isNotNull())
    return aps.withColumn("group", F.explode(own)).groupBy("group").agg(F.count("ap").alias("n_labels"), F.avg("ap").alias("mean_ap"))

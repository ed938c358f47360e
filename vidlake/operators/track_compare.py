"""Two results of one video held against each other: are they the same but for ids, and how much of the way is covered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidlake.operators.assignment import min_cost
from vidlake.operators.ordered import per_key
from vidlake.operators.tracking_metrics import EPS, best_pairs
from vidlake.storage import saved


def same_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(seq, t, a, b, delta): boxes of each frame paired so that the largest differences of their coordinates sum up to the least. Both tables: seq, t, id, box."""
    side = lambda rows, name: rows.groupBy("seq", "t").agg(F.array_sort(F.collect_list(F.struct("id", "box"))).alias(name))
    both = side(left, "l").join(side(right, "r"), ["seq", "t"])

    def step(held: list[tuple]) -> list[tuple]:
        seq, t, a, b = held[0]
        x, y = (np.array([[r["box"][c] for c in ("x1", "y1", "x2", "y2")] for r in rows]) for rows in (a, b))
        away = np.abs(x[:, None] - y[None]).max(axis=2)
        return [(seq, t, a[i]["id"], b[j]["id"], float(away[i, j])) for i, j in zip(*min_cost(away), strict=True)]

    kinds = dict(left.dtypes)
    return per_key(both, ["seq", "t"], [], step, f"seq {kinds['seq']}, t {kinds['t']}, a {kinds['id']}, b {kinds['id']}, delta double")


def id_mapping(pairs: DataFrame) -> DataFrame:
    """(seq, a, b, first, n, kept) of all pairs of ids: one bijection for each sequence. The first pair met keeps both of its ids; a later one with either is a conflict, in every frame."""
    met = pairs.groupBy("seq", "a", "b").agg(F.min("t").alias("first"), F.count("*").alias("n"))
    kinds = dict(met.dtypes)

    def step(held: list[tuple]) -> list[tuple]:
        to: dict = {}
        back: dict = {}
        out = []
        for seq, a, b, first, n in held:
            kept = to.get(a, b) == b and back.get(b, a) == a
            if kept:
                to[a], back[b] = b, a
            out.append((seq, a, b, first, n, kept))
        return out

    return per_key(met, ["seq"], ["first", "a", "b"], step, f"seq {kinds['seq']}, a {kinds['a']}, b {kinds['b']}, first {kinds['first']}, n bigint, kept boolean")


def parity(left: DataFrame, right: DataFrame, most: float = 0.01) -> DataFrame:
    """A row for each sequence: boxes compared, frames whose counts differ, boxes that are off by more than ``most``, boxes whose ids
    contradict the bijection, the largest difference, and whether all is equal but for names of ids."""
    n = lambda rows, name: rows.groupBy("seq", "t").agg(F.count("*").alias(name))
    frames = n(left, "l").join(n(right, "r"), ["seq", "t"], "full").na.fill(0, ["l", "r"])
    by = frames.groupBy("seq").agg(F.count_if(F.col("l") != F.col("r")).alias("count_mismatch_frames"))
    pairs = saved(same_boxes(left, right))
    shape = pairs.groupBy("seq").agg(F.count("*").alias("compared"), F.count_if(F.col("delta") > most).alias("moved"), F.max("delta").alias("largest"))
    ids = id_mapping(pairs.filter(F.col("delta") <= most)).groupBy("seq").agg(F.sum(F.when(F.col("kept"), 0).otherwise(F.col("n"))).alias("id_conflicts"), F.count_if("kept").alias("ids"))
    out = by.join(shape, "seq", "left").join(ids, "seq", "left").na.fill(0, ["compared", "moved", "id_conflicts", "ids"]).na.fill(0.0, ["largest"])
    return out.withColumn("equal", (F.col("count_mismatch_frames") == 0) & (F.col("moved") == 0) & (F.col("id_conflicts") == 0))


def _way(rows: DataFrame, by: list[str]) -> DataFrame:
    """Length of the way of box centres from one row to the next of each key."""
    w = Window.partitionBy(*by).orderBy("t")
    x, y = (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2
    steps = rows.withColumns({"_x": x, "_y": y}).withColumns({"_dx": F.col("_x") - F.lag("_x").over(w), "_dy": F.col("_y") - F.lag("_y").over(w)})
    return steps.groupBy(*by).agg(F.coalesce(F.sum(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)), F.lit(0.0)).alias("way"))


def covered_ways(truth: DataFrame, similarities: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((seq, gt_id, way), (seq, gt_id, tr_id, way)): the way of each truth, and of the part of it where a track is on it, frames between left out."""
    t = truth.select("seq", "t", F.col("id").alias("gt_id"), "box")
    on = similarities.filter(F.col("sim") >= least - EPS).filter("gt_id is not null and tr_id is not null").select("seq", "t", "gt_id", "tr_id")
    return _way(t, ["seq", "gt_id"]), _way(t.join(on, ["seq", "t", "gt_id"]), ["seq", "gt_id", "tr_id"])


def way_coverage(truth: DataFrame, similarities: DataFrame, least: float = 0.5) -> DataFrame:
    """(seq, covered, way, share): whole tracks are paired with truths so that the ways covered sum up to the most; share of all ways, 0 without any."""
    ways, parts = covered_ways(truth, similarities, least)
    best = best_pairs(parts.filter("way > 0").select("seq", "gt_id", "tr_id", "way"), ["seq"], "way").groupBy("seq").agg(F.sum("way").alias("covered"))
    out = ways.groupBy("seq").agg(F.sum("way").alias("way")).join(best, "seq", "left").na.fill(0.0, ["covered"])
    return out.select("seq", "covered", "way", F.when(F.col("way") > 0, F.col("covered") / F.col("way")).otherwise(0.0).alias("share"))


def mean_share(shares: DataFrame, sequences: DataFrame) -> DataFrame:
    """Mean over all sequences, those without truth counting 0."""
    return sequences.select("seq").distinct().join(shares, "seq", "left").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("share"))

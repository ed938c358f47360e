"""Tracks of masks: which masks of a frame stay, and how well regions and boundaries of whole tracks are met."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.functions import masks as m
from vidlake.operators.assignment import max_score
from vidlake.operators.ordered import per_key
from vidlake.storage import saved


def apart(rows: DataFrame, keys: list[str], most: float | None = None) -> DataFrame:
    """Masks (keys, id, mask, score) of each frame by score: without ``most`` each loses what better ones cover; with it, one that
    overlaps a kept better one by more is dropped. A mask of which nothing is left stays, empty."""
    kinds, n = dict(rows.dtypes), len(keys)
    ordered = rows.select(*keys, "id", "mask", "score").withColumn("_order", -F.col("score"))

    def step(held: list[tuple]) -> list[tuple]:
        out, kept = [], []
        over = np.zeros((0, 2), np.int64)
        for row in held:
            shape, own = row[n + 1], m.spans(np.array(row[n + 1]["runs"], np.int64))
            if most is None:
                left = m.without(own, over)
                over = m.joined(over, own)
                runs = m.runs_of(left, shape["height"] * shape["width"])
                out.append((*row[: n + 1], {**shape, "runs": runs.tolist()}, row[n + 2]))
                continue
            size = (own[:, 1] - own[:, 0]).sum()
            if all((both := m.common(own, other)) <= most * (size + other_size - both) for other, other_size in kept):
                kept.append((own, size))
                out.append((*row[: n + 1], shape, row[n + 2]))
        return out

    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"id {kinds['id']}, mask {kinds['mask']}, score {kinds['score']}"])
    return per_key(ordered, keys, ["_order", "id"], step, fields)


def met(truth: DataFrame, tracks: DataFrame, share: float = 0.008) -> DataFrame:
    """(seq, t, gt_id, tr_id, j, f) of all pairs of masks in a frame. Both tables: seq, t, id, mask; the masks of a frame are of one size."""
    side = lambda rows, k: rows.select("seq", "t", F.lit(k).alias("_side"), F.col("id").cast("bigint").alias("id"), "mask")
    rows = side(truth, 0).unionByName(side(tracks, 1)).filter("seq is not null and t is not null")

    def step(held: list[tuple]) -> list[tuple]:
        a, b = ([row for row in held if row[2] == k] for k in (0, 1))
        if not a or not b:
            return []
        runs = [[np.array(row[4]["runs"], np.int64) for row in rows_] for rows_ in (a, b)]
        j, f = m.all_pairs(*runs, a[0][4]["height"], a[0][4]["width"], share)
        return [(*x[:2], x[3], y[3], *v) for x, *values in zip(a, j.tolist(), f.tolist(), strict=True) for y, *v in zip(b, *values, strict=True)]

    kinds = dict(truth.dtypes)
    return per_key(rows, ["seq", "t"], ["_side", "id"], step, f"seq {kinds['seq']}, t {kinds['t']}, gt_id bigint, tr_id bigint, j double, f double")


def _absent(rows: DataFrame) -> DataFrame:
    """(seq, id, n) frames of each track."""
    return rows.groupBy("seq", "id").agg(F.count("*").alias("n"))


def paired(pairs: DataFrame, truth: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """(seq, gt_id, tr_id) of the pairing with the largest summed mean of J and F; tr_id is null for a truth that is held against an empty track.

    Where neither of two tracks has a mask, both values are 1, where one has none, 0. A sequence with fewer tracks than
    truths is filled up with empty ones. frames: seq, frames.
    """
    sums = pairs.groupBy("seq", "gt_id", "tr_id").agg(F.count("*").alias("both"), (F.sum(F.col("j") + F.col("f")) / 2).alias("value"))
    cells = sums.select("seq", F.lit(2).alias("what"), "gt_id", "tr_id", "both", "value")
    gt = _absent(truth).select("seq", F.lit(0).alias("what"), F.col("id").alias("gt_id"), F.lit(None).cast("bigint").alias("tr_id"), F.col("n").alias("both"), F.lit(0.0).alias("value"))
    tr = _absent(tracks).select("seq", F.lit(1).alias("what"), F.lit(None).cast("bigint").alias("gt_id"), F.col("id").alias("tr_id"), F.col("n").alias("both"), F.lit(0.0).alias("value"))
    rows = gt.unionByName(tr).unionByName(cells).join(frames, "seq")

    def step(held: list[tuple]) -> list[tuple]:
        seq, total = held[0][0], held[0][-1]
        gts, trs = ({row[2 + k]: row[4] for row in held if row[1] == k} for k in (0, 1))
        if not gts:
            return []
        i, j = ({x: at for at, x in enumerate(ids)} for ids in (gts, trs))
        n_tr = np.array([*trs.values(), *[0] * max(0, len(gts) - len(trs))], float)
        score = total - np.array(list(gts.values()), float)[:, None] - n_tr[None]
        for row in held:
            if row[1] == 2:
                score[i[row[2]], j[row[3]]] += row[4] + row[5]
        names = [*trs, *[None] * (len(n_tr) - len(trs))]
        keys = list(gts)
        return [(seq, keys[a], names[b]) for a, b in zip(*max_score(score / total), strict=True)]

    return per_key(rows, ["seq"], ["what", "gt_id", "tr_id"], step, f"seq {dict(truth.dtypes)['seq']}, gt_id bigint, tr_id bigint")


def j_and_f(truth: DataFrame, tracks: DataFrame, frames: DataFrame, share: float = 0.008, bins: int = 4) -> DataFrame:
    """(seq, gt_id, tr_id, j_mean, j_recall, j_decay, f_mean, f_recall, f_decay) of each truth: means over all frames, share of frames
    over a half, and how much the first quarter is better than the last. frames: seq, frames, numbered from 1; share of the diagonal by which a boundary may be off."""
    truth, tracks = saved(truth), saved(tracks)
    pairs = saved(met(truth, tracks, share))
    chosen = saved(paired(pairs, truth, tracks, frames)).join(frames, "seq")
    has = lambda side, id_: side.select("seq", "t", F.col("id").alias(id_), F.lit(True).alias(f"_{id_}"))
    at = chosen.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("frames").cast("int"))))
    at = at.withColumn("t", F.col("t").cast(dict(truth.dtypes)["t"]))
    at = at.join(has(truth, "gt_id"), ["seq", "t", "gt_id"], "left").join(has(tracks, "tr_id"), ["seq", "t", "tr_id"], "left").join(pairs, ["seq", "t", "gt_id", "tr_id"], "left")
    none = F.when(F.col("_gt_id").isNull() & F.col("_tr_id").isNull(), 1.0).otherwise(0.0)
    at = at.withColumns({"j": F.coalesce("j", none), "f": F.coalesce("f", none)})
    # bins share their bounds; a bound lies at the nearest frame to its part of the way
    bound = lambda k: F.floor((F.col("frames") - 1) * k / bins + 0.5 + 1e-10) + 1
    first, last = F.col("t") <= bound(1), F.col("t") >= bound(bins - 1)
    out = []
    for c in ("j", "f"):
        v = F.col(c)
        out += [F.avg(v).alias(f"{c}_mean"), F.avg((v > 0.5).cast("double")).alias(f"{c}_recall"), (F.avg(F.when(first, v)) - F.avg(F.when(last, v))).alias(f"{c}_decay")]
    return at.groupBy("seq", "gt_id", "tr_id").agg(*out)


def sequence_means(result: DataFrame, by: list[str]) -> DataFrame:
    """Means over the truths of each scope, and the mean of both means."""
    names = [f"{c}_{k}" for c in ("j", "f") for k in ("mean", "recall", "decay")]
    out = result.groupBy(*by).agg(F.count("*").alias("n_truth"), *(F.avg(c).alias(c) for c in names))
    return out.withColumn("j_and_f", (F.col("j_mean") + F.col("f_mean")) / 2)

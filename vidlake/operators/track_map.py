"""Average precision and recall of whole tracks, for ranges of their area and length.

Tracks are compared by summed intersection over summed union of their boxes or masks. In each sequence and class the
surest tracks choose first, at each overlap and range: the most similar truth that counts and is free, and only if there
is none, one that is ignored (outside the range, or a crowd). A track that takes an ignored truth is ignored itself; so
is one without truth that is outside the range, or whose class is not labelled exhaustively in its sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators.detection import track_precision
from vidlake.operators.ordered import per_key

#: Overlaps, recalls, and ranges of mean area and of frames; bounds belong to the ranges on both sides. Fixed values.
OVERLAPS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
RECALLS = [k / 100 for k in range(101)]
RANGES = {
    "all": (0.0, float("inf"), 0.0, float("inf")),
    "area_s": (0.0, 32.0**2, 0.0, float("inf")), "area_m": (32.0**2, 96.0**2, 0.0, float("inf")), "area_l": (96.0**2, 1e10, 0.0, float("inf")),
    "time_s": (0.0, float("inf"), 0.0, 3.0), "time_m": (0.0, float("inf"), 3.0, 10.0), "time_l": (0.0, float("inf"), 10.0, 1e5),
}


def track_facts(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Frames and mean area of each track (keys, id, t, box)."""
    return boxes.groupBy(*keys, "id").agg(F.count("*").alias("length"), F.avg(g.area(F.col("box"))).alias("area"))


def best_tracks(tracks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The surest tracks of each sequence; all if ``most`` is 0. tracks: keys, id, score."""
    if not most:
        return tracks
    surest = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return tracks.withColumn("_n", F.row_number().over(surest)).filter(F.col("_n") <= most).drop("_n")


def choices(pairs: DataFrame, truths: DataFrame, tracks: DataFrame, keys: list[str], overlaps: list[float], ranges: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """(keys, id, score, overlap, range, hit, ignored) of each track at each overlap and range.

    pairs: keys, truth, id, iou; truths: keys, id, area, length, crowd; tracks: keys, id, score, area, length, exhaustive.
    """
    t = truths.select(*keys, F.col("id").alias("truth"), F.struct("area", "length", "crowd").alias("_t"))
    near = pairs.filter(F.col("iou") >= min(overlaps) - 1e-12).join(t, [*keys, "truth"])
    near = near.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("truth", "iou", "_t.area", "_t.length", "_t.crowd"))).alias("near"))
    rows = tracks.select(*keys, "id", "score", "area", "length", "exhaustive").join(near, [*keys, "id"], "left").withColumn("_order", -F.col("score"))
    kinds, n = dict(rows.dtypes), len(keys)
    inside = lambda r, area, length: r[0] <= area <= r[1] and r[2] <= length <= r[3]

    def step(held: list[tuple]) -> list[tuple]:
        out = []
        for overlap in overlaps:
            for name, r in ranges.items():
                taken: set = set()
                for row in held:
                    track, score, area, length, exhaustive, close = row[n : n + 6]
                    # free truths that are similar enough: those that count before those that are ignored, then the most similar
                    free = [(not (c["crowd"] or not inside(r, c["area"], c["length"])), c["iou"], c["truth"]) for c in close or () if c["truth"] not in taken and c["iou"] >= min(overlap, 1 - 1e-10) - 1e-12]
                    if free:
                        counts, _, truth = max(free)
                        taken.add(truth)
                        out.append((*row[:n], track, score, overlap, name, counts, not counts))
                    else:
                        out.append((*row[:n], track, score, overlap, name, False, not exhaustive or not inside(r, area, length)))
        return out

    fields = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"id {kinds['id']}", f"score {kinds['score']}", "overlap double, range string, hit boolean, ignored boolean"])
    return per_key(rows, keys, ["_order", "id"], step, fields)


def counted_truths(truths: DataFrame, by: list[str], ranges: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """(by, range, n_truth): truths that are not ignored."""
    def inside(r: tuple[float, float, float, float]) -> Column:
        return F.col("area").between(r[0], r[1]) & F.col("length").between(r[2], r[3]) & ~F.col("crowd")

    names = F.explode(F.filter(F.array(*(F.when(inside(r), F.lit(name)) for name, r in ranges.items())), lambda x: x.isNotNull()))
    return truths.select(*by, names.alias("range")).groupBy(*by, "range").agg(F.count("*").alias("n_truth"))


def track_map(pairs: DataFrame, truths: DataFrame, tracks: DataFrame, sequence: str, by: list[str], most: int = 0, overlaps: list[float] | None = None, recalls: list[float] | None = None, ranges: dict | None = None) -> DataFrame:
    """(by, overlap, range, n_truth, ap, ar); without a row where no truth counts. ``most`` tracks of a sequence are taken, all if it is 0."""
    overlaps, recalls, ranges = overlaps or OVERLAPS, recalls or RECALLS, ranges or RANGES
    keys = [sequence, *by]
    made = choices(pairs, truths, best_tracks(tracks, keys, most), keys, overlaps, ranges)
    n = counted_truths(truths, by, ranges)
    # a track's id is one of its sequence's
    rows = made.filter(~F.col("ignored")).join(n, [*by, "range"]).select(*by, "overlap", "range", "n_truth", "score", F.struct(sequence, "id").alias("pred"), "hit")
    group = [*by, "overlap", "range"]
    ap = track_precision(rows, group, "n_truth", recalls)
    ar = rows.groupBy(*group).agg((F.count_if("hit") / F.first("n_truth")).alias("ar"))
    every = n.withColumn("overlap", F.explode(F.array(*map(F.lit, overlaps))))
    return every.join(ap, group, "left").join(ar, group, "left").na.fill(0.0, ["ap", "ar"])


def class_mean(result: DataFrame, by: list[str]) -> DataFrame:
    """Mean over classes of each overlap and range; classes without truth are left out."""
    return result.groupBy("overlap", "range").agg(*(F.avg(c).alias(c) for c in ("ap", "ar")), F.count("*").alias("n_classes"))

"""Action points to event intervals, links between actions and people, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v


def ranked_actions(records: DataFrame, candidates: str = "action_candidates", selected: str = "selected_actions") -> DataFrame:
    """One row for each record and label: the best score in either array."""
    keys = [c for c in records.columns if c not in (candidates, selected)]
    both = records.select(*keys, F.explode(F.concat(F.coalesce(candidates, F.array()), F.coalesce(selected, F.array()))).alias("_a"))
    return both.groupBy(*keys, F.col("_a.label").alias("event")).agg(F.max("_a.score").alias("score"))


def best_points(points: DataFrame, threshold: float) -> DataFrame:
    """Points at the threshold or over, one for each identity, event and frame: the best score, the earliest row on ties."""
    first = Window.partitionBy("identity", "event", "frame_idx").orderBy(F.desc("score"), "row_seq")
    return points.filter(F.col("score") >= threshold).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def islands(points: DataFrame, keys: list[str], order: str, gap: Column) -> DataFrame:
    """Adds run: a new one wherever the order column moves by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    return points.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


REDUCERS = {"mean": F.avg, "median": F.median, "max": F.max}


def event_intervals(points: DataFrame, fps: float, cadence: int, frame_count: int, threshold: float = 0.2, missing: int = 1, min_support: int = 1, min_duration: float = 0.0, reducer: str = "mean") -> DataFrame:
    """Intervals of runs of points: half a cadence before the first frame to the other half after the last, within the video."""
    left = cadence // 2
    right = cadence - left - 1
    runs = islands(best_points(points, threshold), ["identity", "event"], "frame_idx", F.lit(cadence * (missing + 1)))
    out = runs.groupBy("identity", "event", "run").agg(
        F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"), F.count("*").alias("support_count"), REDUCERS[reducer]("score").alias("raw_score"),
        F.array_sort(F.collect_set("raw_track_id")).alias("raw_track_ids"))
    out = out.withColumns({"start_frame": F.greatest(F.lit(0), F.col("_first") - left), "end_frame": F.least(F.col("_last") + right, F.lit(frame_count - 1))})
    out = out.withColumns({"start": F.col("start_frame") / fps, "end": (F.col("end_frame") + 1) / fps})
    return out.filter((F.col("support_count") >= min_support) & (F.col("end") - F.col("start") >= min_duration)).drop("_first", "_last", "run")


def numbered_events(events: DataFrame, video: Column) -> DataFrame:
    """Ids by start, end, identity and label, from E00001 in each video."""
    place = F.row_number().over(Window.partitionBy(video).orderBy("start_frame", "end_frame", "identity", "event"))
    return events.withColumn("event_id", F.concat(video.cast("string"), F.lit(":E"), F.format_string("%05d", place)))


def cadence(points: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest common divisor of the steps between distinct frames."""
    frames = points.select(*keys, "frame_idx").distinct()
    step = frames.withColumn("_d", F.col("frame_idx") - F.lag("frame_idx").over(Window.partitionBy(*keys).orderBy("frame_idx")))
    return step.groupBy(*keys).agg(F.collect_set("_d").alias("_all")).select(*keys, F.when(F.size("_all") > 0, v.gcd(F.col("_all"))).alias("cadence"))


def frame_rate(points: DataFrame, keys: list[str], frame: str, time: str) -> DataFrame:
    """Median of frames over seconds between neighbours."""
    w = Window.partitionBy(*keys).orderBy(frame, time)
    rate = F.try_divide((F.col(frame) - F.lag(frame).over(w)).cast("double"), (F.col(time) - F.lag(time).over(w)).cast("double"))
    return points.withColumn("_r", rate).groupBy(*keys).agg(F.median("_r").alias("fps"))


def link_people(actions: DataFrame, identity_map: DataFrame, allow_unmapped: bool) -> DataFrame:
    """Actions with their person; those without one stay only if allowed."""
    return actions.join(identity_map, "raw_track_id", "left" if allow_unmapped else "inner")


def unmapped(actions: DataFrame, identity_map: DataFrame) -> DataFrame:
    return actions.join(identity_map, "raw_track_id", "left_anti")


def keep_accepted(actions: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Actions whose observation was kept."""
    return actions.join(observations.filter("kept").select(*keys).distinct(), keys, "left_semi")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float, carried: list[str]) -> DataFrame:
    """For each left row, the right row of the same keys nearest in ``at`` (the earlier on ties, then the first by the carried columns); nulls beyond the tolerance.

    Both sides go through a sort each way: each row sees the last right row at or before it and the first after it.
    """
    own = [c for c in left.columns]
    r = right.groupBy(*keys, at).agg(F.min(F.struct(*carried)).alias("_s")).select(*keys, at, F.struct(F.col(at).alias("at"), *(F.col("_s")[c].alias(c) for c in carried)).alias("_right"), F.lit(0).alias("_side"))
    l_ = left.select(*keys, F.col(at), F.struct(*own).alias("_left"), F.lit(1).alias("_side"))
    both = r.unionByName(l_, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side")
    back = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumns({"_b": back, "_a": ahead}).filter("_side = 1")
    gap_b, gap_a = F.abs(F.col(at) - F.col("_b.at")), F.abs(F.col("_a.at") - F.col(at))
    best = F.when(gap_b.isNull() | (gap_a < gap_b), F.col("_a")).otherwise(F.col("_b"))
    out = seen.withColumn("_m", best).withColumn("_m", F.when(F.abs(F.col("_m.at") - F.col(at)) <= tolerance, F.col("_m")))
    return out.select("_left.*", F.col("_m.at").alias(f"matched_{at}"), *(F.col(f"_m.{c}").alias(f"matched_{c}") for c in carried))


def gated_nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float, score: str, least: float) -> DataFrame:
    """As nearest; a match under the score gate is no match, even if a farther one would pass."""
    out = nearest(left, right, keys, at, tolerance, [score])
    ok = F.col(f"matched_{score}") >= least
    return out.withColumns({f"matched_{at}": F.when(ok, F.col(f"matched_{at}")), f"matched_{score}": F.when(ok, F.col(f"matched_{score}"))})


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float, least: float) -> DataFrame:
    """Pairs of intervals (a.start, a.end), (b.start, b.end) of equal keys whose temporal IoU is ``least`` or more.

    Time is cut into cells of ``width``; intervals meet in the cell where the later of the two starts.
    """
    cells = lambda s, e: F.sequence(F.floor(s / width), F.floor(e / width))
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys)).withColumn("_cell", F.explode(cells(F.col("a_start"), F.col("a_end"))))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys)).withColumn("_cell", F.explode(cells(F.col("b_start"), F.col("b_end"))))
    met = left.join(right, [*keys, "_cell"]).filter("a_start < b_end and b_start < a_end")
    met = met.filter(F.col("_cell") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_cell")
    return met.withColumn("tiou", g.tiou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).filter(F.col("tiou") >= least)


#: Points of one time that meet a range as one row.
TOGETHER = 128


def near_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], tolerance: float, most: float) -> DataFrame:
    """Points (at) within ``tolerance`` of ranges [lo, hi] that are no wider than ``most``.

    Time is cut into cells. Points of one time have the same ranges: they meet them as one row, ``TOGETHER`` at most, and are
    parted after it. So a range's rows come in runs and its points in an order that recurs, and the pairs, quadratic in number,
    are written in a fraction of a byte each. Cells are dealt out by hand, as tasks merged by what they read would make too many pairs.
    """
    width, tasks = most + 2 * tolerance, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, rest = [c for c in points.columns if c not in keys], [c for c in ranges.columns if c not in keys]
    p = points.withColumn("_cell", F.floor(F.col("at") / width)).repartition(tasks, *keys, "_cell")
    nth = F.row_number().over(Window.partitionBy(*keys, "_cell", "at").orderBy("at"))
    p = p.withColumn("_part", F.floor((nth - 1) / TOGETHER)).groupBy(*keys, "_cell", "at", "_part").agg(F.collect_list(F.struct(*own)).alias("_points"))
    r = ranges.filter(F.col("hi") - F.col("lo") <= most).withColumn("_cell", F.explode(F.sequence(F.floor((F.col("lo") - tolerance) / width), F.floor((F.col("hi") + tolerance) / width))))
    met = p.join(r.hint("merge"), [*keys, "_cell"]).filter((F.col("at") >= F.col("lo") - tolerance) & (F.col("at") <= F.col("hi") + tolerance))
    return met.select(*keys, *rest, F.explode("_points").alias("_point")).select(*keys, *(F.col("_point")[c].alias(c) for c in own), *rest)


def unanimous_owner(events: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner of each event: that of all its tracks, if all have one and the same; else null."""
    rows = events.select("event_id", F.explode_outer("track_ids").alias("track_id")).join(owners, "track_id", "left")
    agg = rows.groupBy("event_id").agg(F.min("owner").alias("_low"), F.max("owner").alias("_high"), F.count_if(F.col("owner").isNull()).alias("_none"))
    return agg.select("event_id", F.when((F.col("_none") == 0) & (F.col("_low") == F.col("_high")), F.col("_low")).alias("owner"))


def tube_evidence(tubes: DataFrame, boxes: DataFrame, least: float = 0.5, coverage: float = 0.8, mean: float = 0.5) -> DataFrame:
    """For each event, the track that best follows its actor's tube, and whether it passes; a frame without a box counts 0.

    tubes: video_id, event_id, frame_idx, box, track_ids; boxes: video_id, frame_idx, track_id, box.
    """
    t = tubes.select("video_id", "event_id", "frame_idx", F.col("box").alias("_tube"), F.explode("track_ids").alias("track_id"))
    met = t.join(boxes, ["video_id", "frame_idx", "track_id"], "left").withColumn("_iou", F.coalesce(g.iou(F.col("_tube"), F.col("box")), F.lit(0.0)))
    by = met.groupBy("video_id", "event_id", "track_id").agg(F.avg((F.col("_iou") >= least).cast("double")).alias("coverage"), F.avg("_iou").alias("mean_iou"))
    by = by.withColumn("passes", (F.col("coverage") >= coverage) & (F.col("mean_iou") >= mean))
    return by.groupBy("video_id", "event_id").agg(F.max_by(F.struct("track_id", "coverage", "mean_iou", "passes"), F.struct("passes", "coverage", "mean_iou", -F.col("track_id"))).alias("_b")).select("video_id", "event_id", "_b.*")


def tube_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """IoU of tubes (keys, tube_id, frame_idx, box): mean over common frames times the temporal IoU of their extents."""
    ext = lambda t, n: t.groupBy(*keys, F.col("tube_id").alias(n)).agg(F.min("frame_idx").alias(f"{n}_s"), F.max("frame_idx").alias(f"{n}_e"))
    met = a.select(*keys, "frame_idx", F.col("tube_id").alias("a"), F.col("box").alias("_p")).join(b.select(*keys, "frame_idx", F.col("tube_id").alias("b"), F.col("box").alias("_q")), [*keys, "frame_idx"])
    space = met.groupBy(*keys, "a", "b").agg(F.avg(g.iou(F.col("_p"), F.col("_q"))).alias("spatial"))
    out = space.join(ext(a, "a"), [*keys, "a"]).join(ext(b, "b"), [*keys, "b"])
    return out.select(*keys, "a", "b", "spatial", (F.col("spatial") * g.tiou(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))).alias("iou"))


def track_volume_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of intersections over sum of unions across all frames of two tracks."""
    pairs = a.select(*keys, "frame_idx", F.col("tube_id").alias("a"), F.col("box").alias("_p")).join(b.select(*keys, "frame_idx", F.col("tube_id").alias("b"), F.col("box").alias("_q")), [*keys, "frame_idx"])
    both = pairs.groupBy(*keys, "a", "b").agg(F.sum(g.intersection(F.col("_p"), F.col("_q"))).alias("_i"))
    total = lambda t, n: t.groupBy(*keys, F.col("tube_id").alias(n)).agg(F.sum(g.area(F.col("box"))).alias(f"_{n}"))
    out = both.join(total(a, "a"), [*keys, "a"]).join(total(b, "b"), [*keys, "b"])
    return out.select(*keys, "a", "b", F.try_divide(F.col("_i"), F.col("_a") + F.col("_b") - F.col("_i")).alias("iou"))


def to_source_time(events: DataFrame, clips: DataFrame) -> DataFrame:
    """Event times on the source's clock, the end within the clip; clips: clip, clip_start, clip_end."""
    out = events.join(clips, "clip")
    return out.withColumns({"source_start": F.col("clip_start") + F.col("start"), "source_end": F.least(F.col("clip_start") + F.col("end"), F.col("clip_end"))}).filter("source_end > source_start")

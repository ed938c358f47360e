"""Track tables: checks, summaries, quality, duplicates and relations between tracks.

A track table has video_id, frame_idx, track_id, box, det_score; times come from fps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators.ordered import per_key

TRACK = ["video_id", "track_id"]


def by_track(*order: str) -> Window:
    return Window.partitionBy(*TRACK).orderBy(*(order or ("frame_idx",)))


def violations(tracks: DataFrame, fps: Column | float, frame_count: Column | int) -> DataFrame:
    """Rows that break the contract, with the reasons: repeated key, frame out of range, clock off by more than a frame, empty box."""
    n = F.count("*").over(Window.partitionBy(*TRACK, "frame_idx"))
    tests = [
        (n > 1, "repeated"), ((F.col("frame_idx") < 0) | (F.col("frame_idx") >= frame_count), "frame_out_of_range"),
        (F.abs(F.col("timestamp_s") - F.col("frame_idx") / fps) > 1 / fps, "clock"), (g.area(F.col("box")) <= 0, "empty_box"),
    ]
    return tracks.withColumn("reasons", v.reasons(*tests)).filter(F.size("reasons") > 0)


def summary(tracks: DataFrame, fps: Column | float) -> DataFrame:
    """One row a track: first and last frame, observations, coverage of the span, scores, duration."""
    out = tracks.groupBy(*TRACK).agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("observations"), F.min("det_score").alias("min_score"), F.avg("det_score").alias("mean_score"), F.max("det_score").alias("max_score"))
    span = F.col("end_frame") - F.col("start_frame") + 1
    return out.withColumns({"coverage": F.col("observations") / span, "duration_s": span / fps})


def steps(tracks: DataFrame, fps: Column | float, jump: float = 60.0) -> DataFrame:
    """Each observation with the gap since the last, its speed in box diagonals a second, and whether it jumps."""
    before = lambda c: F.lag(c).over(by_track())
    out = tracks.withColumns({"gap_s": (F.col("frame_idx") - before("frame_idx")) / fps, "_last": before("box")})
    speed = g.centre_distance(F.col("box"), F.col("_last")) / F.greatest(F.lit(1.0), g.diagonal(F.col("_last"))) / F.nullif(F.col("gap_s"), F.lit(0.0))
    return out.withColumn("speed", speed).withColumn("is_jump", F.coalesce(F.col("speed") > jump, F.lit(False))).drop("_last")


def quality(tracks: DataFrame, fps: Column | float, jump: float = 60.0, least: int = 3, least_s: float = 0.1) -> DataFrame:
    """One row a track with status tentative, needs_review or accepted, and what led to it."""
    out = steps(tracks, fps, jump).groupBy(*TRACK).agg(
        F.count("*").alias("observations"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.max("gap_s").alias("max_gap_s"),
        F.array_sort(F.collect_list(F.when(F.col("is_jump"), F.col("frame_idx")))).alias("jump_frames"), F.avg("det_score").alias("mean_det_score"), F.first(F.lit(fps)).alias("_fps"))
    seconds = F.col("observations") / F.col("_fps")
    tests = [(F.col("observations") < least, "few_observations"), (seconds < least_s, "short"), (F.size("jump_frames") > 0, "motion_jump")]
    status = F.when((F.col("observations") < least) | (seconds < least_s), "tentative").when(F.size("jump_frames") > 0, "needs_review").otherwise("accepted")
    return out.withColumns({"observed_s": seconds, "status": status, "reasons": v.reasons(*tests)}).drop("_fps")


def frame_pairs(tracks: DataFrame) -> DataFrame:
    """Pairs of tracks (track_a < track_b) in the same frame, with their IoU; frames hold a bounded number of boxes."""
    a = tracks.select("video_id", "frame_idx", F.col("track_id").alias("track_a"), F.col("box").alias("box_a"))
    b = tracks.select("video_id", "frame_idx", F.col("track_id").alias("track_b"), F.col("box").alias("box_b"))
    return a.join(b, ["video_id", "frame_idx"]).filter("track_a < track_b").withColumn("iou", g.iou(F.col("box_a"), F.col("box_b")))


def duplicate_pairs(tracks: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs that look like one object: in how many frames, and which."""
    hit = frame_pairs(tracks).filter(F.col("iou") >= least)
    return hit.groupBy("video_id", "track_a", "track_b").agg(F.count("*").alias("n_frames"), F.array_sort(F.collect_list("frame_idx")).alias("frames"))


def co_observation(tracks: DataFrame) -> DataFrame:
    """For pairs of tracks seen together: common frames and the least IoU there."""
    return frame_pairs(tracks).groupBy("video_id", "track_a", "track_b").agg(F.count("*").alias("common_frames"), F.min("iou").alias("min_iou"))


def gaps(tracks: DataFrame, fps: Column | float) -> DataFrame:
    """For pairs of tracks of a video: frames and seconds between their spans."""
    s = tracks.groupBy(*TRACK).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    a = s.select("video_id", F.col("track_id").alias("track_a"), F.col("first").alias("fa"), F.col("last").alias("la"))
    b = s.select("video_id", F.col("track_id").alias("track_b"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    between = g.gap_frames(F.col("fa"), F.col("la"), F.col("fb"), F.col("lb"))
    return a.join(b, "video_id").filter("track_a < track_b").select("video_id", "track_a", "track_b", between.alias("gap_frames"), (between / fps).alias("gap_s"))


def most_overlapped(tracks: DataFrame) -> DataFrame:
    """For each observation: the largest share of its box under another track's."""
    a = tracks.select("video_id", "frame_idx", "track_id", "box")
    b = tracks.select("video_id", "frame_idx", F.col("track_id").alias("_other"), F.col("box").alias("_box"))
    near = a.join(b, ["video_id", "frame_idx"], "left").withColumn("_share", F.when(F.col("track_id") != F.col("_other"), g.ioa(F.col("box"), F.col("_box"))))
    return near.groupBy("video_id", "frame_idx", "track_id").agg(F.coalesce(F.max("_share"), F.lit(0.0)).alias("overlapped"))


def suppress_duplicates(tracks: DataFrame, status: DataFrame, least: float = 0.9) -> DataFrame:
    """Marks, frame by frame, boxes that repeat a better one: accepted tracks first, then longer, then surer, then by id."""
    ranked = tracks.join(status.select(*TRACK, "status", "observations"), TRACK)

    def frame(held: list[tuple]) -> list[tuple]:
        out, kept = [], []
        for video, at, track, *_, x1, y1, x2, y2 in held:
            best, who = 0.0, None
            for (a1, b1, a2, b2), other in kept:
                both = max(min(x2, a2) - max(x1, a1), 0) * max(min(y2, b2) - max(y1, b1), 0)
                union = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - both
                if union > 0 and both / union >= least and both / union > best:
                    best, who = both / union, other
            out.append((video, at, track, who, best if who is not None else None))
            if who is None:
                kept.append(((x1, y1, x2, y2), track))
        return out

    flat = ranked.select("video_id", "frame_idx", "track_id", "det_score", "observations", (F.col("status") != "accepted").alias("_late"), "box.*")
    # only frames with two boxes that may be one need the ordered scan
    met = frame_pairs(tracks).filter(F.col("iou") >= least).select("video_id", "frame_idx").distinct()
    several = flat.join(met, ["video_id", "frame_idx"], "left_semi").select("video_id", "frame_idx", "track_id", "_late", (-F.col("observations")).alias("_n"), (-F.col("det_score")).alias("_s"), "x1", "y1", "x2", "y2")
    found = per_key(several, ["video_id", "frame_idx"], ["_late", "_n", "_s", "track_id"], frame, "video_id bigint, frame_idx bigint, track_id bigint, duplicate_of bigint, duplicate_iou double")
    rest = flat.join(met, ["video_id", "frame_idx"], "left_anti").select("video_id", "frame_idx", "track_id", F.lit(None).cast("bigint").alias("duplicate_of"), F.lit(None).cast("double").alias("duplicate_iou"))
    return found.unionByName(rest)


def spaced_best(samples: DataFrame, keys: list[str], time: str, quality_: str, gap: float, most: int) -> DataFrame:
    """Greedy choice in each group: best quality first, none nearer in time than ``gap`` to one chosen, ``most`` at most."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}

    ordered = samples.select(*keys, *(c for c in samples.columns if c not in keys))
    at = ordered.columns.index(time)

    def pick(held: list[tuple]) -> list[tuple]:
        chosen: list[tuple] = []
        for row in held:
            if len(chosen) < most and all(abs(row[at] - c[at]) >= gap for c in chosen):
                chosen.append(row)
        return [row[:-1] for row in chosen]

    return per_key(ordered.withColumn("_order", -F.col(quality_)), keys, ["_order", time], pick, ", ".join(f"`{c}` {kinds[c]}" for c in ordered.columns))


def best_in_bucket(samples: DataFrame, keys: list[str], time: Column, quality_: Column, gap: float, most: int) -> DataFrame:
    """The best row of each time bucket, and of those the ``most`` best of each group."""
    cut = samples.withColumn("bucket", F.floor(time / gap))
    first = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(quality_.desc(), time))
    best = cut.withColumn("_n", first).filter("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(quality_.desc(), time))).filter(F.col("rank") <= most)


def relabelled(tracks: DataFrame, group: list[str], key: str) -> DataFrame:
    """Ids from 0 in each group, in order of the old ones."""
    return tracks.withColumn("new_id", F.dense_rank().over(Window.partitionBy(*group).orderBy(key)) - 1)


def newborn(tracks: DataFrame) -> DataFrame:
    """Whether an observation is the first of its track."""
    return tracks.withColumn("is_newborn", F.row_number().over(by_track()) == 1)


def legal_windows(frames: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Frames from which ``length`` frames on are all there and legal."""
    ahead = Window.partitionBy(*keys).orderBy("frame_idx").rangeBetween(0, length - 1)
    out = frames.withColumns({"_n": F.count("*").over(ahead), "_ok": F.min(F.col("is_legal").cast("int")).over(ahead)})
    return out.filter((F.col("_n") == length) & (F.col("_ok") == 1)).drop("_n", "_ok")



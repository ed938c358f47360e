"""Queries on tracks: summaries, quality, pairs of boxes, detections against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators import tracking_metrics as tm
from vidlake.operators import tracks as tr
from vidlake.plans import views as vw
from vidlake.storage import saved

R = lambda c, n=6: F.round(c, n)
FPS = vw.FPS


def summary(spark: SparkSession, d: str) -> DataFrame:
    s = tr.summary(vw.tracks(spark, d), FPS)
    return s.select("video_id", "track_id", "start_frame", "end_frame", "observations", *(R(F.col(c)).alias(c) for c in ("min_score", "mean_score", "max_score", "coverage", "duration_s")))


def quality(spark: SparkSession, d: str) -> DataFrame:
    q = tr.quality(vw.tracks(spark, d), FPS, jump=40.0, least=60, least_s=2.5)
    return q.select("video_id", "track_id", "observations", "start_frame", "end_frame", "status", F.array_join("reasons", ",").alias("reasons"), F.size("jump_frames").cast("bigint").alias("n_jumps"), R(F.col("max_gap_s")).alias("max_gap_s"))


def jumps(spark: SparkSession, d: str) -> DataFrame:
    return tr.steps(vw.tracks(spark, d), FPS, 40.0).select("video_id", "track_id", "frame_idx", R(F.col("gap_s")).alias("gap_s"), R(F.col("speed"), 4).alias("speed"), "is_jump")


STEPS = f"""{vw.TRACKS}, s AS (SELECT *, (frame_idx - lag(frame_idx) OVER w) / 25.0::DOUBLE AS gap_s, lag(x1) OVER w AS p1, lag(y1) OVER w AS q1, lag(x2) OVER w AS p2, lag(y2) OVER w AS q2 FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)),
 st AS (SELECT *, sqrt(((x1 + x2 - p1 - p2) / 2) ** 2 + ((y1 + y2 - q1 - q2) / 2) ** 2) / greatest(1.0, sqrt((p2 - p1) ** 2 + (q2 - q1) ** 2)) / nullif(gap_s, 0) AS speed FROM s)"""


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Line items before a key is kept once, so that some keys repeat; frames count from 1995 to the end of 1997."""
    li = vw.table(spark, d, "lineitem")
    t = li.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 16).alias("video_id"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("frame_idx"), (F.col("l_partkey") % 32).alias("track_id"),
                  g.from_xywh(F.col("l_quantity") * 4, F.col("l_discount") * 1000, (F.col("l_tax") * 100).cast("double"), F.lit(40.0)).alias("box"))
    t = t.withColumn("timestamp_s", F.col("frame_idx") / FPS + F.when(F.col("l_linenumber") == 7, 0.1).otherwise(0.0))
    return tr.violations(t, FPS, 1095).select("l_orderkey", "l_linenumber", "video_id", "track_id", "frame_idx", F.array_join("reasons", ",").alias("reasons"))


VIOLATIONS = """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey % 16 AS video_id, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS frame_idx, l_partkey % 32 AS track_id, l_tax FROM lineitem),
 n AS (SELECT *, count(*) OVER (PARTITION BY video_id, track_id, frame_idx) AS n FROM t),
 r AS (SELECT *, concat_ws(',', CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN frame_idx < 0 OR frame_idx >= 1095 THEN 'frame_out_of_range' END, CASE WHEN l_linenumber = 7 THEN 'clock' END, CASE WHEN l_tax <= 0 THEN 'empty_box' END) AS reasons FROM n)
 SELECT l_orderkey, l_linenumber, video_id, track_id, frame_idx, reasons FROM r WHERE reasons <> ''"""


def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = tr.frame_pairs(vw.tracks(spark, d))
    a, b = F.col("box_a"), F.col("box_b")
    made = {"iou": g.iou(a, b), "iou_plus": g.iou(a, b, 1.0), "ioa": g.ioa(a, b), "contained": g.containment(a, b), "giou": g.giou(a, b), "distance": g.iou_distance(a, b, 0.5), "near": g.point_similarity(a["x1"], a["y1"], b["x1"], b["y1"], 100.0)}
    return p.select("video_id", "frame_idx", "track_a", "track_b", *(R(c).alias(n) for n, c in made.items()))


PAIRS = f"""{vw.TRACKS}, p AS (SELECT a.video_id, a.frame_idx, a.track_id AS track_a, b.track_id AS track_b, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2,
   greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) AS i1,
   (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb, (a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) AS sa1, (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) AS sb1,
   (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id),
 q AS (SELECT *, CASE WHEN sa + sb - i > 0 THEN i / (sa + sb - i) ELSE 0 END AS iou FROM p)"""


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return tr.duplicate_pairs(vw.tracks(spark, d), 0.7).select("video_id", "track_a", "track_b", "n_frames", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


def gap_seconds(spark: SparkSession, d: str) -> DataFrame:
    return tr.gaps(vw.tracks(spark, d), FPS).select("video_id", "track_a", "track_b", "gap_frames", R(F.col("gap_s")).alias("gap_s"))


def suppressed(spark: SparkSession, d: str) -> DataFrame:
    t = vw.tracks(spark, d)
    s = tr.suppress_duplicates(t, tr.quality(t, FPS, 40.0, 60, 2.5), 0.6)
    return s.select("video_id", "frame_idx", "track_id", "duplicate_of", R(F.col("duplicate_iou")).alias("duplicate_iou"))


def spaced_best(spark: SparkSession, d: str) -> DataFrame:
    t = vw.tracks(spark, d).select("video_id", "track_id", "timestamp_s", (F.col("det_score") + (F.col("frame_idx") % 97) / 1e4).alias("quality"))
    return tr.spaced_best(t, ["video_id", "track_id"], "timestamp_s", "quality", 2.0, 6).select("video_id", "track_id", R(F.col("timestamp_s")).alias("timestamp_s"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth and prediction: a video is a sequence, boxes of one flag are missed and of another moved, and ids change on some days."""
    # made once, however often a query reads the sides: at most one row of a video, day and track, so only this step grows with line items
    t = saved(vw.tracks(spark, d).select(F.col("video_id").alias("seq"), F.col("frame_idx").alias("t"), F.col("track_id").alias("id"), "box", "flag"))
    moved = g.box(F.col("box.x1") + F.when(F.col("flag") == "R", 6).otherwise(1), F.col("box.y1") + 2, F.col("box.x2") + 3, F.col("box.y2") + 2)
    said = t.filter("(id + t) % 9 <> 0").select("seq", "t", ((F.col("id") + F.when(F.col("t") % 500 > 450, 40).otherwise(0))).alias("id"), moved.alias("box"))
    return t.select("seq", "t", "id", "box"), said


def similarities(spark: SparkSession, d: str) -> DataFrame:
    return tm.similarities(*sides(spark, d))


def clear(spark: SparkSession, d: str) -> DataFrame:
    c = tm.clear(similarities(spark, d))
    return tm.clear_finals(c).select("seq", *(F.round(x, 6).alias(x) for x in (*tm.CLEAR, "mota", "motp", "moda", "smota", "motal", "f1", "recall", "precision", "mtr", "ptr", "mlr", "fp_per_frame")))


def clear_trace(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of each frame that CLEAR counts."""
    return tm.clear_matches(tm.frames(similarities(spark, d))).select("seq", "t", "gt_id", "tr_id", R(F.col("sim")).alias("sim"))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """How alike whole tracks are, before any are paired."""
    return tm.alignments(tm.frames(similarities(spark, d))).select("seq", "gt_id", "tr_id", "n_gt", "n_tr", R(F.col("align")).alias("align"))


def identity(spark: SparkSession, d: str) -> DataFrame:
    return tm.identity_finals(tm.identity(similarities(spark, d))).select("seq", *(F.round(x, 6).alias(x) for x in ("idtp", "idfn", "idfp", "idf1", "idr", "idp")))


def hota(spark: SparkSession, d: str) -> DataFrame:
    per = tm.hota(similarities(spark, d))
    every = tm.hota_finals(tm.combined(per, ["alpha"]).withColumn("seq", F.lit("all")), ["seq"])
    return tm.hota_finals(per.withColumn("seq", F.col("seq").cast("string")), ["seq"]).unionByName(every).select("seq", *(F.round(x, 6).alias(x) for x in ("hota", "det_a", "ass_a", "det_re", "det_pr", "ass_re", "ass_pr", "loc_a", "rhota", "hota_0", "loc_a_0", "hota_loc_a_0")))


def vace(spark: SparkSession, d: str) -> DataFrame:
    return tm.vace_finals(tm.vace(similarities(spark, d))).select("seq", F.round("ata", 6).alias("ata"), F.round("sfda", 6).alias("sfda"))


def view_rollup(spark: SparkSession, d: str) -> DataFrame:
    """CLEAR counts for each sequence, each view and all, ratios taken after the sums."""
    from vidlake.operators.catalog import scope_rollup

    c = tm.clear(similarities(spark, d)).withColumn("view", F.when(F.col("seq") % 2 == 0, "top").otherwise("side"))
    return tm.clear_finals(scope_rollup(c, ["view", "seq"], tm.CLEAR)).select("view", "seq", "level", *(F.round(x, 6).alias(x) for x in ("tp", "fn", "fp", "idsw", "mota")))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return tm.counts(*sides(spark, d)).select("seq", "gt_dets", "gt_ids", "tr_dets", "tr_ids")


SIDES = f"""{vw.TRACKS}, gt AS (SELECT video_id AS seq, frame_idx AS t, track_id AS id FROM tracks), pr AS (SELECT video_id AS seq, frame_idx AS t, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS id FROM tracks WHERE (track_id + frame_idx) % 9 <> 0)"""


def relabel(spark: SparkSession, d: str) -> DataFrame:
    t = tr.newborn(tr.relabelled(vw.tracks(spark, d), ["video_id"], "track_id"))
    return t.select("video_id", "track_id", "frame_idx", F.col("new_id").cast("bigint").alias("new_id"), "is_newborn")


def legal(spark: SparkSession, d: str) -> DataFrame:
    f = vw.tracks(spark, d).groupBy("video_id", "frame_idx").agg((F.count("*") > 1).alias("is_legal"))
    return tr.legal_windows(f, ["video_id"], 3).select("video_id", "frame_idx")


def overlapped(spark: SparkSession, d: str) -> DataFrame:
    return tr.most_overlapped(vw.tracks(spark, d)).select("video_id", "frame_idx", "track_id", R(F.col("overlapped")).alias("overlapped"))


def co_observed(spark: SparkSession, d: str) -> DataFrame:
    return tr.co_observation(vw.tracks(spark, d)).select("video_id", "track_a", "track_b", "common_frames", R(F.col("min_iou")).alias("min_iou"))


def conversions(spark: SparkSession, d: str) -> DataFrame:
    t = vw.tracks(spark, d)
    c, w, cut = g.to_centre(F.col("box")), g.to_xywh(F.col("box")), g.clipped(F.col("box"), F.lit(180.0), F.lit(90.0))
    person = g.crop(F.col("box"), 0.08, 0.12, 0.70)
    return t.select("video_id", "frame_idx", "track_id", R(c["cx"]).alias("cx"), R(c["cy"]).alias("cy"), R(w["w"]).alias("w"), R(w["h"]).alias("h"), R(cut["x2"]).alias("clip_x2"), R(cut["y2"]).alias("clip_y2"), R(person["x1"]).alias("crop_x1"), R(person["y2"]).alias("crop_y2"), v.colour(F.col("track_id")).alias("colour"))


def cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Detections of truth and prediction up to each frame of a sequence."""
    gt, pr = sides(spark, d)
    by = gt.groupBy("seq", "t").agg(F.count("*").alias("gt")).join(pr.groupBy("seq", "t").agg(F.count("*").alias("pr")), ["seq", "t"], "full").na.fill(0)
    w = Window.partitionBy("seq").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("seq", "t", F.sum("gt").over(w).alias("gt_so_far"), F.sum("pr").over(w).alias("pr_so_far"))


QUERIES = {
    "track_summary": (summary, f"WITH {vw.TRACKS} SELECT video_id, track_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS observations, round(min(det_score), 6) AS min_score, round(avg(det_score), 6) AS mean_score, round(max(det_score), 6) AS max_score, round(count(*) / (max(frame_idx) - min(frame_idx) + 1), 6) AS coverage, round((max(frame_idx) - min(frame_idx) + 1) / 25.0::DOUBLE, 6) AS duration_s FROM tracks GROUP BY 1, 2"),
    "track_quality_status": (quality, f"""WITH {STEPS}, q AS (SELECT video_id, track_id, count(*) AS observations, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) FILTER (speed > 40) AS n_jumps, round(max(gap_s), 6) AS max_gap_s FROM st GROUP BY 1, 2)
      SELECT video_id, track_id, observations, start_frame, end_frame, CASE WHEN observations < 60 OR observations / 25.0 < 2.5 THEN 'tentative' WHEN n_jumps > 0 THEN 'needs_review' ELSE 'accepted' END AS status,
      concat_ws(',', CASE WHEN observations < 60 THEN 'few_observations' END, CASE WHEN observations / 25.0 < 2.5 THEN 'short' END, CASE WHEN n_jumps > 0 THEN 'motion_jump' END) AS reasons, n_jumps, max_gap_s FROM q"""),
    "track_jumps": (jumps, f"WITH {STEPS} SELECT video_id, track_id, frame_idx, round(gap_s, 6) AS gap_s, round(speed, 4) AS speed, coalesce(speed > 40, false) AS is_jump FROM st"),
    "track_violations": (violations, VIOLATIONS),
    "box_iou_pairs": (box_pairs, f"""WITH {PAIRS} SELECT video_id, frame_idx, track_a, track_b, round(iou, 6) AS iou, round(CASE WHEN sa1 + sb1 - i1 > 0 THEN i1 / (sa1 + sb1 - i1) ELSE 0 END, 6) AS iou_plus, round(CASE WHEN sa > 0 THEN i / sa ELSE 0 END, 6) AS ioa,
      round(i / greatest(least(sa, sb), 1), 6) AS contained, round(iou - CASE WHEN hull > 0 THEN (hull - (sa + sb - i)) / hull ELSE 0 END, 6) AS giou, CASE WHEN iou >= 0.5 THEN round(1 - iou, 6) END AS distance, round(greatest(0, 1 - sqrt((x1 - u1) ** 2 + (y1 - v1) ** 2) / 100), 6) AS near FROM q"""),
    "frame_duplicates": (duplicates, f"WITH {PAIRS} SELECT video_id, track_a, track_b, count(*) AS n_frames, string_agg(frame_idx::VARCHAR, ',' ORDER BY frame_idx) AS frames FROM q WHERE iou >= 0.7 GROUP BY 1, 2, 3"),
    "coobservation": (co_observed, f"WITH {PAIRS} SELECT video_id, track_a, track_b, count(*) AS common_frames, round(min(iou), 6) AS min_iou FROM q GROUP BY 1, 2, 3"),
    "gap_seconds": (gap_seconds, f"""WITH {vw.TRACKS}, s AS (SELECT video_id, track_id, min(frame_idx) AS f, max(frame_idx) AS l FROM tracks GROUP BY 1, 2)
      SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b, greatest(0, greatest(a.f, b.f) - least(a.l, b.l) - 1) AS gap_frames, round(greatest(0, greatest(a.f, b.f) - least(a.l, b.l) - 1) / 25.0::DOUBLE, 6) AS gap_s FROM s a JOIN s b ON a.video_id = b.video_id AND a.track_id < b.track_id"""),
    "suppress_duplicates_k": (suppressed, None),
    "spaced_best_k": (spaced_best, None),
    "most_overlapped": (overlapped, f"""WITH {vw.TRACKS} SELECT a.video_id, a.frame_idx, a.track_id, round(coalesce(max(CASE WHEN b.track_id IS NOT NULL THEN greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) END), 0), 6) AS overlapped
      FROM tracks a LEFT JOIN tracks b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id GROUP BY 1, 2, 3"""),
    "box_conversions": (conversions, f"""WITH {vw.TRACKS} SELECT video_id, frame_idx, track_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h,
      CASE WHEN least(x2, 180) > least(x1, 180) AND least(y2, 90) > least(y1, 90) THEN round(least(x2, 180), 6) END AS clip_x2, CASE WHEN least(x2, 180) > least(x1, 180) AND least(y2, 90) > least(y1, 90) THEN round(least(y2, 90), 6) END AS clip_y2,
      round(x1 + (x2 - x1) * 0.08, 6) AS crop_x1, round(y1 + (y2 - y1) * 0.70, 6) AS crop_y2, '#' || lpad(lower(to_hex((track_id * 37 + 17) % 192 + 64)), 2, '0') || lpad(lower(to_hex((track_id * 67 + 71) % 192 + 64)), 2, '0') || lpad(lower(to_hex((track_id * 97 + 131) % 192 + 64)), 2, '0') AS colour FROM tracks"""),
    "track_relabel": (relabel, f"WITH {vw.TRACKS} SELECT video_id, track_id, frame_idx, dense_rank() OVER (PARTITION BY video_id ORDER BY track_id) - 1 AS new_id, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) = 1 AS is_newborn FROM tracks"),
    "legal_windows": (legal, f"WITH {vw.TRACKS}, f AS (SELECT video_id, frame_idx, count(*) > 1 AS ok FROM tracks GROUP BY 1, 2) SELECT a.video_id, a.frame_idx FROM f a JOIN f b ON a.video_id = b.video_id AND b.frame_idx = a.frame_idx + 1 JOIN f c ON a.video_id = c.video_id AND c.frame_idx = a.frame_idx + 2 WHERE a.ok AND b.ok AND c.ok"),
    "track_counts": (counts, f"WITH {SIDES} SELECT coalesce(g.seq, p.seq) AS seq, coalesce(gt_dets, 0) AS gt_dets, coalesce(gt_ids, 0) AS gt_ids, coalesce(tr_dets, 0) AS tr_dets, coalesce(tr_ids, 0) AS tr_ids FROM (SELECT seq, count(*) AS gt_dets, count(DISTINCT id) AS gt_ids FROM gt GROUP BY 1) g FULL JOIN (SELECT seq, count(*) AS tr_dets, count(DISTINCT id) AS tr_ids FROM pr GROUP BY 1) p ON g.seq = p.seq"),
    "cumulative_frames": (cumulative, f"WITH {SIDES}, b AS (SELECT seq, t, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT seq, t, 1 AS a, 0 AS b FROM gt UNION ALL SELECT seq, t, 0, 1 FROM pr) GROUP BY 1, 2) SELECT seq, t, (sum(a) OVER w)::BIGINT AS gt_so_far, (sum(b) OVER w)::BIGINT AS pr_so_far FROM b WINDOW w AS (PARTITION BY seq ORDER BY t)"),
    "clear_k": (clear, None),
    "clear_trace_k": (clear_trace, None),
    "track_alignment": (alignment, f"""WITH {vw.TRACKS}, gt AS (SELECT video_id AS seq, frame_idx AS t, track_id AS id, x1, y1, x2, y2 FROM tracks),
      pr AS (SELECT video_id AS seq, frame_idx AS t, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS id, x1 + CASE WHEN flag = 'R' THEN 6 ELSE 1 END AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM tracks WHERE (track_id + frame_idx) % 9 <> 0),
      p AS (SELECT seq, t, g.id AS gt_id, p.id AS tr_id, greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i, (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS s FROM gt g JOIN pr p USING (seq, t)),
      q AS (SELECT seq, t, gt_id, tr_id, i / (s - i) AS sim FROM p WHERE i > 0), x AS (SELECT *, sim / (sum(sim) OVER (PARTITION BY seq, t, gt_id) + sum(sim) OVER (PARTITION BY seq, t, tr_id) - sim) AS x FROM q), m AS (SELECT seq, gt_id, tr_id, sum(x) AS x FROM x GROUP BY 1, 2, 3),
      a AS (SELECT seq, id, count(*) AS n FROM gt GROUP BY 1, 2), b AS (SELECT seq, id, count(*) AS n FROM pr GROUP BY 1, 2)
      SELECT m.seq, gt_id, tr_id, a.n AS n_gt, b.n AS n_tr, round(x / (a.n + b.n - x), 6) AS align FROM m JOIN a ON a.seq = m.seq AND a.id = gt_id JOIN b ON b.seq = m.seq AND b.id = tr_id"""),
    "identity_k": (identity, None),
    "hota_k": (hota, None),
    "vace_k": (vace, None),
    "view_rollup_k": (view_rollup, None),
}

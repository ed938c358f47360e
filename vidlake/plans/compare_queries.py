"""Queries that hold two results of one video against each other: masks, parity, ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import masks as m
from vidlake.operators import segments as sg
from vidlake.operators import track_compare as tc
from vidlake.plans import views as vw
from vidlake.plans.track_queries import sides, similarities

R = lambda c, n=6: F.round(c, n)
HEIGHT, WIDTH = 40, 64


def masked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes of truth and prediction as masks of a quarter of the size, frames of each sequence numbered from 1; and how many a sequence has."""
    gt, pr = sides(spark, d)
    first = gt.groupBy("seq").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    quarter = lambda c: F.floor(F.col(f"box.{c}") / 4)
    made = lambda rows: rows.join(first, "seq").select("seq", (F.col("t") - F.col("_first") + 1).alias("t"), "id", m.rectangle(HEIGHT, WIDTH, *map(quarter, ("x1", "y1", "x2", "y2"))).alias("mask"))
    return made(gt), made(pr), first.select("seq", (F.col("_last") - F.col("_first") + 1).cast("int").alias("frames"))


def mask_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Area and overlap of masks of one id in truth and prediction."""
    gt, pr, _ = masked(spark, d)
    met = gt.select("seq", "t", "id", F.col("mask").alias("a")).join(pr.select("seq", "t", "id", F.col("mask").alias("b")), ["seq", "t", "id"])
    return met.select("seq", "t", "id", m.area(F.col("a")).alias("area"), R(m.iou(F.col("a"), F.col("b"))).alias("iou"))


QUARTERS = f"""f AS (SELECT video_id, min(frame_idx) AS first FROM tracks GROUP BY 1),
 g AS (SELECT video_id, frame_idx, track_id AS id, floor(x1 / 4) AS x1, floor(y1 / 4) AS y1, floor(x2 / 4) AS x2, floor(y2 / 4) AS y2 FROM tracks),
 p AS (SELECT video_id, frame_idx, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS id, floor((x1 + CASE WHEN flag = 'R' THEN 6 ELSE 1 END) / 4) AS x1, floor((y1 + 2) / 4) AS y1, floor((x2 + 3) / 4) AS x2, floor((y2 + 2) / 4) AS y2 FROM tracks WHERE (track_id + frame_idx) % 9 <> 0),
 c AS (SELECT g.video_id AS seq, g.frame_idx - f.first + 1 AS t, g.id, greatest(0, least(g.x2, {WIDTH}) - greatest(g.x1, 0)) * greatest(0, least(g.y2, {HEIGHT}) - greatest(g.y1, 0)) AS a, greatest(0, least(p.x2, {WIDTH}) - greatest(p.x1, 0)) * greatest(0, least(p.y2, {HEIGHT}) - greatest(p.y1, 0)) AS b,
   greatest(0, least(g.x2, p.x2, {WIDTH}) - greatest(g.x1, p.x1, 0)) * greatest(0, least(g.y2, p.y2, {HEIGHT}) - greatest(g.y1, p.y1, 0)) AS i FROM g JOIN p USING (video_id, frame_idx, id) JOIN f USING (video_id))"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions and boundaries of whole tracks, a row for each sequence."""
    made = sg.sequence_means(sg.j_and_f(*masked(spark, d)), ["seq"])
    return made.select("seq", "n_truth", *(R(F.col(c)).alias(c) for c in ("j_mean", "j_recall", "j_decay", "f_mean", "f_recall", "f_decay", "j_and_f")))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each predicted mask under those of smaller ids."""
    _, pr, _ = masked(spark, d)
    kept = sg.apart(pr.withColumn("score", -F.col("id").cast("double")), ["seq", "t"])
    return kept.select("seq", "t", "id", m.area(F.col("mask")).alias("area"))


def parity(spark: SparkSession, d: str) -> DataFrame:
    """Tracks against themselves under other names, with boxes of two ids exchanged on some days and some boxes moved."""
    t = vw.tracks(spark, d).select(F.col("video_id").alias("seq"), F.col("frame_idx").alias("t"), F.col("track_id").alias("id"), "box")
    name = (F.col("id") * 7 + 3) % 32
    name = F.when((F.col("seq") % 4 == 1) & (F.col("t") % 97 == 0), (name + 1) % 32).otherwise(name)
    off = F.when((F.col("seq") % 4 == 2) & (F.col("t") % 89 == 0), 0.5).otherwise(0.004)
    moved = g.box(F.col("box.x1") + off, F.col("box.y1"), F.col("box.x2") + off, F.col("box.y2"))
    right = t.filter(~((F.col("seq") % 4 == 3) & (F.col("t") % 101 == 0))).select("seq", "t", name.alias("id"), moved.alias("box"))
    return tc.parity(t, right).select("seq", "count_mismatch_frames", "compared", "moved", "id_conflicts", "ids", R(F.col("largest"), 4).alias("largest"), "equal")


def ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways of truths, and of their parts with each track."""
    whole, part = tc.covered_ways(sides(spark, d)[0], similarities(spark, d))
    return whole.withColumn("tr_id", F.lit(-1).cast("bigint")).unionByName(part).select("seq", "gt_id", "tr_id", R(F.col("way"), 4).alias("way"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    shares = tc.way_coverage(sides(spark, d)[0], similarities(spark, d))
    return shares.select("seq", R(F.col("covered"), 4).alias("covered"), R(F.col("way"), 4).alias("way"), R(F.col("share")).alias("share"))


WAYS = f"""WITH {vw.TRACKS}, g AS (SELECT video_id AS seq, frame_idx AS t, track_id AS gt_id, x1, y1, x2, y2 FROM tracks),
 p AS (SELECT video_id AS seq, frame_idx AS t, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS tr_id, x1 + CASE WHEN flag = 'R' THEN 6 ELSE 1 END AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM tracks WHERE (track_id + frame_idx) % 9 <> 0),
 o AS (SELECT g.seq, g.t, gt_id, tr_id, g.x1, g.y1, g.x2, g.y2, greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i, (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS s FROM g JOIN p USING (seq, t)),
 r AS (SELECT seq, t, gt_id, -1 AS tr_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM g UNION ALL SELECT seq, t, gt_id, tr_id, (x1 + x2) / 2, (y1 + y2) / 2 FROM o WHERE i / (s - i) >= 0.5),
 d AS (SELECT seq, gt_id, tr_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM r WINDOW w AS (PARTITION BY seq, gt_id, tr_id ORDER BY t)) SELECT seq, gt_id, tr_id::BIGINT AS tr_id, round(coalesce(sum(d), 0), 4) AS way FROM d GROUP BY 1, 2, 3"""

QUERIES = {
    "mask_overlaps": (mask_overlaps, f"WITH {vw.TRACKS}, {QUARTERS} SELECT seq, t, id, a::BIGINT AS area, round(CASE WHEN a + b - i > 0 THEN i / (a + b - i) ELSE 0 END, 6) AS iou FROM c"),
    "mask_regions_k": (regions, None),
    "mask_layers_k": (layers, None),
    "track_parity_k": (parity, None),
    "way_lengths": (ways, WAYS),
    "way_coverage_k": (coverage, None),
}

"""Queries over whole tracks and tubes: precision by ranges, of frames and videos, kinds of error, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators import events as ev
from vidlake.operators import track_map as tmap
from vidlake.operators import tubelets as tb
from vidlake.plans.track_queries import sides

R = lambda c, n=6: F.round(c, n)


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth and predicted tubes of four labels; every fifth predicted tube has a wrong one."""
    gt, pr = sides(spark, d)
    truth = gt.select(F.col("seq").alias("video_id"), F.col("id").alias("tube_id"), (F.col("id") % 4).alias("label"), F.col("t").alias("frame_idx"), "box")
    label = F.pmod(F.col("id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0), F.lit(4))
    score = F.pmod(F.col("id") * 37 + F.col("seq") * 11, F.lit(100)) / 100.0
    return truth, pr.select(F.col("seq").alias("video_id"), F.col("id").alias("tube_id"), label.alias("label"), F.col("t").alias("frame_idx"), "box", score.alias("score"))


LABELLED = """tr AS (SELECT video_id, frame_idx, track_id, x1, y1, x2, y2, flag FROM tracks),
 gt AS (SELECT video_id, track_id AS tube_id, track_id % 4 AS label, frame_idx, x1, y1, x2, y2 FROM tr),
 pr AS (SELECT video_id, id AS tube_id, (id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS label, frame_idx, x1, y1, x2, y2, ((id * 37 + video_id * 11) % 100) / 100.0::DOUBLE AS score FROM (
  SELECT video_id, frame_idx, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS id, x1 + CASE WHEN flag = 'R' THEN 6 ELSE 1 END AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM tr WHERE (track_id + frame_idx) % 9 <> 0))"""


def track_map(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of whole tracks for ranges of area and length, mean of four classes; every eleventh truth is a crowd, and a class is not labelled exhaustively in every fifth sequence."""
    truth, said = labelled(spark, d)
    a, b = (t.select(F.col("video_id").alias("seq"), "label", F.col("tube_id").alias("id"), F.col("frame_idx").alias("t"), "box") for t in (truth, said))
    keys = ["seq", "label"]
    as_tubes = lambda t: t.select(*keys, F.col("t").alias("frame_idx"), F.col("id").alias("tube_id"), "box")
    pairs = ev.track_volume_iou(as_tubes(a), as_tubes(b), keys).select(*keys, F.col("a").alias("truth"), F.col("b").alias("id"), "iou")
    truths = tmap.track_facts(a, keys).withColumn("crowd", F.col("id") % 11 == 0)
    scores = said.groupBy(F.col("video_id").alias("seq"), "label", F.col("tube_id").alias("id")).agg(F.avg("score").alias("score"))
    tracks = tmap.track_facts(b, keys).join(scores, [*keys, "id"]).withColumn("exhaustive", (F.col("seq") + F.col("label")) % 5 != 0)
    ranges = {k: r for k, r in tmap.RANGES.items() if k != "area_l"} | {"time_100": (0.0, float("inf"), 100.0, 1e5)}
    made = tmap.track_map(pairs, truths, tracks, "seq", ["label"], most=50, overlaps=[0.1, 0.3, 0.5, 0.7], ranges=ranges)
    return tmap.class_mean(made, ["label"]).select("overlap", "range", "n_classes", R(F.col("ap")).alias("ap"), R(F.col("ar")).alias("ar"))


def numbered(t: DataFrame, name: str) -> DataFrame:
    return t.withColumn(name, (F.col("video_id") * 100_000 + F.col("frame_idx")) * 100 + F.col("tube_id"))


def frame_ap(spark: SparkSession, d: str) -> DataFrame:
    truth, said = labelled(spark, d)
    return tb.frame_ap(numbered(said, "pred"), numbered(truth, "truth"), 0.5).select("label", R(F.col("ap")).alias("ap"))


FRAME_HITS = """b AS (SELECT p.label, p.pred, p.score, g.truth, i / (s - i) AS iou FROM (SELECT p.label, p.pred, p.score, g.truth, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s
   FROM (SELECT *, (video_id * 100000 + frame_idx) * 100 + tube_id AS pred FROM pr) p JOIN (SELECT *, (video_id * 100000 + frame_idx) * 100 + tube_id AS truth FROM gt) g ON p.video_id = g.video_id AND p.frame_idx = g.frame_idx AND p.label = g.label) p, LATERAL (SELECT p.truth) g
   QUALIFY row_number() OVER (PARTITION BY p.label, p.pred ORDER BY i / (s - i) DESC, p.truth) = 1),
 h AS (SELECT p.label, p.score, (p.video_id * 100000 + p.frame_idx) * 100 + p.tube_id AS pred, CASE WHEN b.iou >= 0.5 THEN b.truth END AS truth FROM pr p LEFT JOIN b ON b.label = p.label AND b.pred = (p.video_id * 100000 + p.frame_idx) * 100 + p.tube_id),
 k AS (SELECT label, score, pred, truth IS NOT NULL AND row_number() OVER (PARTITION BY label, truth ORDER BY score DESC, pred) = 1 AS hit FROM h),
 n AS (SELECT label, count(*) AS n FROM gt GROUP BY 1)"""
AREA = """c AS (SELECT k.*, n.n, sum(hit::INT) OVER w AS tp, row_number() OVER w AS r FROM k JOIN n USING (label) WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, {tie})),
 q AS (SELECT *, max(tp / r::DOUBLE) OVER (PARTITION BY {by} ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS env FROM c)"""


def group_means(spark: SparkSession, d: str) -> DataFrame:
    """Precision of single boxes for each of many labels, and its mean over groups of labels."""
    truth, said = labelled(spark, d)
    label = lambda t: t.withColumn("label", F.pmod(F.col("tube_id"), F.lit(40)) * 2 + 1)
    aps = tb.frame_ap(numbered(label(said), "pred"), numbered(label(truth), "truth"), 0.5)
    return tb.action_group_means(aps).select("group", "n_labels", R(F.col("mean_ap")).alias("mean_ap"))


GROUP_SQL = LABELLED.replace("track_id % 4 AS label", "(track_id % 40) * 2 + 1 AS label").replace("(id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS label", "(id % 40) * 2 + 1 AS label")


def video_ap(spark: SparkSession, d: str) -> DataFrame:
    truth, said = labelled(spark, d)
    return tb.video_ap(said, truth, [0.1, 0.2, 0.3, 0.5]).select("label", "threshold", R(F.col("ap")).alias("ap"))


def video_bands(spark: SparkSession, d: str) -> DataFrame:
    truth, said = labelled(spark, d)
    return tb.band_means(tb.video_ap(said, truth, sorted({t for ts in tb.BANDS.values() for t in ts}))).select("band", R(F.col("mean_ap")).alias("mean_ap"))


TUBES = """m AS (SELECT p.video_id, p.tube_id AS pred, g.tube_id AS truth, avg(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END) AS spatial FROM (SELECT p.video_id, p.tube_id, g.tube_id AS truth, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s
   FROM pr p JOIN gt g ON p.video_id = g.video_id AND p.frame_idx = g.frame_idx) p, LATERAL (SELECT p.truth AS tube_id) g GROUP BY 1, 2, 3),
 pe AS (SELECT video_id, tube_id AS pred, any_value(label) AS label, any_value(score) AS score, min(frame_idx) AS s, max(frame_idx) AS e FROM pr GROUP BY 1, 2),
 ge AS (SELECT video_id, tube_id AS truth, any_value(label) AS truth_label, min(frame_idx) AS s, max(frame_idx) AS e FROM gt GROUP BY 1, 2),
 o AS (SELECT m.video_id, m.pred, m.truth, pe.label, pe.score, ge.truth_label, spatial, CASE WHEN greatest(pe.e, ge.e) > least(pe.s, ge.s) THEN greatest(0, least(pe.e, ge.e) - greatest(pe.s, ge.s)) / (greatest(pe.e, ge.e) - least(pe.s, ge.s))::DOUBLE ELSE 0 END AS temporal FROM m JOIN pe USING (video_id, pred) JOIN ge USING (video_id, truth)),
 n AS (SELECT truth_label AS label, count(*) AS n FROM ge GROUP BY 1)"""
VIDEO_AP = f"""{TUBES}, b AS (SELECT *, spatial * temporal AS iou FROM o WHERE label = truth_label QUALIFY row_number() OVER (PARTITION BY video_id, pred ORDER BY spatial * temporal DESC, truth) = 1),
 x AS (SELECT unnest({{thresholds}})::DOUBLE AS threshold), h AS (SELECT pe.video_id, pe.pred, pe.label, pe.score, threshold, CASE WHEN b.iou >= threshold THEN b.truth END AS truth FROM pe CROSS JOIN x LEFT JOIN b ON b.video_id = pe.video_id AND b.pred = pe.pred),
 k AS (SELECT *, truth IS NOT NULL AND row_number() OVER (PARTITION BY video_id, label, threshold, truth ORDER BY score DESC, pred) = 1 AS hit FROM h), {AREA.format(by="label, threshold", tie="video_id, pred")},
 a AS (SELECT n.label, x.threshold, coalesce(sum(CASE WHEN hit THEN env / n.n ELSE 0 END), 0) AS ap FROM n CROSS JOIN x LEFT JOIN q ON q.label = n.label AND q.threshold = x.threshold GROUP BY 1, 2)"""
BAND_ROWS = ", ".join(f"('{b}', {t}::DOUBLE)" for b, ts in tb.BANDS.items() for t in ts)


def tube_errors(spark: SparkSession, d: str) -> DataFrame:
    truth, said = labelled(spark, d)
    areas = tb.error_areas(tb.tube_verdicts(said, truth, 0.2), tb.truth_counts(truth))
    return areas.select("label", "kind", "n", R(F.col("area")).alias("area"), R(F.col("enveloped")).alias("enveloped"))


KIND_LIST = "[" + ", ".join(f"'{k}'" for k in ("hit", *tb.KINDS)) + "]"
ERRORS = f"""{TUBES}, u AS (SELECT *, spatial * temporal AS iou, label = truth_label AS same FROM o),
 own AS (SELECT * FROM u WHERE same QUALIFY row_number() OVER (PARTITION BY video_id, pred ORDER BY iou DESC, truth) = 1), oth AS (SELECT video_id, pred, max(iou) AS iou FROM u WHERE NOT same GROUP BY 1, 2),
 any_ AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY video_id, pred ORDER BY iou DESC, truth) = 1),
 f AS (SELECT video_id, pred FROM own WHERE iou >= 0.2 QUALIFY row_number() OVER (PARTITION BY video_id, label, truth ORDER BY score DESC, pred) = 1),
 v AS (SELECT pe.video_id, pe.pred, pe.label, pe.score, CASE WHEN f.pred IS NOT NULL THEN 'hit' WHEN own.iou >= 0.2 THEN 'repeat' WHEN oth.iou >= 0.2 THEN 'class' WHEN coalesce(any_.iou, 0) <= 0 THEN 'extra'
   WHEN any_.same THEN CASE WHEN any_.temporal >= sqrt(0.2) THEN 'location' WHEN any_.spatial >= sqrt(0.2) THEN 'time' ELSE 'time_location' END WHEN any_.temporal >= sqrt(0.2) THEN 'class_location' WHEN any_.spatial >= sqrt(0.2) THEN 'class_time' ELSE 'class_time_location' END AS kind
   FROM pe LEFT JOIN f USING (video_id, pred) LEFT JOIN own USING (video_id, pred) LEFT JOIN oth USING (video_id, pred) LEFT JOIN any_ USING (video_id, pred)),
 kk AS (SELECT unnest({KIND_LIST}) AS k), w AS (SELECT v.*, n.n, row_number() OVER (PARTITION BY label ORDER BY score DESC, video_id, pred) AS r FROM v JOIN n USING (label)),
 z AS (SELECT w.label, w.n, k, w.kind = 'hit' AS hit, w.kind = k AS own, r, sum((w.kind = k)::INT) OVER (PARTITION BY label, k ORDER BY r) / r::DOUBLE AS share FROM w CROSS JOIN kk),
 e AS (SELECT *, max(share) OVER (PARTITION BY label, k ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS env FROM z),
 t AS (SELECT n.label, kk.k AS kind, count(*) FILTER (own) AS n, coalesce(sum(share / e.n) FILTER (hit), 0) AS area, coalesce(sum(env / e.n) FILTER (hit), 0) AS enveloped FROM n CROSS JOIN kk LEFT JOIN e ON e.label = n.label AND e.k = kk.k GROUP BY 1, 2),
 miss AS (SELECT n.label, 'missed' AS kind, n.n - t.n AS n, (n.n - t.n) / n.n::DOUBLE AS area, (n.n - t.n) / n.n::DOUBLE AS enveloped FROM n JOIN t ON t.label = n.label AND t.kind = 'hit')"""


def suppression(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each frame and label after decay, the ten surest."""
    _, said = labelled(spark, d)
    boxes = said.select("video_id", "frame_idx", "label", F.col("tube_id").alias("id"), F.array("box").alias("boxes"), "score")
    kept = tb.suppressed(boxes, ["video_id", "frame_idx", "label"], 0.3, 10)
    return kept.select("video_id", "frame_idx", "label", "id", R(F.col("score")).alias("score"), "rank", R(g.area(F.col("boxes")[0])).alias("area"))


def _with(sql: str) -> str:
    from vidlake.plans import views as vw

    return f"WITH {vw.TRACKS}, {LABELLED}, {sql}"


def _group_sql() -> str:
    from vidlake.plans import views as vw

    groups = ", ".join(f"('{name}', {lo}, {hi})" for name, (lo, hi) in tb.ACTION_GROUPS.items())
    return f"""WITH {vw.TRACKS}, {GROUP_SQL}, {FRAME_HITS}, {AREA.format(by="label", tie="pred")}, a AS (SELECT n.label, coalesce(sum(CASE WHEN hit THEN env / n.n ELSE 0 END), 0) AS ap FROM n LEFT JOIN q USING (label) GROUP BY 1)
      SELECT grp AS "group", count(*) AS n_labels, round(avg(ap), 6) AS mean_ap FROM a JOIN (VALUES {groups}) AS g(grp, lo, hi) ON label BETWEEN lo AND hi GROUP BY 1"""


QUERIES = {
    "track_map_k": (track_map, None),
    "frame_ap": (frame_ap, _with(f"""{FRAME_HITS}, {AREA.format(by="label", tie="pred")} SELECT n.label, round(coalesce(sum(CASE WHEN hit THEN env / n.n ELSE 0 END), 0), 6) AS ap FROM n LEFT JOIN q USING (label) GROUP BY 1""")),
    "action_group_means": (group_means, _group_sql()),
    "video_ap": (video_ap, _with(VIDEO_AP.format(thresholds="[0.1, 0.2, 0.3, 0.5]") + " SELECT label, threshold, round(ap, 6) AS ap FROM a")),
    "video_ap_bands": (video_bands, _with(VIDEO_AP.format(thresholds=str(sorted({t for ts in tb.BANDS.values() for t in ts}))) + f", bands AS (SELECT * FROM (VALUES {BAND_ROWS}) AS b(band, threshold)), by_t AS (SELECT threshold, avg(ap) AS ap FROM a GROUP BY 1) SELECT band, round(avg(ap), 6) AS mean_ap FROM bands JOIN by_t USING (threshold) GROUP BY 1")),
    "tube_errors": (tube_errors, _with(ERRORS + " SELECT label, kind, n, round(area, 6) AS area, round(enveloped, 6) AS enveloped FROM (SELECT * FROM t UNION ALL SELECT * FROM miss)")),
    "tubelet_suppression_k": (suppression, None),
}

"""Queries on tubes, gates, sampling of frames and moments, and decisions about identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import skeletons as sk
from vidlake.functions import values as v
from vidlake.operators import catalog, detection as det, evaluation as evl, events as ev, identity as ident, registry as reg, sampling
from vidlake.plans import track_queries as tq
from vidlake.plans import views as vw

R = lambda c, n=6: F.round(c, n)
joined = lambda c: F.array_join(c.cast("array<string>"), ",")

SIDES = f"""{vw.TRACKS}, gt AS (SELECT video_id AS seq, frame_idx AS t, track_id AS id, x1, y1, x2, y2 FROM tracks),
  pr AS (SELECT video_id AS seq, frame_idx AS t, track_id + CASE WHEN frame_idx % 500 > 450 THEN 40 ELSE 0 END AS id, x1 + CASE WHEN flag = 'R' THEN 6 ELSE 1 END AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM tracks WHERE (track_id + frame_idx) % 9 <> 0),
  met AS (SELECT seq, t, g.id AS a, p.id AS b, greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa FROM gt g JOIN pr p USING (seq, t))"""


def _tubes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(x.select("seq", F.col("id").alias("tube_id"), F.col("t").alias("frame_idx"), "box") for x in tq.sides(spark, d))


def tube_iou(spark: SparkSession, d: str) -> DataFrame:
    return ev.tube_iou(*_tubes(spark, d), ["seq"]).select("seq", "a", "b", R(F.col("spatial")).alias("spatial"), R(F.col("iou")).alias("iou"))


def volume_iou(spark: SparkSession, d: str) -> DataFrame:
    return ev.track_volume_iou(*_tubes(spark, d), ["seq"]).select("seq", "a", "b", R(F.col("iou")).alias("iou"))


def tube_evidence(spark: SparkSession, d: str) -> DataFrame:
    """An event for each true track, whose actor may be that track or the one that has its id on some days."""
    truth, said = _tubes(spark, d)
    tubes = truth.select(F.col("seq").alias("video_id"), F.col("tube_id").alias("event_id"), "frame_idx", "box", F.array(F.col("tube_id"), F.col("tube_id") + 40).alias("track_ids"))
    boxes = said.select(F.col("seq").alias("video_id"), "frame_idx", F.col("tube_id").alias("track_id"), "box")
    return ev.tube_evidence(tubes, boxes, 0.5, 0.6, 0.4).select("video_id", "event_id", "track_id", R(F.col("coverage")).alias("coverage"), R(F.col("mean_iou")).alias("mean_iou"), "passes")


def frame_samples(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each part's clip, of p_size * 7 + 1 frames, in three ways."""
    n = (F.col("p_size") * 7 + 1).cast("bigint")
    made = {"dense": sampling.dense(n, 3, 16, 4, 4), "uniform": sampling.uniform(n, 5), "positions": sampling.positions(n, 6)}
    return vw.table(spark, d, "part").select("p_partkey", *(joined(c).alias(name) for name, c in made.items()))


def smallest_orders(spark: SparkSession, d: str) -> DataFrame:
    o = vw.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.smallest_by_group(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


def padded_windows(spark: SparkSession, d: str) -> DataFrame:
    i = vw.intervals(spark, d).select("interval_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    return sampling.padded_windows(i, 2.5, F.lit(2000.0)).select("interval_id", "window_start", "window_end")


def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = vw.table(spark, d, "part")
    out = sampling.gate_reasons(p, [(F.col("p_size") >= 10, "small"), (F.col("p_retailprice") < 1500, "dear"), (F.col("p_brand") != "Brand#11", "brand")])
    return out.select("p_partkey", joined(F.col("reasons")).alias("reasons"), "eligible")


def next_items(spark: SparkSession, d: str) -> DataFrame:
    """What comes after two cursors, one of them past the end."""
    q = vw.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return catalog.next_after(q, "id", 4).unionAll(catalog.next_after(q, "id", 10**9))


def first_events(spark: SparkSession, d: str) -> DataFrame:
    e = vw.table(spark, d, "events").select((F.col("user_id") % 100).alias("person"), F.col("event_type").alias("event"), "event_id", (F.col("event_id") % 1000).alias("start_frame"))
    out = catalog.first_events(e, ["person"], 5)
    labels = F.array_join(F.transform(F.map_entries("label_counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("person", labels.alias("label_counts"), "n_events", joined(F.col("first_events")).alias("first_events"))


def match_report(spark: SparkSession, d: str) -> DataFrame:
    return catalog.match_report(vw.table(spark, d, "events").select((F.col("event_id") % 77).alias("possession"), (F.col("event_id") % 9).alias("clip"), F.col("user_id").alias("player")))


def stale_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = vw.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("track_id"), (F.col("o_orderkey") % 25).alias("linked_owner"))
    own = vw.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").cast("bigint").alias("owner"))
    return catalog.stale(e, own).select("o_orderkey", "is_stale")


def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    c = vw.table(spark, d, "customer")
    return catalog.fragmentation(c.select(F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") * 10 + F.col("c_custkey") % 7).alias("identity_label"), F.when(F.col("c_custkey") % 3 > 0, "pure").otherwise("mixed").alias("verdict"), F.col("c_custkey").alias("raw_track_id")))


def reused_ids(spark: SparkSession, d: str) -> DataFrame:
    c = vw.table(spark, d, "customer")
    groups = c.select(F.col("c_custkey").alias("member"), ((F.col("c_custkey") + F.col("c_nationkey")) % 40).alias("group"))
    return reg.reused_ids(groups, c.select(F.col("c_custkey").alias("member"), (F.col("c_custkey") % 60).alias("id")))


def player_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier and the one after it, with its clips and one span of time."""
    s = vw.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey") % 3).alias("team"), (F.col("s_suppkey") % 4).alias("number"), F.array(F.col("s_suppkey") % 6, F.col("s_nationkey").cast("bigint") + 100).alias("clips"),
                                                  F.array(F.struct((F.col("s_acctbal") / 100).alias("start"), (F.col("s_acctbal") / 100 + 20).alias("end"))).alias("spans"))
    side = lambda n: s.select(*(F.col(c).alias(f"{c}_{n}") for c in s.columns))
    pairs = side("a").join(side("b"), F.col("k_b") == F.col("k_a") + 1)
    return reg.conflicts(pairs).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), joined(F.col("reasons")).alias("reasons"))


def promoted_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    made = {"n_photos": k % 4, "n_clips": k % 3, "best_track_samples": k % 5, "locked": k % 17 == 0, "established": k % 7 == 0, "number_clips": k % 6 - 2, "nearest_other": F.col("c_acctbal") / 10000, "strong": F.lit(0.6), "strong_identity": k % 11 == 0}
    return reg.promoted(vw.table(spark, d, "customer").select("c_custkey", *(c.alias(n) for n, c in made.items()))).select("c_custkey", joined(F.col("reasons")).alias("reasons"), "promoted")


def anchored_groups(spark: SparkSession, d: str) -> DataFrame:
    """Customers as groups, order priorities as anchors, at distances in whole cents; some are blocked and some equal by identity."""
    cents = F.min(F.round(F.col("o_totalprice") * 100))
    o = vw.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("group"), F.col("o_orderpriority").alias("anchor")).agg(F.when(F.col("o_custkey") % 13 == 0, F.lit(-1.0)).otherwise(cents).alias("distance"))
    o = o.withColumn("blocked", (F.col("group") % 5 == 0) & (F.substring("anchor", 1, 1) == "1"))
    return reg.anchored(o, 1.2e7, 1e6).select("group", "anchor", "distance", "decision")


def block_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = vw.table(spark, d, "part").select("p_partkey", F.when(k % 9 > 0, k % 9 == 4).alias("manual"), F.col("p_brand").alias("label_a"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("none").alias("label_b"), (k % 5).alias("common_frames"), (F.col("p_size") / 50).alias("min_iou"))
    return ident.block_reasons(p, 0.5).select("p_partkey", joined(F.col("reasons")).alias("reasons"))


def sample_quality(spark: SparkSession, d: str) -> DataFrame:
    li = vw.table(spark, d, "lineitem")
    q = v.sampling_quality(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.5), F.col("l_discount") * 2, F.col("l_tax") * 2, F.col("l_quantity") / 100)
    near = lambda c: F.round(c + 1e-9, 4)  # noqa: E731  products of two-place numbers lie on ties of the seventh place
    return li.select("l_orderkey", "l_linenumber", near(q).alias("quality"), near(v.display_quality(q, F.col("l_discount"))).alias("display"))


def part_distances(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last eight numbers of each vector as two bodies of four parts."""
    e = vw.features(spark, d)
    parts = lambda at: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", at + k * 2, 2), lambda x: x.cast("double")))
    seen = lambda m: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((F.col("vec_id") + k * m) % 3).cast("double") / 2)
    return e.select("vec_id", R(v.part_distance(parts(F.lit(1)), parts(F.size("embedding") - 7), seen(1), seen(2))).alias("distance"))


def span_targets(spark: SparkSession, d: str) -> DataFrame:
    """Regression targets of an interval against an anchor, taken back to the interval."""
    i = vw.intervals(spark, d)
    a, b, s, e = F.floor(F.col("start") / 10) * 10.0, F.floor(F.col("start") / 10) * 10.0 + 8, F.col("start"), F.col("end")
    x, y = g.span_to_xw(a, b, s, e), g.span_to_se(a, b, s, e)
    p, q = g.xw_to_span(a, b, x["dx"], x["dw"]), g.se_to_span(a, b, y["ds"], y["de"])
    made = {"from_centre": p["start"], "to_centre": p["end"], "from_ends": q["start"], "to_ends": q["end"]}
    return i.select("interval_id", *(R(c).alias(n) for n, c in made.items()))


def skeleton_streams(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a vector as 17 joints, the next vector as the next frame: bones, and how far joints move."""
    e = vw.features(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
    joints = lambda c: F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.array(F.get(c, j * 2), F.get(c, j * 2 + 1)))
    own = e.select("vec_id", joints(F.col("_e")).alias("_a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), joints(F.col("_e")).alias("_b")), "vec_id")
    body = own.select("vec_id", F.array(F.array("_a", "_b")).alias("k"))
    flat = body.select("vec_id", F.posexplode(F.arrays_zip(sk.bones(F.col("k"), "coco")[0][0].alias("b"), sk.motion(F.col("k"), "coco")[0][0].alias("m"))).alias("joint", "x"))
    return flat.select("vec_id", "joint", R(F.col("x.b")[0]).alias("bone_x"), R(F.col("x.b")[1]).alias("bone_y"), R(F.col("x.m")[0]).alias("move_x"), R(F.col("x.m")[1]).alias("move_y"))


def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a curve of steps of half a second, with a proposal of its own."""
    e = vw.features(spark, d)
    start = F.col("vec_id") % 7 * 1.5
    made = det.boundary_features(F.col("embedding"), F.lit(0.5), start, start + 4 + F.col("vec_id") % 11)
    return e.select("vec_id", F.posexplode(made).alias("place", "value")).select("vec_id", "place", R(F.col("value")).alias("value"))


def covering_windows(spark: SparkSession, d: str) -> DataFrame:
    """Six windows of each customer's orders, of a month each, from strata of a year; open orders are not clear."""
    i = vw.intervals(spark, d)
    w = i.select("actor", F.floor(F.col("start") / 365).alias("stratum"), F.col("interval_id").alias("window"), "start", (F.col("start") + 30).alias("end"), "score", (F.col("side") != "P").alias("clear"))
    return sampling.covering_windows(w, ["actor"], 6).select("actor", "window", "start", "end", "enough")


def centre_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = g.from_centre(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1, F.col("l_linenumber").cast("double"))
    return vw.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(R(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")))


def recall_area(spark: SparkSession, d: str) -> DataFrame:
    """Area under the orders' share of customers by nation, over few points."""
    n = vw.table(spark, d, "customer").groupBy((F.col("c_nationkey") / 25.0).alias("x")).agg((F.count("*") / 1.0).alias("y"))
    return evl.trapezoid(n, "x", "y").select(R(F.col("auc")).alias("auc"))


reason = lambda *tests: "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + ")"

QUERIES = {
    "tube_iou": (tube_iou, f"""WITH {SIDES}, s AS (SELECT seq, a, b, avg(i / (ga + pa - i)) AS sp FROM met GROUP BY 1, 2, 3), ea AS (SELECT seq, id, min(t) AS s, max(t) AS e FROM gt GROUP BY 1, 2), eb AS (SELECT seq, id, min(t) AS s, max(t) AS e FROM pr GROUP BY 1, 2)
      SELECT s.seq, a, b, round(sp, 6) AS spatial, round(sp * CASE WHEN greatest(ea.e, eb.e) > least(ea.s, eb.s) THEN greatest(0, least(ea.e, eb.e) - greatest(ea.s, eb.s)) / (greatest(ea.e, eb.e) - least(ea.s, eb.s))::DOUBLE ELSE 0 END, 6) AS iou FROM s JOIN ea ON ea.seq = s.seq AND ea.id = a JOIN eb ON eb.seq = s.seq AND eb.id = b"""),
    "track_volume_iou": (volume_iou, f"""WITH {SIDES}, s AS (SELECT seq, a, b, sum(i) AS i FROM met GROUP BY 1, 2, 3), ea AS (SELECT seq, id, sum((x2 - x1) * (y2 - y1)) AS n FROM gt GROUP BY 1, 2), eb AS (SELECT seq, id, sum((x2 - x1) * (y2 - y1)) AS n FROM pr GROUP BY 1, 2)
      SELECT s.seq, a, b, round(i / (ea.n + eb.n - i), 6) AS iou FROM s JOIN ea ON ea.seq = s.seq AND ea.id = a JOIN eb ON eb.seq = s.seq AND eb.id = b"""),
    "tube_evidence": (tube_evidence, f"""WITH {SIDES}, x AS (SELECT seq, t, id, unnest([id, id + 40]) AS k FROM gt), j AS (SELECT x.seq, x.id, x.k, coalesce(i / (ga + pa - i), 0) AS u FROM x LEFT JOIN met m ON m.seq = x.seq AND m.t = x.t AND m.a = x.id AND m.b = x.k),
      s AS (SELECT seq, id, k, avg((u >= 0.5)::INT::DOUBLE) AS c, avg(u) AS m FROM j GROUP BY 1, 2, 3) SELECT seq AS video_id, id AS event_id, k AS track_id, round(c, 6) AS coverage, round(m, 6) AS mean_iou, c >= 0.6 AND m >= 0.4 AS passes FROM s QUALIFY row_number() OVER (PARTITION BY seq, id ORDER BY c >= 0.6 AND m >= 0.4 DESC, c DESC, m DESC, k) = 1"""),
    "frame_samples": (frame_samples, """WITH p AS (SELECT p_partkey, (p_size * 7 + 1)::BIGINT AS n FROM part),
      l AS (SELECT p_partkey, n, flatten(list_transform(range(0, 3), lambda i: list_transform(range(0, 4), lambda k: (floor(greatest(0, n - 16) * i / 2)::BIGINT + k * 4) % n))) AS a, list_transform(range(0, 5), lambda i: floor((i + 0.5) * n / 5)::BIGINT) AS b,
        list_transform(range(0, least(n, 6)), lambda i: CASE WHEN least(n, 6) > 1 THEN round(i * (n - 1) / (least(n, 6) - 1)::DOUBLE)::BIGINT ELSE 0 END) AS c FROM p)
      SELECT p_partkey, array_to_string(a, ',') AS dense, array_to_string(b, ',') AS uniform, array_to_string(c, ',') AS positions FROM l"""),
    "smallest_orders": (smallest_orders, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3"),
    "padded_windows": (padded_windows, f"""WITH {vw.INTERVALS} SELECT interval_id, greatest(0.0, "start" - 2.5)::DOUBLE AS window_start, least(2000.0, "end" + 2.5)::DOUBLE AS window_end FROM intervals"""),
    "gate_reasons": (gate_reasons, f"WITH r AS (SELECT p_partkey, {reason(('p_size < 10', 'small'), ('p_retailprice >= 1500', 'dear'), (chr(39).join(('p_brand = ', 'Brand#11', '')), 'brand'))} AS reasons FROM part) SELECT p_partkey, reasons, reasons = '' AS eligible FROM r"),
    "next_items": (next_items, "SELECT min(s_suppkey) AS id FROM supplier WHERE s_suppkey > 4 UNION ALL SELECT min(s_suppkey) FROM supplier"),
    "first_events": (first_events, """WITH e AS (SELECT user_id % 100 AS person, event_type AS event, event_id, event_id % 1000 AS f FROM events), k AS (SELECT person, string_agg(event || '=' || n::VARCHAR, ',' ORDER BY event) AS label_counts, sum(n)::BIGINT AS n_events FROM (SELECT person, event, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
      h AS (SELECT person, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS first_events FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY f, event_id) AS n FROM e) WHERE n <= 5 GROUP BY 1) SELECT person, label_counts, n_events, first_events FROM k JOIN h USING (person)"""),
    "match_report": (match_report, "SELECT count(DISTINCT event_id % 77) AS possessions, count(DISTINCT event_id % 9) AS clips, count(DISTINCT user_id) AS players, count(*) AS events FROM events"),
    "stale_evidence": (stale_evidence, "SELECT o_orderkey, c_nationkey IS DISTINCT FROM o_orderkey % 25 AS is_stale FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey"),
    "fragmentation": (fragmentation, "WITH b AS (SELECT c_nationkey * 10 + c_custkey % 7 AS k, count(DISTINCT c_custkey) AS n FROM customer WHERE c_nationkey > 2 AND c_custkey % 3 > 0 GROUP BY 1) SELECT count(*) AS identities, sum(n - 1)::BIGINT AS extra_tracks, max(n) AS most_tracks FROM b"),
    "reused_ids": (reused_ids, """WITH m AS (SELECT (c_custkey + c_nationkey) % 40 AS g, c_custkey % 60 AS id, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT c_custkey % 60 AS id, count(*) AS z FROM customer GROUP BY 1), o AS (SELECT m.*, z FROM m JOIN s USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, g) = 1)
      SELECT g AS "group", id FROM o QUALIFY row_number() OVER (PARTITION BY g ORDER BY z DESC, id) = 1"""),
    "player_conflicts": (player_conflicts, f"""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey % 3 END AS team, s_suppkey % 4 AS number, [s_suppkey % 6, s_nationkey + 100] AS clips, s_acctbal / 100 AS s, s_acctbal / 100 + 20 AS e FROM supplier)
      SELECT a.k AS a, b.k AS b, {reason(('a.team <> b.team', 'teams'), ('a.number <> b.number', 'numbers'), ('list_has_any(a.clips, b.clips)', 'same_clip'), ('a.s < b.e AND b.s < a.e', 'same_time'))} AS reasons FROM s a JOIN s b ON b.k = a.k + 1"""),
    "promoted_groups": (promoted_groups, f"""WITH c AS (SELECT c_custkey AS k, c_acctbal FROM customer), r AS (SELECT k, {reason(('NOT ((k % 4 >= 2 AND k % 3 >= 2) OR k % 5 >= 2 OR k % 17 = 0)', 'too_few_samples'), ('NOT (k % 7 = 0 OR k % 17 = 0 OR k % 6 - 2 >= 2 OR c_acctbal / 10000 > 0.6 OR k % 11 = 0)', 'not_backed'))} AS reasons FROM c)
      SELECT k AS c_custkey, reasons, reasons = '' AS promoted FROM r"""),
    "anchored_groups": (anchored_groups, """WITH o AS (SELECT o_custkey AS g, o_orderpriority AS a, CASE WHEN o_custkey % 13 = 0 THEN -1.0 ELSE min(round(o_totalprice * 100)) END::DOUBLE AS d FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS nx FROM o WHERE NOT (g % 5 = 0 AND a[1] = '1') WINDOW w AS (PARTITION BY g ORDER BY d, a)),
      x AS (SELECT *, CASE WHEN d > 1.2e7 THEN 'new' WHEN (nx IS NOT NULL AND d >= 0 AND nx - d < 1e6) OR coalesce(nx = -1, false) THEN 'abstain' ELSE 'join' END AS decision FROM r WHERE n = 1) SELECT g AS "group", CASE WHEN decision = 'join' THEN a END AS anchor, d AS distance, decision FROM x"""),
    "block_reasons": (block_reasons, f"SELECT p_partkey, {reason(('p_partkey % 9 = 4', 'manual_cannot_link'), ('p_partkey % 3 <> 0', 'different_labels'), ('p_partkey % 5 > 0 AND p_size / 50 < 0.5', 'seen_together'))} AS reasons FROM part"),
    "sample_quality": (sample_quality, """WITH q AS (SELECT l_orderkey, l_linenumber, l_discount, (0.30::DOUBLE * l_discount + 0.25::DOUBLE * l_tax + 0.15::DOUBLE * (l_quantity / 50) + 0.15::DOUBLE * 0.5::DOUBLE + 0.10::DOUBLE * (l_discount * 2) + 0.05::DOUBLE * (l_tax * 2)) * (1 - 0.5::DOUBLE * (l_quantity / 100)) AS q FROM lineitem)
      SELECT l_orderkey, l_linenumber, round(q + 1e-9::DOUBLE, 4) AS quality, round(q - 0.35::DOUBLE * l_discount + 1e-9::DOUBLE, 4) AS display FROM q"""),
    "part_distances": (part_distances, """WITH x AS (SELECT vec_id, unnest(range(0, 4)) AS k, embedding AS e FROM embeddings), y AS (SELECT vec_id, sqrt(((vec_id + k) % 3) / 2.0::DOUBLE * (((vec_id + k * 2) % 3) / 2.0::DOUBLE)) AS w, sqrt((e[1 + k * 2]::DOUBLE - e[len(e) - 7 + k * 2]::DOUBLE) ** 2 + (e[2 + k * 2]::DOUBLE - e[len(e) - 6 + k * 2]::DOUBLE) ** 2) AS d FROM x)
      SELECT vec_id, CASE WHEN count(*) FILTER (w > 0) >= 2 THEN round(sum(w * d) / sum(w) / 2, 6) END AS distance FROM y GROUP BY 1"""),
    "span_targets": (span_targets, f"""WITH {vw.INTERVALS} SELECT interval_id, round("start", 6) AS from_centre, round("end", 6) AS to_centre, round("start", 6) AS from_ends, round("end", 6) AS to_ends FROM intervals"""),
    "skeleton_streams": (skeleton_streams, f"""WITH j AS (SELECT vec_id, unnest(range(0, 17)) AS joint, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT *, {sk.PARENTS["coco"]}[joint + 1] AS up FROM j)
      SELECT p.vec_id, p.joint::INT AS joint, round(p.e[joint * 2 + 1] - p.e[up * 2 + 1], 6) AS bone_x, round(p.e[joint * 2 + 2] - p.e[up * 2 + 2], 6) AS bone_y, round(n.embedding[joint * 2 + 1]::DOUBLE - p.e[joint * 2 + 1], 6) AS move_x, round(n.embedding[joint * 2 + 2]::DOUBLE - p.e[joint * 2 + 2], 6) AS move_y
      FROM p JOIN embeddings n ON n.vec_id = p.vec_id + 1"""),
    "boundary_features_k": (boundary_features, None),
    "covering_windows_k": (covering_windows, None),
    "centre_boxes": (centre_boxes, "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS cx, l_discount * 100 AS cy, l_tax * 100 + 1 AS w, l_linenumber::DOUBLE AS h FROM lineitem) SELECT l_orderkey, l_linenumber, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM b"),
    "recall_area": (recall_area, "WITH n AS (SELECT c_nationkey / 25.0::DOUBLE AS x, count(*)::DOUBLE AS y FROM customer GROUP BY 1), a AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM n) SELECT round(sum(a), 6) AS auc FROM a"),
}

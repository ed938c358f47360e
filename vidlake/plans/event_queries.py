"""Queries on action points and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions import values as v
from vidlake.operators import events as ev
from vidlake.operators import identity as ident
from vidlake.operators import segmentation as seg
from vidlake.plans import views as vw

R = lambda c, n=6: F.round(c, n)


def _video() -> Column:
    """The video of an event."""
    return F.format_string("V%d", F.col("identity") % 20)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_intervals(vw.action_points(spark, d), vw.FPS, 60, vw.MINUTES)


def event_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).select("identity", "event", "start_frame", "end_frame", R(F.col("start")).alias("start"), R(F.col("end")).alias("end"), R(F.col("raw_score")).alias("raw_score"), "support_count", F.array_join(F.col("raw_track_ids").cast("array<string>"), ",").alias("track_ids"))


RUNS = f"""{vw.ACTION_POINTS},
best AS (SELECT * FROM action_points WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY identity, event, frame_idx ORDER BY score DESC, row_seq) = 1),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY identity, event ORDER BY frame_idx) AS run FROM (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY identity, event ORDER BY frame_idx) <= 120 THEN 0 ELSE 1 END AS fresh FROM best)),
made AS (SELECT identity, event, greatest(0, min(frame_idx) - 30) AS start_frame, least(max(frame_idx) + 29, 43200) AS end_frame, avg(score) AS raw_score, median(score) AS mid_score, max(score) AS top_score, count(*) AS support_count,
  array_to_string(list_sort(list_distinct(list(raw_track_id))), ',') AS track_ids FROM runs GROUP BY identity, event, run)"""


def event_ids(spark: SparkSession, d: str) -> DataFrame:
    return ev.numbered_events(_intervals(spark, d).filter("support_count >= 2"), _video()).select("event_id", "identity", "event", "start_frame", "end_frame")


def reducers(spark: SparkSession, d: str) -> DataFrame:
    p = vw.action_points(spark, d)
    keys = ["identity", "event", "start_frame"]
    made = [ev.event_intervals(p, vw.FPS, 60, vw.MINUTES, reducer=r).select(*keys, R(F.col("raw_score")).alias(f"{r}_score")) for r in ("mean", "median", "max")]
    return made[0].join(made[1], keys).join(made[2], keys)


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a record with candidates of its type and a second one, the chosen again among the selected."""
    e = vw.table(spark, d, "events")
    cand = lambda label, score: F.struct(label.alias("label"), score.alias("score"))
    r = e.select("event_id", F.array(cand(F.col("event_type"), F.col("value")), cand(F.lit("click"), F.col("value") / 2)).alias("action_candidates"), F.array(cand(F.col("event_type"), F.col("value") + 1)).alias("selected_actions"))
    return ev.ranked_actions(r).select("event_id", "event", R(F.col("score")).alias("score"))


def cadence_gcd(spark: SparkSession, d: str) -> DataFrame:
    return ev.cadence(vw.action_points(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 10) * 6), ["identity"])


def fps_median(spark: SparkSession, d: str) -> DataFrame:
    p = vw.action_points(spark, d).withColumn("t", F.col("frame_idx") * 1.5 + F.col("row_seq") % 2)
    return ev.frame_rate(p.groupBy("identity", "frame_idx").agg(F.min("t").alias("t")), ["identity"], "frame_idx", "t").select("identity", R(F.col("fps")).alias("fps"))


def _map(spark: SparkSession, d: str) -> DataFrame:
    return vw.table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("raw_track_id"), F.col("c_name").alias("person_id"))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return vw.table(spark, d, "events").select("event_id", F.col("user_id").alias("raw_track_id"), "event_type")


MAP = "m AS (SELECT c_custkey AS raw_track_id, c_name AS person_id FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT event_id, user_id AS raw_track_id, event_type FROM events)"


def quality_semi(spark: SparkSession, d: str) -> DataFrame:
    kept = vw.table(spark, d, "customer").select(F.col("c_custkey").alias("raw_track_id"), (F.col("c_acctbal") > 0).alias("kept"))
    return ev.keep_accepted(_actions(spark, d), kept, ["raw_track_id"])


def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    p = vw.action_points(spark, d)
    left = p.filter("event = 'click'").select("identity", "frame_idx", "row_seq")
    right = p.filter("event = 'view'").groupBy("identity", "frame_idx").agg(F.max("score").alias("score"))
    out = ev.gated_nearest(left, right, ["identity"], "frame_idx", 600, "score", 0.1)
    return out.select("row_seq", "matched_frame_idx", R(F.col("matched_score")).alias("matched_score"))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    i = vw.intervals(spark, d).withColumn("actor", F.col("actor") % 40)
    """Orders with an even key against those with an odd one."""
    a, b = i.filter("interval_id % 2 = 0"), i.filter("interval_id % 2 = 1")
    cols = ["label", "actor", "interval_id", "start", "end"]
    out = ev.overlapping(a.select(*cols), b.select(*cols), ["label", "actor"], 8.0, 0.2)
    return out.select("actor", "label", "a_interval_id", "b_interval_id", R(F.col("tiou")).alias("tiou"))


def point_in_range(spark: SparkSession, d: str) -> DataFrame:
    r = vw.intervals(spark, d).select(F.col("label").alias("stage"), "interval_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    p = vw.intervals(spark, d).select(F.col("label").alias("stage"), F.col("interval_id").alias("point_id"), F.col("start").alias("at"))
    return ev.near_ranges(p, r, ["stage"], 2.0, 3.0).select("stage", "point_id", "interval_id")


def owner_unanimous(spark: SparkSession, d: str) -> DataFrame:
    e = vw.table(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("event_id"), F.col("o_custkey").alias("track_id")).groupBy("event_id").agg(F.collect_set("track_id").alias("track_ids"))
    own = vw.table(spark, d, "customer").filter("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("track_id"), F.when(F.col("c_nationkey") < 22, "home").otherwise("guest").alias("owner"))
    return ev.unanimous_owner(e, own)


def to_source_time(spark: SparkSession, d: str) -> DataFrame:
    e = _intervals(spark, d).filter("support_count >= 2").select("identity", "event", (F.col("identity") % 25).alias("clip"), "start", "end")
    clips = vw.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("clip"), (F.col("n_nationkey") * 100.0).alias("clip_start"), (F.col("n_nationkey") * 100.0 + 1500).alias("clip_end"))
    return ev.to_source_time(e, clips).select("identity", "event", "clip", R(F.col("source_start")).alias("source_start"), R(F.col("source_end")).alias("source_end"))


def hop_windows(spark: SparkSession, d: str) -> DataFrame:
    c = vw.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97).cast("double").alias("duration"))
    return c.select("c_custkey", F.posexplode(seg.hop_windows(F.col("duration"), 20.0, 14.0)).alias("window", "_w")).select("c_custkey", F.col("window").cast("bigint").alias("window"), F.col("_w.start").cast("double").alias("start"), F.col("_w.end").alias("end"))


def hop_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return seg.windows_of(vw.action_points(spark, d).select("event", F.col("frame_idx").alias("t")), "t", 200, 140).groupBy("event", "window_start").agg(F.count("*").alias("n"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    p = vw.action_points(spark, d).withColumn("team", F.when(F.col("event") == "signup", "dark").when(F.col("event") == "purchase", "light"))
    return seg.carried(p, ["identity"], "row_seq", "team", "last_team").select("row_seq", "last_team")


def team_changes(spark: SparkSession, d: str) -> DataFrame:
    p = vw.action_points(spark, d).withColumn("team", F.when(F.col("event") == "signup", "dark").when(F.col("event") == "purchase", "light"))
    return seg.changes(p, ["identity"], "row_seq", "team").select("row_seq", "previous", "team")


def bucket_best(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators.tracks import best_in_bucket

    return best_in_bucket(vw.action_points(spark, d).select("identity", "frame_idx", "score", "row_seq"), ["identity"], F.col("row_seq"), F.col("score"), 500.0, 8).select("identity", "row_seq", F.col("bucket").cast("bigint").alias("bucket"), F.col("rank").cast("bigint").alias("rank"))


def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    day = vw.action_points(spark, d).groupBy("event", F.floor(F.col("frame_idx") / 1440).alias("day")).agg(F.count("*").alias("n"))
    return seg.peaks(day, ["event"], "day", "n", 0.9)


def number_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a track's own number, of which a third of the tracks have another now and then and a fifth none."""
    track = F.col("user_id")
    said = F.when(track % 5 == 4, F.lit("?")).when((track % 3 == 0) & (F.col("event_id") % 11 == 0), (F.col("event_id") % 7).cast("string")).otherwise((track % 60).cast("string"))
    e = vw.table(spark, d, "events").select(track.alias("track"), v.jersey_number(said).alias("number"), (F.col("event_id") / 100.0).alias("timestamp_s"))
    return ident.number_consensus(e, "track", 5.0)


def props_json(spark: SparkSession, d: str) -> DataFrame:
    e = vw.table(spark, d, "events")
    return e.select("event_id", v.reading(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "k bigint")["k"].alias("k"), v.jersey_number(v.reading(F.col("props"), "k bigint")["k"].cast("string")).alias("number"))


def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    return vw.table(spark, d, "part").select("p_partkey", v.canonical_label(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" _ "), F.col("p_brand"))).alias("label"), v.safe_slug(F.concat("p_name", F.lit(" / "), F.col("p_brand"))).alias("slug"), v.track_uid(F.col("p_brand"), F.col("p_size")).alias("uid"), v.content_id("CL-", F.col("p_name"), F.col("p_size")).alias("clip_id"))


def player_events(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators import catalog

    e = ev.numbered_events(_intervals(spark, d), _video()).withColumn("player", F.col("identity") % 40)
    return catalog.player_events(e, 8, min_score=0.3).select("event_id", "identity", "event", "start_frame")


def export_plan(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators import catalog

    e = _intervals(spark, d).filter("support_count >= 3")
    return catalog.export_windows(e, ["identity", "event"], 2.0, F.lit(1700.0)).select("identity", "event", R(F.col("from_s")).alias("from_s"), R(F.col("to_s")).alias("to_s"))


def sampled_strata(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators import sampling

    c = vw.table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 40 + 100).cast("bigint").alias("frames"))
    return c.select("n_nationkey", F.posexplode(sampling.untrimmed(F.col("frames"), 32)).alias("clip", "centre")).select("n_nationkey", F.col("clip").cast("bigint").alias("clip"), F.col("centre").cast("bigint").alias("centre"))


def clip_indices(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators import sampling

    c = vw.table(spark, d, "part").select("p_partkey", "p_size")
    w = sampling.clip_window(F.col("p_size").cast("bigint"), 16, 2, F.lit(50))
    return c.select("p_partkey", F.array_join(w["frames"].cast("array<string>"), ",").alias("frames"), w["padded"].alias("padded"))


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators import sampling

    o = sampling.smoothed(vw.table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 5)
    return o.select("o_orderkey", R(F.col("average"), 4).alias("mean5"), R(F.col("median"), 4).alias("median5"), R(F.col("overall"), 4).alias("overall"))


QUERIES = {
    "event_intervals": (event_intervals, f"WITH {RUNS} SELECT identity, event, start_frame, end_frame, round(start_frame / 25.0, 6)::DOUBLE AS \"start\", round((end_frame + 1) / 25.0, 6)::DOUBLE AS \"end\", round(raw_score, 6) AS raw_score, support_count, track_ids FROM made"),
    "event_ids": (event_ids, f"WITH {RUNS} SELECT printf('V%d:E%05d', identity % 20, row_number() OVER (PARTITION BY identity % 20 ORDER BY start_frame, end_frame, identity, event)) AS event_id, identity, event, start_frame, end_frame FROM made WHERE support_count >= 2"),
    "score_reducers": (reducers, f"WITH {RUNS} SELECT identity, event, start_frame, round(raw_score, 6) AS mean_score, round(mid_score, 6) AS median_score, round(top_score, 6) AS max_score FROM made"),
    "ranked_actions": (ranked, "SELECT event_id, event, round(max(s), 6) AS score FROM (SELECT event_id, event_type AS event, value + 1 AS s FROM events UNION ALL SELECT event_id, 'click', value / 2 FROM events) GROUP BY 1, 2"),
    "cadence_gcd": (cadence_gcd, f"WITH {vw.ACTION_POINTS}, f AS (SELECT DISTINCT identity, (frame_idx // 10) * 6 AS f FROM action_points), s AS (SELECT identity, f - lag(f) OVER (PARTITION BY identity ORDER BY f) AS d FROM f) SELECT identity, CASE WHEN count(d) > 0 THEN list_reduce(list(d) FILTER (d IS NOT NULL), lambda a, b: gcd(a, b)) END AS cadence FROM s GROUP BY identity"),
    "fps_median": (fps_median, f"WITH {vw.ACTION_POINTS}, p AS (SELECT identity, frame_idx, min(frame_idx * 1.5 + row_seq % 2)::DOUBLE AS t FROM action_points GROUP BY 1, 2), s AS (SELECT identity, (frame_idx - lag(frame_idx) OVER w) / nullif(t - lag(t) OVER w, 0) AS r FROM p WINDOW w AS (PARTITION BY identity ORDER BY frame_idx, t)) SELECT identity, round(median(r), 6) AS fps FROM s GROUP BY identity"),
    "link_actions_left": (lambda s, d: ev.link_people(_actions(s, d), _map(s, d), True), f"WITH {MAP} SELECT raw_track_id, event_id, event_type, person_id FROM a LEFT JOIN m USING (raw_track_id)"),
    "link_actions_inner": (lambda s, d: ev.link_people(_actions(s, d), _map(s, d), False), f"WITH {MAP} SELECT raw_track_id, event_id, event_type, person_id FROM a JOIN m USING (raw_track_id)"),
    "unmapped_anti": (lambda s, d: ev.unmapped(_actions(s, d), _map(s, d)), f"WITH {MAP} SELECT raw_track_id, event_id, event_type FROM a ANTI JOIN m USING (raw_track_id)"),
    "quality_semi": (quality_semi, f"WITH {MAP} SELECT raw_track_id, event_id, event_type FROM a WHERE raw_track_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "nearest_asof": (nearest_asof, f"""WITH {vw.ACTION_POINTS}, r AS (SELECT identity, frame_idx, max(score) AS score FROM action_points WHERE event = 'view' GROUP BY 1, 2),
      j AS (SELECT l.row_seq, r.frame_idx AS f, r.score AS s, row_number() OVER (PARTITION BY l.row_seq ORDER BY abs(r.frame_idx - l.frame_idx), r.frame_idx) AS n FROM action_points l LEFT JOIN r ON r.identity = l.identity AND abs(r.frame_idx - l.frame_idx) <= 600 WHERE l.event = 'click')
      SELECT row_seq, CASE WHEN s >= 0.1 THEN f END AS matched_frame_idx, CASE WHEN s >= 0.1 THEN round(s, 6) END AS matched_score FROM j WHERE n = 1"""),
    "interval_overlap": (interval_overlap, f"""WITH {vw.INTERVALS}, i AS (SELECT * REPLACE (actor % 40 AS actor) FROM intervals), p AS (SELECT a.actor, a.label, a.interval_id AS a_interval_id, b.interval_id AS b_interval_id, (least(a."end", b."end") - greatest(a."start", b."start")) / (greatest(a."end", b."end") - least(a."start", b."start")) AS t
      FROM i a JOIN i b ON a.actor = b.actor AND a.label = b.label AND a."start" < b."end" AND b."start" < a."end" WHERE a.interval_id % 2 = 0 AND b.interval_id % 2 = 1) SELECT actor, label, a_interval_id, b_interval_id, round(t, 6) AS tiou FROM p WHERE t >= 0.2"""),
    "point_in_range": (point_in_range, f"""WITH {vw.INTERVALS} SELECT p.label AS stage, p.interval_id AS point_id, r.interval_id FROM intervals p JOIN intervals r ON p.label = r.label AND p."start" BETWEEN r."start" - 2 AND r."end" + 2 WHERE r."end" - r."start" <= 3"""),
    "owner_unanimous": (owner_unanimous, """WITH e AS (SELECT o_orderkey % 3000 AS event_id, list_distinct(list(o_custkey)) AS ids FROM orders GROUP BY 1), t AS (SELECT event_id, unnest(ids) AS t FROM e),
      j AS (SELECT event_id, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_nationkey < 22 THEN 'home' ELSE 'guest' END AS o FROM t LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 <> 0) ON c_custkey = t) SELECT event_id, CASE WHEN count(*) = count(o) AND min(o) = max(o) THEN min(o) END AS owner FROM j GROUP BY 1"""),
    "to_source_time": (to_source_time, f"""WITH {RUNS}, s AS (SELECT identity, event, identity % 25 AS clip, (identity % 25) * 100.0::DOUBLE + start_frame / 25.0::DOUBLE AS a, least((identity % 25) * 100.0::DOUBLE + (end_frame + 1) / 25.0::DOUBLE, (identity % 25) * 100.0::DOUBLE + 1500) AS b FROM made WHERE support_count >= 2)
      SELECT identity, event, clip, round(a, 6) AS source_start, round(b, 6) AS source_end FROM s WHERE b > a"""),
    "hop_windows": (hop_windows, "WITH c AS (SELECT c_custkey, (c_custkey % 97)::DOUBLE AS d FROM customer), w AS (SELECT c_custkey, d, unnest(range(0, (greatest(0, ceil((d - 20) / 14)) + 1)::BIGINT)) AS k FROM c) SELECT c_custkey, k AS \"window\", (k * 14)::DOUBLE AS \"start\", least(k * 14 + 20, d)::DOUBLE AS \"end\" FROM w"),
    "hop_window_counts": (hop_window_counts, f"WITH {vw.ACTION_POINTS}, w AS (SELECT event, unnest(range(greatest(0, floor((frame_idx - 200) / 140)::BIGINT + 1), frame_idx // 140 + 1)) * 140 AS window_start FROM action_points) SELECT event, window_start, count(*) AS n FROM w GROUP BY 1, 2"),
    "carry_forward": (carry_forward, f"WITH {vw.ACTION_POINTS}, t AS (SELECT *, CASE event WHEN 'signup' THEN 'dark' WHEN 'purchase' THEN 'light' END AS team FROM action_points) SELECT row_seq, last_value(team IGNORE NULLS) OVER (PARTITION BY identity ORDER BY row_seq ROWS UNBOUNDED PRECEDING) AS last_team FROM t"),
    "team_changes": (team_changes, f"WITH {vw.ACTION_POINTS}, t AS (SELECT *, CASE event WHEN 'signup' THEN 'dark' WHEN 'purchase' THEN 'light' END AS team FROM action_points), p AS (SELECT *, last_value(team IGNORE NULLS) OVER (PARTITION BY identity ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM t) SELECT row_seq, previous, team FROM p WHERE team <> previous"),
    "bucket_best": (bucket_best, f"WITH {vw.ACTION_POINTS}, b AS (SELECT identity, row_seq, score, row_seq // 500 AS bucket FROM action_points QUALIFY row_number() OVER (PARTITION BY identity, row_seq // 500 ORDER BY score DESC, row_seq) = 1) SELECT identity, row_seq, bucket, rank FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY score DESC, row_seq) AS rank FROM b) WHERE rank <= 8"),
    "local_peaks": (local_peaks, f"WITH {vw.ACTION_POINTS}, d AS (SELECT event, frame_idx // 1440 AS day, count(*) AS n FROM action_points GROUP BY 1, 2), w AS (SELECT *, lag(n) OVER (PARTITION BY event ORDER BY day) AS b, lead(n) OVER (PARTITION BY event ORDER BY day) AS a, max(n) OVER (PARTITION BY event) AS m FROM d) SELECT event, day, n FROM w WHERE (n > b AND n > a) OR n > 0.9 * m OR b IS NULL OR a IS NULL"),
    "number_consensus": (number_consensus, None),
    "props_json": (props_json, "SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN regexp_full_match(props->>'k', '0|00|[1-9][0-9]?') THEN props->>'k' END AS number FROM events"),
    "canonical_labels": (canonical_labels, """SELECT p_partkey, regexp_replace(lower(trim('  ' || upper(p_name) || ' _ ' || p_brand)), '[\\s_]+', '_', 'g') AS label, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      p_brand || ':T' || lpad(p_size::VARCHAR, 4, '0') AS uid, 'CL-' || sha256(p_name || chr(31) || p_size::VARCHAR)[1:20] AS clip_id FROM part"""),
    "player_events": (player_events, f"WITH {RUNS}, n AS (SELECT *, printf('V%d:E%05d', identity % 20, row_number() OVER (PARTITION BY identity % 20 ORDER BY start_frame, end_frame, identity, event)) AS event_id FROM made) SELECT event_id, identity, event, start_frame FROM n WHERE identity % 40 = 8 AND raw_score >= 0.3"),
    "export_plan": (export_plan, f"WITH {RUNS} SELECT identity, event, round(greatest(0, start_frame / 25.0::DOUBLE - 2), 6)::DOUBLE AS from_s, round(least(1700, (end_frame + 1) / 25.0::DOUBLE + 2), 6)::DOUBLE AS to_s FROM made WHERE support_count >= 3 QUALIFY row_number() OVER (PARTITION BY identity, event ORDER BY raw_score DESC, start_frame) = 1"),
    "untrimmed_centres": (sampled_strata, "WITH c AS (SELECT n_nationkey, unnest(range(16, n_nationkey * 40 + 100, 32)) AS centre FROM nation) SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY centre) - 1 AS clip, centre FROM c"),
    "clip_indices": (clip_indices, "WITH f AS (SELECT p_partkey, p_size, list_transform(range(0, 16), lambda i: p_size + (i - 8) * 2) AS raw FROM part) SELECT p_partkey, array_to_string(list_transform(raw, lambda x: greatest(0, least(49, x))), ',') AS frames, list_min(raw) < 0 OR list_max(raw) > 49 AS padded FROM f"),
    "windowed_smoothing": (smoothed, "SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS mean5, round(median(o_totalprice) OVER w, 4) AS median5, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS overall FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
}

"""Queries of the gallery plan: vectors as pictures of players in matches of a hundred observations each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators import gallery as gal
from vidlake.plans import views as vw

R = lambda c, n=6: F.round(c, n)


def templates(spark: SparkSession, d: str) -> DataFrame:
    """One picture for each vector, a second for odd ones; five vectors in a row look alike, as the first of them is mixed in."""
    e = vw.features(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    base = e.select(F.col("vec_id").alias("_b"), F.col("own").alias("base"))
    after = e.select((F.col("vec_id") - 1).alias("_b"), F.col("own").alias("next"))
    rows = e.join(base, F.col("_b") == F.col("vec_id") - F.col("vec_id") % 5).drop("_b")
    mix = lambda other: F.zip_with("base", other, lambda x, y: 0.8 * x + 0.2 * y)
    one = rows.select("vec_id", F.lit("a").alias("key"), mix("own").alias("feature"))
    two = rows.filter("vec_id % 2 = 1").join(after, F.col("_b") == F.col("vec_id")).select("vec_id", F.lit("b").alias("key"), mix("next").alias("feature"))
    made = one.unionByName(two).select(F.floor(F.col("vec_id") / 100).alias("scope"), F.col("vec_id").alias("obs"), "key", "feature")
    worth = (F.col("obs") * 7 + F.when(F.col("key") == "b", 3).otherwise(0)) % 60 / 100 + 0.4
    view = F.element_at(F.array(*map(F.lit, ("front", "back", "unknown", "left"))), (F.col("obs") % 4 + 1).cast("int"))
    return made.select("*", F.lit(4).alias("visible_parts"), worth.alias("quality"), F.concat_ws(":", "obs", "key").alias("frame"), view.alias("view"), F.lit(True).alias("active"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = vw.features(spark, d).select(F.col("vec_id").alias("obs"))
    o, kind = F.col("obs"), F.element_at(F.array(*map(F.lit, ("photo", "track", "tracklet"))), (F.col("obs") % 3 + 1).cast("int"))
    who = F.floor(o / 5)
    span = F.struct((o % 7 * 10.0).alias("start"), (o % 7 * 10.0 + 8).alias("end"))
    corner = (o % 5 * 200 + F.when(o % 10 < 2, 0).otherwise(o % 10 * 3)).cast("double")
    return e.select(
        F.floor(o / 100).alias("scope"), o.alias("obs"), F.concat(F.lit("clip"), (o % 5).cast("string")).alias("clip"), kind.alias("kind"), F.when(o % 4 > 0, F.concat(F.lit("team"), (who % 2).cast("string"))).alias("team"),
        F.when(o % 3 == 0, (who % 30).cast("string")).alias("number"), (o % 6 == 0).alias("number_consensus"), ((o % 12 == 9)).alias("strong_identity"), F.lit("v").alias("video"), (o % 5 * 100.0).alias("clip_start_s"), F.array(span).alias("spans"), (o * 1.0).alias("at_s"),
        F.when(o % 3 == 1, 3).otherwise(1).alias("samples"), F.when(o % 3 == 0, g.box(corner, F.lit(0.0), corner + 60, F.lit(120.0))).alias("box"), F.array().cast("array<string>").alias("holds"), (o % 41 == 40).alias("rejected"), (o % 53 == 52).alias("non_player"), F.lit(False).alias("detached"),
        (o % 37 == 36).alias("locked"), (o % 10 == 1).alias("established"), (o % 70 == 61).alias("invalidated"), (who + 1).alias("player"))


def support(spark: SparkSession, d: str) -> DataFrame:
    """Distances of observations from their pictures in both directions."""
    t = templates(spark, d).select("scope", F.col("obs").alias("unit"), "key", "feature")
    return gal.support_distances(t).select("scope", "a", "b", R(F.col("distance")).alias("distance"))


def plan(spark: SparkSession, d: str) -> DataFrame:
    s = gal.plan(observations(spark, d), templates(spark, d)).states
    return s.select("scope", "obs", "grp", "status", F.array_join("reasons", ",").alias("reasons"), "new_player")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    s = gal.plan(observations(spark, d), templates(spark, d), incremental=True).states
    return s.select("scope", "obs", "grp", "status", F.array_join("reasons", ",").alias("reasons"), "new_player", R(F.col("distance")).alias("distance"))


def pictures(spark: SparkSession, d: str) -> DataFrame:
    return gal.plan(observations(spark, d), templates(spark, d)).templates


SUPPORT = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT e.vec_id, x.v AS base, e.v AS own, n.v AS nxt FROM e JOIN e x ON x.vec_id = e.vec_id - e.vec_id % 5 LEFT JOIN e n ON n.vec_id = e.vec_id + 1),
 t AS (SELECT vec_id AS obs, 'a' AS key, list_transform(list_zip(base, own), lambda p: 0.8 * p[1] + 0.2 * p[2]) AS f FROM b UNION ALL SELECT vec_id, 'b', list_transform(list_zip(base, nxt), lambda p: 0.8 * p[1] + 0.2 * p[2]) FROM b WHERE vec_id % 2 = 1 AND nxt IS NOT NULL),
 u AS (SELECT obs // 100 AS scope, obs, key, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS f FROM t), n AS (SELECT obs, count(*) AS n FROM u GROUP BY 1),
 d AS (SELECT p.scope, p.obs AS a, q.obs AS b, p.key AS ka, q.key AS kb, 1 - list_dot_product(p.f, q.f) AS d FROM u p JOIN u q ON p.scope = q.scope AND p.obs < q.obs),
 ra AS (SELECT scope, a, b, d, row_number() OVER (PARTITION BY a, b ORDER BY d) AS k FROM (SELECT scope, a, b, ka, min(d) AS d FROM d GROUP BY 1, 2, 3, 4)), rb AS (SELECT scope, a, b, d, row_number() OVER (PARTITION BY a, b ORDER BY d) AS k FROM (SELECT scope, a, b, kb, min(d) AS d FROM d GROUP BY 1, 2, 3, 4)),
 m AS (SELECT scope, a, b, avg(d) AS d FROM ra WHERE k <= least(2, (SELECT n FROM n WHERE obs = a), (SELECT n FROM n WHERE obs = b)) GROUP BY 1, 2, 3 UNION ALL SELECT scope, a, b, avg(d) FROM rb WHERE k <= least(2, (SELECT n FROM n WHERE obs = a), (SELECT n FROM n WHERE obs = b)) GROUP BY 1, 2, 3)
 SELECT scope, a, b, round(max(d), 6) AS distance FROM m GROUP BY 1, 2, 3"""

QUERIES = {
    "support_distance": (support, SUPPORT),
    "gallery_plan_k": (plan, None),
    "gallery_arrivals_k": (arrivals, None),
    "gallery_templates_k": (pictures, None),
}

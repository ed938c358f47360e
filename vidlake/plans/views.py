"""Driver tables read as the library's own: what each is made of, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g

FPS, MINUTES = 25.0, 43_201


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def action_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sparse scores: the user acts, a frame is a minute since 2024."""
    e = table(spark, sf_dir, "events")
    frame = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 60)
    return e.select(F.col("user_id").alias("identity"), F.col("event_type").alias("event"), frame.cast("bigint").alias("frame_idx"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
                    (F.col("user_id") % 7).alias("raw_track_id"), F.col("event_id").alias("row_seq"))


ACTION_POINTS = """action_points AS (SELECT user_id AS identity, event_type AS event, (date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 60)::BIGINT AS frame_idx,
  least(value / 100, 1.0) AS score, user_id % 7 AS raw_track_id, event_id AS row_seq FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: a supplier group is a video, a part group a track, a day since 1995 a frame; the first row of a key."""
    li = table(spark, sf_dir, "lineitem")
    keyed = li.select((F.col("l_suppkey") % 16).alias("video_id"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("frame_idx"), (F.col("l_partkey") % 32).alias("track_id"),
                      (F.col("l_quantity") * 4).alias("x1"), (F.col("l_discount") * 1000).alias("y1"), (20 + F.col("l_tax") * 100).alias("w"), (40 + F.col("l_linenumber") * 5).cast("double").alias("h"),
                      (1 - F.col("l_discount")).alias("det_score"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    first = Window.partitionBy("video_id", "frame_idx", "track_id").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    one = keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.select("video_id", "frame_idx", "track_id", g.from_xywh(F.col("x1"), F.col("y1"), F.col("w"), F.col("h")).alias("box"), "det_score", F.col("l_returnflag").alias("flag"), (F.col("frame_idx") / FPS).alias("timestamp_s"))


TRACKS = """tracks AS (SELECT video_id, frame_idx, track_id, x1, y1, x1 + w AS x2, y1 + h AS y2, det_score, flag, frame_idx / 25.0 AS timestamp_s FROM (
  SELECT l_suppkey % 16 AS video_id, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS frame_idx, l_partkey % 32 AS track_id, l_quantity * 4 AS x1, l_discount * 1000 AS y1,
    20 + l_tax * 100 AS w, (40 + l_linenumber * 5)::DOUBLE AS h, 1 - l_discount AS det_score, l_returnflag AS flag,
    row_number() OVER (PARTITION BY l_suppkey % 16, l_shipdate::DATE, l_partkey % 32 ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled spans of days, by customer."""
    o = table(spark, sf_dir, "orders")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("interval_id"), F.col("o_custkey").alias("actor"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("side"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 5).alias("end"), F.col("o_totalprice").alias("score"))


INTERVALS = """intervals AS (SELECT o_orderkey AS interval_id, o_custkey AS actor, o_orderpriority AS label, o_orderstatus AS side, s AS "start", s + 1 + o_orderkey % 5 AS "end", o_totalprice AS score
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS s FROM orders))"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a prediction made from their length and source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 1000) / 1000.0
    return d.select("doc_id", "lang", "source", "quality", "toxic", score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


CLASSIFIED = """classified AS (SELECT doc_id, lang, source, quality, toxic, score, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS predicted
  FROM (SELECT *, ((n_chars * 37 + doc_id * 11) % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")

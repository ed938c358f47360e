"""Streams of action points and observations: sessions, hopping windows, evidence that repeats, and frozen references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(points: DataFrame, gap: str, late: str, threshold: float = 0.2) -> DataFrame:
    """Runs of points (identity, event, ts, score) that end when no point follows for ``gap``."""
    kept = points.filter(F.col("score") >= threshold).withWatermark("ts", late)
    by = kept.groupBy(F.session_window("ts", gap).alias("w"), "identity", "event").agg(F.count("*").alias("support_count"), F.avg("score").alias("raw_score"))
    return by.select("identity", "event", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "support_count", "raw_score")


def hops(points: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    """Counts and mean scores in hopping windows."""
    by = points.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("w"), "event").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return by.select("event", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_score")


def first_seen(evidence: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Evidence without repeats that come within the watermark."""
    return evidence.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def against_frozen(stream: DataFrame, reference: Callable[[SparkSession], DataFrame], decide: Callable[[DataFrame, DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Decides each batch against the reference as last published; what a batch adds is seen by later ones only after it is published."""
    def batch(rows: DataFrame, number: int) -> None:
        decide(rows, reference(rows.sparkSession)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

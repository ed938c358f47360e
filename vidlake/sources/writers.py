"""Sinks: JSON lines, CSV, and revisions that are written once and then pointed at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a line, its keys in order; an output that is there stays unless told otherwise."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def publish(df: DataFrame, root: str, revision: int) -> None:
    """Writes a revision, which must be new, then a row that points at it; readers see a revision when its row is there."""
    spark: SparkSession = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/revision={revision}")
    spark.createDataFrame([(revision,)], "revision bigint").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}-pointers")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last published revision."""
    revision = spark.read.parquet(f"{root}-pointers").agg(F.max("revision")).first()[0]
    return spark.read.parquet(f"{root}/revision={revision}")


def bundle(df: DataFrame, path: str, by: str) -> None:
    """A folder with one part for each value, for review."""
    df.write.mode("errorifexists").partitionBy(by).json(path)

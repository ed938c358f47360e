"""Numbers for all rows in a global order, without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidlake.storage import saved


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers all rows from 0 in the given order: a range of rows for each task, then the tasks' offsets."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # ranges are drawn from a sample: written once, they cannot be drawn differently for the counts
    rows = saved(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each task
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")

"""Sessions for tests, benches and scripts. On a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold for every run here; sizes are for one machine.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=LOCAL | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

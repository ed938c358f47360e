"""Points near ranges: every pair, and what the pairs take when they are written."""

from pathlib import Path

from pyspark.sql import functions as F

from vidlake.operators import events as ev


def test_pairs_of_odd_points_and_ranges(spark):
    nan, big = float("nan"), ev.TOGETHER * 2 + 3
    points = [("a", i, 5.0, "x") for i in range(big)] + [("a", 7, 5.0, "x"), ("a", 1000, -0.0, None), ("a", 1001, 0.0, "y"), ("a", 1002, -9.5, "y"), ("a", 1003, None, "y"), ("a", 1004, nan, "y"), (None, 1005, 5.0, "y"), ("b", None, 5.0, "z"), ("c", 1006, 5.0, "z")]
    ranges = [("a", 1, 7.0, 9.0), ("a", 2, 7.1, 9.0), ("a", 3, -1.0, 3.0), ("a", 4, -1.0, 2.0), ("a", 5, -12.0, -11.5), ("a", None, 5.0, 5.0), (None, 6, 5.0, 5.0), ("b", 7, 4.0, 6.0), ("b", 7, 4.0, 6.0), ("a", 8, None, 5.0), ("d", 9, 5.0, 5.0)]
    found = ev.near_ranges(spark.createDataFrame(points, "stage string, point_id long, at double, note string"), spark.createDataFrame(ranges, "stage string, interval_id long, lo double, hi double"), ["stage"], 2.0, 3.0)
    assert found.columns == ["stage", "point_id", "at", "note", "interval_id", "lo", "hi"]
    wanted = [(*p, *r[1:]) for p in points for r in ranges if None not in (p[0], p[2], r[0], r[2]) and p[0] == r[0] and r[3] - r[2] <= 3 and r[2] - 2 <= p[2] <= r[3] + 2]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert len(wanted) > big


def test_pairs_take_little_when_written(spark, tmp_path):
    """1.38 bytes for each pair before points of one time met their ranges together."""
    rows = spark.range(2000).select(F.pmod(F.xxhash64("id"), F.lit(10**7)).alias("i"), (F.col("id") % 10).cast("double").alias("at"), F.lit("s").alias("stage")).orderBy("i").localCheckpoint()
    points = rows.select("stage", F.col("i").alias("point_id"), "at")
    ranges = rows.select("stage", F.col("i").alias("interval_id"), F.col("at").alias("lo"), (F.col("at") + 1 + F.col("i") % 5).alias("hi"))
    ev.near_ranges(points, ranges, ["stage"], 2.0, 3.0).select("stage", "point_id", "interval_id").write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n == points.crossJoin(ranges.drop("stage")).filter("hi - lo <= 3 and at between lo - 2 and hi + 2").count()
    assert sum(f.stat().st_size for f in Path(tmp_path, "pairs").glob("*.parquet")) < 0.5 * n

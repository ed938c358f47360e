"""Scans of observation tables, annotations and benchmark layouts. All are lazy; checks come back as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.sources import schemas


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """One object a line; blank lines do not count. Strict: a bad line stops the scan; else it is left out."""
    out = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return out if limit is None else out.limit(limit)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def boxed(rows: DataFrame, array: str = "bbox_xyxy") -> DataFrame:
    """The box array as the library's struct, column box."""
    return rows.withColumn("box", g.box(*(F.get(array, i) for i in range(4)))).drop(array)


def track_table(spark: SparkSession, path: str) -> DataFrame:
    return boxed(jsonl(spark, path, schemas.TRACKS))


def frame_limit(wanted: Column | None, meta: DataFrame) -> DataFrame:
    """(video_id, frames): the wanted number, else the processed frames, else all."""
    first = [wanted] if wanted is not None else []
    return meta.select("video_id", F.coalesce(*first, "processed_frames", "frame_count").alias("frames"))


def mot(spark: SparkSession, path: str, first_frame: int = 1, least_conf: float = 0.0, frames: int | None = None) -> DataFrame:
    """Rows of frame, id, x, y, w, h, conf and more, # lines left out: those over the confidence with a box, frames from 0."""
    rows = spark.read.schema(schemas.MOT).option("comment", "#").option("mode", "FAILFAST").csv(path)
    rows = rows.withColumn("frame_idx", F.col("frame") - first_frame).filter((F.coalesce("conf", F.lit(1.0)) > least_conf) & (F.col("w") > 0) & (F.col("h") > 0))
    if frames is not None:
        rows = rows.filter(F.col("frame_idx") < frames)
    return rows.select("frame_idx", F.col("id").alias("track_id"), g.from_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), F.coalesce("conf", F.lit(1.0)).alias("det_score"), "class", "visibility")


def mot_violations(rows: DataFrame, frames: int) -> DataFrame:
    """Rows of a ground truth that repeat an id in a frame or lie outside the frames."""
    n = F.count("*").over(Window.partitionBy("frame_idx", "track_id"))
    return rows.withColumn("_n", n).filter((F.col("_n") > 1) | (F.col("frame_idx") < 0) | (F.col("frame_idx") >= frames)).drop("_n")


def native_columns(spark: SparkSession, path: str) -> DataFrame:
    """Lines of native layouts (nine or ten columns) with the layout, and whether the tail holds the layout's fixed values."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select(F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("p"))
    n = F.size("p")
    tail = F.when(n == 10, F.forall(F.slice("p", 7, 4), lambda x: x == -1)).when(n == 9, F.forall(F.slice("p", 8, 2), lambda x: x == -1)).otherwise(False)
    return parts.select(F.get("p", 0).cast("bigint").alias("frame"), F.get("p", 1).cast("bigint").alias("id"), g.from_xywh(*(F.get("p", i) for i in range(2, 6))).alias("box"), F.when(n == 9, F.get("p", 6)).alias("score"), n.alias("n_columns"), tail.alias("valid"))


def wide_teams(spark: SparkSession, path: str, video_id: str) -> DataFrame:
    """Long rows of a wide table with four header lines (team, player, attribute, frame), the ball left out. A box is there whole or not at all."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_line"), F.split("value", ",").alias("p"))
    head = lines.orderBy("_line").limit(3).collect()  # three header lines
    names = [tuple(x.strip() for x in column) for column in zip(*(r["p"][1:] for r in head), strict=True)]
    body = lines.filter(F.col("_line") >= 4)
    columns = F.array(*(F.struct(F.lit(t).alias("team"), F.lit(p).alias("player"), F.lit(a).alias("attribute"), F.expr(f"try_cast(p[{i + 1}] AS double)").alias("v")) for i, (t, p, a) in enumerate(names) if t.upper() != "BALL"))
    long = body.select(F.expr("try_cast(p[0] AS bigint)").alias("frame"), F.explode(columns).alias("c")).select("frame", "c.*")
    by = long.groupBy("frame", "team", "player").pivot("attribute", ["bb_left", "bb_top", "bb_width", "bb_height"]).agg(F.first("v"))
    known = F.size(F.array_compact(F.array("bb_left", "bb_top", "bb_width", "bb_height")))
    person = F.dense_rank().over(Window.partitionBy(F.lit(video_id)).orderBy("team", "player"))
    out = by.withColumn("track_id", person - 1).filter(known > 0)
    return out.select(F.lit(video_id).alias("video_id"), (F.col("frame") - 1).alias("frame_idx"), F.col("track_id").cast("bigint").alias("track_id"), F.when(known == 4, g.from_xywh(F.col("bb_left"), F.col("bb_top"), F.col("bb_width"), F.col("bb_height"))).otherwise(F.raise_error(F.lit("a box lacks some of its sides"))).alias("box"))


def ava(spark: SparkSession, path: str, classes: list[int] | None = None, scored: bool = False) -> DataFrame:
    """Boxes of key frames; the key is video and four-digit second; score is 1 where the last column is an entity."""
    rows = spark.read.schema(schemas.AVA.replace("entity_id int", "score double") if scored else schemas.AVA).csv(path)
    rows = rows.filter(F.col("action_id").isNotNull())
    if classes is not None:
        rows = rows.filter(F.col("action_id").isin(*classes))
    score = F.col("score") if scored else F.lit(1.0)
    return rows.select(F.concat("video", F.lit(","), F.lpad(F.col("timestamp").cast("string"), 4, "0")).alias("image"), g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("box"), "action_id", score.alias("score"))


def without_excluded(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose image is not among the excluded (video, timestamp)."""
    keys = excluded.select(F.concat("video", F.lit(","), F.lpad(F.col("timestamp").cast("string"), 4, "0")).alias("image")).distinct()
    return rows.join(keys, "image", "left_anti")


def label_map(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(class_id, label) of lines 'id: label', those whose label starts with a prefix."""
    p = F.split("value", ": ", 2)
    return spark.read.text(path).filter(F.contains("value", F.lit(": "))).select(F.trim(p[0]).cast("int").alias("class_id"), F.trim(p[1]).alias("label")).filter(F.startswith("label", F.lit(prefix)))


def localisation_truth(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """(video, duration, label, start, end) of an annotation file: one object that maps videos to their annotations."""
    kind = "map<string,struct<duration:double,duration_second:double,subset:string,annotations:array<struct<segment:array<double>,label:string>>>>"
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.database"), "value"), kind)).alias("video", "v"))
    if subset is not None:
        rows = rows.filter(F.col("v.subset") == subset)
    return rows.select("video", F.coalesce("v.duration", "v.duration_second").alias("duration"), F.explode("v.annotations").alias("a")).select("video", "duration", "a.label", F.get("a.segment", 0).alias("start"), F.get("a.segment", 1).alias("end"))


def localisation_results(spark: SparkSession, path: str) -> DataFrame:
    """(video, label, score, start, end) of a result file."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.results"), "map<string,array<struct<label:string,score:double,segment:array<double>>>>")).alias("video", "r")).select("video", F.explode("r").alias("a"))
    return rows.select("video", "a.label", "a.score", F.get("a.segment", 0).alias("start"), F.get("a.segment", 1).alias("end"))


def file_list(spark: SparkSession, path: str, counted: bool) -> DataFrame:
    """(name, frames, labels) of lines 'name [frames] label ...'."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(p.alias("p"))
    return rows.select(F.get("p", 0).alias("name"), (F.get("p", 1).cast("bigint") if counted else F.lit(None).cast("bigint")).alias("frames"), F.transform(F.slice("p", 3 if counted else 2, 1000), lambda x: x.cast("int")).alias("labels"))


def spans_csv(spark: SparkSession, path: str) -> DataFrame:
    """Proposals or scores with a header; all columns are numbers."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(c).cast("double").alias(c) for c in rows.columns))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file; contents do not leave the tasks."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def selected(manifest: DataFrame, split: str) -> DataFrame:
    return manifest.filter(F.col("split") == split)


def smallest_by_view(manifest: DataFrame, n: int, status: str = "ready") -> DataFrame:
    """The n shortest ready sequences of each view."""
    w = Window.partitionBy("view").orderBy("frames", "sequence")
    return manifest.filter(F.col("status") == status).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def box_conflicts(rows: DataFrame) -> DataFrame:
    """Keys (video_id, frame_idx, track_id) that have different boxes; equal ones are repeats only."""
    return rows.groupBy("video_id", "frame_idx", "track_id").agg(F.count_distinct("box").alias("n_boxes")).filter("n_boxes > 1")


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are on one side only, and on which."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("only_in", F.lit("right")))

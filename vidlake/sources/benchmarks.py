"""Scans of tracking benchmarks' layouts as one table: seq, t (frames from 0), track_id, class, box, score, crowd.

Delimited files and archives of them are read as whole files through Spark's readers, so that any store that Spark reaches
will do, one file to a row: a file is one sequence. Crowd rows are regions to be ignored, no detections. JSON layouts are
nested tables, exploded and joined.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vidlake.functions import geometry as g
from vidlake.functions import masks as m

ROWS = "seq string, line bigint, t bigint, track_id bigint, class string, a double, b double, c double, d double, score double, crowd boolean, mask_height int, mask_width int, mask_text string, extra map<string,double>"


@dataclass(frozen=True)
class Layout:
    """Columns of a delimited file, counted from 0. crowd: values of a column (lower case) that mark a region to be ignored; valid: those that a detection
    must have; names: what values of a column stand for; extra: further numbers by name."""

    time: int = 0
    id: int = 1
    kind: int | None = None
    box: tuple[int, int, int, int] | None = (2, 3, 4, 5)
    corners: bool = False
    score: int | None = None
    mask: tuple[int, int, int] | None = None  # height, width, text
    first_frame: int = 1
    crowd: dict[int, tuple[str, ...]] = field(default_factory=dict)
    valid: dict[int, tuple[str, ...]] = field(default_factory=dict)
    names: dict[int, dict[str, str]] = field(default_factory=dict)
    extra: dict[str, int] = field(default_factory=dict)
    negative_ids: bool = True
    delimiters: str | None = None


#: Layouts of public benchmarks. Fixed values.
KITTI = Layout(kind=2, box=(6, 7, 8, 9), corners=True, score=17, first_frame=0, crowd={2: ("dontcare",)}, valid={2: ("car", "van", "pedestrian", "person")}, extra={"truncation": 3, "occlusion": 4}, negative_ids=False, delimiters=" ")
HEAD_TRACKING = Layout(kind=7, score=6, names={7: {"1": "pedestrian", "2": "static", "3": "ignore", "4": "person_on_vehicle"}}, extra={"visibility": 8}, delimiters=", ")
MOTS = Layout(kind=2, box=None, mask=(3, 4, 5), crowd={2: ("10",)}, names={2: {"1": "car", "2": "pedestrian", "10": "ignore"}}, delimiters=" ")
KITTI_MOTS = Layout(kind=2, box=None, mask=(3, 4, 5), first_frame=0, crowd={2: ("10",)}, names={2: {"1": "car", "2": "pedestrian", "10": "ignore"}}, delimiters=" ")
PERSON_PATH = Layout(kind=7, score=6, names={7: {"1": "pedestrian"}}, extra={"visibility": 8}, delimiters=", ")


def parsed(text: str, seq: str, layout: Layout) -> Iterator[tuple]:
    """Rows of one file. The delimiter is sniffed from the first line; a line that cannot be read is an error that names it."""
    if not text:
        return
    dialect = csv.Sniffer().sniff(text.split("\n", 1)[0], layout.delimiters)
    dialect.skipinitialspace = True
    for n, row in enumerate(csv.reader(io.StringIO(text), dialect), 1):
        row = row[:-1] if row and row[-1] == "" else row
        if not row:
            continue
        try:
            crowd = any(row[k].lower() in values for k, values in layout.crowd.items())
            if not crowd and any(row[k].lower() not in values for k, values in layout.valid.items() if k < len(row)):
                continue
            track = int(float(row[layout.id]))
            if track < 0 and not layout.negative_ids and not crowd:
                continue
            named = lambda k: layout.names.get(k, {}).get(row[k].lower(), row[k].lower())  # noqa: E731, B023
            number = lambda k: float(row[k]) if k is not None and k < len(row) else None  # noqa: E731, B023
            mask = (int(row[layout.mask[0]]), int(row[layout.mask[1]]), row[layout.mask[2]]) if layout.mask else (None, None, None)
            kind = named(layout.kind) if layout.kind is not None and layout.kind < len(row) else None
            yield (seq, n, int(float(row[layout.time])) - layout.first_frame, track, kind, *([float(row[k]) for k in layout.box] if layout.box else [None] * 4), number(layout.score), crowd, *mask, {name: number(k) for name, k in layout.extra.items() if k < len(row)})
        except (ValueError, IndexError) as bad:
            raise ValueError(f"line {n} of {seq} cannot be read: {' '.join(row)}") from bad


def delimited(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """All files below the path, archives (.zip) with all their .txt members; the sequence is the file's name. Masks come as a column if the layout has them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    made = StructType.fromDDL(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(made)
        stem = lambda name: name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        members = [(stem(x), archive.read(x)) for x in sorted(archive.namelist()) if x.endswith(".txt")]
                else:
                    members = [(stem(name), content)]
                for seq, data in members:
                    rows = list(parsed(data.decode(), seq, layout))
                    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
                    for k in range(0, len(rows), 1 << 14):
                        yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c[k : k + (1 << 14)]], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = files.mapInArrow(run, ROWS)
    corner = [F.col(c) for c in "abcd"]
    box = g.box(*corner) if layout.corners else g.from_xywh(*corner)
    out = rows.select("seq", "line", "t", "track_id", "class", F.when(F.col("a").isNotNull(), box).alias("box"), F.coalesce("score", F.lit(1.0)).alias("score"), "crowd", "extra", *(["mask_height", "mask_width", "mask_text"] if layout.mask else []))
    if layout.mask:
        out = out.withColumn("mask", m.read_text(F.col("mask_text"), F.col("mask_height"), F.col("mask_width"))).drop("mask_height", "mask_width", "mask_text")
    return out


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(seq, t, track_id, n) of ids that stand more than once in a frame; regions to be ignored do not count."""
    return rows.filter(~F.col("crowd")).groupBy("seq", "t", "track_id").agg(F.count("*").alias("n")).filter("n > 1")


def outside(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows whose frame is none of their sequence's. lengths: seq, frames."""
    return rows.join(lengths, "seq", "left").filter(F.col("frames").isNull() | (F.col("t") < 0) | (F.col("t") >= F.col("frames"))).drop("frames")


BDD_LABEL = "struct<id:string,category:string,box2d:struct<x1:double,y1:double,x2:double,y2:double>,score:double,attributes:struct<Crowd:boolean>>"
#: Categories that are no road users of their own. Fixed values.
BDD_DISTRACTORS = ("other person", "trailer", "other vehicle")


def bdd100k(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of frames a sequence, in order; the sequence is the file's name. Distractors and crowds are regions to be ignored."""
    frames = spark.read.schema(f"name string, videoName string, frameIndex bigint, labels array<{BDD_LABEL}>").option("multiLine", "true").json(path)
    stem = F.regexp_extract(F.input_file_name(), "([^/]+?)\\.[^./]*$", 1)
    at = frames.select(F.coalesce("videoName", stem).alias("seq"), "name", "frameIndex", "labels")
    # frames without a number stand in the order of their names
    at = at.withColumn("t", F.coalesce("frameIndex", F.row_number().over(Window.partitionBy("seq").orderBy("name")) - 1))
    one = at.select("seq", "t", F.explode("labels").alias("x"))
    crowd = F.col("x.category").isin(*BDD_DISTRACTORS) | F.coalesce("x.attributes.Crowd", F.lit(False))
    return one.filter(F.col("x.box2d").isNotNull()).select("seq", "t", F.col("x.id").cast("bigint").alias("track_id"), F.col("x.category").alias("class"), F.col("x.box2d").alias("box"), F.coalesce("x.score", F.lit(1.0)).alias("score"), crowd.alias("crowd"))


TAO = """videos array<struct<id:bigint,name:string,neg_category_ids:array<bigint>,not_exhaustive_category_ids:array<bigint>>>, images array<struct<id:bigint,video_id:bigint,frame_index:bigint>>,
 annotations array<struct<image_id:bigint,video_id:bigint,track_id:bigint,category_id:bigint,bbox:array<double>,score:double>>, categories array<struct<id:bigint,name:string,merged:array<struct<id:bigint>>>>"""


@dataclass
class Annotated:
    boxes: DataFrame
    labelled: DataFrame  # (seq, class, negative, exhaustive): classes that are labelled, sought in vain, or not labelled throughout


def tao(spark: SparkSession, path: str, results: str | None = None) -> Annotated:
    """Boxes of a truth file, or of a results file (an array of annotations) on the truth's images.

    Frames are numbered by frame_index in each video; an annotation's video is its image's; merged categories count as what
    they were merged into; a track id used in several videos, or for several categories, becomes as many tracks.
    """
    truth = spark.read.schema(TAO).option("multiLine", "true").json(path)
    part = lambda name: truth.select(F.explode(name).alias("x")).select("x.*")
    videos, images = part("videos").select(F.col("id").alias("video_id"), F.regexp_replace("name", "/", "-").alias("seq"), "neg_category_ids", "not_exhaustive_category_ids"), part("images")
    order = Window.partitionBy("video_id").orderBy("frame_index", "id")
    at = images.select(F.col("id").alias("image_id"), "video_id", (F.row_number().over(order) - 1).cast("bigint").alias("t"))
    kinds = part("categories")
    into = kinds.select(F.col("id").alias("_to"), F.explode("merged.id").alias("category_id"))
    names = kinds.select(F.col("id").alias("category_id"), F.col("name").alias("class"))
    if results is None:
        found = part("annotations")
    else:
        found = spark.read.schema("image_id bigint, video_id bigint, track_id bigint, category_id bigint, bbox array<double>, score double").option("multiLine", "true").json(results)
    rows = found.drop("video_id").join(at, "image_id").join(into, "category_id", "left").withColumn("category_id", F.coalesce("_to", "category_id")).drop("_to")
    rows = rows.join(videos.select("video_id", "seq"), "video_id").join(names, "category_id", "left")
    # the first use of an id keeps it, the others get numbers behind the largest
    uses = rows.groupBy("track_id", "video_id", "category_id").count().drop("count")
    first = Window.partitionBy("track_id").orderBy("video_id", "category_id")
    uses = uses.withColumn("_n", F.row_number().over(first))
    more = uses.filter("_n > 1").join(rows.agg(F.max("track_id").alias("_top")))
    fresh = more.select("track_id", "video_id", "category_id", (F.col("_top") + F.row_number().over(Window.orderBy("track_id", "_n"))).alias("_id"))
    rows = rows.join(fresh, ["track_id", "video_id", "category_id"], "left").withColumn("track_id", F.coalesce("_id", "track_id"))
    boxes = rows.select("seq", "t", "track_id", "class", g.from_xywh(*(F.get("bbox", i) for i in range(4))).alias("box"), F.coalesce("score", F.lit(1.0)).alias("score"), F.lit(False).alias("crowd"))
    named = lambda ids, c: videos.select("seq", F.explode(ids).alias("category_id")).join(names, "category_id").select("seq", "class", F.lit(True).alias(c))
    seen = boxes.select("seq", "class").distinct() if results is None else tao(spark, path).boxes.select("seq", "class").distinct()
    labelled = seen.join(named("neg_category_ids", "negative"), ["seq", "class"], "full").join(named("not_exhaustive_category_ids", "_partly"), ["seq", "class"], "full")
    return Annotated(boxes, labelled.select("seq", "class", F.coalesce("negative", F.lit(False)).alias("negative"), F.col("_partly").isNull().alias("exhaustive")))


VIS = """videos array<struct<id:bigint,file_names:array<string>>>, categories array<struct<id:bigint,name:string>>,
 annotations array<struct<id:bigint,video_id:bigint,category_id:bigint,iscrowd:int,height:int,width:int,bboxes:array<array<double>>,segmentations:array<struct<size:array<int>,counts:array<int>>>>>"""


def youtube_vis(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame in which a track has a box or a mask; masks in plain run lengths. A track may be a crowd."""
    whole = spark.read.schema(VIS).option("multiLine", "true").json(path)
    part = lambda name: whole.select(F.explode(name).alias("x")).select("x.*")
    seqs = part("videos").select(F.col("id").alias("video_id"), F.regexp_extract(F.get("file_names", 0), "^([^/]*)/", 1).alias("seq"))
    names = part("categories").select(F.col("id").alias("category_id"), F.col("name").alias("class"))
    at = part("annotations").join(seqs, "video_id").join(names, "category_id", "left")
    rows = at.select("seq", F.col("id").alias("track_id"), "class", (F.coalesce("iscrowd", F.lit(0)) == 1).alias("crowd"), F.posexplode(F.arrays_zip("bboxes", "segmentations")).alias("t", "x"))
    mask = F.when(F.col("x.segmentations.counts").isNotNull(), m.mask(F.get("x.segmentations.size", 0), F.get("x.segmentations.size", 1), F.col("x.segmentations.counts")))
    box = F.when(F.size("x.bboxes") == 4, g.from_xywh(*(F.get("x.bboxes", i) for i in range(4))))
    return rows.select("seq", F.col("t").cast("bigint").alias("t"), "track_id", "class", box.alias("box"), mask.alias("mask"), F.lit(1.0).alias("score"), "crowd").filter("box is not null or mask is not null")


def ready(truth: DataFrame, tracks: DataFrame, distractor: Column, crowds: DataFrame | None = None, least: float = 0.5, crowd_share: float = 0.5, least_height: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(truth, tracks) as metrics take them. Tracks' boxes are paired with truth in each frame: those paired with a distractor go; of the
    others those that are too low, or lie in a region to be ignored by more than the share. Truth loses its distractors. Tables: seq, t, id, box."""
    from vidlake.operators.detection import paired_boxes

    pairs = paired_boxes(truth.withColumn("_bad", distractor), tracks, least, "_bad")
    met = tracks.join(pairs.select("seq", "t", F.col("tr_id").alias("id"), "_bad"), ["seq", "t", "id"], "left")
    met = met.filter(F.coalesce(~F.col("_bad"), F.lit(True)))
    met = met.filter(F.col("_bad").isNotNull() | (F.col("box.y2") - F.col("box.y1") > least_height))
    if crowds is not None:
        c = crowds.select("seq", "t", F.col("box").alias("_c"))
        gone = met.filter(F.col("_bad").isNull()).join(c, ["seq", "t"]).filter(g.ioa(F.col("box"), F.col("_c")) > crowd_share).select("seq", "t", "id").distinct()
        met = met.join(gone, ["seq", "t", "id"], "left_anti")
    return truth.filter(~distractor), met.drop("_bad")

"""Benchmark layouts written by hand and read back as one table."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vidlake.functions import masks as m
from vidlake.sources import benchmarks as bm

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
KITTI = """0 1 Car 0 0 -1.5 10 20 110 80 1 2 3 4 5 6 7
0 -1 DontCare -1 -1 -10 200 10 260 90 -1 -1 -1 -1 -1 -1 -1
1 1 Car 0 3 -1.5 12 20 112 80 1 2 3 4 5 6 7 0.75
1 2 Van 1 0 -1.5 50 20 90 60 1 2 3 4 5 6 7
2 3 Cyclist 0 0 -1.5 50 20 90 60 1 2 3 4 5 6 7
2 -4 Car 0 0 -1.5 50 20 90 60 1 2 3 4 5 6 7
"""


def rows_of(df):
    return sorted((r.seq, r.t, r.track_id, r["class"], (r.box.x1, r.box.y1, r.box.x2, r.box.y2), r.score, r.crowd) for r in df.collect())


@pytest.mark.parametrize("zipped", [False, True])
def test_kitti(spark, tmp_path, zipped):
    if zipped:
        with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
            z.writestr("0007.txt", KITTI)
            z.writestr("0008.txt", "")
            z.writestr("readme.md", "not a sequence")
    else:
        (tmp_path / "0007.txt").write_text(KITTI)
        (tmp_path / "0008.txt").write_text("")
    got = bm.delimited(spark, str(tmp_path), bm.KITTI)
    assert rows_of(got) == [
        ("0007", 0, -1, "dontcare", (200, 10, 260, 90), 1.0, True), ("0007", 0, 1, "car", (10, 20, 110, 80), 1.0, False),
        ("0007", 1, 1, "car", (12, 20, 112, 80), 0.75, False), ("0007", 1, 2, "van", (50, 20, 90, 60), 1.0, False)]
    assert {(r.track_id, r.t): r.extra for r in got.collect()}[2, 1] == {"truncation": 1.0, "occlusion": 0.0}


@pytest.mark.parametrize("mark", [",", ", "])
def test_heads_with_either_delimiter(spark, tmp_path, mark):
    lines = [[1, 5, 10, 20, 30, 40, 0.9, 1, 0.5], [2, 5, 11, 20, 30, 40, 0.8, 2, 0.25]]
    (tmp_path / "HT-01.txt").write_text("\n".join(mark.join(map(str, x)) for x in lines) + "\n")
    got = bm.delimited(spark, str(tmp_path), bm.HEAD_TRACKING)
    assert rows_of(got) == [("HT-01", 0, 5, "pedestrian", (10, 20, 40, 60), 0.9, False), ("HT-01", 1, 5, "static", (11, 20, 41, 60), 0.8, False)]


def test_masks_of_a_benchmark(spark, tmp_path):
    runs = [30, 6, 4, 6, 54]
    (tmp_path / "0002.txt").write_text(f"1 1001 1 10 10 {m.to_text(runs)}\n2 10000 10 10 10 {m.to_text([0, 100])}\n")
    got = {r.t: r for r in bm.delimited(spark, str(tmp_path), bm.MOTS).collect()}
    assert got[0].mask.runs == runs and (got[0]["class"], got[0].crowd, got[0].box) == ("car", False, None)
    assert got[1].crowd and got[1]["class"] == "ignore"


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1,2,3,4,5,6,1,1,1\n1,x,3,4,5,6,1,1,1\n")
    with pytest.raises(Exception, match="line 2 of s cannot be read"):
        bm.delimited(spark, str(tmp_path), bm.HEAD_TRACKING).collect()


def test_checks_of_rows(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1,2,3,4,5,6,1,1,1\n1,2,3,4,5,6,1,1,1\n9,3,3,4,5,6,1,1,1\n")
    rows = bm.delimited(spark, str(tmp_path), bm.HEAD_TRACKING)
    assert [tuple(r) for r in bm.repeated_ids(rows).collect()] == [("s", 0, 2, 2)]
    assert [r.t for r in bm.outside(rows, spark.createDataFrame([("s", 5)], "seq string, frames int")).collect()] == [8]


def test_bdd(spark, tmp_path):
    box = {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 5.0}
    frames = [{"name": "b-2.jpg", "labels": [{"id": "7", "category": "car", "box2d": box, "attributes": {"Crowd": True}}]},
              {"name": "b-1.jpg", "labels": [{"id": "7", "category": "car", "box2d": box}, {"id": "8", "category": "trailer", "box2d": box}]}, {"name": "b-3.jpg", "labels": []}]
    (tmp_path / "b.json").write_text(json.dumps(frames))
    assert rows_of(bm.bdd100k(spark, str(tmp_path))) == [("b", 0, 7, "car", (1, 2, 3, 5), 1.0, False), ("b", 0, 8, "trailer", (1, 2, 3, 5), 1.0, True), ("b", 1, 7, "car", (1, 2, 3, 5), 1.0, True)]


def test_tao(spark, tmp_path):
    note = lambda image, track, kind, **more: {"image_id": image, "track_id": track, "category_id": kind, "bbox": [1, 2, 10, 20], **more}
    truth = {"videos": [{"id": 1, "name": "a/x", "neg_category_ids": [3], "not_exhaustive_category_ids": [2]}, {"id": 2, "name": "a/y", "neg_category_ids": [], "not_exhaustive_category_ids": []}],
             "images": [{"id": 11, "video_id": 1, "frame_index": 30}, {"id": 12, "video_id": 1, "frame_index": 0}, {"id": 21, "video_id": 2, "frame_index": 5}],
             "categories": [{"id": 1, "name": "cat", "merged": [{"id": 4}]}, {"id": 2, "name": "dog"}, {"id": 3, "name": "cow"}, {"id": 4, "name": "kitten"}],
             "annotations": [note(11, 5, 1), note(12, 5, 4), note(21, 5, 2)]}
    (tmp_path / "t.json").write_text(json.dumps(truth))
    (tmp_path / "r.json").write_text(json.dumps([note(12, 1, 3, score=0.5), note(99, 1, 1, score=0.5)]))
    got = bm.tao(spark, str(tmp_path / "t.json"))
    assert rows_of(got.boxes) == [("a-x", 0, 5, "cat", (1, 2, 11, 22), 1.0, False), ("a-x", 1, 5, "cat", (1, 2, 11, 22), 1.0, False), ("a-y", 0, 6, "dog", (1, 2, 11, 22), 1.0, False)]
    assert sorted(tuple(r) for r in got.labelled.collect()) == [("a-x", "cat", False, True), ("a-x", "cow", True, True), ("a-x", "dog", False, False), ("a-y", "dog", False, True)]
    assert rows_of(bm.tao(spark, str(tmp_path / "t.json"), str(tmp_path / "r.json")).boxes) == [("a-x", 0, 1, "cow", (1, 2, 11, 22), 0.5, False)]


def test_youtube_vis(spark, tmp_path):
    whole = {"videos": [{"id": 1, "file_names": ["v1/0.jpg", "v1/1.jpg", "v1/2.jpg"]}], "categories": [{"id": 2, "name": "ape"}],
             "annotations": [{"id": 9, "video_id": 1, "category_id": 2, "iscrowd": 0, "bboxes": [[0, 0, 2, 3], None, None], "segmentations": [{"size": [4, 5], "counts": [3, 17]}, None, {"size": [4, 5], "counts": [20]}]}]}
    (tmp_path / "v.json").write_text(json.dumps(whole))
    got = {r.t: r for r in bm.youtube_vis(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 2} and got[0].seq == "v1" and got[0]["class"] == "ape" and got[0].box.x2 == 2 and got[2].box is None
    assert got[0].mask.runs == [3, 17] and got[2].mask.runs == [20]


def test_boxes_made_ready(spark):
    at = lambda *rows: spark.createDataFrame([(1, 0, i, tuple(map(float, b)), *more) for i, b, *more in rows], f"seq bigint, t bigint, id bigint, box {BOX}" + ", kind string" * bool(len(rows[0]) > 2))
    truth = at((1, (0, 0, 100, 100), "car"), (2, (200, 0, 300, 100), "van"))
    tracks = at((11, (0, 0, 100, 90)), (12, (200, 0, 300, 90)), (13, (400, 0, 420, 20)), (14, (500, 0, 600, 100)), (15, (700, 0, 800, 100)))
    crowd = at((0, (480, 0, 560, 100)))
    kept, boxes = bm.ready(truth, tracks, F.col("kind") == "van", crowd, least_height=25.0)
    assert [r.id for r in kept.collect()] == [1]
    assert sorted(r.id for r in boxes.collect()) == [11, 15]  # 12 is a van, 13 too low, 14 mostly in the crowd

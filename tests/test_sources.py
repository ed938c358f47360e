"""Scans, checks and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from vidlake.sources import readers, schemas, writers


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_jsonl(spark, tmp_path):
    good = json.dumps({"video_id": "v", "frame_idx": 3, "track_id": 1, "bbox_xyxy": [0, 0, 2, 4], "det_score": 0.5})
    rows = readers.track_table(spark, write(tmp_path, "a.jsonl", f"{good}\n\n{good}\n")).select("frame_idx", "box.x2").collect()
    assert [tuple(r) for r in rows] == [(3, 2.0)] * 2
    bad = write(tmp_path, "b.jsonl", f"{good}\n{{oops\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, bad, schemas.TRACKS).collect()
    assert readers.jsonl(spark, bad, schemas.TRACKS, strict=False, limit=5).count() == 1
    assert readers.empty(spark, schemas.EVENTS).count() == 0


def test_mot(spark, tmp_path):
    path = write(tmp_path, "gt.txt", "# c\n1,1,0,0,2,2,1,1,1\n1,2,5,5,0,2,1,1,1\n2,1,1,1,2,2,0,1,1\n3,1,1,1,2,2,1,1,0.5\n3,1,1,1,2,2,1,1,0.5\n")
    rows = readers.mot(spark, path)
    assert sorted((r["frame_idx"], r["track_id"], r["box"]["x2"]) for r in rows.collect()) == [(0, 1, 2.0), (2, 1, 3.0), (2, 1, 3.0)]
    assert readers.mot_violations(rows, 3).count() == 2 and readers.mot_violations(rows, 1).count() == 2
    assert readers.mot(spark, path, frames=1).count() == 1


def test_native_layouts(spark, tmp_path):
    rows = readers.native_columns(spark, write(tmp_path, "n.txt", "1,1,0,0,2,2,-1,-1,-1,-1\n1,2,0,0,2,2,0.9,-1,-1\n1,3,0,0,2,2,0.9,-1,5\n")).orderBy("id").collect()
    assert [(r["n_columns"], r["score"], r["valid"]) for r in rows] == [(10, None, True), (9, 0.9, True), (9, 0.9, False)]


def test_wide_teams(spark, tmp_path):
    head = ["TeamID," + ",".join(["0"] * 4 + ["1"] * 4 + ["BALL"] * 4), "PlayerID," + ",".join(["7"] * 4 + ["7"] * 4 + ["0"] * 4), "Attributes," + ",".join(["bb_height", "bb_left", "bb_top", "bb_width"] * 3), "frame" + "," * 12]
    body = ["1,2,0,0,3,,,,,1,1,1,1", "2,2,1,1,3,4,5,6,7,1,1,1,1"]
    rows = readers.wide_teams(spark, write(tmp_path, "w.csv", "\n".join(head + body)), "v").orderBy("frame_idx", "track_id").collect()
    assert [(r["frame_idx"], r["track_id"], r["box"]["x2"], r["box"]["y2"]) for r in rows] == [(0, 0, 3.0, 2.0), (1, 0, 4.0, 3.0), (1, 1, 12.0, 10.0)]
    with pytest.raises(Exception, match="lacks some"):
        readers.wide_teams(spark, write(tmp_path, "x.csv", "\n".join([*head, "1,2,,0,3,,,,,1,1,1,1"])), "v").collect()


def test_annotations(spark, tmp_path):
    rows = readers.ava(spark, write(tmp_path, "a.csv", "v,902,0.1,0.2,0.3,0.4,12,0\nv,903,0.1,0.2,0.3,0.4,80,0\n"), [12, 80])
    assert [r["image"] for r in rows.orderBy("image").collect()] == ["v,0902", "v,0903"]
    assert readers.without_excluded(rows, spark.createDataFrame([("v", 902)], "video string, timestamp int")).count() == 1
    assert [tuple(r) for r in readers.label_map(spark, write(tmp_path, "l.txt", "1: ball: pass\n2: other\n"), "ball").collect()] == [(1, "ball: pass")]
    truth = write(tmp_path, "t.json", json.dumps({"database": {"v1": {"duration": 9.0, "subset": "val", "annotations": [{"segment": [1, 2], "label": "x"}]}, "v2": {"duration": 9.0, "subset": "train", "annotations": []}}}))
    assert [tuple(r) for r in readers.localisation_truth(spark, truth, "val").collect()] == [("v1", 9.0, "x", 1.0, 2.0)]
    said = write(tmp_path, "r.json", json.dumps({"results": {"v1": [{"label": "x", "score": 0.5, "segment": [1, 3]}]}}))
    assert [tuple(r) for r in readers.localisation_results(spark, said).collect()] == [("v1", "x", 0.5, 1.0, 3.0)]
    listed = readers.file_list(spark, write(tmp_path, "f.txt", "a 10 1 2\nb 20 3\n"), True).orderBy("name").collect()
    assert [tuple(r) for r in listed] == [("a", 10, [1, 2]), ("b", 20, [3])]
    assert readers.spans_csv(spark, write(tmp_path, "s.csv", "tmin,tmax\n1,2\n")).first()["tmax"] == 2.0
    assert len(readers.checksums(spark, str(tmp_path / "s.csv")).first()["sha256"]) == 64


def test_manifests_and_checks(spark):
    m = spark.createDataFrame([("top", 5, "a", "ready"), ("top", 3, "b", "ready"), ("top", 1, "c", "bad"), ("side", 9, "d", "ready")], "view string, frames int, sequence string, status string")
    assert sorted(r["sequence"] for r in readers.smallest_by_view(m, 1).collect()) == ["b", "d"]
    b = spark.createDataFrame([("v", 1, 1, 1.0), ("v", 1, 1, 1.0), ("v", 2, 1, 1.0), ("v", 2, 1, 2.0)], "video_id string, frame_idx int, track_id int, x double").withColumn("box", F.struct("x"))
    assert readers.box_conflicts(b).select("frame_idx").collect() == [(2,)]
    assert {tuple(r) for r in readers.missing_keys(b, b.filter("frame_idx = 2"), "frame_idx").collect()} == {(1, "left")}
    meta = spark.createDataFrame([("v", None, 9), ("w", 4, 9)], "video_id string, processed_frames bigint, frame_count bigint")
    assert {tuple(r) for r in readers.frame_limit(None, meta).collect()} == {("v", 9), ("w", 4)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    writers.jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":"x","b":1}'
    with pytest.raises(Exception):
        writers.jsonl(df, str(tmp_path / "j"))
    writers.csv(df, str(tmp_path / "c"))
    for r in (1, 2):
        writers.publish(df.withColumn("b", F.lit(r)), str(tmp_path / "p"), r)
    assert writers.latest(spark, str(tmp_path / "p")).first()["b"] == 2
    with pytest.raises(Exception):
        writers.publish(df, str(tmp_path / "p"), 2)
    writers.bundle(df, str(tmp_path / "z"), "a")

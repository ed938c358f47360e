"""Streams over files that come one by one, against the batch forms."""

import datetime as dt

import numpy as np

from vidlake.streaming import tracker, windows

T0 = dt.datetime(2024, 1, 1)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_sessions(spark, tmp_path):
    rows = [(1, "a", at(s), 0.5) for s in (0, 3, 20, 21, 22)] + [(1, "a", at(1), 0.1), (2, "b", at(1000), 0.9)]
    df = windows.sessions(stream(spark, tmp_path, [rows, [(3, "c", at(5000), 0.9)], [(3, "c", at(9000), 0.9)]], "identity int, event string, ts timestamp, score double"), "10 seconds", "1 minute")
    run(df, "sessions")
    got = spark.table("sessions").filter("identity = 1").orderBy("start").collect()
    assert [(r["support_count"], (r["end"] - r["start"]).seconds) for r in got] == [(2, 13), (3, 12)]


def test_hops_and_repeats(spark, tmp_path):
    rows = [(1, "a", at(s), 1.0) for s in (0, 15, 19)] + [(1, "a", at(0), 1.0)]
    df = stream(spark, tmp_path, [rows], "identity int, event string, ts timestamp, score double")
    run(windows.hops(df, "20 seconds", "10 seconds", "1 minute"), "hops", "update")
    assert {(r["n"], (r["start"] - T0).total_seconds()) for r in spark.table("hops").collect()} == {(2, -10.0), (4, 0.0), (2, 10.0)}
    run(windows.first_seen(df, ["identity", "ts"], "1 minute"), "once")
    assert spark.table("once").count() == 3


def test_frozen_reference(spark, tmp_path):
    df = stream(spark, tmp_path, [[(1,)], [(2,)]], "id int")
    ref = lambda s: s.createDataFrame([(1, "known")], "id int, name string")
    q = windows.against_frozen(df, ref, lambda rows, r: rows.join(r, "id", "left"), str(tmp_path / "out"), str(tmp_path / "chk"))
    q.processAllAvailable()
    q.stop()
    assert {(r["id"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "known"), (2, None)}


def test_tracker_steps():
    live, labels = {}, [0, 1]
    s = lambda *rows: np.array(rows, float)
    out, n = tracker.step(live, 0, 0, [10, 11], s([0, 0, 0.9], [0, 0, 0.8]), labels, 0.5, 0.5, 2)
    assert out == [(10, 0, True), (11, 1, True)] and n == 2
    out, n = tracker.step(live, n, 1, [12], s([0.1, 0.9, 0.0]), labels, 0.5, 0.5, 2)
    assert out == [(12, 1, False)]
    out, n = tracker.step(live, n, 3, [13], s([0.0, 0.1, 0.9]), labels, 0.5, 0.5, 2)
    assert out == [(13, 2, True)] and set(live) == {0, 1} and live[0] == (2, 3)


def test_tracker_stream(spark, tmp_path):
    frames = [[(7, f, d, [0.9 if d == 0 and f else 0.0, 0.9 if d == 1 and f else 0.0, 0.9]) for d in (0, 1)] for f in range(3)]
    df = tracker.track(stream(spark, tmp_path, frames, "video_id bigint, frame_idx bigint, detection bigint, scores array<double>"))
    run(df, "tracked")
    got = sorted((r["frame_idx"], r["detection"], r["track_id"]) for r in spark.table("tracked").collect())
    assert len(got) == 6 and {t for _, _, t in got} == {0, 1}


def test_late_frames_are_violations(spark, tmp_path):
    row = lambda f, d: (7, f, d, [0.0, 0.9])
    df = tracker.track(stream(spark, tmp_path, [[row(5, 0)], [row(3, 1), row(6, 2)]], "video_id bigint, frame_idx bigint, detection bigint, scores array<double>"), miss=0)
    run(df, "late")
    rows = spark.table("late")
    seen = {r.frame_idx: r for r in rows.collect()}
    assert {f for f, r in seen.items() if r.violation is None} >= {6} and len(seen) == 3
    for r in tracker.violations(rows).collect():
        assert (r.frame_idx, r.detection, r.violation) == (3, 1, "late_frame")


def test_state_ends_after_a_time(tmp_path):
    """The state function by hand: after a timeout nothing is kept, so ids start anew."""
    class State:
        def __init__(self):
            self.exists, self.hasTimedOut, self.get, self.wait = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, ms):
            self.wait = ms

    import pandas as pd

    made = {}

    class Grouped:
        def applyInPandasWithState(self, run, *rest):
            made["run"] = run

    class Frame:
        def groupBy(self, key):
            return Grouped()

    tracker.track(Frame(), idle_ms=1234)
    state, rows = State(), pd.DataFrame({"video_id": [1], "frame_idx": [5], "detection": [0], "scores": [[0.0, 0.9]]})
    first = list(made["run"]((1,), iter([rows]), state))[0]
    again = list(made["run"]((1,), iter([rows]), state))[0]
    assert first["track_id"].tolist() == [0] and again["violation"].tolist() == ["late_frame"] and state.wait == 1234
    state.hasTimedOut = True
    assert list(made["run"]((1,), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert list(made["run"]((1,), iter([rows]), state))[0]["violation"].tolist() == [None]

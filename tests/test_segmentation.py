"""Boundary proposals, their merging and segments, on cases worked out by hand."""

from vidlake.operators import segmentation as seg


def proposals(spark, rows, ends):
    states = spark.createDataFrame(rows, "source string, t double, phase string, team string")
    out = seg.reconcile(states, spark.createDataFrame(ends, "source string, duration double")).collect()
    return sorted((r["source"], r["lo"], r["hi"], r["kind"], r["transition"] or "") for r in out)


def test_reconcile(spark):
    rows = [("v", 0.0, "live", "dark"), ("v", 5.0, "live", "dark"), ("v", 10.0, "replay", None), ("v", 11.0, "non_play", None), ("v", 12.0, "live", "light"), ("v", 14.0, "live", "dark"),
            ("w", 3.0, "live", "dark"), ("w", 3.0, "replay", "dark"), ("w", 6.0, "unknown", "dark"), ("w", 7.0, "unknown", "light")]
    assert proposals(spark, rows, [("v", 15.0), ("w", 7.5)]) == [
        ("v", 5.0, 10.0, "content_transition", "game>replay"), ("v", 10.0, 11.0, "content_transition", "replay>non_play"), ("v", 11.0, 12.0, "content_transition", "non_play>game"), ("v", 12.0, 14.0, "possession_change", "light>dark"),
        ("w", 1.0, 5.0, "uncertain", ""), ("w", 6.0, 7.0, "possession_change", "dark>light"),
    ]


def test_an_unknown_team_is_doubted_in_chunks_also_at_the_end(spark):
    rows = [("v", 2.0, "live", "dark"), ("v", 3.5, "live", "unknown"), ("v", 45.0, "live", "light"), ("v", 50.0, "live", None), ("w", 1.0, "live", "dark"), ("w", 5.0, "live", None)]
    assert proposals(spark, rows, [("v", 60.0), ("w", 9.0)]) == [("v", 2.0, 22.0, "uncertain", ""), ("v", 22.0, 42.0, "uncertain", ""), ("v", 25.0, 45.0, "uncertain", ""), ("v", 42.0, 45.0, "uncertain", ""), ("v", 45.0, 60.0, "uncertain", "")]


def test_one_team_for_long_is_doubted_and_ends_are_cut(spark):
    rows = [("v", float(t), "live", "dark") for t in range(0, 100, 5)] + [("v", 99.0, "live", "light"), ("v", 99.0, "live", "dark")]
    assert proposals(spark, rows, [("v", 100.0)]) == [("v", 25.0, 45.0, "uncertain", ""), ("v", 70.0, 90.0, "uncertain", ""), ("v", 97.0, 100.0, "uncertain", "")]


def test_merged_proposals(spark):
    rows = [("v", "a", None, 0.0, 2.0), ("v", "a", None, 1.0, 3.0), ("v", "a", None, 2.5, 9.0), ("v", "a", None, 10.0, 11.0), ("v", "b", "x", 0.0, 1.0), ("w", "a", None, 0.0, 1.0)]
    out = seg.merge_proposals(spark.createDataFrame(rows, "source string, kind string, transition string, lo double, hi double")).collect()
    assert sorted((r["source"], r["kind"], r["lo"], r["hi"], r["n"]) for r in out) == [("v", "a", 0.0, 9.0, 3), ("v", "a", 10.0, 11.0, 1), ("v", "b", 0.0, 1.0, 1), ("w", "a", 0.0, 1.0, 1)]


def test_segments(spark):
    cuts = spark.createDataFrame([("v", t) for t in (0.2, 5.0, 5.3, 19.8)], "source string, at double")
    ends = spark.createDataFrame([("v", 20.0), ("w", 7.0)], "source string, duration double")
    out = seg.segments(cuts, ends).collect()
    assert sorted((r["source"], r["segment"], r["start"], r["end"]) for r in out) == [("v", 1, 0.0, 5.0), ("v", 2, 5.0, 20.0), ("w", 1, 0.0, 7.0)]

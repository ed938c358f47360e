"""Operators on identities beyond what the queries reach."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import assignment
from vidlake.operators import identity as ident


def test_a_deep_chain_of_dependents_is_followed_step_by_step(spark):
    edges = spark.range(40).selectExpr("id", "id - 1 AS needs")
    began = time.perf_counter()
    found = ident.dependents(edges, spark.createDataFrame([(3,)], "id bigint"))
    assert sorted(r.id for r in found.collect()) == list(range(3, 40))
    assert time.perf_counter() - began < 120


def test_dependents_in_a_circle_end(spark):
    edges = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (5, 4)], "id bigint, needs bigint")
    assert sorted(r.id for r in ident.dependents(edges, spark.createDataFrame([(1,)], "id bigint")).collect()) == [1, 2, 3]


def vectors(spark, n, seed=5):
    draw = np.random.default_rng(seed)
    made = draw.normal(size=(n, 8)).astype(np.float32)
    made[3], made[7] = made[2], 0  # a copy, and one without length
    return made, spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(made)], "id bigint, v array<float>, label int")


def cosines(made):
    unit = made.astype(float) / np.maximum(np.linalg.norm(made.astype(float), axis=1, keepdims=True), 1e-300)
    out = np.round(unit @ unit.T, 9)
    np.fill_diagonal(out, np.nan)
    return out


@pytest.mark.parametrize("group, side", [(8192, 1024), (16, 5)])
def test_cosines_in_groups_are_those_of_all_pairs(spark, monkeypatch, group, side):
    monkeypatch.setattr(ident, "GROUP", group)
    monkeypatch.setattr(ident, "SIDE", side)
    made, rows = vectors(spark, 90)
    asked = rows.filter("id % 5 = 1")
    every = cosines(made)
    got = {}
    for r in ident.nearest_by_cosine(rows, asked, "id", "id", "v", 4).orderBy("rank").collect():
        got.setdefault(r["query"], []).append(r.item)
    assert got == {q: sorted((i for i in range(90) if i != q), key=lambda i: (-every[q, i], i))[:4] for q in range(1, 90, 5)}
    ranks = {r["query"]: r["rank"] for r in ident.rank_by_cosine(rows, asked.withColumn("right", F.col("id") + 1), "id", "v", "right").collect()}
    own = np.delete(np.arange(90), 7)
    assert ranks == {q: 1 + int((every[q, own][own != q] > every[q, q + 1]).sum()) for q in range(1, 86, 5) if q + 1 != 7} | {q: 1 for q in (6,)} | {86: 1 + int((every[86, own][own != 86] > every[86, 87]).sum())}
    found = ident.cosine_quantiles(rows, asked, "id", "v", "label", {"low": 0.1, "mid": 0.5}).collect()
    assert len(found) == 18
    for r in found:
        mine = [every[r["query"], i] for i in range(90) if i != r["query"] and i % 3 == r["query"] % 3 and i != 7]
        assert [r["mean"], r["most"], r["low"], r["mid"]] == pytest.approx([np.mean(mine), max(mine), np.quantile(mine, 0.1), np.quantile(mine, 0.5)])


def test_no_task_gets_more_pairs_than_a_group_holds(spark, monkeypatch):
    monkeypatch.setattr(ident, "GROUP", 10)
    _, rows = vectors(spark, 100)
    left, right = ident._dealt(ident._named(rows, "id", "v"), ident._named(rows.filter("id % 5 = 0"), "id", "v"), [])
    assert left.groupBy("_i", "_j").count().agg(F.max("count")).first()[0] < 30 and left.count() == 200 and right.count() == 200


@pytest.mark.parametrize("rows, edges", [(1024, 1 << 22), (16, 50)])
@pytest.mark.parametrize("most", [0.5, 0.9])
def test_complete_link_of_vectors_is_that_of_their_pairs(monkeypatch, rows, edges, most):
    monkeypatch.setattr(assignment, "ROWS", rows)
    monkeypatch.setattr(assignment, "EDGES", edges)
    made = np.random.default_rng(8).normal(size=(90, 4))
    made[5] = made[40] = made[4]
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    unit[9] = np.nan
    apart = np.arange(90) % 7
    far = np.round(1 - unit @ unit.T, 12)
    pairs = [(a, b) for a in range(90) for b in range(a + 1, 90)]
    wanted = assignment.complete_link({p: far[p] for p in pairs if far[p] == far[p]}, list(range(90)), most, {p for p in pairs if apart[p[0]] == apart[p[1]]})
    assert assignment.complete_link_vectors(unit, apart, most).tolist() == [wanted[i] for i in range(90)]


def test_complete_link_of_thousands_of_vectors_takes_seconds():
    made = np.random.default_rng(8).normal(size=(3000, 64))
    began = time.perf_counter()
    group = assignment.complete_link_vectors(made / np.linalg.norm(made, axis=1, keepdims=True), np.arange(3000) % 7, 0.9)
    assert time.perf_counter() - began < 60 and len(set(group.tolist())) < 3000

"""The n-gram Jaccard join against all pairs, by brute force and by SQL."""

import random

import pytest

from tests.compare import spark_rows, sql_rows
from tests.llm.brute import ODD, linked_components, prose, shingle_set
from vidlake.llm import queries, trie_join

SCHEMA = "doc_id bigint, text string, n_shingles int, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, -1, "e") for i, t in rows], SCHEMA)


def near_copies(seed: int) -> list[tuple]:
    """Documents of many lengths with copies that differ by a few words, chains of copies of copies, and shared passages."""
    rnd, rows, i = random.Random(seed), [], 100
    passage = prose(999, 60)
    for base in range(12):
        words = prose(base, rnd.choice([3, 5, 9, 14, 25, 60, 120, 300]))
        if base % 4 == 0:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        for _ in range(rnd.choice([1, 2, 5, 9])):
            rows.append((i, " ".join(words)))
            i += rnd.randint(1, 9)
            if rnd.random() < 0.8:
                words = list(words)
                for _ in range(max(1, len(words) // 120)):
                    words[rnd.randrange(len(words))] = f"new{rnd.randrange(50)}"
            if rnd.random() < 0.3:
                words = words + prose(rnd.randrange(99), max(1, len(words) // 30))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_components_of_all_pairs(spark, n, percent):
    rows = near_copies(n) + ODD
    out = trie_join.ngram_components(frame(spark, rows), n=n, percent=percent).collect()
    wanted = linked_components(rows, n, percent)
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {*wanted.items(), (None, None)}
    sizes = {i: max(len(shingle_set(t, n)) for j, t in rows if j == i) for i in wanted}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert all(r["extra"] == "e" for r in out)


def test_groups_larger_than_blocks(spark, monkeypatch):
    for name, n in (("BLOCK", 4), ("CHARACTERS", 3000), ("SETS", 3), ("BYTES", 2000)):
        monkeypatch.setattr(trie_join, name, n)
    rows = near_copies(77)
    out = trie_join.ngram_components(frame(spark, rows), n=3, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == linked_components(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_sets_over_the_threshold_are_alike_in_a_range(percent):
    """All sets made by taking some n-grams out of, and some into, a set of each size."""
    import numpy as np

    rnd = np.random.default_rng(percent)
    for size in [1, 2, 3, 5, 8, 13, 20, 41, 42, 90, 140, 141, 600, 2500]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
            out = int(rnd.integers(0, size + 1))
            b = np.unique(np.concatenate([a[out:], rnd.integers(0, 1 << 63, int(rnd.integers(0, size // 4 + 2)), dtype=np.uint64)]))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if not len(b) or 100 * both < percent * either:
                continue
            keys, owner, _, leave = trie_join.Ranges(percent, 1 << 14).keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            shared = set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
            assert shared
            # both leave as many keys as they may of the one class in which they must meet, shared ones first
            own = trie_join.Ranges(percent, 1 << 14).keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))[2]
            assert any(len(set(keys[(owner == 0) & (own == c)].tolist()) & shared) > max(leave[own == c], default=0) for c in np.unique(own))


@pytest.mark.parametrize("percent", [80, 90])
def test_links_over_the_last_class_bound(spark, monkeypatch, percent):
    """Two sets on both sides of the bound where the smaller one's table of classes ended, each in a chunk of its own."""
    monkeypatch.setattr(trie_join, "LONGEST", 64)
    bounds = trie_join.Ranges(percent, 400).first.tolist()
    for k in (bounds.index(63), bounds.index(211)):
        rows = [(i, " ".join(f"v{j}" for j in range(n))) for i, n in ((1, bounds[k] - 2), (2, bounds[k] + 2))]
        keys = [{r["gram"] for r in trie_join.range_keys(frame(spark, [row]), "doc_id", "text", 1, percent).collect()} for row in rows]
        assert keys[0] & keys[1]
        out = trie_join.ngram_components(frame(spark, rows).repartition(2, "doc_id"), n=1, percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 1}


def test_empty_table(spark):
    out = trie_join.ngram_components(frame(spark, []))
    assert out.count() == 0 and "component_id" in out.columns


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    assert spark_rows(queries.queries()["op4_ngram_jaccard_join"](spark, d)) == sql_rows(queries.oracle_sql()["op4_ngram_jaccard_join"], d)

"""LM scoring against plain forward recursions and counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import ODD, prose, word_list
from vidlake.llm import hmm

SCHEMA = "doc_id bigint, text string, score string, n_known int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", -1) for i, t in rows], SCHEMA)


def corpus() -> list[tuple]:
    return [(i + 20, " ".join(prose(i % 17, 5 + 13 * i % 200))) for i in range(90)]


def held(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_score_by_counting(spark):
    rows = corpus() + ODD
    train = [t for i, t in rows if i is not None and not held(i)]
    counts = Counter(w for t in train for w in word_list(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    wanted = []
    for i, t in rows:
        c = [counts[w] for w in word_list(t)] + [len(train)]
        wanted.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    out = hmm.op1(frame(spark, [r for r in rows if r[0] is not None])).collect()
    key = lambda r: tuple(r[:5])
    got, wanted = sorted(map(tuple, out), key=key), sorted((w for w in wanted if w[0] is not None), key=key)
    assert [r[:5] for r in got] == [w[:5] for w in wanted]
    assert all(r[5] == pytest.approx(w[5], abs=1e-4) for r, w in zip(got, wanted, strict=True))
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)


@pytest.mark.parametrize("run", [3, 64, 1024])
def test_forward_recursion_of_whole_texts(monkeypatch, run):
    """Products over runs give what the plain recursion gives, token after token."""
    monkeypatch.setattr(hmm, "RUN", run)
    rnd = np.random.default_rng(1)
    k, classes = 5, 40
    model = hmm.Model(rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k), rnd.dirichlet(np.ones(classes), k).T.copy())
    lengths = np.array([1, 2, 63, 64, 65, 129, 1000])
    seq = rnd.integers(0, classes, lengths.sum())
    got, at = hmm.log_likelihoods(seq, lengths, model), 0
    for n, g in zip(lengths, got, strict=True):
        alpha, total = model.start, 0.0
        for t in range(n):
            alpha = (alpha if t == 0 else alpha @ model.move) * model.emit[seq[at + t]]
            total += np.log(alpha.sum())
            alpha = alpha / alpha.sum()
        assert g == pytest.approx(total, rel=1e-9)
        at += n


@pytest.mark.parametrize("run", [1, 2, 3, 64])
def test_expected_counts_of_whole_texts(monkeypatch, run):
    """Expected starts, moves and states of short sequences, by summing over all paths, however runs are cut."""
    monkeypatch.setattr(hmm, "RUN", run)
    from itertools import product

    rnd = np.random.default_rng(2)
    k = 3
    model = hmm.Model(rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k), rnd.dirichlet(np.ones(6), k).T.copy())
    lengths, seq = np.array([4, 1, 6]), rnd.integers(0, 6, 11)
    start, moves, state = np.zeros(k), np.zeros((k, k)), np.zeros((11, k))
    at = 0
    for n in lengths:
        weights = {}
        for path in product(range(k), repeat=int(n)):
            p = model.start[path[0]] * model.emit[seq[at], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[at + t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            start[path[0]] += p / total
            for t in range(n):
                state[at + t, path[t]] += p / total
                if t:
                    moves[path[t - 1], path[t]] += p / total
        at += n
    got = hmm.expected(seq, lengths, model)
    for a, b in zip(got, (start, moves, state), strict=True):
        assert np.allclose(a, b)


def test_a_trained_model_is_better_than_counts(spark):
    """Texts whose topics stay for long: states learn them, so the held-out score is above the base."""
    rows = [(i, " ".join(f"t{i % 4}w{int(w, 36) % 60}" for w in prose(i, 150))) for i in range(160)]
    out = hmm.score_texts(frame(spark, rows).withColumn("held_out", F.col("doc_id") % 5 == 0), F.col("doc_id") % 5 != 0, rounds=8, states=6).filter("held_out").agg(F.avg("score"), F.avg("base_score")).first()
    assert out[0] > out[1]


def test_columns_with_clashing_names(spark):
    rows = corpus()[:20]
    names = ["seq", "_row", "_learn", "rest", "base", "n_head", "h", "_kept0", "_text"]
    plain = hmm.score_texts(frame(spark, rows), F.col("doc_id") % 2 == 0)
    more = hmm.score_texts(frame(spark, rows).select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names))), F.col("doc_id") % 2 == 0)
    assert set(more.columns) == {*plain.columns, *names}
    assert sorted(plain.select("doc_id", "n_known").collect()) == sorted(more.select("doc_id", "n_known").collect())
    assert all(r["seq"] == "x0" and r["_text"] == "x8" for r in more.collect())


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    out = {r["doc_id"]: r for r in hmm.score_texts(docs, F.lit(False)).collect()}
    assert out[1]["n_known"] == 0 and out[1]["train_tokens"] == 0 and out[1]["n_tokens"] == 3 and out[2]["n_tokens"] == 1
    assert out[1]["base_score"] == pytest.approx(0.0)
    assert hmm.score_texts(frame(spark, []), F.lit(True)).count() == 0


def test_expected_counts_take_about_two_passes():
    """Forward and backward take less than 2.3 times the forward pass alone, and moves and states of many texts add up to their tokens."""
    import time

    rnd = np.random.default_rng(4)
    lengths = np.minimum(1 + rnd.geometric(1 / 400, 400), 6_000)
    lengths[:3] = 1, 2, 20_000
    classes, k = 20_000, 8
    seq = rnd.integers(0, classes, lengths.sum()).astype(np.uint16)
    model = hmm.Model(rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k), rnd.dirichlet(np.ones(classes), k).T.copy())
    seconds = {}
    for f in (hmm.log_likelihoods, hmm.expected):
        for _ in range(3):
            began = time.process_time()
            got = f(seq, lengths, model)
            seconds[f] = min(seconds.get(f, 1e9), time.process_time() - began)
    start, moves, state = got
    assert start.sum() == pytest.approx(len(lengths)) and moves.sum() == pytest.approx(len(seq) - len(lengths))
    assert np.allclose(state.sum(axis=1), 1)
    assert seconds[hmm.expected] < 2.3 * seconds[hmm.log_likelihoods]

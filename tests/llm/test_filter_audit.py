"""The audit by applying the filters one after the other, and the matrix word by word."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import spark_rows, sql_rows
from tests.llm.brute import ODD
from tests.llm.test_rows import WORD, docs
from vidlake.llm import filter_audit, queries, term_matrix

SF = "/root/testdata/sf0.001"
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, smaller):
    w = WORD.findall(text)
    tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in text for c in "#$%&*|"), smaller)
    return {f for f, bad in zip("ABCDE", tests, strict=True) if bad}


def plain(rows, labels):
    """rows: (id, text, source); filters applied in turn, order by order."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = [(i, s or "", fails(t or "", i is not None and least[t or ""] < i)) for i, t, s in rows]
    out, share = {}, Counter()
    for part in {s for _, s, _ in judged}:
        for order in permutations("ABCDE"):
            left = [r for r in judged if r[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                redundant = sum(f in r[2] for r in gone)
                left = [r for r in left if f not in r[2]]
                gone += removed
                share[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(r[2] == {f} for r in judged if r[1] == part), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def made(spark, rows, labels, **how):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows).repartition(3), table, **how).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in NUMBERS) for r in got}


@pytest.mark.parametrize("limit", [1 << 24, 300])
def test_against_filters_in_turn(spark, limit):
    draw = random.Random(2)
    texts = [" ".join(draw.choices(["alpha", "BETA", "gamma", "d%lta", "épsilon", "zeta", "\v", "eta", *map(str, range(draw.randint(1, 80)))], k=draw.randint(0, 120))) for _ in range(60)]
    rows = [(k, t, draw.choice(["a", "b", None, ""])) for k, t in enumerate([*texts, *texts[:20], None, "", texts[0]])]
    rows += [(None, texts[1], "a"), (3, texts[3], "b"), (3, texts[3], "b"), (70, texts[3], "b")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1])) for k in range(50)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    assert made(spark, rows, [x for x in labels], limit=limit) == plain(rows, [x for x in labels if x[0] is not None])


def test_odd_texts_and_no_rows(spark):
    rows = [(i, t, "s") for i, t in ODD]
    assert made(spark, rows, [(1, 1, 1)]) == plain(rows, [(1, 1, 1)])
    assert made(spark, [], []) == {}


def test_clashing_names(spark):
    rows = docs(spark, [(1, "a b"), (2, "a b")])
    for name in ("part", "step", "word_id", "n_distinct", "documents", "good", "pattern", "rows", "columns", "labels", "quality"):
        rows = rows.withColumn(name, rows.text)
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    assert {r.kept for r in filter_audit.audit(rows, labels).collect() if r.step == 5} == {0}


def test_matrix_has_every_word_of_every_document(spark):
    rows = [(k, t) for k, t in enumerate([t for _, t in ODD if t is None or len(t) < 5_000] + ["x y x", "y  z\n\nx", "Ärger Ä", None])]
    dictionary, shards = term_matrix.document_term_matrix(docs(spark, rows).repartition(2).select("doc_id", "text"), limit=100)
    words = {r.word_id: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(set(words.values())) == len(words)
    got = {}
    for shard in shards.collect():
        ids = pa.ipc.open_stream(bytes(shard.rows)).read_all().column("doc_id").to_pylist()
        sizes, columns, counts = (term_matrix.spread(bytes(shard[c]), k) for c, k in (("sizes", np.int32), ("columns", np.int64), ("counts", np.int32)))
        at = 0
        for i, n in zip(ids, sizes.tolist(), strict=True):
            got[i] = dict(zip((words[c] for c in columns[at : at + n].tolist()), counts[at : at + n].tolist(), strict=True))
            at += n
    assert got == {i: dict(Counter(WORD.findall(t or ""))) for i, t in rows}


def test_query(spark):
    got = spark_rows(queries.queries()["op11_filter_audit"](spark, SF))
    assert got == sql_rows(queries.oracle_sql()["op11_filter_audit"], SF)

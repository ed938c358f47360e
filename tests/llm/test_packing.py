"""Packing against the library's ids, the optimum of small cases and the rules of a packing."""

import random
import zlib
from functools import cache

import numpy as np
import pytest

from tests.llm.test_rows import docs
from vidlake.llm import packing
from vidlake.llm.pieces import byte_level, byte_level_ids, document_ids
from vidlake.llm.queries import byte_level_path
from vidlake.llm.text import chunks

PATH = byte_level_path()


def fewest(lengths, capacity):
    """The least number of sequences, by all ways to fill one around the longest piece."""
    @cache
    def least(rest):
        if not rest:
            return 0
        best, others = len(rest), rest[1:]
        for mask in range(1 << len(others)):
            if rest[0] + sum(s for i, s in enumerate(others) if mask >> i & 1) <= capacity:
                best = min(best, 1 + least(tuple(s for i, s in enumerate(others) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def whole(plan, counts, capacity):
    seen = np.zeros_like(counts)
    for filling, many in plan:
        assert sum(s * n for s, n in filling) <= capacity
        for s, n in filling:
            seen[s] += n * many
    return (seen == counts).all()


def test_small_cases_are_optimal():
    draw = random.Random(3)
    for case in range(120):
        capacity = draw.choice([7, 10, 20, 50])
        lengths = [draw.randint(1, capacity) if case % 2 else draw.randint(max(1, capacity // 5), capacity // 2) for _ in range(draw.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        found = packing.complete(counts, capacity)
        assert whole(found.plan, counts, capacity)
        assert found.sequences == fewest(lengths, capacity) >= found.bound


def test_completion_beats_best_fit():
    counts = np.bincount([6, 6, 5, 4, 4, 3, 2], minlength=11)  # best fit gives 6+4, 6+4, 5+3+2; a harder one follows
    assert packing.complete(counts, 10).sequences == 3
    counts = np.bincount([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 100 - 44 - 24 - 24 + 8], minlength=101)
    assert packing.complete(counts, 100).sequences <= sum(n for _, n in packing.best_fit(counts, 100))
    draw = np.random.default_rng(5)
    better = 0
    for _ in range(20):
        counts = np.bincount(draw.integers(20, 51, 30), minlength=101)
        better += packing.complete(counts, 100).sequences < sum(n for _, n in packing.best_fit(counts, 100))
    assert better


def test_many_documents_are_near_the_bound():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1024, 200_000), minlength=1025)
    found = packing.complete(counts, 1024, nodes=50)
    assert whole(found.plan, counts, 1024)
    assert found.sequences <= 1.001 * found.bound
    assert len(found.plan) < 7_700


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_library_s(seed):
    import pyarrow as pa

    draw = random.Random(seed)
    alphabet = ["a", "B", "é", "日", "1", "２", "'", "'s", "'re", "'ll", "'t", " ", "  ", "\n", "\t", " ", "　", "!", "<|endoftext|>", "𐍈", "\x1c", "\x85", "​", "\r\n", "▁", "\0"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 14))) for _ in range(3_000)] + [None, ""]
    got = []
    for a, b, data, offs in chunks(pa.array(texts), 1 << 12):
        ids, at = document_ids(data, offs, PATH)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    assert got == [e.ids for e in byte_level(PATH)[0].encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_new_parts_go_to_the_library_together():
    import time

    draw = random.Random(4)
    parts = list({(" " * draw.randint(0, 1) + "".join(draw.choices("abcdefghéß日", k=draw.randint(1, 14)))).encode() for _ in range(60_000)})
    library, encode = byte_level(PATH)[0], byte_level_ids(PATH).encode
    encode(parts[:10])
    began = time.process_time()
    expected = [e.ids for e in library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
    one_by_one, began = time.process_time() - began, time.process_time()
    n, ids, _, _ = encode(parts)
    assert time.process_time() - began < 0.75 * one_by_one
    at = np.append(0, np.cumsum(n)).tolist()
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == expected


def checked(rows, texts, capacity, end=2):
    """Every id of every document once, gapless, in sequences that hold no more than they may."""
    library = byte_level(PATH)[0]
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in texts]
    found, inside = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in enumerate(ids):
        at, parts = 0, sorted(found.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(own) // capacity)))
        assert all(r.length == capacity for r in parts[1:])
        for r in parts:
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : at], "<u4").tobytes())
        assert at == len(own)
    assert not found
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside), sum(map(len, ids))


def test_packed_documents(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choices(["alpha", "be", "gamma,", "Über", "12", "\n"], k=draw.randint(0, 150))) for _ in range(80)] + [None, "", "word " * 1_000, "same text", "same text"]
    frame = docs(spark, list(enumerate(texts)))
    n, total = checked(packing.pack(frame, PATH, capacity=64).collect(), texts, 64)
    assert -(-total // 64) <= n <= 1.1 * total / 64 + 1


def test_sequences_hold_the_ids(spark):
    texts = ["one two three " * n for n in (1, 3, 9, 30)] + [None]
    placed = packing.pack(docs(spark, list(enumerate(texts))), PATH, capacity=32, keep_ids=True)
    sums = {(r.sequence_id, r.offset): r for r in placed.collect()}
    for row in packing.sequences(placed).collect():
        assert len(row.ids) <= 32
        for (sequence, offset), r in sums.items():
            if sequence == row.sequence_id:
                assert zlib.crc32(np.array(row.ids[offset : offset + r.length], "<u4").tobytes()) == r.ids_crc32


def test_null_ids_repeats_other_columns_and_nothing(spark):
    rows = docs(spark, [(None, "a b"), (None, None), (4, "a b"), (4, "a b")])
    for name in ("piece", "start", "length", "sequence_id", "offset", "ids", "__number"):
        rows = rows.withColumn(name, rows.text)
    got = packing.pack(rows, PATH, capacity=8).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 3), (False, 3), (True, 1), (True, 3)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4
    assert packing.pack(docs(spark, []), PATH).collect() == []


def test_query(spark):
    from vidlake.llm.queries import queries

    rows = queries()["op12_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(texts) == list(range(len(texts)))
    n, total = checked(rows, [texts[i] for i in range(len(texts))], 1024)
    assert n <= 1.01 * -(-total // 1024) + 1

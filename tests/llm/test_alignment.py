"""Alignment against whole texts encoded by both libraries, pair by pair."""

import hashlib
import random
from bisect import bisect
from collections import Counter

import pytest

from tests.llm.brute import ODD
from tests.llm.test_rows import docs
from vidlake.llm import alignment
from vidlake.llm.pieces import byte_level
from vidlake.llm.queries import byte_level_path, queries, tokenizer_path

A, B = byte_level_path(), tokenizer_path()


def plain_tokens(text):
    """(ids, byte ends) of both, from what ids decode to."""
    import sentencepiece

    library, piece = byte_level(A)[0], sentencepiece.SentencePieceProcessor(model_file=B)
    table = alignment.byte_alphabet()
    a = library.encode(" " + text, add_special_tokens=False).ids
    b = piece.encode(text)
    spelled = [bytes(table[c] for c in library.id_to_token(i)) for i in a], [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
        return None
    out = []
    for ids, tokens in zip((a, b), spelled, strict=True):
        at, ends = 0, []
        for t in tokens:
            at += len(t)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(texts):
    held, rows = Counter(), []
    for text in texts:
        found = plain_tokens(text or "")
        if found is None:
            rows.append((0, 0, [], Counter(), ""))
            continue
        (a, ends_a), (b, ends_b) = found
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links = [], Counter()
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            own = [ids[bisect(ends, lo) : bisect(ends, hi)] for ids, ends in found]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            links.update((i, j) for i in own[0] for j in own[1])
        held.update(set(links))
        rows.append((len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()), digest) for na, nb, groups, links, digest in rows]


def result(rows):
    return [tuple(r[c] for c in alignment.RESULTS) for r in sorted(rows, key=lambda r: r.doc_id)]


def odd_texts():
    draw = random.Random(4)
    alphabet = ["a", "the", "Häuser", "日本", "1", "23", "'s", " ", "  ", "   ", "\n", "\n\n", "\t", " ", "!?", "<s>", "<|endoftext|>", "𐍈", "\x1c", "é", "re", "ing", "\r\n", "\0", "　", "<0x41>", "…"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 20))) for _ in range(300)]
    return [*texts, None, "", " ", "\n", "a▁b", "▁", " x", "x ", "the the the", "the the the", "𐍈" * 40, "!" * 300, "\t" * 200 + "x", "ab" * 400]


@pytest.mark.parametrize("limit", [1 << 24, 200])
def test_against_whole_texts(spark, limit, monkeypatch):
    texts = odd_texts()
    got = alignment.align(docs(spark, list(enumerate(texts))).repartition(3), A, B, limit=limit).collect()
    assert result(got) == plain(texts)
    assert {r.lang for r in got} == {"en", None}


def test_long_groups_are_counted_before_they_meet():
    import numpy as np

    text = ("x" * 7 + "\t" * 5 + "日") * 60
    data = np.frombuffer(text.encode(), np.uint8)
    aligned = alignment.Aligned(data, np.array([0, len(data)]), A, B)
    doc, pair, times = aligned.links()
    (a, ends_a), (b, ends_b) = plain_tokens(text)
    cuts = sorted(set(ends_a) & set(ends_b))
    wanted = Counter((sum(c < e for c in cuts), i) for i, e in zip(a, ends_a, strict=True))
    links = Counter()
    for j, e in zip(b, ends_b, strict=True):
        for (g, i), n in wanted.items():
            if g == sum(c < e for c in cuts):
                links[i << alignment.B_BITS | j] += n
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == links


def test_odd_rows_and_clashing_names(spark):
    rows = docs(spark, [(i, t) for i, t in ODD if i is not None and (t is None or len(t) < 20_000)])
    for name in ("n_a", "pairs", "count", "best", "rows", "local", "times", "sizes", "pair", "documents"):
        rows = rows.withColumn(name, rows.lang)
    got = alignment.align(rows, A, B).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows.collect())
    assert all(r.pairs == r.lang and r.n_a >= 0 for r in got)
    nulls = alignment.align(docs(spark, [(None, "a b"), (None, None), (3, "a b")]), A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in nulls) == [(False, 2, 4), (True, 0, 0), (True, 2, 4)]
    assert alignment.align(docs(spark, []), A, B).collect() == []


def test_query(spark):
    got = queries()["op13_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert result(got) == plain([texts[i] for i in sorted(texts)])

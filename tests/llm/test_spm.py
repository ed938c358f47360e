"""SentencePiece coding against the library."""

import hashlib
import random

import pytest

from tests.llm.brute import ODD, prose
from vidlake.llm import spm
from vidlake.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def texts() -> list[str]:
    rnd = random.Random(8)
    letters = "abcde éß漢字🙂\n\t▁ <s></s><0x41> .,'\"-​ " + "thing"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(300)] + [" ".join(prose(k, 40)) for k in range(20)] + ["  two  spaces ", "\n\nlines\n", "▁", "▁▁ a", " ", "the the the"]


def test_codec_equals_the_library(library):
    codec = spm.Codec(library.serialized_model_proto(), check=False)
    for text in [*texts(), *(t or "" for _, t in ODD)]:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_query_equals_the_library(spark, library):
    rows = [(100 + k, t) for k, t in enumerate(texts())] + ODD
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in spm.op2(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_decoding_a_table(spark, library):
    made = spm.round_trip(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string"), tokenizer_path())
    out = {r["doc_id"]: r for r in spm.decode(made, tokenizer_path(), into="again").collect()}
    assert out[1]["again"] == out[1]["decoded"] == "one two" and out[2]["ids"] == [library.eos_id()] and out[2]["again"] == ""


def test_empty_table(spark):
    assert spm.op2(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_parts_are_merged_side_by_side_as_alone(library):
    """Parts that are new to a task: all at once they get the ids that the agenda gives each of them, in less than half of its time."""
    import time

    import numpy as np

    rnd = random.Random(3)
    syllables = ["the", "ion", "ung", "é", "ä", "ou", "st", "zz", "0", "漢", "🙂", ".", "x" * 30]
    parts = list({(rnd.choice(["", " ", "  "]) + "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 7)))).encode() for _ in range(20_000)})
    codec = spm.Codec(library.serialized_model_proto())
    alone = [codec.merge(p.decode().replace(" ", spm.SPACE)) for p in parts[:3000]]
    assert [np.frombuffer(ids, np.int32).tolist() for ids in codec.ids_of(parts)[:3000]] == alone
    codec.verify()
    plain = ["".join(rnd.choices("etaoinshr", k=rnd.randrange(4, 15))).encode() for _ in range(20_000)]
    began = time.process_time()
    for p in plain:
        codec.merge(p.decode().replace(" ", spm.SPACE))
    one_by_one = time.process_time() - began
    began = time.process_time()
    codec.merge_all(plain)
    assert time.process_time() - began < one_by_one / 2

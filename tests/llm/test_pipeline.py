"""The corpus pipeline, stage by stage and as a whole, against plain versions of what each stage keeps."""

import random

import pytest

import corpus_pipeline
from tests.llm.brute import ODD, linked_components, prose, word_list
from vidlake.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lines(seed: int, n: int) -> list[str]:
    return [" ".join(prose(seed * 1000 + k, 11)) + "." for k in range(n)]


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd, folder = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    items = [(k, " ".join(f"item{k}w{rnd.randrange(99)}" for _ in range(30))) for k in range(5)]
    passage = " ".join(prose(5555, 70)) + "."
    rows = [(100 + k, "\n".join(lines(k, 12))) for k in range(20)]  # clean
    near = lines(50, 40)
    rows += [(200, "\n".join(near)), (201, "\n".join([*near[:-1], "one line that differs from the other."])), (202, "\n".join(near))]
    rows += [(300 + k, "\n".join([*lines(60 + k, 6), passage, *lines(80 + k, 6)])) for k in range(3)]
    rows += [(400, "\n".join([*lines(95, 10), items[2][1] + "."]))]
    rows += [(500, "\n".join(["Home | News | Sport | Contact", *lines(97, 12)])), (501, "too short")]
    rows += [(1000 + i, t) for i, t in ODD if i is not None]
    table(spark, folder, "documents", [(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)
    table(spark, folder, "benchmark", items, "item_id bigint, text string")
    return folder, dict(rows), passage


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{k}.parquet"
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    return out


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    quality, joined, cut, clean, coded = staged(spark, folder)
    assert set(range(100, 120)) <= set(coded)  # clean documents stay
    assert all(coded[i]["text"] == texts[i] for i in range(100, 120))
    assert 501 not in quality and 1001 not in quality and not quality[500]["text"].startswith("Home")
    assert set(joined) == {min(i for i, c in linked_components([(i, r["text"]) for i, r in quality.items()], 5, 80).items() if c == root) for root in set(linked_components([(i, r["text"]) for i, r in quality.items()], 5, 80).values())}
    assert {200, 201, 202} & set(joined) == {200}
    inside = [i for i in (300, 301, 302) if " ".join(word_list(passage)) in " ".join(word_list(cut[i]["text"]))]
    assert inside == [300] and all(r["n_chars"] == len(r["text"]) for i, r in cut.items() if i in (301, 302))
    assert 400 in cut and 400 not in clean and set(clean) == set(coded)

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert all(r["ids"] == library.encode(r["text"], add_eos=True) and r["n_tokens"] == len(r["ids"]) for r in coded.values())


def test_run_gives_the_stages_rows(spark, corpus):
    folder, *_ = corpus
    out = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()}
    assert out == staged(spark, folder)[-1]


def test_empty_tables(spark, tmp_path):
    table(spark, str(tmp_path), "documents", [], SCHEMA)
    table(spark, str(tmp_path), "benchmark", [], "item_id bigint, text string")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Training-text pipeline over documents: clean, join near duplicates, cut shared passages, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents, and whatever other columns these have; texts that a stage changes get their new n_chars. An empty
table stays empty in every stage. Rows that repeat an id are one document: a stage judges them together where it joins
by id, and keeps or drops each. Rows without an id pass all stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.llm import decontam, passages, quality, spm, trie_join
from vidlake.llm.queries import table, tokenizer_path

#: Near duplicates here: sets of so many words in a row, and a similarity in per cent.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, null and empty texts among them, and takes failed lines out of the others. Ids play no part."""
    kept = quality.line_clean(docs).filter("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, all its rows if it has several. A document without words is linked with nothing and stays."""
    grouped = trie_join.ngram_components(docs, n=WORDS, percent=PERCENT)
    return grouped.filter(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too; a document with no word left goes. Null texts stay as they are."""
    done = passages.cut(docs, passages.shared_passages(docs))
    left = done.filter((F.col("n_cut_words") == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return left.withColumn("n_chars", F.when(F.col("n_cut_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null texts hold none; a null id is no document's, so such rows stay; an empty benchmark drops nothing."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and what the ids decode to, as a checksum. A null text is an empty one: the end id alone."""
    return spm.round_trip(docs, tokenizer_path(), added=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
#: SQL cannot express the latent search and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""Queries over the whole driver tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidlake.llm import alignment, decontam, filter_audit, hilbert, hmm, langid, licenses, packing, passages, quality, spm, trie_join, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The merge-type vocabulary of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_path() -> str:
    """The byte-level vocabulary of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Query]:
    return {
        "op1_lm_scoring": on_documents(hmm.op1),
        "op2_sentencepiece": on_documents(lambda docs: spm.op2(docs, tokenizer_path())),
        "op3_substring_dedup": on_documents(passages.op3),
        "op4_ngram_jaccard_join": on_documents(trie_join.op4),
        "op5_url_filters": lambda spark, sf_dir: urls.op5(table(spark, sf_dir, "pages")),
        "op6_license_scan": on_documents(licenses.op6),
        "op7_hilbert_sharding": on_documents(hilbert.op7),
        "op8_quality_rules": on_documents(quality.op8),
        "op9_decontamination": lambda spark, sf_dir: decontam.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op10_language_id": on_documents(langid.op10),
        "op11_filter_audit": lambda spark, sf_dir: filter_audit.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op12_best_fit_packing": on_documents(lambda docs: packing.op12(docs, byte_level_path())),
        "op13_token_alignment": on_documents(lambda docs: alignment.op13(docs, byte_level_path(), tokenizer_path())),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": trie_join.op4_sql(), "op8_quality_rules": quality.op8_sql(), "op11_filter_audit": filter_audit.op11_sql()}

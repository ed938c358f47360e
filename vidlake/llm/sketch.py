"""A bitmap of bounded size that tells which keys cannot be in a table, to leave rows out before a shuffle.

It passes every key of the table and some others, so it changes what a join moves, never what it gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.text import mix, tidy

#: Bits at most (8 MB), and words of 64 bits that come to the driver as one value.
LIMIT, PIECE = 1 << 26, 1 << 13


class Sketch:
    def __init__(self, words: np.ndarray):
        self.words = words

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """keys: 64-bit values, spread by hashing."""
        at = mix(keys.astype(np.uint64)) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def sketch_of(keys: DataFrame, column: str) -> Sketch:
    """Of a long column; each task makes its part, the parts are merged word by word."""
    n = max(keys.count(), 1)
    size = min(LIMIT, 1 << max(16, (16 * n - 1).bit_length()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(size - 1))
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array((np.bitwise_or.reduceat(bit, first) if len(first) else bit).view(np.int64))], ["word", "bits"])

    def piece(words: pa.Table) -> pa.Table:
        whole = np.zeros(min(PIECE, size // 64), np.uint64)
        at = words.column("word").to_numpy()
        np.bitwise_or.at(whole, at % PIECE, words.column("bits").to_numpy().view(np.uint64))
        return pa.table({"piece": pa.array([int(at[0]) // PIECE], pa.int64()), "bits": pa.array([whole.tobytes()], pa.binary())})

    made = keys.select(column).filter(F.col(column).isNotNull()).mapInArrow(run, "word bigint, bits bigint")
    pieces = made.groupBy(F.floor(F.col("word") / PIECE).alias("_piece")).applyInArrow(piece, "piece bigint, bits binary")
    words = np.zeros(size // 64, np.uint64)
    for row in pieces.collect():
        held = np.frombuffer(row["bits"], np.uint64)
        words[row["piece"] * PIECE : row["piece"] * PIECE + len(held)] = held
    return Sketch(words)


def may_be_in(column: Column, sketch: Sketch) -> Column:
    """Whether a long column's value may be among the sketched ones; false for null."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in columns:
            held = sketch.may_hold(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.array(held & keys.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "boolean")(column.cast("long"))


def texts_of(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows whose ids are in a table (column id), and perhaps a few others."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.filter(may_be_in(F.col("id"), sketch_of(ids, "id")))

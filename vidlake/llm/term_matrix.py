"""A sparse document-term matrix of a corpus: words under numbers of one dictionary, documents' rows in compressed shards.

Documents are worked through in shards of a bounded number of bytes. A shard lists its words once and numbers documents'
words by that list; lists, not documents' words, are shuffled by word, numbered there, and sent back to their shards. A
word's number is made of the bucket that its hash gives it and its rank in that bucket: whole for the corpus, without
collisions, and as dense as the buckets are even.

Words are case-sensitive runs of bytes that are no ASCII white space. A null or empty text has an empty row. Equal rows
get a row each. An empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.text import chunks, spans
from vidlake.storage import saved

#: Bytes of text handled at once, and in a shard.
BYTES, SHARD = 1 << 20, 1 << 24

#: What is noted of each text while it is at hand: name, type, and values of a chunk's texts from its bytes and offsets.
Note = tuple[str, pa.DataType, Callable[[np.ndarray, np.ndarray], pa.Array]]


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values))


def spread(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's start among them."""
    starts, ends, at = spans(data, offs)
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = starts, ends, len(data)
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2))), at


def rows_of(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of each text, columns, counts): words' numbers of each text in order, once each."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = np.sort((doc << 32) | code)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return np.bincount(key[first] >> 32, minlength=len(at) - 1), (key[first] & 0xFFFFFFFF).astype(np.int32), np.diff(np.append(first, len(key))).astype(np.int32)


def local_shards(docs: DataFrame, text: str, notes: list[Note], limit: int) -> DataFrame:
    """A row for each shard: its documents' other columns and notes, its words, and the matrix under the shard's own numbers."""
    source, others = docs.schema[text].name, [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        number, held = 0, 0
        rows: list[pa.RecordBatch] = []
        parts: list[tuple[pa.Array, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            coded = pc.dictionary_encode(pa.chunked_array([w for w, _ in parts], pa.large_binary())).unify_dictionaries()
            listed = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_binary())
            entries = [rows_of(c.indices.to_numpy().astype(np.int64), at) for c, (_, at) in zip(coded.chunks, parts, strict=True)]
            size, column, count = (np.concatenate([e[k] for e in entries]) for k in range(3))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for r in rows:
                    out.write_batch(r)
            length = pc.binary_length(listed).to_numpy(zero_copy_only=False).astype(np.int32)
            values = [first + number, sink.getvalue().to_pybytes(), squeezed(length), zstandard.ZstdCompressor(level=1).compress(b"".join(listed.to_pylist())), squeezed(size.astype(np.int32)), squeezed(column), squeezed(count)]
            rows.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=["__shard", "rows", "lengths", "words", "sizes", "columns", "counts"])

        for batch in batches:
            for a, b, data, offs in chunks(batch.column(source), BYTES):
                noted = [pc.cast(make(data, offs), kind) for _, kind, make in notes]
                rows.append(pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in others), *noted], names=[*others, *(n for n, _, _ in notes)]))
                parts.append(words_of(data, offs))
                held += len(data)
                if held >= limit:
                    yield done()
                    number, held = number + 1, 0
        if rows:
            yield done()

    return docs.mapInArrow(run, "__shard bigint, rows binary, lengths binary, words binary, sizes binary, columns binary, counts binary")


def listed_words(shards: DataFrame) -> DataFrame:
    """(shard, place in its list, word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lengths, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edges = np.append(0, np.cumsum(spread(lengths, np.int32))).astype(np.int64)
                all_words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(zstandard.ZstdDecompressor().decompress(words))])
                for k in range(0, len(all_words), 1 << 14):
                    part = all_words.slice(k, 1 << 14)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), part.cast(pa.binary())], names=["__shard", "place", "word"])

    return shards.select("__shard", "lengths", "words").mapInArrow(run, "__shard bigint, place int, word binary")


def encoded(words: DataFrame, buckets: int) -> DataFrame:
    """Adds word_id to rows with words: rank of the word in its bucket, and the bucket."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("__bucket").orderBy("word"))
    return words.withColumn("__bucket", bucket).withColumn("word_id", (rank - 1).cast("long") * buckets + F.col("__bucket")).drop("__bucket")


def document_term_matrix(docs: DataFrame, text: str = "text", notes: list[Note] | None = None, limit: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(dictionary, shards): words as UTF-8 with their numbers, a row for each word and shard that has it; and for each shard its documents (an Arrow stream of
    their other columns and notes) and their rows of the matrix: entries of each row, words' numbers and counts, as compressed arrays of int32, int64 and int32."""
    shards = saved(local_shards(docs, text, notes or [], limit))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = encoded(listed_words(shards), buckets)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = np.empty(len(right), np.int64)
        number[right.column("place").to_numpy()] = right.column("word_id").to_numpy()
        columns = [squeezed(number[spread(c, np.int32)]) for c in left.column("columns").to_pylist()]
        return pa.table({"__shard": left.column("__shard"), "rows": left.column("rows"), "sizes": left.column("sizes"), "columns": pa.array(columns, pa.binary()), "counts": left.column("counts")})

    numbers = dictionary.select("__shard", "place", "word_id")
    local = shards.select("__shard", "rows", "sizes", "columns", "counts")
    matrix = local.groupBy("__shard").cogroup(numbers.groupBy("__shard")).applyInArrow(run, "__shard bigint, rows binary, sizes binary, columns binary, counts binary")
    return dictionary, matrix


def row_totals(matrix: DataFrame, fields: str, names: list[str]) -> DataFrame:
    """The documents' columns and notes, with each matrix row's sum (n_words) and number of entries that are not zero (n_distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sizes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = pa.ipc.open_stream(rows).read_all()
                size, total = spread(sizes, np.int32), np.append(0, np.cumsum(spread(counts, np.int32)))
                end = np.cumsum(size)
                table = table.append_column("n_words", pa.array(total[end] - total[end - size])).append_column("n_distinct", pa.array(size.astype(np.int64)))
                yield from table.select(names).combine_chunks().to_batches(max_chunksize=4096)

    return matrix.select("rows", "sizes", "counts").mapInArrow(run, fields)

"""Sharding along a Hilbert curve over quantised metadata, for pruning files in several dimensions at once.

Null numbers and null strings fall in the lowest cell; strings are ordered by the ranks of their distinct values. Cells
are quantiles of the rows, so a dimension of few values is spread over all cells by how many rows have each. Ties on the
curve are broken by the columns given for it. The law of shards is that of rows: counts differ by one at most, so bytes
may differ much between shards, as size is one of the dimensions. In the query equal texts are put where the row with
the smallest id is, and lie side by side by their checksum: only a cut between two shards can part them. Equal rows each
get a slot of their own. An empty table gives an empty table. Other columns pass through, but those named curve, shard
or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.numbering import numbered
from vidlake.storage import saved


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the curve of points with ``bits`` bits in each dimension: Gray-code the axes, undo rotations from the top bit down."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        x[0] = np.where((x[0] & q) > 0, x[0] ^ low, x[0])
        for i in range(1, n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0], x[i] = np.where(up, x[0] ^ low, x[0] ^ swap), x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def with_ordinal(df: DataFrame, dim: str, kind: str, name: str) -> DataFrame:
    """Adds a number in the column's own order: numbers as they are, strings by the rank of their value."""
    if kind != "string":
        return df.withColumn(name, F.coalesce(F.col(dim).cast("double"), F.lit(float("-inf"))))
    ranks = numbered(df.select(F.col(dim).alias("__value")).filter("__value is not null").distinct(), ["__value"], "__rank")
    ranked = df.join(ranks, F.col(dim) == F.col("__value"), "left")
    return ranked.withColumn(name, F.coalesce(F.col("__rank").cast("double"), F.lit(float("-inf")))).drop("__value", "__rank")


def below(grid: Column, value: Column) -> Column:
    """How many of the cut points are smaller than the value."""
    return F.size(F.filter(grid, lambda c: c < value))


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Adds __cell0.. with the quantile of each dimension's value, from cut points over all rows."""
    kinds = dict(df.dtypes)
    keyed = df
    for i, d in enumerate(dims):
        keyed = with_ordinal(keyed, d, kinds[d], f"__key{i}")
    parts = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = keyed.agg(*(F.percentile_approx(f"__key{i}", parts, 1000).alias(f"c{i}") for i in range(len(dims)))).first()
    for i in range(len(dims)):
        steps = sorted(cuts[f"c{i}"] or [])
        grid = F.array(*map(F.lit, steps)).cast("array<double>") if steps else F.array().cast("array<double>")
        keyed = keyed.withColumn(f"__cell{i}", below(grid, F.col(f"__key{i}")))
    return keyed.drop(*(f"__key{i}" for i in range(len(dims))))


def on_curve(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Adds _curve, each row's place on the curve."""
    def place(cells: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for cell in cells:
            yield pd.Series(hilbert_index([cell[c].to_numpy() for c in cell.columns], bits))

    names = [f"__cell{i}" for i in range(len(dims))]
    udf = F.pandas_udf(place, "long")
    return quantised(df, dims, bits).withColumn("__curve", udf(F.struct(*names))).drop(*names)


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, tie: list[str], bits: int = 5) -> DataFrame:
    """Adds curve, shard and slot: rows in curve order are cut into runs whose counts differ by one at most."""
    df = df.drop(*({"curve", "shard", "slot"} - {*dims, *tie}))
    spread = numbered(on_curve(df, dims, bits), ["__curve", *tie], "__row")
    total = spread.count()
    out = spread.withColumn("shard", F.expr(f"(__row * {shards}) div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return out.withColumn("slot", F.col("__row") - first).withColumnRenamed("__curve", "curve").drop("__row")


def write_shards(df: DataFrame, path: str, dims: list[str], tie: list[str], shards: int, bits: int = 5) -> None:
    """Writes whole rows as one file a shard, in curve order, so that the files' statistics prune on every dimension."""
    placed = hilbert_shards(df, dims, shards, tie, bits)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7(docs: DataFrame, shards: int = 16) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    # texts of one size and checksum, be they equal or not, have the place of one of them
    place = saved(keys.groupBy("size", "text_crc32").agg(F.min(F.struct("doc_id", "source", "lang")).alias("__first")))
    keys = keys.drop("source", "lang").join(place, ["size", "text_crc32"]).withColumns({"source": F.col("__first.source"), "lang": F.col("__first.lang")}).drop("__first")
    placed = hilbert_shards(keys, ["size", "lang", "source"], shards, ["size", "text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")

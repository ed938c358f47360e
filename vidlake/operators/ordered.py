"""Working through the rows of each key in order, one key after the other, without a grouped frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_key(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """step gets the rows of one key as tuples, in order, and gives rows of the schema; a task passes from key to key of its sorted partition."""
    made = StructType.fromDDL(schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(made)
        held: list[tuple] = []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        for part in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[-1][:n] != row[:n]:
                    out += step(held)
                    held = []
                held.append(row)
            yield batch(out)
        if held:
            yield batch(step(held))

    first = [*keys, *(c for c in rows.columns if c not in keys)]
    return rows.select(*first).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, made)

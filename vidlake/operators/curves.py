"""Running sums and envelopes along ordered rows of a group, however many rows a group has.

Rows are dealt by ranges of group and order, so that a large group lies in many tasks. Each task sums up its own run of
a group; what comes before a run is a sum over one row for each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.storage import saved

PART, AT = "_curve_part", "_curve_at"


def _same(by: list[str], other: str) -> Column:
    out = F.col(f"a.{PART}") == F.col(f"{other}.{PART}")
    for c in by:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"{other}.{c}"))
    return out


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the named sums over the rows of a group up to each row. Two more columns say where a row stands; ``envelope`` needs them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_sum_{n}": c for n, c in sums.items()})
    ranged = named.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # ranges are drawn from a sample: written once, they cannot be drawn differently for the sums of runs
    at = saved(ranged.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))
    inside = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    own = at.withColumns({f"_sum_{n}": F.sum(f"_sum_{n}").over(inside) for n in sums})
    runs = at.groupBy(*by, PART).agg(*(F.sum(f"_sum_{n}").alias(f"_run_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({f"_run_{n}": F.coalesce(F.sum(f"_run_{n}").over(before), F.lit(0)) for n in sums})
    joined = own.alias("a").join(runs.alias("r"), _same(by, "r"))
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), *((F.col(f"a._sum_{n}") + F.col(f"r._run_{n}")).alias(n) for n in sums), F.col(f"a.{PART}"), F.col(f"a.{AT}"))


def envelope(at: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, to rows of ``running``, the largest value of a group from each row on."""
    named = at.withColumns({f"_top_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*by, PART).orderBy(F.desc(AT)).rowsBetween(Window.unboundedPreceding, 0)
    own = named.withColumns({f"_top_{n}": F.max(f"_top_{n}").over(inside) for n in values})
    runs = named.groupBy(*by, PART).agg(*(F.max(f"_top_{n}").alias(f"_run_{n}") for n in values))
    after = Window.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({f"_run_{n}": F.max(f"_run_{n}").over(after) for n in values})
    joined = own.alias("a").join(runs.alias("r"), _same(by, "r"))
    return joined.select(*(F.col(f"a.{c}") for c in at.columns), *(F.greatest(F.col(f"a._top_{n}"), F.col(f"r._run_{n}")).alias(n) for n in values))

"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from vidlake.storage import saved



def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of a link (a, b), the smallest id it is joined to.

    Each round points every id at its smallest neighbour and replaces ids by what they point at, until no link
    is left; the pointers are then followed back. Links without both ends are ignored; none give an empty table.
    """
    links = saved(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_low")).select("id", F.least("id", "_low").alias("to")))
        rounds.append(point)
        moved = links.join(point, F.col("a") == F.col("id")).select(F.col("to").alias("a"), "b")
        moved = moved.join(point, F.col("b") == F.col("id")).select("a", F.col("to").alias("b"))
        links = saved(moved.filter("a <> b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # rounds may leave a chain id -> to within one round; following the later rounds' pointers ends at the smallest id
    out = rounds[0].withColumnRenamed("to", "component")
    for later in rounds[1:]:
        step = later.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        out = out.join(step, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("_to", "component").alias("component"))
    return saved(out)

"""Identities: evidence, consensus, constrained grouping, owners and aliases."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vidlake.functions import values as v
from vidlake.operators.assignment import complete_link, complete_link_vectors
from vidlake.storage import saved


def spaced(times: Column, gap: float) -> Column:
    """Times kept greedily, in order, each ``gap`` or more after the one before."""
    return F.aggregate(F.array_sort(times), F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(t))).otherwise(kept))


def number_consensus(readings: DataFrame, key: str, gap: float = 0.5, least: int = 2) -> DataFrame:
    """One row a track: the number, if there is one only and readings far enough apart support it. readings: key, number, timestamp_s."""
    by = readings.groupBy(key, "number").agg(F.collect_set(F.col("timestamp_s").cast("double")).alias("_t"))
    by = by.withColumn("_s", F.when(F.col("number").isNotNull(), F.size(spaced(F.col("_t"), gap))))
    out = by.groupBy(key).agg(F.count("number").alias("n_numbers"), F.coalesce(F.max("_s"), F.lit(0)).cast("long").alias("support"), F.min("number").alias("_one"))
    status = F.when(F.col("n_numbers") == 0, "unreadable").when(F.col("n_numbers") > 1, "conflict").when(F.col("support") >= least, "consensus").otherwise("partial")
    return out.withColumn("status", status).withColumn("number", F.when(F.col("status") == "consensus", F.col("_one"))).drop("_one")


def team_palette(colours: DataFrame, least: int = 2) -> DataFrame:
    """The two team colours of each clip, if exactly two are on ``least`` tracks or more. colours: clip, track_id, colour."""
    by = colours.groupBy("clip", "colour").agg(F.count_distinct("track_id").alias("_n")).filter(F.col("_n") >= least)
    return by.groupBy("clip").agg(F.array_sort(F.collect_list("colour")).alias("palette")).filter(F.size("palette") == 2)


def block_reasons(pairs: DataFrame, least_iou: float = 0.9) -> DataFrame:
    """Why two tracks cannot be one, in order; pairs: manual, label_a, label_b, common_frames, min_iou."""
    tests = [(F.coalesce("manual", F.lit(False)), "manual_cannot_link"), (F.col("label_a") != F.col("label_b"), "different_labels"), ((F.col("common_frames") > 0) & (F.col("min_iou") < least_iou), "seen_together")]
    return pairs.withColumn("reasons", v.reasons(*tests))


def resolve(pairs: DataFrame, tracks: DataFrame, most: float) -> DataFrame:
    """Complete-link groups of each clip; pairs: clip, a, b, distance, blocked; tracks: clip, track_id."""
    rows = tracks.select("clip", F.col("track_id").alias("a"), F.col("track_id").alias("b"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("blocked"))
    every = pairs.select("clip", "a", "b", "distance", "blocked").unionByName(rows)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(p.loc[p["a"] == p["b"], "a"]))
        edges = p[p["a"] != p["b"]]
        key = [(min(a, b), max(a, b)) for a, b in zip(edges["a"], edges["b"], strict=True)]
        near = {k: d for k, d in zip(key, edges["distance"], strict=True) if d == d and d is not None}
        group = complete_link(near, ids, most, {k for k, x in zip(key, edges["blocked"], strict=True) if x})
        return pd.DataFrame({"clip": p["clip"].iloc[0], "track_id": ids, "person_id": [group[i] for i in ids]})

    kinds = dict(tracks.dtypes)
    return every.groupBy("clip").applyInPandas(run, f"clip {kinds['clip']}, track_id bigint, person_id bigint")


def resolve_vectors(tracks: DataFrame, most: float) -> DataFrame:
    """Complete-link groups of each clip by cosine distance; tracks: clip, track_id, vector, apart. Tracks with equal ``apart`` are never one person.

    A clip's tracks meet in one group, as each joining depends on those before; only their vectors go there, no pairs.
    """
    kinds = dict(tracks.dtypes)
    schema = to_arrow_schema(StructType.fromDDL(f"clip {kinds['clip']}, track_id bigint, person_id bigint"))

    def run(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows.column("track_id").to_numpy(), return_index=True)
        vectors = rows.column("vector").take(first).to_pylist()
        size = max((len(x) for x in vectors if x is not None), default=0)
        made = pa.table({"vector": [[0.0] * size if x is None else x for x in vectors]})
        group = complete_link_vectors(_unit(made, "vector"), rows.column("apart").to_numpy()[first], most)
        return pa.table({"clip": rows.column("clip").take(first), "track_id": ids, "person_id": ids[group]}).cast(schema)

    return tracks.filter("track_id is not null").select("clip", F.col("track_id").cast("long").alias("track_id"), "vector", "apart").groupBy("clip").applyInArrow(run, f"clip {kinds['clip']}, track_id bigint, person_id bigint")


def prototype(samples: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """Weighted mean vector of each key, of length 1."""
    flat = samples.select(key, weight.alias("_w"), F.posexplode(vector).alias("dim", "_x"))
    mean = flat.groupBy(key, "dim").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    norm = F.sqrt(F.sum(F.col("_m") ** 2).over(Window.partitionBy(key)))
    return mean.select(key, "dim", v.ratio(F.col("_m"), norm).alias("value"))


def follow(aliases: DataFrame, most: int = 16) -> DataFrame:
    """(id, target): the end of each chain of aliases (id -> to). A cycle is an error, as is a chain longer than 2^most."""
    hop = aliases.select("id", F.col("to").alias("target"))
    for _ in range(most):
        step = hop.select(F.col("id").alias("_id"), F.col("target").alias("_to"))
        ahead = hop.join(step, F.col("target") == F.col("_id"), "left")
        if ahead.filter("_id is not null").isEmpty():
            return hop
        if not ahead.filter("id = _to").isEmpty():
            raise ValueError("aliases go round in a circle")
        hop = saved(ahead.select("id", F.coalesce("_to", "target").alias("target")))
    raise ValueError("aliases go round in a circle")


def dependents(edges: DataFrame, changed: DataFrame, most: int = 64) -> DataFrame:
    """All ids that depend, over any number of steps, on the changed ones. edges: (id, needs); changed: id."""
    edges = saved(edges.select("id", "needs"))
    reached = front = saved(changed.select("id").distinct())
    for _ in range(most):
        # saved, so that a step starts from the one before and does not run all of them again
        front = saved(edges.join(front.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct().join(reached, "id", "left_anti"))
        if front.isEmpty():
            return reached
        reached = reached.union(front)
    raise ValueError(f"dependencies are deeper than {most} steps")


def nearest_player(distances: DataFrame, key: str, novelty: float, margin: float) -> DataFrame:
    """The nearest player, unless it is too far (new) or a second is about as near (ambiguous). distances: key, player, distance."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "player"))
    two = distances.withColumn("_n", rank).filter("_n <= 2").groupBy(key).agg(F.min("distance").alias("best"), F.max(F.when(F.col("_n") == 2, F.col("distance"))).alias("second"), F.min(F.when(F.col("_n") == 1, F.col("player"))).alias("_p"))
    decision = F.when(F.col("best") > novelty, "new").when(F.col("second") - F.col("best") < margin, "ambiguous").otherwise("match")
    return two.withColumn("decision", decision).withColumn("player", F.when(F.col("decision") == "match", F.col("_p"))).drop("_p")


#: Vectors on each side of a group of pairs, and those multiplied at once.
GROUP, SIDE = 8192, 1024


def _unit(batch: pa.Table, vector: str) -> np.ndarray:
    """Vectors as rows of length one; one without length is all NaN."""
    made = np.array(batch.column(vector).to_pylist(), np.float64).reshape(batch.num_rows, -1)
    size = np.linalg.norm(made, axis=1, keepdims=True)
    return np.divide(made, size, out=np.full_like(made, np.nan), where=size > 0)


def _dealt(items: DataFrame, queries: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into parts of about GROUP rows of each key, each part of one beside each of the other: columns _i and _j name the group."""
    def parts(rows: DataFrame) -> DataFrame:
        size = rows.groupBy(*by).agg(F.ceil(F.count("*") / GROUP).alias("_parts"))
        return size if by else size.filter("_parts > 0")

    sizes = [saved(parts(rows)) for rows in (items, queries)]
    n = sizes[0].withColumnRenamed("_parts", "_is")
    n = n.join(sizes[1].withColumnRenamed("_parts", "_js"), by) if by else n.crossJoin(sizes[1].withColumnRenamed("_parts", "_js"))  # single rows
    place = lambda rows: rows.join(n, by) if by else rows.crossJoin(F.broadcast(n))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = place(items).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_is"))).withColumn("_j", each("_js"))
    right = place(queries).withColumn("_j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_js"))).withColumn("_i", each("_is"))
    return left.drop("_is", "_js"), right.drop("_is", "_js")


def _by_cosine(items: DataFrame, queries: DataFrame, by: list[str], digits: int, found: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table], pa.Table], schema: str) -> DataFrame:
    """found's rows for each slice of items and queries: (item ids, query ids, rounded cosines of items by queries, the queries' rows).

    items, queries: id, vector, by, and further columns of queries. A cosine of a vector without length is NaN, as is that of an item with itself.
    Tasks get groups of bounded size; queries and items meet once.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [kinds.empty_table()]
        if left.num_rows and right.num_rows:
            ids, vectors = left.column("id").to_numpy(), _unit(left, "vector")
            for lo in range(0, right.num_rows, SIDE):
                part = right.slice(lo, SIDE)
                asked, wanted = part.column("id").to_numpy(), _unit(part, "vector")
                for at in range(0, len(ids), SIDE):
                    made = np.round(vectors[at : at + SIDE] @ wanted.T, digits)
                    made[ids[at : at + SIDE, None] == asked[None]] = np.nan
                    out.append(found(ids[at : at + SIDE], asked, made, part).cast(kinds))
        return pa.concat_tables(out)

    held = lambda rows: rows.filter("id is not null and vector is not null")
    left, right = _dealt(held(items), held(queries), by)
    keys = [*by, "_i", "_j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _named(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), *(F.col(c).alias(c) for c in more))


def nearest_by_cosine(vectors: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """(query, item, score, rank): the k vectors nearest to each query, smaller keys first on ties. Each task keeps a slice's best k only; a vector without length is at 0."""
    def best(items: np.ndarray, asked: np.ndarray, score: np.ndarray, part: pa.Table) -> pa.Table:
        score = np.where(items[:, None] == asked[None], -np.inf, np.nan_to_num(score, nan=0.0))
        last = len(items) - min(k, len(items))
        a, b = np.nonzero((score >= np.partition(score, last, axis=0)[last]) & np.isfinite(score))
        # of many at the last place, the smallest keys
        order = np.lexsort((items[a], -score[a, b], b))
        a, b = a[order], b[order]
        kept = np.arange(len(b)) - np.searchsorted(b, b) < k
        a, b = a[kept], b[kept]
        return pa.table({"query": asked[b], "item": items[a], "score": score[a, b]})

    found = _by_cosine(_named(vectors, key, vector), _named(queries, query, vector), [], digits, best, "query bigint, item bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_by_cosine(vectors: DataFrame, queries: DataFrame, key: str, vector: str, right: str, digits: int = 9) -> DataFrame:
    """(query, rank): one more than the vectors nearer to the query than its right item; 1 where one of the two has no vector. queries: key, vector, right; ids name one vector each."""
    own = _named(vectors, key, vector).select(F.col("id").alias(right), F.col("vector").alias("_right"))
    asked = _named(queries, key, vector, right).join(own, right)

    def nearer(items: np.ndarray, asked_: np.ndarray, score: np.ndarray, part: pa.Table) -> pa.Table:
        least = np.round(np.einsum("ij,ij->i", _unit(part, "vector"), _unit(part, "_right")), digits)
        return pa.table({"query": asked_, "n": (score > least[None]).sum(axis=0)})

    whole = F.col("vector").isNotNull() & F.col("_right").isNotNull()
    found = _by_cosine(_named(vectors, key, vector), asked.filter(whole), [], digits, nearer, "query bigint, n bigint")
    found = found.unionByName(asked.filter(~whole).select(F.col("id").alias("query"), F.lit(0).cast("long").alias("n")))
    return found.groupBy("query").agg((F.sum("n") + 1).alias("rank"))


def cosine_quantiles(vectors: DataFrame, queries: DataFrame, key: str, vector: str, by: str, shares: dict[str, float], digits: int = 9) -> DataFrame:
    """(query, mean, most, and a column for each share) of each query's cosines with the other vectors of its key ``by``, straight between ranks.

    Rounded cosines are whole numbers of the last digit, four bytes each (up to 9 digits), and go to their query packed.
    """
    unit = 10.0**digits
    named = lambda rows: _named(rows, key, vector, by).filter(F.col(by).isNotNull())

    def packed(items: np.ndarray, asked: np.ndarray, score: np.ndarray, part: pa.Table) -> pa.Table:
        made = [np.rint(x[~np.isnan(x)] * unit).astype(np.int32).tobytes() for x in score.T]
        return pa.table({"query": asked, "scores": pa.array(made, pa.binary())})

    found = _by_cosine(named(vectors), named(queries), [by], digits, packed, "query bigint, scores binary")
    fields = "query bigint, mean double, most double" + "".join(f", {c} double" for c in shares)
    kinds = to_arrow_schema(StructType.fromDDL(fields))

    def one(rows: pa.Table) -> pa.Table:
        scores = np.frombuffer(b"".join(rows.column("scores").to_pylist()), np.int32)
        if not len(scores):
            return kinds.empty_table()
        at = {c: (len(scores) - 1) * p for c, p in shares.items()}
        low = {c: int(x) for c, x in at.items()}
        scores = np.partition(scores, sorted({min(x + d, len(scores) - 1) for x in low.values() for d in (0, 1)} | {len(scores) - 1}))
        value = lambda x: float(scores[min(x, len(scores) - 1)]) / unit
        made = {c: value(low[c]) if x == low[c] else (low[c] + 1 - x) * value(low[c]) + (x - low[c]) * value(low[c] + 1) for c, x in at.items()}
        made = {"query": rows.column("query")[0].as_py(), "mean": int(scores.sum(dtype=np.int64)) / unit / len(scores), "most": value(len(scores) - 1)} | made
        return pa.Table.from_pylist([made], kinds)

    return found.groupBy("query").applyInArrow(one, fields)

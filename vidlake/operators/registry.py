"""Versioned state as tables of operations: what is new, what breaks the contract, and what holds after all operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import values as v


def ingest(known: DataFrame, arriving: DataFrame, key: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, violations): rows known already are left out; a known key with another fingerprint is a violation, as are two of one key that arrive."""
    old = known.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_old")).distinct()
    joined = arriving.join(old, arriving[key] == F.col("_k"), "left")
    w = Window.partitionBy(key)
    marked = joined.withColumns({"_low": F.min(fingerprint).over(w), "_high": F.max(fingerprint).over(w)})
    bad = (F.col("_old").isNotNull() & (F.col("_old") != F.col(fingerprint))) | (F.col("_low") != F.col("_high"))
    reasons = v.reasons((F.col("_old").isNotNull() & (F.col("_old") != F.col(fingerprint)), "fingerprint_changed"), (F.col("_low") != F.col("_high"), "arrives_twice"))
    fresh = marked.filter(~bad & F.col("_old").isNull()).drop("_k", "_old", "_low", "_high").dropDuplicates([key])
    return fresh, marked.filter(bad).withColumn("reasons", reasons).drop("_k", "_old", "_low", "_high")


def current(operations: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """State of each key after all its operations in order: of each field the last value that was set."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = operations.select(key, order, *(F.last(f, ignorenulls=True).over(whole).alias(f) for f in fields), F.max(order).over(Window.partitionBy(key)).alias("revision"))
    return out.filter(F.col(order) == F.col("revision")).drop(order).dropDuplicates([key])


def as_of(operations: DataFrame, key: str, order: str, fields: list[str], revision: int) -> DataFrame:
    """State at an earlier revision."""
    return current(operations.filter(F.col(order) <= revision), key, order, fields)


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys added, removed or changed between two states."""
    a = before.select(F.col(key).alias("_a"), F.struct(*fields).alias("_was"))
    b = after.select(F.col(key).alias("_b"), F.struct(*fields).alias("_is"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed")
    return both.select(F.coalesce("_a", "_b").alias(key), kind.alias("change")).filter("change is not null")


def successors(old: DataFrame, new: DataFrame, member: str, group: str) -> DataFrame:
    """Old groups whose members all went to one new group: (old group, new group). A group that was split has none."""
    moved = old.select(member, F.col(group).alias("old")).join(new.select(member, F.col(group).alias("new")), member)
    return moved.groupBy("old").agg(F.collect_set("new").alias("_to")).filter(F.size("_to") == 1).select("old", F.col("_to")[0].alias("new"))


def reused_ids(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The id each new group keeps: an old id goes to the new group with the most of its members, the larger old group first. groups: member, group; members: member, id."""
    met = groups.join(members, "member").groupBy("group", "id").agg(F.count("*").alias("n"))
    size = members.groupBy("id").agg(F.count("*").alias("old_size"))
    ranked = met.join(size, "id")
    best_for_id = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "group"))
    one = ranked.withColumn("_r", best_for_id).filter("_r = 1")
    best_for_group = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("old_size"), "id"))
    return one.withColumn("_r", best_for_group).filter("_r = 1").select("group", "id")


def conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs of players with the reasons that they cannot be merged. pairs: a, b, team_a, team_b, number_a, number_b, clips_a, clips_b, spans_a, spans_b.

    Spans are arrays of (start, end) on the source's clock; a common moment is a conflict.
    """
    differ = lambda x: F.col(f"{x}_a").isNotNull() & F.col(f"{x}_b").isNotNull() & (F.col(f"{x}_a") != F.col(f"{x}_b"))
    meet = F.exists("spans_a", lambda p: F.exists("spans_b", lambda q: (p["start"] < q["end"]) & (q["start"] < p["end"])))
    return pairs.withColumn("reasons", v.reasons((differ("team"), "teams"), (differ("number"), "numbers"), (F.arrays_overlap("clips_a", "clips_b"), "same_clip"), (meet, "same_time")))


def promoted(groups: DataFrame) -> DataFrame:
    """Groups that may become players, and why not. groups: n_photos, n_clips, best_track_samples, locked, established, number_clips, nearest_other, strong, strong_identity."""
    enough = ((F.col("n_photos") >= 2) & (F.col("n_clips") >= 2)) | (F.col("best_track_samples") >= 2) | F.col("locked")
    backed = F.col("established") | F.col("locked") | (F.col("number_clips") >= 2) | (F.col("nearest_other") > F.col("strong")) | F.col("strong_identity")
    return groups.withColumn("reasons", v.reasons((~enough, "too_few_samples"), (~backed, "not_backed"))).withColumn("promoted", F.size("reasons") == 0)


def anchored(distances: DataFrame, novelty: float, margin: float) -> DataFrame:
    """Where arriving groups go, against a frozen set of anchors. distances: group, anchor, distance (-1: equal strong identity), blocked.

    A group abstains if the second anchor is about as near or two are equal by identity; groups that go to one anchor though they conflict all abstain elsewhere.
    """
    ok = distances.filter(~F.col("blocked"))
    w = Window.partitionBy("group").orderBy("distance", "anchor")
    ranked = ok.withColumns({"_n": F.row_number().over(w), "_next": F.lead("distance").over(w)}).filter("_n = 1")
    near = F.col("_next").isNotNull() & (F.col("distance") >= 0) & (F.col("_next") - F.col("distance") < margin)
    decision = F.when(F.col("distance") > novelty, "new").when(near | (F.col("_next") == -1), "abstain").otherwise("join")
    return ranked.select("group", F.when(decision == "join", F.col("anchor")).alias("anchor"), "distance", decision.alias("decision"))

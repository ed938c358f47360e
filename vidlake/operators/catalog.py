"""Catalogue queries: players, their events, people, clips, review queues, reports and export plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def player_events(events: DataFrame, player: int | str, event: str | None = None, clip: object | None = None, min_score: float | None = None) -> DataFrame:
    """Events of one player, in time order; each further condition only if it is given."""
    out = events.filter(F.col("player") == F.lit(player))
    if event is not None:
        out = out.filter(F.col("event") == event)
    if clip is not None:
        out = out.filter(F.col("clip") == F.lit(clip))
    if min_score is not None:
        out = out.filter(F.col("raw_score") >= min_score)
    return out.orderBy("start_frame", "event_id")


def export_windows(events: DataFrame, keys: list[str], padding: float, duration: Column) -> DataFrame:
    """One padded window inside the video for each key: that of the best event, the earliest on ties."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("raw_score"), "start_frame"))
    one = events.withColumn("_n", first).filter("_n = 1").drop("_n")
    return one.withColumns({"from_s": F.greatest(F.lit(0.0), F.col("start") - padding), "to_s": F.least(duration.cast("double"), F.col("end") + padding)})


def people(members: DataFrame, events: DataFrame) -> DataFrame:
    """One row a person: members, clips, cover (the best sample) and a histogram of event types.

    members: person, clip, track_id, quality; events: person, event.
    """
    who = members.groupBy("person").agg(F.count("*").alias("n_members"), F.count_distinct("clip").alias("n_clips"), F.max_by("track_id", F.struct("quality", -F.col("track_id"))).alias("cover"))
    by = events.groupBy("person", "event").agg(F.count("*").alias("n"))
    kinds = by.groupBy("person").agg(F.sum("n").alias("n_events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("event_types"))
    return who.join(kinds, "person", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows of one page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def search(people_: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """People whose label contains the words, and who have the status; either only if given."""
    out = people_
    if q:
        out = out.filter(F.contains(F.lower("label"), F.lit(q.strip().lower())))
    return out if status is None else out.filter(F.col("status") == status)


def next_after(queue: DataFrame, key: str, cursor: object) -> DataFrame:
    """The next item after the cursor, from the start again if there is none after it."""
    return queue.orderBy((F.col(key) <= F.lit(cursor)).cast("int"), key).limit(1)


def first_events(events: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """Counts of labels and the first ``most`` events of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame", "event_id"))
    head = events.withColumn("_n", place).filter(F.col("_n") <= most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_id"))), lambda s: s["event_id"]).alias("first_events"))
    by = events.groupBy(*keys, "event").agg(F.count("*").alias("n"))
    counts = by.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("label_counts"), F.sum("n").alias("n_events"))
    return counts.join(head, keys)


def review_scope(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of verdicts and their rates among reviewed tracks; pooled, so scopes can be summed. rows: verdict."""
    count = lambda name: F.count_if(F.col("verdict") == name).alias(name)
    out = rows.groupBy(*by).agg(F.count("*").alias("tracks"), *(count(n) for n in ("pure", "mixed", "non_player", "uncertain", "unreviewed")))
    done = (F.col("pure") + F.col("mixed") + F.col("non_player")).cast("double")
    return out.withColumns({"purity": F.try_divide(F.col("pure").cast("double"), (F.col("pure") + F.col("mixed")).cast("double")), "reviewed_share": F.try_divide(done + F.col("uncertain"), F.col("tracks").cast("double"))})


def fragmentation(rows: DataFrame) -> DataFrame:
    """Pure tracks of each identity label: how many stand for it. rows: identity_label, verdict, raw_track_id."""
    by = rows.filter("verdict = 'pure' and identity_label is not null").groupBy("identity_label").agg(F.count_distinct("raw_track_id").alias("n_tracks"))
    return by.agg(F.count("*").alias("identities"), F.sum(F.col("n_tracks") - 1).alias("extra_tracks"), F.max("n_tracks").alias("most_tracks"))


def scope_rollup(rows: DataFrame, scopes: list[str], sums: list[str]) -> DataFrame:
    """Sums for the whole scope path, each shorter path and everything, with the level (0 the finest)."""
    out = rows.rollup(*scopes).agg(*(F.sum(c).alias(c) for c in sums), F.grouping_id().alias("_g"))
    return out.withColumn("level", F.bit_count("_g").cast("int")).drop("_g")


def match_report(events: DataFrame) -> DataFrame:
    """Distinct possessions, clips, players and events of a match."""
    return events.agg(F.count_distinct("possession").alias("possessions"), F.count_distinct("clip").alias("clips"), F.count_distinct("player").alias("players"), F.count("*").alias("events"))


def stale(evidence: DataFrame, owners: DataFrame) -> DataFrame:
    """Evidence with a flag for an owner that has changed since it was linked. evidence: track_id, linked_owner; owners: track_id, owner."""
    return evidence.join(owners, "track_id", "left").withColumn("is_stale", ~F.col("owner").eqNullSafe(F.col("linked_owner")))

"""Cutting long videos: windows, states over time, boundary proposals, segments and what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.operators.ordered import per_key


def hop_windows(duration: Column, length: float, hop: float) -> Column:
    """Windows (start, end) that cover a duration: each ``hop`` after the last, the final one cut, none after the end is reached."""
    last = F.greatest(F.lit(0), F.ceil((duration - length) / hop))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: F.struct((i * hop).alias("start"), F.least(i * hop + length, duration.cast("double")).alias("end")))


def windows_of(times: DataFrame, at: str, length: int, hop: int) -> DataFrame:
    """Each row once for every window [k hop, k hop + length) that holds its whole-second time."""
    first = F.greatest(F.lit(0), F.floor((F.col(at) - length) / hop) + 1)
    return times.withColumn("window", F.explode(F.sequence(first, F.floor(F.col(at) / hop)))).withColumn("window_start", F.col("window") * hop)


def carried(rows: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """The last known value at or before each row."""
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def changes(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Rows where the value differs from the last known one before, with both."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("previous", F.last(column, ignorenulls=True).over(w))
    return out.filter(F.col(column).isNotNull() & (F.col(column) != F.col("previous")))


def peaks(rows: DataFrame, keys: list[str], order: str, value: str, share: float) -> DataFrame:
    """Local peaks, values over a share of the greatest, and both ends."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hit = ((F.col(value) > before) & (F.col(value) > after)) | (F.col(value) > share * F.max(value).over(whole)) | before.isNull() | after.isNull()
    return rows.withColumn("_hit", hit).filter("_hit").drop("_hit")


#: Phases that are no game; all others are, known or not. Fixed values.
NO_GAME = ("replay", "non_play")


def reconcile(states: DataFrame, durations: DataFrame, unknown_after: float = 8.0, chunk: float = 20.0, stable: float = 45.0, around: float = 2.0) -> DataFrame:
    """(source, lo, hi, kind, transition): boundary proposals from a video's states in time order, inside the video.

    Differing states of one time make both phase and team unknown, and a doubt around it. A change between game, replay and
    other content is a content_transition; no game forgets the team. A team that is unknown for longer than
    ``unknown_after`` is doubted in chunks and forgotten, also at the video's end. Another team is a possession_change; one
    team for ``stable`` is doubted and timed anew. states: source, t, phase, team (null or unknown); durations: source, duration.
    """
    one = states.groupBy("source", F.round("t", 6).alias("t")).agg(F.count_distinct(F.struct("phase", "team")).alias("n"), F.min("phase").alias("phase"), F.min("team").alias("team"))
    known = one.join(durations, "source")

    def run(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        source, end = rows[0][0], float(rows[0][5])

        def propose(lo: float, hi: float, kind: str, transition: str | None = None) -> None:
            if hi > lo:
                out.append((source, max(0.0, lo), min(end, hi), kind, transition))

        def doubted(lo: float, hi: float) -> bool:
            if hi - lo <= unknown_after:
                return False
            at = float(int(lo))
            while at <= int(hi):
                propose(max(lo, at), min(hi, at + chunk), "uncertain")
                at += chunk
            return True

        content = team = gap = None
        before = held = since = 0.0  # times of the last state, of the last state with the team, and from which the team is timed
        for _, t, n, phase, said, _ in rows:
            now = phase if n == 1 and phase in NO_GAME else "game"
            if n > 1:
                propose(max(0.0, t - around), t + around, "uncertain")
            if content is not None and now != content:
                propose(before, t, "content_transition", f"{content}>{now}")
            content, last = now, before
            before = t
            if now != "game":
                team, since = None, t
                continue
            if n > 1 or said is None or said == "unknown":
                gap = last if gap is None else gap
                continue
            if gap is not None and doubted(gap, t):
                team = None
            gap = None
            if team is not None and said != team:
                propose(held, t, "possession_change", f"{team}>{said}")
                since = t
            elif t - since >= stable:
                propose(max(0.0, t - chunk), t, "uncertain")
                since = t
            team, held = said, t
        if gap is not None:
            doubted(gap, end)
        return out

    kind = dict(states.dtypes)["source"]
    return per_key(known.select("source", F.col("t").cast("double").alias("t"), "n", "phase", "team", "duration"), ["source"], ["t"], run, f"source {kind}, lo double, hi double, kind string, transition string")


def merge_proposals(proposals: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """Proposals of one kind and transition that share a moment, give or take the tolerance, become one: the latest group with room takes them."""
    def run(rows: list[tuple]) -> list[tuple]:
        groups: list[dict] = []
        open_: list[dict] = []  # starts only grow, so groups that end before one, give or take, are done
        for *_, lo, hi in rows:
            open_ = [x for x in open_ if x["core_hi"] + tolerance >= lo]
            for x in reversed(open_):
                if max(x["core_lo"], lo) <= min(x["core_hi"], hi) + tolerance:
                    x.update(core_lo=max(x["core_lo"], lo), core_hi=min(x["core_hi"], hi), lo=min(x["lo"], lo), hi=max(x["hi"], hi), n=x["n"] + 1)
                    break
            else:
                groups.append({"lo": lo, "hi": hi, "core_lo": lo, "core_hi": hi, "n": 1})
                open_.append(groups[-1])
        return [(*rows[0][:3], x["lo"], x["hi"], x["n"]) for x in groups]

    k = dict(proposals.dtypes)["source"]
    filled = proposals.withColumn("transition", F.coalesce("transition", F.lit("")))
    return per_key(filled.select("source", "kind", "transition", "lo", "hi"), ["source", "kind", "transition"], ["lo", "hi"], run, f"source {k}, kind string, transition string, lo double, hi double, n long")


def segments(boundaries: DataFrame, durations: DataFrame, spacing: float = 0.5) -> DataFrame:
    """Segments between accepted boundaries: in time order, each ``spacing`` or more after the last and before the end.

    boundaries: source, at; durations: source, duration.
    """
    rows = durations.join(boundaries, "source", "left")

    def run(p: list[tuple]) -> list[tuple]:
        end, cuts = float(p[0][1]), [0.0]
        for *_, t in p:
            if t is not None and t - cuts[-1] >= spacing and end - t >= spacing:
                cuts.append(float(t))
        return [(p[0][0], k, a, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], end], strict=True), 1)]

    k = dict(durations.dtypes)["source"]
    return per_key(rows.select("source", "duration", "at"), ["source"], ["at"], run, f"source {k}, segment long, start double, end double")


def needing_review(segs: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Whether an unresolved range [lo, hi] touches a segment."""
    hit = segs.join(unresolved, "source", "left").withColumn("_hit", (F.col("lo") < F.col("end")) & (F.col("hi") >= F.col("start")))
    return hit.groupBy("source", "segment", "start", "end").agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("needs_review"))

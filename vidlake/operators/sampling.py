"""Which frames, windows and samples to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import values as v
from vidlake.operators.ordered import per_key


def untrimmed(frames: Column, interval: int) -> Column:
    """Centres of clips over a whole video: half an interval in, then each interval."""
    return F.when(frames > interval // 2, F.sequence(F.lit(interval // 2).cast("bigint"), frames - 1, F.lit(interval).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def clip_window(centre: Column, length: int, step: int, frames: Column) -> Column:
    """Frames around a centre, each at its place or the nearest edge, and whether an edge was repeated."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: centre + (i - length // 2) * step)
    inside = F.transform(raw, lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(frames.cast("bigint") - 1, x)))
    return F.struct(inside.alias("frames"), F.exists(raw, lambda x: (x < 0) | (x >= frames)).alias("padded"))


def dense(frames: Column, positions: int, span: int, length: int, step: int) -> Column:
    """Frames of ``positions`` evenly spread clip starts, counted modulo the number of frames."""
    last = F.greatest(F.lit(1), 1 + frames - span) - 1
    starts = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda i: F.floor(last * i / max(positions - 1, 1)))
    return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.pmod(s + k * step, frames))))


def uniform(frames: Column, clips: int) -> Column:
    """The middle frame of each of ``clips`` equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), lambda i: F.floor((i + 0.5) * frames / clips))


def positions(n: Column, most: int) -> Column:
    """At most ``most`` places from 0 to n - 1, evenly in order, both ends among them."""
    k = F.least(n, F.lit(most))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), lambda i: F.when(k > 1, F.round(i * (n - 1) / F.greatest(k - 1, F.lit(1)))).otherwise(F.lit(0)).cast("bigint"))


def one_per_stratum(duration: Column, strata: int, seed: int) -> Column:
    """One moment in each of ``strata`` equal parts, by a hash of seed and part: the same on every run."""
    width = duration / strata
    return F.transform(F.sequence(F.lit(0), F.lit(strata - 1)), lambda i: (i + F.pmod(F.xxhash64(F.lit(seed), i), F.lit(10_000)) / 10_000.0) * width)


def smallest_by_group(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def distinct_best(rows: DataFrame, window: list[str], track: str, order: list[Column | str], n: int) -> DataFrame:
    """In each window the best ``n`` rows of different tracks."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*window, track).orderBy(*order))).filter("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(*window).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def padded_windows(candidates: DataFrame, padding: float, duration: Column) -> DataFrame:
    """Candidates' ranges [lo, hi] with padding, inside the video."""
    return candidates.withColumns({"window_start": F.greatest(F.lit(0.0), F.col("lo") - padding), "window_end": F.least(duration, F.col("hi") + padding)})


def gate_reasons(rows: DataFrame, gates: list[tuple[Column, str]]) -> DataFrame:
    """Each row with the gates it fails, and by these whether it is eligible."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in gates)))
    return rows.withColumn("reasons", failed).withColumn("eligible", F.size("reasons") == 0)


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Mean and median of the last ``n`` values, and the mean of all."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumns({"average": F.avg(value).over(w), "median": v.middle(F.collect_list(value).over(w)), "overall": F.avg(value).over(Window.partitionBy(*keys))})


def covering_windows(windows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, window, start, end, score, enough): ``n`` clear windows of each video. The best of each stratum first, whatever they share; then the best
    of all others that meet none of those chosen, until there are enough. enough is false where they do not suffice. windows: keys, stratum, window, start, end, score, clear."""
    kinds, k = dict(windows.dtypes), len(keys)
    clear = windows.filter("clear").select(*keys, "stratum", "window", "start", "end", "score").withColumn("_order", -F.col("score"))

    def step(held: list[tuple]) -> list[tuple]:
        rows = [row[k : k + 5] for row in held]  # best first
        seen: set = set()
        chosen = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
        for r in rows:
            if len(chosen) >= n:
                break
            if all(r[3] <= c[2] or c[3] <= r[2] for c in chosen):
                chosen.append(r)
        return [(*held[0][:k], *r[1:], len(chosen) == n) for r in sorted(chosen, key=lambda r: r[2])]

    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *(f"`{c}` {kinds[c]}" for c in ("window", "start", "end", "score")), "enough boolean"])
    return per_key(clear, keys, ["_order", "start", "window"], step, fields)

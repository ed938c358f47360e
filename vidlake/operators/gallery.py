"""A library of players: what is admitted, who may be one, how observations are grouped, and which pictures stand for them.

All is a plan: tables in, tables out. Observations of a scope (a match) are compared in blocks of templates, so that no
scope passes through one task; gates, conflicts, anchors and promotion are joins and aggregates over pairs. Only what has
to be done in turn runs in kernels: the merging of one connected component, the choice of one group's templates and the
naming of one scope's groups.

observations: scope, obs, clip, kind (photo, tracklet or track), team, number, number_consensus, strong_identity, video,
clip_start_s, spans (start, end), at_s, samples, box, holds (reasons), rejected, non_player, detached, locked, established,
invalidated, player. templates: scope, obs, key, feature, visible_parts, quality, frame, view, active.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators.ordered import per_key
from vidlake.storage import saved


@dataclass(frozen=True)
class Policy:
    """Limits of the plan. Fixed values, to be validated on one's own data."""

    strong: float = 0.12
    supported: float = 0.2
    novel: float = 0.5
    margin: float = 0.05
    templates: int = 8
    parts: int = 2
    quality: float = 0.45
    apart_s: float = 1.0
    duplicate_iou: float = 0.85
    overlap: float = 0.45


NEAR_DUPLICATE, PER_VIEW, NEW_VIEW, MOST_DIVERSE = 0.025, 2, 0.15, 0.3


def admitted(templates: DataFrame, observations: DataFrame, policy: Policy, incremental: bool = False) -> DataFrame:
    """Templates that are good enough; of an established observation only the active ones, if the plan is incremental."""
    good = templates.filter((F.col("quality") >= policy.quality) & (F.col("visible_parts") >= policy.parts))
    if not incremental:
        return good
    fixed = observations.filter("established").select("scope", "obs", F.lit(True).alias("_fixed"))
    return good.join(fixed, ["scope", "obs"], "left").filter(F.col("_fixed").isNull() | F.col("active")).drop("_fixed")


def gated(observations: DataFrame, good: DataFrame, incremental: bool = False) -> DataFrame:
    """Adds best (quality), n_templates and reasons against each observation. A strong identity stands without pictures."""
    bank = good.groupBy("scope", "obs").agg(F.max("quality").alias("best"), F.count("*").alias("n_templates"))
    out = observations.join(bank, ["scope", "obs"], "left").na.fill(0, ["n_templates"]).na.fill(0.0, ["best"])
    anchor = F.col("established") if incremental else F.lit(False)
    by_name = F.col("strong_identity") & ~F.col("rejected") & ~F.col("non_player")
    looks = F.array(F.lit("no_clear_assessed_kpr_images"), F.lit("no_usable_quality_templates"))
    held = F.when(by_name, F.array_except("holds", looks)).otherwise(F.col("holds"))
    own = v.reasons(((F.col("n_templates") == 0) & ~anchor & ~by_name, "no_usable_quality_templates"), (F.col("rejected"), "manually_rejected"), (F.col("non_player"), "non_player"))
    bare = (F.col("n_templates") == 0) & ~anchor & ~by_name
    return out.withColumn("reasons", F.array_sort(F.array_union(F.coalesce(held, F.array().cast("array<string>")), own))).withColumn("rejected_here", bare | F.col("rejected") | F.col("non_player"))


def support(distance: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Distances of units from those of their templates: for each template the nearest on the other side; of these the mean of the
    two least (one, if a side has one template only); the larger of both directions. at_a, at_b: where units start among rows and columns."""
    n_a, n_b = np.diff(np.append(at_a, distance.shape[0])), np.diff(np.append(at_b, distance.shape[1]))

    def least_two(nearest: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.minimum.reduceat(nearest, at, axis=0)
        unit = np.repeat(np.arange(len(n)), n)
        hit = nearest == first[unit]
        once = np.cumsum(hit, axis=0)
        before = np.where(at[:, None] > 0, once[np.maximum(at - 1, 0)], 0)
        rest = np.where(hit & (once - before[unit] == 1), np.inf, nearest)  # all but one least
        return first, np.minimum.reduceat(rest, at, axis=0)

    one_a, two_a = least_two(np.minimum.reduceat(distance, at_b, axis=1), at_a, n_a)
    one_b, two_b = least_two(np.minimum.reduceat(distance, at_a, axis=0).T, at_b, n_b)
    pair = np.minimum(n_a[:, None], n_b[None]) >= 2
    mean = lambda one, two: np.where(pair, (one + np.where(pair, two, 0)) / 2, one)
    return np.maximum(mean(one_a, two_a), mean(one_b.T, two_b.T))


#: Units whose templates are multiplied at once, on each side.
SIDE = 128


def _blocks(templates: DataFrame, side: str) -> DataFrame:
    """(scope, block, units, counts, matrix): templates of SIDE units at most, as unit vectors in the order of their units."""
    bank = templates.groupBy("scope", "unit").agg(F.array_sort(F.collect_list(F.struct("key", "feature"))).alias("_t"))
    n = templates.groupBy("scope").agg(F.count_distinct("unit").alias("_n"))
    block = F.pmod(F.xxhash64("unit"), F.ceil(F.col("_n") / SIDE)).cast("bigint")
    rows = bank.join(n, "scope").select("scope", block.alias("_block"), "unit", F.transform("_t", lambda t: t["feature"]).alias("_f"))
    kinds = dict(rows.dtypes)

    def pack(held: list[tuple]) -> list[tuple]:
        made = np.array([f for *_, features in held for f in features], float)
        size = np.linalg.norm(made, axis=1, keepdims=True)
        made = np.divide(made, size, out=np.zeros_like(made), where=size > 0)
        return [(held[0][0], held[0][1], [r[2] for r in held], [len(r[3]) for r in held], made.tobytes())]

    return per_key(rows, ["scope", "_block"], ["unit"], pack, f"scope {kinds['scope']}, {side}_block bigint, {side}_units array<bigint>, {side}_counts array<int>, {side} binary")


def support_distances(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(scope, a, b, distance) of all units of a scope (a < b), or of each left unit to each right one. Rows: scope, unit, key, feature."""
    a, b = _blocks(left, "a"), _blocks(left if right is None else right, "b")
    met = a.join(b, "scope")
    met = met if right is not None else met.filter("a_block <= b_block")
    kind, once = dict(met.dtypes)["scope"], right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units, at, matrix = {}, {}, {}
                for s in ("a", "b"):
                    units[s], counts = (np.array(batch.column(f"{s}_{c}")[i].as_py(), np.int64) for c in ("units", "counts"))
                    at[s] = np.cumsum(counts) - counts
                    matrix[s] = np.frombuffer(batch.column(s)[i].as_py()).reshape(counts.sum(), -1)
                made = support(1 - matrix["a"] @ matrix["b"].T, at["a"], at["b"])
                x, y = (z.ravel() for z in np.broadcast_arrays(units["a"][:, None], units["b"][None]))
                keep = np.ones(len(x), bool)
                if once:
                    same = batch.column("a_block")[i].as_py() == batch.column("b_block")[i].as_py()
                    keep = x < y if same else keep
                    x, y = np.minimum(x, y), np.maximum(x, y)
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("scope")[i].as_py()] * n, batch.column("scope").type), pa.array(x[keep]), pa.array(y[keep]), pa.array(made.ravel()[keep])], ["scope", "a", "b", "distance"])

    return met.mapInArrow(run, f"scope {kind}, a bigint, b bigint, distance double")


FACTS = ["clip", "kind", "team", "number", "strong_identity", "video", "clip_start_s", "spans", "box", "best", "rejected_here"]


def incompatibility(a: Column, b: Column) -> Column:
    """Why two observations cannot be one player; null if they can. a, b: structs of FACTS."""
    differ = lambda x: F.coalesce(a[x] != b[x], F.lit(False))
    meet = lambda x, y, p, q: F.coalesce(F.exists(x, lambda s: F.exists(y, lambda t: (p + s["start"] < q + t["end"]) & (q + t["start"] < p + s["end"]))), F.lit(False))
    unknown = (F.coalesce(F.size(a["spans"]), F.lit(0)) < 1) | (F.coalesce(F.size(b["spans"]), F.lit(0)) < 1)
    together = (a["clip"] == b["clip"]) & (unknown | meet(a["spans"], b["spans"], F.lit(0.0), F.lit(0.0)))
    one_video = F.coalesce(a["video"] == b["video"], F.lit(False)) & (a["kind"] != "photo") & (b["kind"] != "photo")
    # a tracklet and a track may hold the same frames of the source, if both are the same player by name
    twice = ((a["kind"] == "tracklet") != (b["kind"] == "tracklet")) & a["strong_identity"] & b["strong_identity"]
    crossing = one_video & ~twice & meet(a["spans"], b["spans"], a["clip_start_s"], b["clip_start_s"])
    return F.when(differ("team"), "different_teams").when(differ("number"), "different_number_candidates").when(together, "simultaneous_observations").when(crossing, "overlapping_source_tracks")


def compared(states: DataFrame, good: DataFrame) -> DataFrame:
    """(scope, a, b, distance, why, fa, fb) of all pairs of a scope; distance is null without templates on both sides."""
    facts = states.select("scope", "obs", F.struct(*FACTS).alias("_f"))
    near = support_distances(good.select("scope", F.col("obs").alias("unit"), "key", "feature"))
    fa, fb = facts.select("scope", F.col("obs").alias("a"), F.col("_f").alias("fa")), facts.select("scope", F.col("obs").alias("b"), F.col("_f").alias("fb"))
    every = fa.join(fb, "scope").filter("a < b").join(near, ["scope", "a", "b"], "left")
    return every.withColumn("why", incompatibility(F.col("fa"), F.col("fb")))


def duplicate_photos(pairs: DataFrame, policy: Policy) -> DataFrame:
    """(scope, obs, duplicate_of): of boxes of one clip that lie on each other and look alike, the better photo takes the other, best first."""
    close = pairs.filter((F.col("fa.clip") == F.col("fb.clip")) & (F.col("distance") <= policy.strong) & (g.iou(F.col("fa.box"), F.col("fb.box")) >= policy.duplicate_iou))
    side = lambda x, y: close.select("scope", F.col(f"f{x}.clip").alias("clip"), (-F.col(f"f{x}.best")).alias("order"), F.col(x).alias("obs"), ((F.col(f"f{x}.kind") == "photo") & ~F.col(f"f{x}.rejected_here")).alias("takes"), F.col(y).alias("other"))
    rows = side("a", "b").unionByName(side("b", "a"))
    kinds = dict(rows.dtypes)

    def step(held: list[tuple]) -> list[tuple]:
        gone: dict = {}
        for _, _, _, obs, takes, other in held:
            if takes and obs not in gone and other not in gone:
                gone[other] = obs
        return [(held[0][0], o, by) for o, by in gone.items()]

    return per_key(rows, ["scope", "clip"], ["order", "obs", "other"], step, f"scope {kinds['scope']}, obs bigint, duplicate_of bigint")


def flagged(states: DataFrame, pairs: DataFrame, duplicates: DataFrame, policy: Policy) -> DataFrame:
    """Adds duplicate_of, the reasons of quarantine and of claims to one identity at one time, and eligible."""
    both = lambda rows, why: rows.select("scope", F.explode(F.array("a", "b")).alias("obs")).distinct().withColumn("_why", F.lit(why))
    for side in ("a", "b"):
        pairs = pairs.join(duplicates.select("scope", F.col("obs").alias(side), F.lit(True).alias(f"_dup_{side}")), ["scope", side], "left")
    boxes = pairs.filter(F.col("_dup_a").isNull() & F.col("_dup_b").isNull() & (F.col("fa.clip") == F.col("fb.clip")) & ((F.col("fa.kind") == "photo") | (F.col("fb.kind") == "photo")))
    over = both(boxes.filter(F.col("fa.box").isNotNull() & F.col("fb.box").isNotNull() & (g.containment(F.col("fa.box"), F.col("fb.box")) >= policy.overlap)), "overlapping_person_targets")
    out = states.join(duplicates, ["scope", "obs"], "left")
    out = out.withColumn("reasons", F.when(F.col("duplicate_of").isNotNull(), F.array(F.lit("duplicate_detection"))).otherwise(F.col("reasons")))
    add = lambda t, more: t.join(more, ["scope", "obs"], "left").withColumn("reasons", F.when(F.col("_why").isNotNull(), F.array_sort(F.array_union("reasons", F.array("_why")))).otherwise(F.col("reasons"))).drop("_why")
    out = add(out, over)
    free = saved(out.withColumn("eligible", (F.size("reasons") == 0) & ~F.col("locked")))
    claims = pairs.filter(F.col("fa.strong_identity") & F.col("fb.strong_identity") & F.col("why").isin("simultaneous_observations", "overlapping_source_tracks") & (F.col("fa.team") == F.col("fb.team")) & (F.col("fa.number") == F.col("fb.number")))
    for side in ("a", "b"):
        claims = claims.join(free.filter("eligible").select("scope", F.col("obs").alias(side)), ["scope", side], "left_semi")
    out = add(free, both(claims, "simultaneous_strong_identity_conflict"))
    return out.withColumn("eligible", F.col("eligible") & (F.size("reasons") == 0))


def merged(members: dict[int, list[dict]], distance: dict[tuple[int, int], float], barred: set[tuple[int, int]], policy: Policy) -> dict[int, list[dict]]:
    """Groups after all merges that are allowed and without a rival about as near. members: group -> observations (obs, team, number, clip, consensus, strong, locked player)."""
    groups = {k: list(m) for k, m in members.items()}
    key = lambda p, q: (min(p, q), max(p, q))

    def cost(a: list[dict], b: list[dict]) -> float | None:
        both = a + b
        several = lambda name: len({m[name] for m in both} - {None}) > 1
        if several("lock") or several("number") or several("team") or any(key(p["obs"], q["obs"]) in barred for p in a for q in b):
            return None
        names = [{(m["team"], m["number"]) for m in side if m["strong"]} for side in (a, b)]
        if len(names[0]) == len(names[1]) == 1 and names[0] == names[1]:
            return -1.0
        worst = max(distance.get(key(p["obs"], q["obs"]), np.inf) for p in a for q in b)
        read = [[m for m in side if m["number"] is not None] for side in (a, b)]
        clear = lambda side: len({m["clip"] for m in side}) >= 2 or any(m["consensus"] for m in side)
        one_team = all(m["team"] is not None for m in both)
        trusted = bool(read[0] and read[1]) and (one_team or clear(read[0]) or clear(read[1]))
        return worst if worst <= (policy.supported if trusted else policy.strong) else None

    costs = {(x, y): c for x in groups for y in groups if x < y and (c := cost(groups[x], groups[y])) is not None}
    while costs:
        beside: dict[int, list[tuple[float, tuple[int, int]]]] = {}
        for edge, c in costs.items():
            for end in edge:
                beside.setdefault(end, []).append((c, edge))
        chosen = None
        for c, edge in sorted((c, e) for e, c in costs.items()):
            rival = min((d for end in edge for d, other in beside[end] if other != edge), default=np.inf)
            a, b = (groups[k] for k in edge)
            agreed = all(m["number"] is not None for m in a + b) and max(len(a), len(b)) >= 2
            if c < 0 or agreed or rival - c >= policy.margin:
                chosen = edge
                break
        if chosen is None:
            break
        x, y = chosen
        groups[x] = groups[x] + groups.pop(y)
        costs = {e: c for e, c in costs.items() if x not in e and y not in e}
        costs |= {key(x, z): c for z in groups if z != x and (c := cost(groups[x], groups[z])) is not None}
    return groups


def _seeds(states: DataFrame) -> DataFrame:
    """(scope, obs, seed): eligible observations alone, and the observations that were grouped by hand, by their player's least."""
    held = states.filter(F.col("locked") & ~F.col("detached") & ~F.col("non_player") & ~F.col("rejected"))
    first = held.groupBy("scope", "player").agg(F.min("obs").alias("seed"))
    by_hand = held.join(first, ["scope", "player"]).select("scope", "obs", "seed")
    return states.filter("eligible").select("scope", "obs", F.col("obs").alias("seed")).unionByName(by_hand)


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, seed, component): least seed reached over links (scope, a, b), by passing on the least number until none changes."""
    both = saved(links.select("scope", "a", "b").unionByName(links.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = saved(nodes.select("scope", "seed", F.col("seed").alias("component")).distinct())
    while True:
        near = both.join(at.select("scope", F.col("seed").alias("b"), F.col("component").alias("_c")), ["scope", "b"]).groupBy("scope", F.col("a").alias("seed")).agg(F.min("_c").alias("_low"))
        # and on to where the component's own least stands already
        step = at.join(near, ["scope", "seed"], "left").withColumn("_low", F.least("component", F.coalesce("_low", "component")))
        jump = at.select("scope", F.col("seed").alias("_low"), F.col("component").alias("_far"))
        ahead = saved(step.join(jump, ["scope", "_low"], "left").select("scope", "seed", "component", F.least("_low", F.coalesce("_far", "_low")).alias("_new")))
        moved = not ahead.filter("_new <> component").isEmpty()
        at = ahead.select("scope", "seed", F.col("_new").alias("component"))
        if not moved:
            return at


def regrouped(states: DataFrame, pairs: DataFrame, policy: Policy) -> DataFrame:
    """(scope, obs, grp) of the full mode. Merges stay inside components of pairs that could ever be merged; each is worked through alone."""
    seeds = saved(_seeds(states))
    of = lambda side: seeds.select("scope", F.col("obs").alias(side), F.col("seed").alias(f"s{side}"))
    kept = saved(pairs.join(of("a"), ["scope", "a"]).join(of("b"), ["scope", "b"]))
    name = lambda f: F.when(F.col(f"{f}.strong_identity"), F.struct(F.col(f"{f}.team"), F.col(f"{f}.number")))
    could = kept.filter(F.col("why").isNull() & ((F.col("distance") <= policy.supported) | (name("fa") == name("fb"))) & (F.col("sa") != F.col("sb")))
    part = connected(seeds, could.select("scope", F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct())
    facts = states.select("scope", "obs", "team", "number", "clip", F.col("number_consensus").alias("consensus"), F.col("strong_identity").alias("strong"), F.when(F.col("locked"), F.col("player")).alias("lock"))
    nodes = seeds.join(part, ["scope", "seed"]).join(facts, ["scope", "obs"]).select("scope", "component", F.col("obs").alias("a"), F.lit(None).cast("bigint").alias("b"), "seed", F.struct("obs", "team", "number", "clip", "consensus", "strong", "lock").alias("fact"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("barred"))
    ends = lambda side: part.select("scope", F.col("seed").alias(f"s{side}"), F.col("component").alias(f"c{side}"))
    inside = kept.join(ends("a"), ["scope", "sa"]).join(ends("b"), ["scope", "sb"]).filter("ca = cb and sa <> sb")
    edges = inside.select("scope", F.col("ca").alias("component"), "a", "b", F.lit(None).cast("bigint").alias("seed"), F.lit(None).cast(dict(nodes.dtypes)["fact"]).alias("fact"), "distance", F.col("why").isNotNull().alias("barred"))

    def step(held: list[tuple]) -> list[tuple]:
        members: dict[int, list[dict]] = {}
        for row in held:
            if row[3] is None:
                members.setdefault(row[4], []).append(row[5])
        links = [row for row in held if row[3] is not None]
        groups = merged(members, {(r[2], r[3]): r[6] for r in links if r[6] is not None}, {(r[2], r[3]) for r in links if r[7]}, policy)
        return [(held[0][0], m["obs"], min(x["obs"] for x in own)) for own in groups.values() for m in own]

    rows = nodes.unionByName(edges)
    return per_key(rows, ["scope", "component"], ["a", "b"], step, f"scope {dict(rows.dtypes)['scope']}, obs bigint, grp bigint")


def joined_to_anchors(states: DataFrame, good: DataFrame, pairs: DataFrame, policy: Policy) -> DataFrame:
    """(scope, obs, grp, distance) of the incremental mode: each arrival against all anchors of the last revision at once.

    An arrival joins its nearest anchor if no other is about as near, and if no other arrival there could not be the same
    player; arrivals are no bridges between each other, and stay alone otherwise.
    """
    fixed = states.filter((F.col("eligible") & F.col("established") & ~F.col("invalidated")) | (F.col("locked") & ~F.col("detached") & ~F.col("non_player") & ~F.col("rejected")))
    first = fixed.groupBy("scope", "player").agg(F.min("obs").alias("grp"))
    anchors = saved(fixed.join(first, ["scope", "player"]).select("scope", "obs", "grp"))
    arrivals = saved(states.filter("eligible").select("scope", "obs").join(anchors.select("scope", "obs"), ["scope", "obs"], "left_anti"))
    bank = good.select("scope", "obs", "key", "feature")
    left = bank.join(arrivals, ["scope", "obs"]).select("scope", F.col("obs").alias("unit"), "key", "feature")
    right = bank.join(anchors, ["scope", "obs"]).select("scope", F.col("grp").alias("unit"), F.concat_ws("/", "obs", "key").alias("key"), "feature")
    near = support_distances(left, right).select("scope", F.col("a").alias("obs"), F.col("b").alias("grp"), "distance")
    facts = states.select("scope", "obs", "team", "number", "clip", "number_consensus", F.when(F.col("strong_identity"), F.concat_ws("/", "team", "number")).alias("name"))
    whole = anchors.join(facts, ["scope", "obs"]).groupBy("scope", "grp").agg(
        F.collect_set("team").alias("teams"), F.collect_set("number").alias("numbers"), F.collect_set("name").alias("names"), F.bool_and(F.col("team").isNotNull()).alias("teamed"),
        ((F.count_distinct(F.when(F.col("number").isNotNull(), F.col("clip"))) >= 2) | F.bool_or(F.col("number").isNotNull() & F.col("number_consensus"))).alias("clear"))
    way = lambda x, y: pairs.filter("why is not null").select("scope", F.col(x).alias("obs"), F.col(y).alias("_m"))
    bars = way("a", "b").unionByName(way("b", "a"))
    barred = bars.join(anchors.select("scope", F.col("obs").alias("_m"), "grp"), ["scope", "_m"]).select("scope", "obs", "grp").distinct().withColumn("_barred", F.lit(True))
    met = arrivals.join(facts, ["scope", "obs"]).join(whole, "scope").join(near, ["scope", "obs", "grp"], "left").join(barred, ["scope", "obs", "grp"], "left")
    one = lambda many, own: F.size(F.array_union(many, F.array_compact(F.array(own)))) <= 1
    named = (F.size("names") == 1) & F.coalesce(F.array_contains("names", F.col("name")), F.lit(False))
    trusted = F.col("number").isNotNull() & (F.size("numbers") > 0) & (F.col("teamed") & F.col("team").isNotNull() | F.col("clear") | F.col("number_consensus"))
    score = F.when(named, -1.0).when(F.col("distance") <= F.when(trusted, policy.supported).otherwise(policy.strong), F.col("distance"))
    viable = met.filter(F.col("_barred").isNull() & one("teams", F.col("team")) & one("numbers", F.col("number"))).withColumn("score", score).filter("score is not null")
    ranked = viable.groupBy("scope", "obs").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "grp"))), 1, 2).alias("_two"))
    best, second = F.get("_two", 0), F.get("_two", 1)
    clear = second.isNull() | ((second["score"] - best["score"] >= policy.margin) & ~((best["score"] == -1) & (second["score"] == -1)))
    sent = saved(ranked.filter(clear).select("scope", "obs", best["grp"].alias("grp"), best["score"].alias("score")))
    there = lambda o, n: sent.select("scope", F.col("obs").alias(o), F.col("grp").alias(n))
    clash = bars.join(there("obs", "_ga"), ["scope", "obs"]).join(there("_m", "_gb"), ["scope", "_m"]).filter("_ga = _gb").select("scope", "obs").distinct()
    took = sent.join(clash, ["scope", "obs"], "left_anti")
    placed = arrivals.join(took, ["scope", "obs"], "left").select("scope", "obs", F.coalesce("grp", "obs").alias("grp"), F.when(F.col("score") >= 0, F.col("score")).alias("distance"))
    return anchors.withColumn("distance", F.lit(None).cast("double")).unionByName(placed)


def promotion(groups: DataFrame, states: DataFrame, pairs: DataFrame, policy: Policy, incremental: bool = False) -> DataFrame:
    """(scope, grp, n, promoted, reason, nearest_other, novel): which groups may be players."""
    own = groups.select("scope", "obs", "grp").join(states, ["scope", "obs"])
    photo, tracklet = F.col("kind") == "photo", F.col("kind") == "tracklet"
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    by_clip = own.filter(photo).groupBy("scope", "grp", "clip").agg(F.min("at_s").alias("lo"), F.max("at_s").alias("hi"))
    apart = by_clip.groupBy("scope", "grp").agg(F.collect_list(F.struct("clip", "lo", "hi")).alias("_c"))
    apart = apart.select("scope", "grp", F.exists("_c", lambda x: F.exists("_c", lambda y: (x["clip"] != y["clip"]) & (y["hi"] - x["lo"] >= policy.apart_s))).alias("independent"))
    facts = own.groupBy("scope", "grp").agg(
        F.count("*").alias("n"), has(~photo & (F.col("samples") >= 2)).alias("tracked"), has(F.col("locked")).alias("held"), has(F.col("established") & ~F.col("invalidated")).alias("known"),
        ((F.count_distinct(F.when(F.col("number").isNotNull(), F.col("clip"))) >= 2) & (F.count_distinct("number") == 1)).alias("backed"), has(F.col("strong_identity")).alias("named"),
        F.bool_and(tracklet).alias("tracklets"), has(tracklet).alias("a_tracklet"), has(F.col("invalidated")).alias("unsure"))
    of = groups.select("scope", F.col("obs").alias("_m"), "grp")
    way = lambda x, y: pairs.select("scope", F.col(x).alias("_m"), F.col(y).alias("obs"), "distance", F.col("why").isNotNull().alias("_bar"))
    others = way("a", "b").unionByName(way("b", "a")).join(of, ["scope", "_m"]).join(states.filter("eligible").select("scope", "obs"), ["scope", "obs"], "left_semi")
    others = others.join(groups.select("scope", "obs", F.col("grp").alias("_g")), ["scope", "obs"], "left").filter("_g is null or _g <> grp")
    near = others.groupBy("scope", "grp", "obs").agg(F.max("_bar").alias("_bar"), F.min("distance").alias("d")).filter("not _bar").groupBy("scope", "grp").agg(F.min("d").alias("nearest_other"))
    out = facts.join(apart, ["scope", "grp"], "left").join(near, ["scope", "grp"], "left")
    enough = F.coalesce("independent", F.lit(False)) | F.col("tracked") | F.col("held")
    alone = F.col("nearest_other").isNull() | (F.col("nearest_other") > policy.strong)
    good = enough & (F.col("known") | F.col("held") | F.col("backed") | alone | F.col("named"))
    good = good & (~F.col("tracklets") | F.col("named") | F.col("held")) & (~F.col("unsure") | F.col("known") | F.col("named") | F.col("held"))
    if incremental:
        good = good & (F.col("known") | F.col("held") | F.col("named"))  # looks alone are no new anchor
    reason = F.when(~good, F.when(F.col("a_tracklet") & ~F.col("named"), "initial_identity_needs_team_and_number").when(F.col("nearest_other") <= policy.supported, "ambiguous_nearby_identity").otherwise("insufficient_independent_support"))
    return out.select("scope", "grp", "n", "held", good.alias("promoted"), reason.alias("reason"), "nearest_other", F.coalesce(F.col("nearest_other") >= policy.novel, F.lit(False)).alias("novel"))


def picked(rows: list[dict], limit: int, first: int | None = None) -> list[int]:
    """Templates of one group, best first: quality, raised by distance from those taken and by a view not seen; no second of a frame, none that looks like one of its view, two of a view at most."""
    made = np.array([r["feature"] for r in rows], float)
    size = np.linalg.norm(made, axis=1, keepdims=True)
    made = np.divide(made, size, out=np.zeros_like(made), where=size > 0)
    quality = np.array([r["quality"] for r in rows])
    view = np.array([r["view"] if r["view"] not in (None, "unknown") else "" for r in rows])
    given = np.array([r["view"] or "" for r in rows])
    frame = np.array([r["frame"] for r in rows])
    open_, nearest, chosen = np.ones(len(rows), bool), np.full(len(rows), np.inf), []

    def take(i: int) -> None:
        nonlocal open_, nearest
        chosen.append(i)
        away = 1 - made @ made[i]
        nearest = np.minimum(nearest, away)
        full = [x for x in set(view[chosen]) - {""} if (view[chosen] == x).sum() >= PER_VIEW]
        open_ &= (frame != frame[i]) & ~((away < NEAR_DUPLICATE) & (given == given[i])) & ~np.isin(view, full)
        open_[i] = False

    if first is not None and limit:
        take(first)
    while open_.any() and len(chosen) < limit:
        fresh = (view != "") & ~np.isin(view, view[chosen])
        away = np.minimum(MOST_DIVERSE, nearest) if chosen else np.zeros(len(rows))
        worth = np.where(open_, quality * (1 + away + NEW_VIEW * fresh), -np.inf)
        take(int(np.argmax(worth)))
    return chosen


def gallery(groups: DataFrame, plan: DataFrame, states: DataFrame, good: DataFrame, policy: Policy, incremental: bool = False) -> DataFrame:
    """(scope, grp, obs, key, rank): templates that stand for each promoted group."""
    sure = plan.filter("promoted").select("scope", "grp")
    usable = states.filter((F.size("reasons") == 0) & ~F.col("detached")).select("scope", "obs", "established")
    rows = good.join(usable, ["scope", "obs"]).join(groups.select("scope", "obs", "grp").join(sure, ["scope", "grp"]), ["scope", "obs"])
    rows = rows.select("scope", "grp", "obs", "key", F.struct("feature", "quality", "frame", "view", (F.col("established") & F.col("active")).alias("keeps")).alias("t"))

    def step(held: list[tuple]) -> list[tuple]:
        own = [r[4] for r in held]
        kept = [i for i, t in enumerate(own) if t["keeps"]] if incremental else []
        chosen = picked(own, policy.templates, max(kept, key=lambda i: (own[i]["quality"], -i)) if kept else None)
        return [(*held[i][:4], rank) for rank, i in enumerate(chosen, 1)]

    kinds = dict(rows.dtypes)
    return per_key(rows, ["scope", "grp"], ["obs", "key"], step, f"scope {kinds['scope']}, grp bigint, obs bigint, key {kinds['key']}, rank int")


def named(groups: DataFrame, plan: DataFrame, states: DataFrame) -> DataFrame:
    """(scope, grp, player): ids that groups get. Hand-made groups keep theirs; then promoted, larger and earlier groups choose first, each
    an old id of its members that is free: established ones first, then the id with most members here. Without one a group gets a new id."""
    old = groups.select("scope", "obs", "grp").join(states.select("scope", "obs", "player", "locked", "established", "non_player"), ["scope", "obs"])
    ids = old.filter("player is not null").groupBy("scope", "grp", "player").agg(F.bool_or("locked").alias("lock"), F.bool_or("established").alias("known"), F.count("*").alias("n"), F.min("obs").alias("low"))
    wishes = ids.groupBy("scope", "grp").agg(F.array_sort(F.collect_list(F.struct((~F.col("lock")).alias("a"), (~F.col("known")).alias("b"), (-F.col("n")).alias("c"), "low", "player"))).alias("wishes"))
    top = states.groupBy("scope").agg(F.coalesce(F.max("player"), F.lit(0)).alias("top"))
    rows = plan.join(wishes, ["scope", "grp"], "left").join(top, "scope").select("scope", (~F.col("held")).alias("o1"), (~F.col("promoted")).alias("o2"), (-F.col("n")).alias("o3"), "grp", "wishes", "top")

    def step(held: list[tuple]) -> list[tuple]:
        out, used = [], set()
        fresh = held[0][6]
        for _, _, _, _, grp, wishes, _ in held:
            forced = [w["player"] for w in wishes or () if not w["a"]]
            found = forced[0] if forced else next((w["player"] for w in wishes or () if w["player"] not in used), None)
            if found is None:
                fresh += 1
                found = fresh
            used.add(found)
            out.append((held[0][0], grp, found))
        return out

    return per_key(rows, ["scope"], ["o1", "o2", "o3", "grp"], step, f"scope {dict(rows.dtypes)['scope']}, grp bigint, player bigint")


@dataclass
class Plan:
    states: DataFrame  # observations with reasons, group and status
    groups: DataFrame  # promotion and ids of groups
    templates: DataFrame  # what stands for the promoted ones


def plan(observations: DataFrame, templates: DataFrame, policy: Policy | None = None, incremental: bool = False) -> Plan:
    """The whole plan. Incremental mode keeps to the anchors of the last revision where a scope has any, and regroups the others in full."""
    policy = policy or Policy()
    good = saved(admitted(templates, observations, policy, incremental))
    states = saved(gated(observations, good, incremental))
    pairs = saved(compared(states, good))
    states = saved(flagged(states, pairs, duplicate_photos(pairs, policy), policy))
    if incremental:
        anchored = states.filter((F.col("eligible") & F.col("established") & ~F.col("invalidated")) | F.col("locked")).select("scope").distinct()
        with_, without = states.join(anchored, "scope", "left_semi"), states.join(anchored, "scope", "left_anti")
        some = joined_to_anchors(with_, good, pairs, policy)
        groups = some.unionByName(regrouped(without, pairs, policy).withColumn("distance", F.lit(None).cast("double")))
    else:
        groups = regrouped(states, pairs, policy).withColumn("distance", F.lit(None).cast("double"))
    groups = saved(groups)
    made = saved(promotion(groups, states, pairs, policy, incremental))
    made = made.join(named(groups, made, states), ["scope", "grp"])
    out = states.join(groups, ["scope", "obs"], "left").join(made.select("scope", "grp", "promoted", "reason", F.col("player").alias("_new")), ["scope", "grp"], "left")
    # a duplicate goes with the photo that took it; who is in no group keeps an id that no group has
    first = out.select("scope", F.col("obs").alias("duplicate_of"), F.col("_new").alias("_by"))
    taken = made.select("scope", "player", F.lit(True).alias("_taken")).distinct()
    out = out.join(first, ["scope", "duplicate_of"], "left").join(taken, ["scope", "player"], "left")
    player = F.coalesce("_new", "_by", F.when(F.col("_taken").isNull() | F.col("locked") | F.col("non_player"), F.col("player")))
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("rejected_here"), "rejected").when(F.col("promoted"), "accepted").otherwise("pending")
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.col("reasons"))
    out = out.withColumns({"status": status, "reasons": reasons, "new_player": player}).drop("_new", "_by", "_taken", "reason")
    return Plan(out, made, gallery(groups, made, states, good, policy, incremental))

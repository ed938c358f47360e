"""Exact Jaccard self-join of n-gram sets through prefix trees.

Sets of word n-grams are kept in one global order, that of their hashes, which is cut into ranges (class Ranges).
Two sets over the threshold are alike in several ranges, so what a set holds in each range deals the sets into groups.
How many ranges at least is known, so a set leaves its largest groups, all but one of these many: two linked sets
still meet in the smallest group that they share, and groups of a passage or phrase that many texts hold are left by all.

Each set meets the lead of each of its groups, the set with the most groups of its own, and is written as what it
differs from that lead in. The differences of a lead's sets make a prefix tree - the sorted list of sequences with the
lengths of common prefixes - which the sets walk: what they share with a prefix is counted once for all below it, and
a branch is left by each set as soon as what is still to come on both sides cannot make up what is missing. Two sets
differ in what only one of their differences holds, so the walk is exact, whatever the lead is.

Equal sets are joined first, then sets with their leads; a tree is walked only where sets of several components are
left, so groups of copies need no pair for each two. A lead with few sets has its tree walked at once; one with many is
worked through in blocks of bounded size, each against each. No link between different sets is lost.

A text with fewer words than n has its whole sequence as the one n-gram; a null text, or one without words, has
no n-gram and is linked with nothing. Rows that repeat an id share its component. A row without an id gets none.
An empty table gives an empty one. Other columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.components import components
from vidlake.llm.sketch import Sketch, sketch_of, texts_of
from vidlake.llm.text import chunks, mix, owners, shingles, tidy, words
from vidlake.storage import saved

#: Texts and their length that meet their lead in one go, and sets or bytes of differences of a lead that are walked at once.
BLOCK, CHARACTERS, SETS, BYTES = 512, 8 << 20, 4096, 8 << 20


def ngram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text in order of hash, and where each text's start."""
    h, at, _, _ = words(data, offs)
    grams, whole = shingles(h, at, n)
    text = owners(at)
    size = np.diff(at)
    short = np.flatnonzero((size > 0) & (size < n))
    lone = [_sequence(h[at[d] : at[d + 1]]) for d in short]
    values = np.concatenate([grams[whole], np.array(lone, np.uint64)])
    owner = np.concatenate([text[whole], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(offs)))


def _sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, other than that of any n-gram."""
    total = np.array([len(h)], np.uint64)
    for x in h:
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + x)
    return total[0]


class Ranges:
    """Cuts the global order into ranges so that two sets over the threshold are alike in one of them at least.

    Sets whose sizes lie in one class [first, end) differ by D n-grams at most, if they are over the threshold; of
    D + 1 + spare ranges of the order, at most D hold a difference. So the sets are equal in spare + 1 ranges or more.
    A set with E empty ranges shares spare + 1 - E or more that are not; a set with more than ``spare`` of them counts
    its empty ranges as well.
    The classes reach beyond ``longest`` to the largest set that one of that size can be linked with.
    """

    def __init__(self, percent: int, longest: int, ratio: float = 1.5):
        first = [1]
        while first[-1] <= longest * 100 // percent:
            first.append(max(first[-1] + 1, int(first[-1] * ratio)))
        self.percent, self.first = percent, np.array(first, np.int64)
        differ = 2 * (self.first[1:] - 1) * (100 - percent) // (100 + percent)
        self.spare = np.array([_spare(int(d), -(-percent * int(f) // 100)) for d, f in zip(differ, self.first, strict=False)], np.int64)
        self.cuts = differ + 1 + self.spare

    def classes(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sets, class) for the class of each set's own size, then for those of larger sets that it can be linked with."""
        own = np.searchsorted(self.first, size, "right") - 1
        sets, c = np.flatnonzero(size > 0), own[size > 0]
        while len(sets):
            yield sets, c
            sets, c = sets, c + 1
            ok = c < len(self.cuts)
            ok[ok] = 100 * size[sets[ok]] >= self.percent * self.first[c[ok]]
            sets, c = sets[ok], c[ok]

    def keys(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, set, class, how many of a set's keys of a class it may leave) of all ranges; values: the sets' n-grams in order of set and hash."""
        size = np.diff(at)
        out: list[tuple[np.ndarray, ...]] = []
        for sets, c in self.classes(size):
            cuts = self.cuts[c]
            base = np.cumsum(cuts) - cuts
            place = np.repeat(at[sets], size[sets]) + np.arange(int(size[sets].sum())) - np.repeat(np.cumsum(size[sets]) - size[sets], size[sets])
            own = values[place]
            part = ((own >> np.uint64(32)) * np.repeat(cuts, size[sets]).astype(np.uint64)) >> np.uint64(32)
            slot = np.repeat(base, size[sets]) + part.astype(np.int64)
            start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            slots, total = slot[start], np.add.reduceat(mix(own), start)
            of = np.searchsorted(base, slots, "right") - 1
            empty = cuts - np.bincount(of, minlength=len(sets))
            for k in np.flatnonzero(empty > self.spare[c]):
                bare = np.setdiff1d(np.arange(base[k], base[k] + cuts[k]), slots[of == k])
                slots, total, of = np.r_[slots, bare], np.r_[total, np.zeros(len(bare), np.uint64)], np.r_[of, np.full(len(bare), k)]
            key = mix(total ^ mix((c[of] * (1 << 40) + slots - base[of]).astype(np.uint64)))
            out.append((key, sets[of], c[of], np.maximum(self.spare[c] - empty, 0)[of]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none.view(np.uint64), none, none, none)


def _spare(differ: int, least: int) -> int:
    """So many ranges over D + 1 that few sets of ``least`` n-grams or more have more empty ranges than these."""
    spare = 0
    while spare < least:
        cuts = differ + 1 + spare
        empty = cuts * (1 - 1 / cuts) ** least
        wanted = int(empty + 2 * math.sqrt(empty))
        if wanted <= spare:
            break
        spare = wanted
    return spare


#: Sizes of sets that a table of classes reaches; larger ones get a larger table.
LONGEST = 1 << 20


def measured(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """For each row: id, size of its set and two checksums of it."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                values, at = ngram_sets(data, offs, n)
                sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])[at]) for v in (values, mix(values ^ np.uint64(0x2545F4914F6CDD1D)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))], ["id", "size", "sum1", "sum2"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id bigint, size bigint, sum1 bigint, sum2 bigint")


def range_keys(docs: DataFrame, key: str, text: str, n: int, percent: int, among: Sketch | None = None, shared: Sketch | None = None) -> DataFrame:
    """Keys of all ranges of each set of ids that may be in ``among``.

    Without ``shared``: (gram). With it: (gram, id, of, may_leave) of keys that may be in it, of sets and classes (of) that
    have more of these than they may leave.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(percent, LONGEST)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if among is not None:
                batch = batch.filter(pa.array(among.may_hold(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column(1)):
                values, at = ngram_sets(data, offs, n)
                longest = int(np.diff(at).max(initial=0))
                keys, owner, cls, leave = (ranges if longest < LONGEST else Ranges(percent, longest + 1)).keys(values, at)
                if shared is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["gram"])
                    continue
                held = shared.may_hold(keys)
                keys, owner, cls, leave = keys[held], owner[held], cls[held], leave[held]
                _, part, many = np.unique(owner << 8 | cls, return_inverse=True, return_counts=True)
                kept = many[part] > leave
                keys, owner, cls, leave = keys[kept], owner[kept], cls[kept], leave[kept]
                sums = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])[at])[owner]
                of = mix(sums ^ cls.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[lo:hi][owner]), pa.array(of.view(np.int64)), pa.array(leave.astype(np.int32))], ["gram", "id", "of", "may_leave"])

    schema = "gram bigint" if shared is None else "gram bigint, id bigint, of bigint, may_leave int"
    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, schema)


def allowed(sizes, percent: int):
    """How many n-grams only one of two sets may hold, if they have so many together."""
    return (100 - percent) * sizes // (100 + percent)


class Tree:
    """A block's sets as sorted sequences of numbers, frequent n-grams first, and for each number the sets that hold it.

    What more than half of the sets hold is taken out of these and put into the others, which changes no difference.
    """

    def __init__(self, sets: list[np.ndarray]):
        names, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        centre = np.flatnonzero(2 * times > len(sets))
        if len(centre):
            has = np.zeros((len(sets), len(centre)), bool)
            inside = np.flatnonzero(2 * times[number] > len(sets))
            has[owner[inside], np.searchsorted(centre, number[inside])] = True
            lacks, which = np.nonzero(~has)
            outside = np.flatnonzero(2 * times[number] <= len(sets))
            number, owner = np.r_[number[outside], centre[which]], np.r_[owner[outside], lacks]
        times = np.bincount(number, minlength=len(names))
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, -times))] = np.arange(len(names))
        number = rank[number]
        order = np.lexsort((number, owner))
        self.number, owner, self.n = number[order], owner[order], len(names)
        self.size = np.bincount(owner, minlength=len(sets))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        order = np.argsort(self.number, kind="stable")
        self.holders, self.start = owner[order], np.searchsorted(self.number[order], np.arange(self.n + 1))
        self.places = owner * (self.n + 1) + self.number  # in order of set and number
        self.base = np.arange(len(sets), dtype=np.int64) * (self.n + 1)
        # the leaves in order, and the length of the prefix that each shares with the one before
        self.order = sorted(range(len(sets)), key=lambda i: self.sequence(i).astype(">u4").tobytes())
        self.shared = np.zeros(len(sets), np.int64)
        for k in range(1, len(sets)):
            a, b = self.sequence(self.order[k - 1]), self.sequence(self.order[k])
            m = min(len(a), len(b))
            off = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(off[0]) if len(off) else m

    def sequence(self, i: int) -> np.ndarray:
        return self.number[self.at[i] : self.at[i + 1]]

    def counted(self, numbers: np.ndarray) -> np.ndarray:
        """How many of the numbers each set holds."""
        first, n = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        place = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.holders[place], minlength=len(self.size))

    def left(self, sets: np.ndarray, number: int) -> np.ndarray:
        """How many numbers of each set come after this one."""
        return self.at[sets + 1] - np.searchsorted(self.places, self.base[sets] + number, "right")


def walk(differences: list[np.ndarray], sizes: np.ndarray, percent: int, group: list[int]) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects. differences: from one set that is the same for all; sizes: of the
    whole sets; group: sets of one number are known to be connected.

    All sets go down the tree together: each knows its overlap with the prefix, which is made once for all sequences
    below, and stays only as long as it can differ from some of them little enough.
    """
    tree = Tree(differences)
    order, shared, size = np.array(tree.order), tree.shared, tree.size
    component = np.unique(np.array(group), return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    every = np.arange(len(sizes))
    nodes = [(0, len(order), 0, every, np.zeros(len(every), np.int64))]
    while nodes:
        lo, hi, depth, rows, over = nodes.pop()
        y = tree.sequence(order[lo])
        end = len(y) if hi - lo == 1 else int(shared[lo + 1 : hi].min())
        below = order[lo:hi]
        if end > depth:
            over = over + tree.counted(y[depth:end])[rows]
            left = tree.left(rows, int(y[end - 1]))
            best = np.clip(end + left, size[below].min(), size[below].max())
            least = size[rows] + best - 2 * (over + np.minimum(left, best - end))
            stay = least <= allowed(sizes[rows] + sizes[below].max(), percent)
            kinds = component[below]
            if (kinds == kinds[0]).all():
                stay &= component[rows] != kinds[0]
            rows, over = rows[stay], over[stay]
            if not len(rows):
                continue
        k = lo
        while k < hi and size[order[k]] == end:
            j = order[k]
            hit = rows[(size[rows] + end - 2 * over <= allowed(sizes[rows] + sizes[j], percent)) & (component[rows] != component[j])]
            for c in np.unique(component[hit]):
                links.append((int(hit[component[hit] == c][0]), int(j)))
            component[np.isin(component, component[hit])] = component[j]
            k += 1
        cuts = [k, *(k + 1 + np.flatnonzero(shared[k + 1 : hi] == end)).tolist(), hi] if k < hi else []
        nodes += [(a, b, end, rows, over) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return links


def _dealt(blocks: DataFrame, *within: str) -> DataFrame:
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block", *within)


def differing(met: DataFrame, n: int, percent: int) -> DataFrame:
    """(cluster, id, size, whole, grams, linked): links of leads with one block of sets; for others a row for each set.

    met: cluster (the lead's id), block, nb (its number of blocks), later (false for the lead), id and text. A link has
    its ends in cluster and id, and no grams. Otherwise these are hashes that only one of the set and its lead holds;
    where they are more, and for the lead, the whole set. A lead with several texts is known by the one with the least
    set, the others are sets like any.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, n_first = None, [], [], 0

        def found() -> Iterator[tuple]:
            if not sets:
                return
            order = sorted(range(n_first), key=lambda i: (len(sets[i]), sets[i].tobytes()))
            lead = sets[order[0]]
            apart = [np.setxor1d(x, lead, assume_unique=True) for x in sets]
            if key[2] == 1:
                if len(set(ids)) > 1:
                    for i, j in walk(apart, np.array([len(x) for x in sets], np.int64), percent, ids):
                        yield ids[i], ids[j], 0, None, None, True
                return
            for k in range(0 if key[1] == 0 else n_first, len(sets)):
                whole = k == order[0] or len(apart[k]) >= len(sets[k])
                yield key[0], ids[k], len(sets[k]), whole, (sets[k] if whole else apart[k]).tobytes(), len(apart[k]) <= allowed(len(sets[k]) + len(lead), percent)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, KINDS, strict=True)], NAMES)

        for part in parts:
            rows = list(zip(*(part.column(c).to_pylist() for c in ("cluster", "block", "nb", "later", "id")), strict=True))
            for lo, _, data, offs in chunks(part.column("text")):
                values, at = ngram_sets(data, offs, n)
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), lo):
                    if rows[i][:3] != key:
                        yield batch(list(found()))
                        key, ids, sets, n_first = rows[i][:3], [], [], 0
                    if b > a:
                        n_first += not rows[i][3]
                        ids.append(rows[i][4])
                        sets.append(values[a:b])
        yield batch(list(found()))

    return _dealt(met, "later").mapInArrow(run, "cluster bigint, id bigint, size bigint, whole boolean, grams binary, linked boolean")


NAMES = ["cluster", "id", "size", "whole", "grams", "linked"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_()]


def joined(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in each block; blocks: cluster, block, id, grp, size, whole and grams, the lead's rows in each block."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len({r[1] for r in rows}) > 1:
                sets = [np.frombuffer(r[4], np.uint64) for r in rows]
                lead = min((x for r, x in zip(rows, sets, strict=True) if r[0] == key[0] and r[3]), key=lambda x: (len(x), x.tobytes()))
                apart = [np.setxor1d(x, lead, assume_unique=True) if r[3] else x for r, x in zip(rows, sets, strict=True)]
                out = [(rows[i][0], rows[j][0]) for i, j in walk(apart, np.array([r[2] for r in rows], np.int64), percent, [r[1] for r in rows])]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for part in parts:
            for c, b, *row in zip(*(part.column(x).to_pylist() for x in ("cluster", "block", "id", "grp", "size", "whole", "grams")), strict=True):
                if (c, b) != key:
                    yield links()
                    key, rows = (c, b), []
                rows.append(row)
        yield links()

    return _dealt(blocks).mapInArrow(run, "a bigint, b bigint")


def _groups(docs: DataFrame, key: str, text: str, n: int, percent: int, lone: DataFrame) -> DataFrame:
    """(cluster, id): the leads of the groups that each set stays in, other than itself."""
    among = sketch_of(lone, "id")
    seen = range_keys(docs, key, text, n, percent, among).groupBy("gram").agg(F.count("*").alias("n"))
    shared = sketch_of(saved(seen.filter("n > 1").select("gram")), "gram")
    posts = saved(range_keys(docs, key, text, n, percent, among, shared).join(lone, "id", "left_semi").distinct())
    # each set leaves its largest groups, as many as it may
    counted = posts.join(saved(posts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")), "gram")
    own = Window.partitionBy("id", "of").orderBy(F.desc("n"), F.desc("gram"))
    stays = counted.withColumn("rank", F.row_number().over(own)).filter("rank > may_leave").select("gram", "id").distinct()
    stays = saved(stays.withColumn("weight", F.count("*").over(Window.partitionBy("id"))))
    # then groups choose among the leads of most groups, so that sets have few leads
    first = lambda t, *by: t.groupBy("gram").agg(F.max(F.struct(*by, (-F.col("id")).alias("id")))["id"].alias("lead"), F.count("*").alias("n")).filter("n > 1").withColumn("lead", -F.col("lead"))
    often = saved(first(stays, "weight").groupBy(F.col("lead").alias("id")).agg(F.count("*").alias("groups")))
    leads = saved(first(stays.join(often, "id", "left").na.fill(0, ["groups"]), "groups", "weight"))
    return stays.join(leads, "gram").select(F.col("lead").alias("cluster"), "id").filter("cluster <> id").distinct()


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Adds n_shingles and component_id: the smallest id reachable over links of Jaccard similarity percent/100 or more."""
    sets = saved(measured(docs, key, text, n))
    keyed = sets.filter("id is not null and size > 0")
    same = saved(keyed.groupBy("size", "sum1", "sum2").agg(F.min("id").alias("rep")))  # apart from the join, so that a hot class can be split there
    classes = saved(keyed.select("id", "size", "sum1", "sum2").join(same, ["size", "sum1", "sum2"]).select("id", "rep").distinct())
    pairs = saved(_groups(docs, key, text, n, percent, classes.filter("id = rep").select("id")))

    # each set meets its leads
    texts = saved(texts_of(docs, key, text, pairs.select("id").unionByName(pairs.select(F.col("cluster").alias("id"))).distinct()))
    long = texts.groupBy("id").agg(F.sum(F.length("text")).alias("long"))
    sizes = pairs.join(long, "id").groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("long") / CHARACTERS)).alias("nb"))
    members = pairs.join(sizes, "cluster").select("cluster", F.pmod(F.xxhash64("id"), "nb").alias("block"), "nb", "id", F.lit(True).alias("later"))
    leads = sizes.select("cluster", F.explode(_upto("nb")).alias("block"), "nb", F.col("cluster").alias("id"), F.lit(False).alias("later"))
    met = saved(differing(members.unionByName(leads).join(texts, "id").select("cluster", "block", "nb", "later", "id", "text"), n, percent))
    links = met.filter("linked and cluster <> id").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    met = met.filter("grams is not null")
    first = components(links)

    # where the sets of a lead with many are of several components: those outside the largest one against all, in blocks
    held = met.select("cluster", "id", F.length("grams").alias("bytes")).join(first, "id", "left").withColumn("grp", F.coalesce("component", "id"))
    by = held.groupBy("cluster", "grp").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    blocks = lambda k, bytes_: F.ceil(F.greatest(k / SETS, bytes_ / BYTES))
    split = by.groupBy("cluster").agg(F.count("*").alias("parts"), F.max(F.struct("k", "grp", "bytes")).alias("main"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes")).filter("parts > 1")
    split = saved(split.select("cluster", F.col("main.grp").alias("main"), blocks(F.col("k"), F.col("bytes")).alias("nb"), blocks(F.col("k") - F.col("main.k"), F.col("bytes") - F.col("main.bytes")).alias("qb")))
    open_ = met.drop("linked").join(split, "cluster").join(first, "id", "left").withColumn("grp", F.coalesce("component", "id"))
    kept = ["cluster", "id", "grp", "size", "whole", "grams"]
    row, ask = F.pmod(F.xxhash64("id"), "nb"), F.pmod(F.xxhash64("id", F.lit(1)), "qb")
    lead = F.col("id") == F.col("cluster")
    at = F.when(lead, _upto(F.col("nb") * F.col("qb"))).otherwise(F.array_union(
        F.transform(_upto("qb"), lambda a: row * F.col("qb") + a),
        F.when(F.col("grp") != F.col("main"), F.transform(_upto("nb"), lambda r: r * F.col("qb") + ask)).otherwise(F.array().cast("array<bigint>")),
    ))
    more = joined(open_.select(*kept, F.explode(at).alias("block")), percent)
    total = components(links.unionByName(saved(more)))

    label = classes.join(total, classes["rep"] == total["id"], "left").select(classes["id"].alias("__id"), F.coalesce("component", "rep").alias("__component"))
    label = label.groupBy("__id").agg(F.min("__component").alias("__component"))
    size = sets.groupBy(F.col("id").alias("__sid")).agg(F.max("size").alias("__size"))
    out = docs.drop("n_shingles", "component_id")
    out = out.join(label, out[key] == F.col("__id"), "left").join(size, out[key] == F.col("__sid"), "left")
    return out.withColumns({"n_shingles": F.coalesce("__size", F.lit(0)).cast("long"), "component_id": F.coalesce("__component", out[key]).cast("long")}).drop("__id", "__sid", "__component", "__size")


def _upto(n: str | Column) -> Column:
    """0 to n - 1."""
    return F.sequence(F.lit(0).cast("long"), (F.col(n) if isinstance(n, str) else n) - 1)


def op4(docs: DataFrame) -> DataFrame:
    return ngram_components(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_sql() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY ALL
"""

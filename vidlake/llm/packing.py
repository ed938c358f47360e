"""Packing of documents' ids into as few sequences of bounded length as can be found.

Only lengths matter to the search, and there are as many as a sequence has places: all documents are counted by length
in Spark, bin completion works on these counts, and its result, so many sequences filled with so many of each length,
is dealt to the numbered documents as intervals of numbers. So the search is over the whole table at any size, and what
the driver holds is bounded by the capacity: each step of the plan uses up a length for the multiplicity it has in a
filling, so there are at most capacity/1 + capacity/2 + ... steps (7,700 at 1,024).

A null text is an empty one: its end id alone. Documents longer than a sequence are cut into full pieces behind a first
piece that may be shorter. Equal rows are packed each. Null ids are ids like others. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.numbering import numbered
from vidlake.llm.pieces import document_ids
from vidlake.llm.text import chunks
from vidlake.storage import saved

#: Nodes of the search, fillings looked at for a node, and fillings kept for it. The best plan found until then is taken.
NODES, LOOKED, KEPT = 2_000, 2_000, 24
BYTES = 1 << 19

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
Plan = list[tuple[Filling, int]]  # fillings and how many sequences have each


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer: total length, and for each k what cannot stand beside pieces longer than capacity - k."""
    size = np.arange(capacity + 1)
    total = np.append(0, np.cumsum(counts * size))
    number = np.append(0, np.cumsum(counts))
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    large = number[capacity + 1] - number[capacity - k + 1]
    middle, room = number[capacity - k + 1] - number[half + 1], total[capacity - k + 1] - total[half + 1]
    small = total[half + 1] - total[k]
    rest = small - (middle * capacity - room)
    return int(max(-(-total[-1] // capacity), (large + middle + np.maximum(0, -(-rest // capacity))).max()))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Longest first, each into the fullest sequence that has room; sequences filled alike are handled at once."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [filling, how many]
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        for left in range(size, capacity):
            groups, room[left] = room[left], []
            for filling, many in groups:
                each = left // size
                full = min(many, n // each)
                if full:
                    room[left - each * size].append([(*filling, (size, each)), full])
                    n -= full * each
                if full < many and n:
                    room[left - n * size].append([(*filling, (size, n)), 1])
                    full, n = full + 1, 0
                if full < many:
                    room[left].append([filling, many - full])
            if not n:
                break
        each = capacity // size
        if n // each:
            room[capacity - each * size].append([((size, each),), n // each])
        if n % each:
            room[capacity - n % each * size].append([((size, n % each),), 1])
    return [(filling, many) for groups in room for filling, many in groups]


def fits(part: list[int], whole: list[int]) -> bool:
    """Whether the lengths of ``part``, longest first, can be dealt into rooms of ``whole``."""
    if not part:
        return True
    seen = set()
    for i, room in enumerate(whole):
        if room >= part[0] and room not in seen:
            seen.add(room)
            if fits(part[1:], [*whole[:i], room - part[0], *whole[i + 1 :]]):
                return True
    return False


def fillings(counts: np.ndarray, room: int, slack: int) -> Iterator[Filling]:
    """Sets of lengths that fill the room but for ``slack`` at most, larger lengths first."""
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    rest = np.append(np.cumsum([s * int(counts[s]) for s in sizes][::-1])[::-1], 0).tolist()
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack:
        at, left, filling = stack.pop()
        while at < len(sizes) and sizes[at] > left:
            at += 1
        if left - rest[at] > slack:
            continue
        if at == len(sizes):
            yield filling
            continue
        most = min(int(counts[sizes[at]]), left // sizes[at])
        for many in range(most + 1):
            stack.append((at + 1, left - many * sizes[at], (*filling, (sizes[at], many)) if many else filling))


def undominated(counts: np.ndarray, room: int, slack: int) -> list[Filling]:
    """Fillings none of which could be dealt into the rooms of another's lengths; fullest first."""
    looked = sorted(islice(fillings(counts, room, slack), LOOKED), key=lambda f: (-sum(s * n for s, n in f), len(f), [(-s, -n) for s, n in f]))
    kept: list[tuple[Filling, list[int]]] = []
    for filling in looked:
        flat = [s for s, n in filling for _ in range(n)]
        if not any(len(flat) <= 12 and fits(flat, whole) for _, whole in kept):
            kept.append((filling, flat))
            if len(kept) == KEPT:
                break
    return [filling for filling, _ in kept]


@dataclass
class Found:
    plan: Plan
    sequences: int
    bound: int
    nodes: int
    exhausted: bool  # whether every filling of every node was searched or pruned: no plan is better


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> Found:
    """Bin completion: the longest piece left and an undominated filling around it, for one sequence or for as many as there is stock.

    Nodes that cannot beat the best plan are pruned by the bound; fillings that waste more than a better plan may are
    not made. Best-fit decreasing gives the first plan.
    """
    counts = counts.astype(np.int64)
    bound, plan = lower_bound(counts, capacity), best_fit(counts, capacity)
    best, done, whole = sum(n for _, n in plan), 0, True
    stack = [(counts, 0, None)] if best > bound else []
    while stack and best > bound:
        if done == nodes:
            whole = False
            break
        done += 1
        left, used, path = stack.pop()
        if not left.any():
            if used < best:
                best, plan, at = used, [], path
                while at is not None:
                    plan.append(at[0])
                    at = at[1]
            continue
        if used + lower_bound(left, capacity) >= best:
            continue
        size = int(np.flatnonzero(left)[-1])
        left = left.copy()
        left[size] -= 1
        slack = (best - 1 - used) * capacity - int((left * np.arange(capacity + 1)).sum()) - size
        found = undominated(left, capacity - size, min(slack, capacity))
        whole &= len(found) < KEPT
        left[size] += 1
        children = []
        for filling in found:
            used_up = dict(filling)
            used_up[size] = used_up.get(size, 0) + 1
            most = min(int(left[s]) // n for s, n in used_up.items())
            for many in (most, 1) if most > 1 else (1,):
                rest = left.copy()
                for s, n in used_up.items():
                    rest[s] -= many * n
                children.append((many == 1 and most > 1, (rest, used + many, ((tuple(sorted(used_up.items(), reverse=True)), many), path))))
        stack += [c for _, c in sorted(children, key=lambda c: c[0])][::-1]
    return Found(plan, best, bound, done, whole or best == bound)


def intervals(plan: Plan, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The plan for pieces numbered by length: of each interval of numbers its first, its sequences' first, how many pieces of the interval each of these has, and where they start in it."""
    next_of = np.append(0, np.cumsum(counts))[:-1].tolist()
    rows, sequence = [], 0
    for filling, many in sorted(plan, reverse=True):
        offset = 0
        for size, each in filling:
            rows.append((next_of[size], sequence, each, offset))
            next_of[size] += many * each
            offset += size * each
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"first": table[:, 0], "sequence": table[:, 1], "each": table[:, 2], "offset": table[:, 3]}


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents with so many ids, one at least."""
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * capacity
    start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
    return doc, piece, start, np.where(piece > 0, capacity, first[doc])


def pieces(docs: DataFrame, path: str, capacity: int, end: int, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids with the end id behind them."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1), BYTES):
                ids, at = document_ids(data, offs, path)
                at = at + np.arange(len(at))
                flat = np.full(at[-1], end, "<u4")
                flat[~np.isin(np.arange(at[-1]), at[1:] - 1, assume_unique=True)] = ids
                doc, piece, start, length = cut(np.diff(at), capacity)
                begin = at[doc] + start
                view = memoryview(flat).cast("B")
                sums = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc + a)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
                names = [doc_id, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1:]), pa.int32()), pa.array(flat.view(np.int32))))
                    names.append("ids")
                for k in range(0, len(doc), 4096):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 4096) for c in columns], names=names)

    schema = f"`{doc_id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(doc_id, text).mapInArrow(run, schema)


def packed(rows: DataFrame, capacity: int, order: list[str], length: str = "length", nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to rows with lengths from 1 to the capacity; ``order`` says which of equal length comes first."""
    rows = saved(rows)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rows.groupBy(length).count().collect():  # as many rows as the capacity at most
        counts[size] = n
    table, names = intervals(complete(counts, capacity, nodes).plan, counts), [*rows.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, size = (batch.column(c).to_numpy() for c in ("__number", length))
            at = np.searchsorted(table["first"], number, "right") - 1
            inside, each = number - table["first"][at], table["each"][at]
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "__number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table["sequence"][at] + inside // each), pa.array(table["offset"][at] + inside % each * size)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return numbered(rows, [length, *order], "__number").mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Each piece of each document with its sequence and its place there."""
    return packed(pieces(docs, path, capacity, end, keep_ids=keep_ids), capacity, ["doc_id", "piece", "ids_crc32"], nodes=nodes)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces that were packed with their ids: a sequence's rows are bounded by its capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(inside.alias("__rows")).select("sequence_id", F.flatten("__rows.ids").alias("ids"), F.col("__rows.doc_id").alias("doc_ids"))


def op12(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path)

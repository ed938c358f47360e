"""Tokens of two vocabularies aligned by the bytes they stand for, and counts of the pairs that are linked.

A byte-level vocabulary (A) encodes a space and the text, a merge-type vocabulary of sentencepiece (B) the text, to which
it adds that space. Tokens are laid out on the same bytes: the libraries' own spans are the coarse cuts, and tokens that
share a character, or have no span as they spell a character byte by byte, are placed by the bytes they decode to. Byte
places where tokens of both end cut the tokens into groups; all pairs across a group are linked. A pair's count is the
number of documents (rows) that hold it linked.

Texts are worked through in shards of a bounded number of bytes. A shard keeps, for each document, the numbers of its
pairs in the shard's own list of pairs and how often each is linked. Only these lists are counted over the corpus and
joined back, so what is moved for a pair is a row for each shard, not for each document. Inside a group, equal tokens
are counted before pairs are made, so that a long group gives no more pairs than there are different ids.

A null or empty text, and one that B cannot give back byte for byte (it holds the vocabulary's own space mark), has no
tokens: zeros and an empty string. Equal rows count each. Null ids are ids like others; other columns pass through,
and those named like a result are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.pieces import Memory, byte_alphabet, byte_level, pattern_cuts, space_cuts
from vidlake.llm.text import chunks
from vidlake.storage import saved

#: Bytes of text handled at once, and in a shard, whose pairs are listed together.
BYTES, SHARD = 1 << 19, 1 << 24
#: A pair of ids as one number: the id of A, then that of B.
B_BITS = 20
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def placed(parts: list[bytes], n: np.ndarray, ids: np.ndarray, spans: np.ndarray, entry: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``Memory`` keeps of parts with so many tokens each: byte ends, and whether a part's tokens decode to it.

    A token ends where its own span does, if that has as many bytes as the token decodes to; the others share a character
    or have no span, and end as many bytes behind the token before.
    """
    size = lengths[ids]
    total = np.append(0, np.cumsum(size))
    last = np.cumsum(n)
    decoded = total[1:] - np.repeat(total[last - n], n)
    ends = np.where(spans[:, 1] - spans[:, 0] == size, spans[:, 1], decoded).astype(np.int32)
    whole = total[last] - total[last - n]
    sound = (whole == np.fromiter(map(len, parts), np.int64, len(parts)))
    if sound.all() and b"".join(map(entry.__getitem__, ids.tolist())) != b"".join(parts) or not sound.all():
        own = ids.tolist()
        sound = np.array([b"".join(map(entry.__getitem__, own[e - k : e])) == part for part, k, e in zip(parts, n.tolist(), last.tolist(), strict=True)], bool)
    return n, ids, ends, sound


@cache
def byte_level_tokens(path: str) -> Memory:
    library, _ = byte_level(path)
    written = byte_alphabet()
    tokens = sorted((i, t) for t, i in library.get_vocab().items())
    entry = [bytes(written[c] for c in t) if all(c in written for c in t) else t.encode() for _, t in tokens]
    if [i for i, _ in tokens] != list(range(len(entry))):
        raise ValueError("ids of the vocabulary have gaps")
    lengths = np.array(list(map(len, entry)))

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = library.encode_batch([p.decode() for p in parts], add_special_tokens=False)
        own = [e.ids for e in found]
        n = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.fromiter(chain.from_iterable(own), np.int64, n.sum())
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * len(ids)).reshape(-1, 2)
        # characters' places as bytes
        data = np.frombuffer(b"".join(parts), np.uint8)
        first = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        characters = np.searchsorted(at, first[:-1])
        spans = at[spans + np.repeat(characters, n)[:, None]] - np.repeat(first[:-1], n)[:, None]
        return placed(parts, n, ids, spans, entry, lengths)

    return Memory(encode)


@cache
def piece_tokens(path: str) -> Memory:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    entry = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i in range(library.get_piece_size()) for p in [library.id_to_piece(i)]]
    lengths = np.array(list(map(len, entry)))
    if any("\n" in p or "▁" in p.lstrip("▁") for p in map(library.id_to_piece, range(library.get_piece_size()))):
        raise ValueError("a piece of the vocabulary spans a line feed or a space that follows something else")
    kind = "proto" if hasattr(library, "encode_as_proto") and not hasattr(library, "encode_as_immutable_proto") else "immutable_proto"

    def read(text: str, added: int) -> np.ndarray:
        """(id, begin, end) of each token of the text and the space that the library puts before it; places are bytes behind the first ``added``."""
        found = library.encode(text, out_type=kind).pieces
        rows = np.array([(p.id, p.begin, p.end) for p in found], np.int64).reshape(-1, 3)
        rows[:, 1:] += 1 - added
        if len(rows) and rows[0, 1] == 1:
            rows[0, 1] = 0  # the first span has that space too
        return rows

    def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Tokens of parts that begin with a space and do not end in one: no token crosses from one to the next, so they are one text."""
        rows = read(b"".join(parts)[1:].decode(), 0)
        first = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        total = np.append(0, np.cumsum(lengths[rows[:, 0]]))
        last = np.searchsorted(total, first)
        if total[-1] != first[-1] or (total[last] != first).any():
            return None
        n = np.diff(last)
        return n, rows[:, 0], rows[:, 1:] - np.repeat(first[:-1], n)[:, None]

    def alone(part: bytes) -> np.ndarray:
        if part == b" ":  # the library gives nothing for an empty text
            return np.array([(library.piece_to_id("▁"), 0, 1)], np.int64)
        if part[:1] == b" ":
            return read(part[1:].decode(), 0)
        return read("\n" + part.decode(), 2)[2:]  # behind a space and a line feed

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        plain = [k for k, p in enumerate(parts) if p[0] == 0x20 and p[-1] != 0x20 and b"\xe2\x96\x81" not in p]
        made = joined([parts[k] for k in plain]) if plain else None
        rest = sorted(set(range(len(parts))) - set(plain)) if made else range(len(parts))
        rows = [alone(parts[k]) for k in rest]
        groups = [(np.array(rest, np.int64), np.array(list(map(len, rows)), np.int64), np.concatenate([r[:, 0] for r in rows]), np.concatenate([r[:, 1:] for r in rows]))] if rows else []
        if made:
            groups.append((np.array(plain, np.int64), *made))
        which, n, ids, spans = (np.concatenate(x) for x in zip(*groups, strict=True))
        # in the order of the parts
        order = np.argsort(which, kind="stable")
        first = np.cumsum(n) - n
        n = n[order]
        place = np.arange(n.sum()) + np.repeat(first[order] - (np.cumsum(n) - n), n)
        return placed(parts, n, ids[place], spans[place], entry, lengths)

    return Memory(encode)


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each that is not empty."""
    size = np.diff(offs)
    full = size > 0
    out = np.full(len(data) + full.sum(), 0x20, np.uint8)
    at = np.append(0, np.cumsum(size + full))
    body = np.ones(len(out), bool)
    body[at[:-1][full]] = False
    out[body] = data
    return out, at


class Aligned:
    """Tokens of both vocabularies for all texts of a chunk, and the groups they form."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, path_a: str, path_b: str):
        data, offs = spaced(data, offs)
        self.n = len(offs) - 1
        sides, sound = [], np.ones(self.n, bool)
        for memory, cuts in ((byte_level_tokens(path_a), pattern_cuts(data, offs, byte_level(path_a)[1])), (piece_tokens(path_b), space_cuts(data, offs))):
            if not len(cuts):
                sides.append((np.zeros(0, np.int32), np.zeros(0, np.int64)))
                continue
            _, ids, ends, good = memory.tokens(data, cuts)
            sound[np.searchsorted(offs, cuts[~good], "right") - 1] = False
            sides.append((ids, ends.astype(np.int64)))
        doc = [np.searchsorted(offs, ends, "left") - 1 for _, ends in sides]  # a token ends inside its text or at its end
        sides = [(ids[sound[d]], ends[sound[d]], d[sound[d]]) for (ids, ends), d in zip(sides, doc, strict=True)]
        (self.a, ends_a, self.doc_a), (self.b, ends_b, self.doc_b) = sides
        both = np.zeros(len(data) + 1, np.uint8)
        both[ends_a] += 1
        both[ends_b] += 2
        cuts = np.flatnonzero(both == 3)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left")
        self.doc_of_group = np.searchsorted(offs, cuts, "left") - 1
        self.n_groups = np.bincount(self.doc_of_group, minlength=self.n)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.doc_a, minlength=self.n), np.bincount(self.doc_b, minlength=self.n)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times linked), each document's pairs once and in order."""
        sides = []
        for ids, group in ((self.a, self.group_a), (self.b, self.group_b)):
            many = (self.in_a * self.in_b)[group] > 16
            if many.any():  # equal ids of a large group are counted before they meet the other side
                key, times = np.unique((group[many].astype(np.int64) << 32) | ids[many], return_counts=True)
                group = np.concatenate([group[~many], key >> 32])
                ids = np.concatenate([ids[~many], (key & 0xFFFFFFFF).astype(np.int32)])
                times = np.concatenate([np.ones((~many).sum(), np.int64), times])
                order = np.argsort(group, kind="stable")
                sides.append((ids[order], group[order], times[order]))
            else:
                sides.append((ids, group, np.ones(len(ids), np.int64)))
        (a, group_a, times_a), (b, group_b, times_b) = sides
        n_b = np.bincount(group_b, minlength=len(self.in_b))
        first_b = np.cumsum(n_b) - n_b
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, total = 0, np.cumsum(n_b[group_a])
        while at < len(a):  # a bounded number of pairs at once, those of one id of A at least
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21), "right")))
            n = n_b[group_a[at:end]]
            place = np.arange(n.sum()) + np.repeat(first_b[group_a[at:end]] - (np.cumsum(n) - n), n)
            doc = np.repeat(self.doc_of_group[group_a[at:end]], n)
            pair = (np.repeat(a[at:end].astype(np.int64), n) << B_BITS) | b[place]
            found.append(summed(doc, pair, np.repeat(times_a[at:end], n) * times_b[place]))
            at = end
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return summed(*(np.concatenate(x) for x in zip(*found, strict=True))) if len(found) > 1 else found[0]

    def digests(self) -> list[str]:
        """Checksum of each document's groups, ids in order; an empty string without tokens."""
        na, nb = len(self.a), len(self.b)
        before_b = np.append(0, np.cumsum(self.in_b))[self.group_a]
        after_a = np.cumsum(self.in_a)[self.group_b]
        rows = np.zeros((na + nb, 8), np.uint8)
        size = np.zeros(na + nb, np.int64)
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True) if na else np.zeros(0, bool)
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True) if nb else np.zeros(0, bool)
        for ids, place, last, mark in ((self.a, np.arange(na) + before_b, last_a, ord("|")), (self.b, np.arange(nb) + after_a, last_b, ord(";"))):
            digits, length = decimal()
            rows[place] = digits[ids]
            size[place] = length[ids]
            rows[place, length[ids]] = np.where(last, mark, ord(","))
        flat = rows.ravel()
        flat = flat[flat > 0]
        tokens = np.bincount(self.doc_a, minlength=self.n) + np.bincount(self.doc_b, minlength=self.n)
        ends = np.append(0, np.cumsum(size + 1))[np.cumsum(tokens)]
        view, at, out = memoryview(flat), 0, []
        for end, some in zip(ends.tolist(), tokens.tolist(), strict=True):
            out.append(hashlib.sha256(view[at : end - 1]).hexdigest() if some else "")
            at = end
        return out


@cache
def decimal() -> tuple[np.ndarray, np.ndarray]:
    """Digits of all ids, with room for a mark behind, and how many they are."""
    text = np.arange(1 << B_BITS).astype("S7")
    rows = np.zeros((len(text), 8), np.uint8)
    rows[:, :7] = np.frombuffer(text.tobytes(), np.uint8).reshape(-1, 7)
    return rows, np.char.str_len(text).astype(np.int64)


def summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one document and pair as one; in order of both."""
    key = (doc.astype(np.int64) << 40) | pair
    if (times == 1).all():
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(first, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(times[order], first)
    key = key[first]
    return key >> 40, key & ((1 << 40) - 1), total


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values))


def spread(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def shards(docs: DataFrame, path_a: str, path_b: str, text: str, carried_names: list[str], limit: int) -> DataFrame:
    """A row for each shard of texts: a number, the documents' own columns and results, and links by the shard's list of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        rows: list[pa.RecordBatch] = []
        own: list[tuple] = []
        held = 0

        def done() -> pa.RecordBatch:
            nonlocal number, held
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for r in rows:
                    out.write_batch(r)
            doc, pair, times = (np.concatenate([x[k] for x in own]) for k in range(3))
            listed, local, documents = np.unique(pair, return_inverse=True, return_counts=True)
            size = np.bincount(doc, minlength=sum(len(r) for r in rows)) if len(rows) else np.zeros(0)
            values = [(task << 33) + number, sink.getvalue().to_pybytes(), squeezed(np.diff(listed, prepend=0)), squeezed(documents.astype(np.int32)), squeezed(size.astype(np.int32)), squeezed(np.diff(local.astype(np.int32), prepend=np.int32(0))), squeezed(times.astype(np.int64 if times.max(initial=0) > 2**31 - 1 else np.int32)), len(listed)]
            number, held = number + 1, 0
            rows.clear()
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for a, b, data, offs in chunks(batch.column(source), BYTES):
                aligned = Aligned(data, offs, path_a, path_b)
                n_a, n_b = aligned.counts()
                columns = [batch.column(c).slice(a, b - a) for c in carried_names]
                results = [pa.array(n_a), pa.array(n_b), pa.array(aligned.n_groups), pa.array(np.bincount(aligned.doc_of_group, weights=aligned.in_a * aligned.in_b, minlength=aligned.n).astype(np.int64)), pa.array(aligned.digests(), pa.string())]
                before = sum(len(r) for r in rows)
                rows.append(pa.RecordBatch.from_arrays([*columns, *results], names=[*carried_names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
                doc, pair, times = aligned.links()
                own.append((doc.astype(np.int32) + before, pair, times.astype(np.int32) if times.max(initial=0) < 2**31 else times))
                held += len(data)
                if held >= limit:
                    yield done()
        if rows:
            yield done()

    source = docs.schema[text].name
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = ["__shard", "rows", "pairs", "documents", "sizes", "local", "times", "n_pairs"]
    return docs.mapInArrow(run, "__shard bigint, rows binary, pairs binary, documents binary, sizes binary, local binary, times binary, n_pairs bigint")


def listed_pairs(table: DataFrame) -> DataFrame:
    """(shard, pair, documents): each shard's list of pairs as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, pairs, documents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = np.cumsum(spread(pairs, np.int64)), spread(documents, np.int32)
                for k in range(0, len(pair), 1 << 15):
                    part = pair[k : k + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(part), pa.array(n[k : k + (1 << 15)].astype(np.int64))], names=["__shard", "pair", "documents"])

    return table.select("__shard", "pairs", "documents").mapInArrow(run, "__shard bigint, pair bigint, documents bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair linked, and whether no pair of the same id of A has more."""
    counts = saved(pairs.groupBy("pair").agg(F.sum("documents").alias("count")))
    id_a = F.shiftrightunsigned("pair", B_BITS)
    top = counts.groupBy(id_a.alias("a")).agg(F.max("count").alias("top"))
    return counts.withColumn("a", id_a).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def judged(table: DataFrame, counts: DataFrame, fields: str, names: list[str]) -> DataFrame:
    """The documents' rows, with counts of their links looked up by shard."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right.column("pair").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        for packed, sizes, local, times in zip(*(left.column(c).to_pylist() for c in ("rows", "sizes", "local", "times")), strict=True):
            rows = pa.ipc.open_stream(packed).read_all()
            size, place = spread(sizes, np.int32), np.cumsum(spread(local, np.int32))
            raw = zstandard.ZstdDecompressor().decompress(times)
            many = np.frombuffer(raw, np.int64 if len(raw) == 8 * len(place) and len(place) else np.int32).astype(np.int64)
            at = np.append(0, np.cumsum(size))
            totals = [np.append(0, np.cumsum(v)) for v in (many * best[place], many * count[place])] if len(place) else [np.zeros(1, np.int64)] * 2
            sums = [t[at[1:]] - t[at[:-1]] for t in totals]
            table = rows.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
            out.append(table.select(names))
        return pa.concat_tables(out)

    return table.groupBy("__shard").cogroup(counts.groupBy("__shard")).applyInArrow(run, fields)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", kept: list[str] | None = None, limit: int = SHARD) -> DataFrame:
    """Adds to the kept columns (all, if none are named) the numbers of tokens, groups and links of each text, the sums of its links' counts, and the groups' checksum."""
    names = [c for c in (docs.columns if kept is None else kept) if c not in RESULTS]
    table = saved(shards(docs.select(*dict.fromkeys([*names, text])), path_a, path_b, text, names, limit))
    pairs = listed_pairs(table)
    counts = pairs.select("__shard", "pair").join(saved(pair_counts(pairs)), "pair").select("__shard", "pair", "count", "best")
    fields = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{r} {'string' if r == 'groups_sha256' else 'bigint'}" for r in RESULTS])
    return judged(table, counts, fields, [*names, *RESULTS])


def op13(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return align(docs, path_a, path_b, kept=["doc_id"])

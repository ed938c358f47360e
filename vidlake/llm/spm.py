"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that make a known piece, best score first and leftmost on
ties, and merges until it is empty; symbols without a piece fall back to bytes. Texts are cut where no piece
of the vocabulary can span (before a space mark, around a line feed), all texts of some rows at once, so a part
met before in the task is looked up. Parts met for the first time are encoded by the sentencepiece library too, and
a difference is an error. Whole texts are encoded, however long. A null text is an empty one: the end id
alone. Equal texts get equal results; an empty table gives an empty one; other columns pass through, and
those named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vidlake.llm.pieces import space_cuts
from vidlake.llm.text import chunks, tidy, utf8

SPACE = "▁"
#: Parts remembered in a task; when full, the memory is emptied.
REMEMBERED = 200_000
#: Characters of parts that are merged side by side; longer ones are merged alone.
ABREAST = 24
#: Bytes of text encoded at once; a longer text is encoded alone.
TOGETHER = 1 << 18


class Codec:
    """Encodes and decodes with the vocabulary of a sentencepiece model."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        byte = {i: int(names[i][3:5], 16) for i in range(len(names)) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in byte.items()}
        special = {i for i in range(len(names)) if sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(names) if i not in byte and i not in special}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.text_of = [None if i in byte else "" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(names)]
        self.byte_of = byte
        self.spans = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.feeds = any("\n" in p for p in self.ids)
        self.parts = re.compile(".+" if self.spans else " *[^ ]+| +" if self.feeds else " *[^ \n]+| +|\n", re.S)
        self.memory: dict[bytes, bytes] = {}
        self.check, self.fresh = check, []
        self.pairs = _Pairs(self.cost, self.ids)
        #: Each id in decimal with a space after it, and the bytes that it decodes to.
        self.digits = pa.array([b"%d " % i for i in range(len(names))], pa.large_binary())
        self.bytes = pa.array([bytes([byte[i]]) if t is None else t.encode() for i, t in enumerate(self.text_of)], pa.large_binary())

    def merge(self, part: str) -> list[int]:
        """Ids of one part of a normalised text."""
        symbols: list[str] = list(part)
        n, cost, agenda = len(symbols), self.cost, []
        for i in range(n - 1):
            c = cost.get(symbols[i] + symbols[i + 1])
            if c is not None:
                agenda.append((c, i, i + 1, 2))
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, left, right, size = heapq.heappop(agenda)
                a, b = symbols[left], symbols[right]
                if not a or not b or len(a) + len(b) != size:
                    continue
                symbols[left], symbols[right] = a + b, ""
                follow = after[left] = after[right]
                if follow < n:
                    before[follow] = left
                    both = symbols[left] + symbols[follow]
                    c = cost.get(both)
                    if c is not None:
                        heapq.heappush(agenda, (c, left, follow, len(both)))
                lead = before[left]
                if lead >= 0:
                    both = symbols[lead] + symbols[left]
                    c = cost.get(both)
                    if c is not None:
                        heapq.heappush(agenda, (c, lead, left, len(both)))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in s.encode()] if self.byte_ids else [self.unknown]
        return out

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, spaces in them for marks, as 32-bit numbers in a row."""
        if len(self.memory) > REMEMBERED:
            self.verify()
            self.memory.clear()
        memory = self.memory
        out = list(map(memory.get, parts))
        new = list(dict.fromkeys(p for p, found in zip(parts, out, strict=True) if found is None))
        if not new:
            return out
        for part, ids in zip(new, self.merge_all(new), strict=True):
            memory[part] = ids
        self.fresh += new
        return [memory[p] if found is None else found for p, found in zip(parts, out, strict=True)]

    def merge_all(self, parts: list[bytes]) -> list[bytes]:
        """Like merge, for many parts at once: in each step every part merges its best pair. Long parts and those with bytes go alone."""
        texts = [p.decode().replace(" ", SPACE) for p in parts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        symbols = self.pairs.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        alone = size > ABREAST
        np.logical_or.at(alone, np.repeat(np.arange(len(texts)), size)[(symbols < 0) | (symbols >= len(self.text_of))], True)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(alone).tolist():
            out[i] = array("i", self.merge(texts[i])).tobytes()
        low = 0
        for width in (4, 8, 12, 16, ABREAST):
            rows = np.flatnonzero(~alone & (size > low) & (size <= width))
            low = width
            if len(rows):
                ids, at = self.pairs.merged(symbols, first[rows], size[rows], width)
                data, cut = ids.tobytes(), (at * 4).tolist()
                for i, a, b in zip(rows.tolist(), cut, cut[1:], strict=False):
                    out[i] = data[a:b]
        return out

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        parts = self.parts.findall(" " + text.replace(SPACE, " ")) if text else []
        out = np.frombuffer(b"".join(self.ids_of([p.encode() for p in parts])), np.int32).tolist()
        return [*out, self.end] if end else out

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First bytes of the parts of all texts, which have spaces for marks and one before them."""
        if not self.spans and not self.feeds:
            return space_cuts(data, offs)
        start = np.zeros(len(data), bool)
        start[offs[:-1][offs[:-1] < len(data)]] = True
        if not self.spans:
            space = data == 0x20
            start[1:] |= space[1:] & ~space[:-1]
        return np.flatnonzero(start)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start among them), without end ids."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        whole = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, offs = utf8(pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), whole))
        cuts = self.cuts(data, offs)
        if not len(cuts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        parts = pc.dictionary_encode(parts)
        found = pa.array(self.ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        ids, at = utf8(found)
        return ids.view(np.int32), at[np.searchsorted(cuts, offs)] // 4

    def pieces(self, ids: list[int]) -> str:
        """Text of the ids, with runs of byte ids read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            text = self.text_of[i]
            if text is None:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(text)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives: the space put before the text is taken away."""
        return self.pieces(ids).removeprefix(" ")

    def verify(self) -> None:
        """Encodes the parts that are new since the last call with the library, and compares."""
        if self.check and self.fresh:
            headed = [p for p in self.fresh if p[:1] == b" "]
            bare = [p for p in self.fresh if p[:1] != b" "]
            lead = self.library.encode("\n")
            for parts, texts, skip in ((headed, [p[1:].decode() for p in headed], 0), (bare, ["\n" + p.decode() for p in bare], len(lead))):
                for part, ids in zip(parts, self.library.encode(texts, num_threads=1), strict=True):
                    if part != b" " and array("i", ids[skip:]).tobytes() != self.memory[part]:
                        raise ValueError(f"the library encodes {part!r} as {ids[skip:]}, the agenda as {np.frombuffer(self.memory[part], np.int32).tolist()}")
        self.fresh.clear()


class _Pairs:
    """Pairs of symbols that make a piece: what they make, and its place in the order of scores, 0 the best.

    A symbol is a piece's id, or a number above them for a character that only longer pieces have.
    """

    def __init__(self, cost: dict[str, float], ids: dict[str, int]):
        numbers = dict(ids)
        bare = sorted({c for p in ids for c in p} - ids.keys())
        numbers |= {c: i for i, c in enumerate(bare, max(ids.values(), default=-1) + 1)}
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in numbers.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.n = max(numbers.values(), default=0) + 1
        of, n = numbers.get, self.n
        found = {a * n + b: i for p, i in ids.items() for k in range(1, len(p)) if (a := of(p[:k])) is not None and (b := of(p[k:])) is not None}
        keys, made = (np.fromiter(x, np.int64, len(found)) for x in (found.keys(), found.values()))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        scores = np.zeros(self.n)
        for p, i in ids.items():
            scores[i] = cost[p]
        self.rank = np.unique(scores[self.made], return_inverse=True)[1].astype(np.int32)
        self.last = np.int32(len(self.keys) + 1)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the order, what is made); the place is ``last`` for pairs that make no piece, and symbols below 0 are none."""
        if not len(self.keys):
            return np.full(len(left), self.last), left
        keys = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(held, self.rank[at], self.last), self.made[at].astype(np.int32)

    def merged(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, where each part's start) for parts of at most ``width`` of the symbols."""
        n, step = len(first), width + 2  # a place before each part and one after it
        held = np.full((n, step), -1, np.int32)
        owner = np.repeat(np.arange(n), size)
        rank_in = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        held[owner, rank_in + 1] = symbols[np.repeat(first, size) + rank_in]
        held = held.ravel()
        rank, made = (np.append(x, y).astype(np.int32) for x, y in zip(self.of(held[:-1], held[1:]), (self.last, 0), strict=True))
        after, before = np.arange(1, n * step + 1), np.arange(-1, n * step - 1)
        table, rows = rank.reshape(n, step), np.arange(n)
        while len(rows):
            best = table[rows].argmin(axis=1)  # the leftmost of equals
            at = rows * step + best
            go = rank[at] < self.last
            rows, at = rows[go], at[go]
            gone = after[at]
            follow, lead = after[gone], before[at]
            held[at], held[gone], rank[gone] = made[at], -1, self.last
            after[at], before[follow] = follow, at
            rank[at], made[at] = self.of(held[at], held[follow])
            rank[lead], made[lead] = self.of(held[lead], held[at])
        kept = held.reshape(n, step) >= 0
        return held[held >= 0], np.append(0, np.cumsum(kept.sum(axis=1)))


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no character becomes the replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[: bad.start].decode() + "�")
            data = data[bad.start + 1 :]
    return "".join(out)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: What round_trip can add, by name.
ADDED = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_DDL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _round(codec: Codec, texts: pa.Array, added: tuple[str, ...]) -> dict[str, pa.Array]:
    """The named results for some texts."""
    plain, at = codec.encode_all(texts)
    n = len(texts)
    ids, ends = np.insert(plain, at[1:], codec.end).astype(np.int32), at + np.arange(n + 1)
    out = {"n_tokens": pa.array(np.diff(ends)), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))} if {"n_tokens", "ids"} & set(added) else {}
    if "ids_sha256" in added:
        data, offs = utf8(codec.digits.take(pa.array(ids)))
        data, cut = memoryview(np.ascontiguousarray(data)), offs[ends].tolist()
        out["ids_sha256"] = pa.array([hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string())
    if {"decoded", "decoded_sha256"} & set(added):
        data, offs = utf8(codec.bytes.take(pa.array(plain)))
        data, cut = memoryview(np.ascontiguousarray(data)), offs[at].tolist()
        # the space put before a text is taken away
        decoded = [data[a + (data[a : a + 1] == b" ") if a < b else a : b] for a, b in zip(cut, cut[1:], strict=False)]
        if "decoded" in added:
            out["decoded"] = pa.array([d.tobytes().decode(errors="replace") for d in decoded], pa.string())
        if "decoded_sha256" in added:
            out["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
    return out


def round_trip(docs: DataFrame, path: str, text: str = "text", added: tuple[str, ...] = ("n_tokens", "ids", "decoded"), check: bool = True) -> DataFrame:
    """Adds the named results of encoding each text with an end id and decoding it again."""
    model = model_bytes(path)
    kept = [c for c in docs.columns if c not in added]
    source = docs.schema[text].name
    fields = [f for f in docs.schema.fields if f.name in kept]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, check)
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(source), TOGETHER):
                rows = batch.slice(lo, hi - lo)
                made = _round(codec, rows.column(source), added)
                codec.verify()
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), *(made[a] for a in added)], names=[*carried, *added])

    carried = list(kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{a} {_DDL[a]}" for a in added])
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that each row's ids decode to; null ids give a null text."""
    from pyspark.sql import functions as F

    model = model_bytes(path)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model, check=False)
        for column in columns:
            yield pa.array([None if v is None else codec.decode(v) for v in column.to_pylist()], pa.string())

    return df.withColumn(into, F.arrow_udf(run, "string")(F.col(ids)))


def op2(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"), path, added=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")

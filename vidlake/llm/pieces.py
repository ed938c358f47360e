"""Texts cut where tokens never cross, and what vocabularies make of the parts, in whole Arrow batches.

A byte-level vocabulary cuts a text by a pattern before it merges; a merge-type vocabulary of sentencepiece has no piece
across a space that follows something else, nor across a line feed. So a part is encoded on its own, by the library, once
for all places where a worker process meets it. All work is on UTF-8 bytes; characters' classes (letter, number, white, other) are
asked of the library for each code point that occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts remembered in a worker process; when full, the memory is emptied.
REMEMBERED = 500_000
#: Parts that are given to the library at once.
TOGETHER = 8192
LETTER, NUMBER, WHITE, OTHER, UNKNOWN = range(5)


class Classes:
    """Classes of code points as the library's own pattern has them."""

    def __init__(self, cut: Callable[[str], list]):
        self.cut = cut
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.of(np.arange(128))

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        for p in np.unique(points[found == UNKNOWN]).tolist():
            joined = (kind for head, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(self.cut(head + chr(p))) == 1)
            self.table[p] = next(joined, WHITE)
        return self.table[points]


def code_points(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points whose first bytes are at ``lead`` (none of them ASCII), and their numbers of bytes."""
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.choose(size - 2, (0x1F, 0x0F, 0x07))
    for k in (1, 2, 3):
        more = size > k
        point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
    return point, size


def pattern_cuts(data: np.ndarray, offs: np.ndarray, classes: Classes) -> np.ndarray:
    """First bytes of the parts of all texts: contractions, runs of letters, numbers or others with one space before them, white space."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = classes.table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        point, size = code_points(data, lead)
        found = classes.of(point)
        for k in range(4):
            kind[lead[size > k] + k] = found[size > k]
    white = kind == WHITE
    head = np.zeros(len(data), bool)
    head[offs[:-1][offs[:-1] < len(data)]] = True
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white character before something else stands alone, or before it if it is a space
    after = np.flatnonzero(start & ~white & ~head)
    after = after[white[after - 1]]
    last = after - 1
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last = last - inside
    start[last] = True
    start[after[data[last] == 0x20]] = False
    mark = np.flatnonzero(start & (data == 0x27))
    if len(mark):
        end = offs[np.searchsorted(offs, mark, "right")]
        padded = np.append(data, np.zeros(3, np.uint8))
        one = np.where(mark + 1 < end, padded[mark + 1], 0)
        two = np.where(mark + 2 < end, padded[mark + 2], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        cut, stop = np.concatenate([mark[short] + 2, mark[long] + 3]), np.concatenate([end[short], end[long]])
        start[cut[cut < stop]] = True
    return np.flatnonzero(start)


def space_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the parts of all texts: spaces with what follows them, and line feeds alone."""
    if not len(data):
        return np.zeros(0, np.int64)
    space, feed = data == 0x20, data == 0x0A
    start = feed.copy()
    start[offs[:-1][offs[:-1] < len(data)]] = True
    start[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    return np.flatnonzero(start)


class Rows:
    """A flat array that grows at its end."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Memory:
    """Ids, byte ends and soundness of parts, each encoded once by ``encode``: parts -> (numbers of ids, ids, ends, sound)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first, self.ids, self.ends, self.sound = Rows(np.int64), Rows(np.int32), Rows(np.int32), Rows(bool)
        self.first.add(np.zeros(1, np.int64))

    def slots(self, parts: list[bytes]) -> np.ndarray:
        if len(self.slot) + len(parts) > self.limit:
            self.clear()
        out = np.fromiter(map(self.slot.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [parts[i] for i in new.tolist()]
            n, ids, ends, sound = self.encode(fresh)
            out[new] = np.arange(len(fresh)) + self.sound.n
            self.slot.update(zip(fresh, out[new].tolist(), strict=True))
            self.first.add(np.cumsum(n) + self.ids.n)
            self.ids.add(ids)
            self.ends.add(ends)
            self.sound.add(sound)
        return out

    def tokens(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each part, all ids, all byte ends in ``data`` if they are kept, soundness of each part)."""
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(coded)
        slot = self.slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        first = self.first.values[slot]
        n = self.first.values[slot + 1] - first
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return n, self.ids.values[place], self.ends.values[place] + np.repeat(cuts, n) if self.ends.n else self.ends.values[:0], self.sound.values[slot]


@cache
def byte_level(path: str) -> tuple[object, Classes]:
    """The tokenizers library with the file's vocabulary; special tokens' strings in texts are plain text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library, Classes(library.pre_tokenizer.pre_tokenize_str)


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes as: visible ones as themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def byte_level_ids(path: str) -> Memory:
    """Ids of parts by the library's model alone: parts are cut and written in the vocabulary's characters for many at once, a line for each."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    library, _ = byte_level(path)
    lines = Tokenizer(library.model)
    lines.pre_tokenizer = Split("\n", "removed")  # a line feed is written otherwise
    written = np.zeros(256, np.uint32)
    for character, byte in byte_alphabet().items():
        written[byte] = ord(character)
    vocabulary = library.get_vocab()
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # in bytes, a character for each
    for token, i in vocabulary.items():
        lengths[i] = len(token)

    def together(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        points = written[np.frombuffer(b"\n".join(parts), np.uint8)]
        points[np.cumsum(size[:-1] + 1) - 1] = ord("\n")
        ids = np.array(lines.encode_batch_fast([points.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int32)
        total, ends = np.cumsum(lengths[ids]), np.cumsum(size)
        last = np.searchsorted(total, ends)
        if len(total) and total[-1] == ends[-1] and (total[last] == ends).all():
            return np.diff(last, prepend=-1), ids
        found = [e.ids for e in library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]  # the vocabulary lacks some byte
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int32)

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, ids = (np.concatenate(x) for x in zip(*(together(parts[k : k + TOGETHER]) for k in range(0, len(parts), TOGETHER)), strict=True))
        return n, ids, np.zeros(0, np.int32), np.ones(len(parts), bool)

    return Memory(encode)


def document_ids(data: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's start among them), as the tokenizers library encodes whole texts."""
    _, classes = byte_level(path)
    cuts = pattern_cuts(data, offs, classes)
    if not len(cuts):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    n, ids, _, _ = byte_level_ids(path).tokens(data, cuts)
    total = np.append(0, np.cumsum(n))
    return ids, total[np.searchsorted(cuts, offs)]

"""Slow, plain versions of the operators, and small tables to hold them against."""

from __future__ import annotations

import re

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def word_list(text: str | None) -> list[str]:
    return WORD.findall(lowered(text))


def shingle_set(text: str | None, n: int) -> set[tuple]:
    w = word_list(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def linked_components(rows: list[tuple], n: int, percent: int) -> dict:
    """Smallest reachable id of each document, by comparing every two."""
    sets: dict = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text, n))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("", "n", "rt", "sk", "la", "mo")]


def prose(seed: int, n: int) -> list[str]:
    """Words that look random and are the same each time."""
    out, x = [], seed * 2654435761 % (1 << 32)
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % (1 << 32)
        out.append(VOCABULARY[(x >> 16) % len(VOCABULARY)])
    return out


#: Texts that every operator must live with: null, empty, white space, one word, equal rows, odd letters, long.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "Word"), (6, "two words"), (7, "two words"), (7, "two words"), (8, "naïve Ünïcode İstanbul ﬁ 漢字 \U0001f600"),
    (9, " ".join(prose(5, 20_000))), (10, "x" * 100_000), (11, "a\x00b   c d"), (None, "no id here at all"),
]

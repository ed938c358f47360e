"""Line-first cleaning: rules on every line, then a verdict on what is left of the text.

Only built-in column functions are used. A null text has no words; a text of white space alone likewise.
An empty table gives an empty table. Extra columns pass through; the added ones replace columns of the
same name. Equal rows get equal results, each its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.binding import let

#: Fixed phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept all cookies",
    "back to top",
    "by continuing to browse",
    "click here to",
    "cookie policy",
    "enable javascript",
    "follow us on",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more »",
    "share this article",
    "sign in to your account",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
)
SYMBOLS = "#*$%&|<>"
#: A line may end without one of these only if it has MENU_WORDS words.
ENDINGS = "[.!?…:;,\"'”’»)\\]。！？]\\s*$"
MENU_WORDS = 4
LONG = f"^\\s*(?:\\S+\\s+){{{MENU_WORDS - 1}}}\\S"
WORDS = "[ \\t\\n\\u000B\\f\\r]+"
WINDOW = 8


def word_array(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORDS), "")


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_passes(line: Column, max_symbols: float, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """Punctuation: few symbols, and an ending unless the line is long. Navigation: no bar of short items. Boilerplate: no such phrase."""
    bars = F.length(line) - F.length(F.translate(line, "|»•", ""))
    marks = (symbol_count(line) <= F.length(line) * max_symbols) & ((bars < 3) | (F.size(word_array(line)) > bars * 6))
    boilerplate = F.lower(line).rlike(f"\\b(?:{'|'.join(phrases)})")
    return (~line.rlike(f"[{SYMBOLS}»•]") | marks) & (line.rlike(LONG) | line.rlike(ENDINGS)) & ~boilerplate


def paired(hashes: Column, apart: int, left: Column) -> Column:
    """A hash of each element and that so many places on; left: how many pairs there are."""
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(apart + 1), left), lambda a, b: F.xxhash64(a, b))


def ranked(windows: Column) -> Column:
    """The windows in order of hash, so that equal ones are neighbours."""
    return F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def repeated_words(windows: Column) -> Column:
    """How many words stand in windows that occur more than once."""
    def steps(rank: Column) -> Column:
        same = F.transform(rank, lambda s, k: F.when((s["x"] == F.get(rank, k - 1)["x"]) | (s["x"] == F.get(rank, k + 1)["x"]), s["i"]))
        return let(F.array_sort(F.array_compact(same)), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(ranked(w), steps)).otherwise(F.lit(0).cast("long")))


def word_windows(words: Column) -> Column:
    """A hash of each WINDOW words in a row, from hashes of 1, 2, 4 and 8 words."""
    left = F.size(words) - WINDOW + 1
    pairs = lambda h, apart: paired(h, apart, left + WINDOW - 2 * apart)
    eight = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(pairs(h, 1), lambda h2: let(pairs(h2, 2), lambda h4: pairs(h4, 4))))
    return F.when(left > 0, eight).otherwise(F.array().cast("array<bigint>"))


def line_clean(docs: DataFrame, text: str = "text", max_lost: float = 0.3, max_symbols: float = 0.1, min_words: int = 20, max_repeated: int = 30) -> DataFrame:
    """Adds clean_text (the lines that pass), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_failed_lines, lost_share, base_failed and kept.

    base_failed: under ``min_words`` words, or over ``max_repeated`` per cent of them inside repeated windows.
    kept: not base_failed, and failed lines hold at most ``max_lost`` of the lines' characters.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))

    def of_lines(lines: Column) -> Column:
        def verdicts(good: Column) -> Column:
            whole = F.size(good) == F.size(lines)
            return F.struct(
                F.when(~whole, F.array_join(good, "\n")).alias("clean_text"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(good)).cast("long").alias("n_failed_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.when(whole, F.lit(0.0)).otherwise(1.0 - chars(good) / chars(lines)).alias("lost_share"),
            )

        return let(F.filter(lines, lambda x: line_passes(x, max_symbols)), verdicts)

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]"))
    of_words = lambda words: F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(word_windows(words)).alias("n_repeat_words"))
    out = docs.withColumns({"__w": let(word_array(F.col(text)), of_words), "__l": let(lines, of_lines)})
    failed = (F.col("__w.n_words") < min_words) | (F.col("__w.n_repeat_words") * 100 > F.col("__w.n_words") * max_repeated)
    return out.withColumns({
        "clean_text": F.coalesce("__l.clean_text", F.col(text)),
        "n_words": F.col("__w.n_words"),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": symbol_count(body).cast("long"),
        "n_dup_lines": F.col("__l.n_dup_lines"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_lines": F.col("__l.n_lines"),
        "n_failed_lines": F.col("__l.n_failed_lines"),
        "lost_share": F.col("__l.lost_share"),
        "base_failed": failed,
        "kept": ~failed & (F.col("__l.lost_share") <= max_lost),
    }).drop("__w", "__l")


def op8(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines"]
    return line_clean(docs).select(*cols)


def op8_sql() -> str:
    phrases = "|".join(BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT *, list_filter(l, lambda x: length(x) - length(translate(x, '{SYMBOLS}', '')) <= length(x) * 0.1
        AND (regexp_matches(x, '^\s*(?:\S+\s+){{{MENU_WORDS - 1}}}\S') OR regexp_matches(x, '[.!?…:;,"''”’»)\]。！？]\s*$'))
        AND (length(x) - length(translate(x, '|»•', '')) < 3 OR len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 6 * (length(x) - length(translate(x, '|»•', ''))))
        AND NOT regexp_matches(lower(x), '\b(?:{phrases})')) AS good FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) - i) AS step FROM rep) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (len(l) - len(good))::BIGINT AS n_failed_lines,
        CASE WHEN len(l) = len(good) THEN 0.0 ELSE 1.0 - coalesce(list_sum(list_transform(good, lambda x: length(x))), 0)::DOUBLE / list_sum(list_transform(l, lambda x: length(x))) END AS lost
      FROM g LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.3 AS kept, n_lines, n_failed_lines FROM m
"""

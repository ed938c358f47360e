"""Labels, ids, readings, answers and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of answer normalisation.
ARTICLES = ("a", "an", "the")
DIGITS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}


def canonical_label(label: Column) -> Column:
    """Trimmed, lower case, with runs of spaces and underscores as one underscore."""
    return F.regexp_replace(F.lower(F.trim(label)), "[\\s_]+", "_")


def safe_slug(name: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def jersey_number(text: Column) -> Column:
    """One or two ASCII digits; 00 is one, other leading zeros are not. A string, as 0 and 00 differ."""
    return F.when(text.rlike("^(?:0|00|[1-9][0-9]?)$"), text)


def reading(text: Column, schema: str) -> Column:
    """The JSON object of a model's answer, in a fence or bare; null if it is none."""
    inner = F.regexp_extract(text, "(?s)^\\s*(?:```(?:json)?\\s*)?(\\{.*\\})\\s*(?:```)?\\s*$", 1)
    return F.from_json(F.when(inner != "", inner), schema)


def plain_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, small number words as digits, single spaces."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " ")), " ")
    table = F.create_map(*(F.lit(x) for pair in DIGITS.items() for x in pair))
    kept = F.filter(words, lambda w: ~w.isin(*ARTICLES) & (w != ""))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def query_words(text: Column, most: int = 20) -> Column:
    """Text of a retrieval query: lower case, no punctuation, its first words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[.!\"()*#:;~]", " "), "\\s+", " ")), " "), 1, most), " ")


def content_id(prefix: str, *parts: Column) -> Column:
    """An id from contents: parts joined by the unit separator, hashed."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 20))


def track_uid(clip: Column, track: Column) -> Column:
    return F.concat(clip.cast("string"), F.lit(":T"), F.lpad(track.cast("string"), 4, "0"))


def colour(key: Column) -> Column:
    """A fixed colour for a number, dark channels avoided."""
    part = lambda step, base: F.lpad(F.lower(F.hex((key * step + base) % 192 + 64)), 2, "0")
    return F.concat(F.lit("#"), part(37, 17), part(67, 71), part(97, 131))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def fused(scores: list[Column], weights: list[float]) -> Column:
    """Weighted sum of score arrays."""
    total = F.transform(scores[0], lambda s: s * weights[0])
    for other, w in zip(scores[1:], weights[1:], strict=True):
        total = F.zip_with(total, F.transform(other, _times(w)), lambda a, b: a + b)
    return total


def _times(w: float):
    return lambda b: b * w


def sampling_quality(sharp: Column, size: Column, det: Column, complete: Column, exposure: Column, stability: Column, overlapped: Column) -> Column:
    """Weighted image quality, less up to half for overlap with others."""
    return (0.30 * sharp + 0.25 * size + 0.15 * det + 0.15 * complete + 0.10 * exposure + 0.05 * stability) * (1 - 0.5 * overlapped)


def display_quality(quality: Column, distance: Column) -> Column:
    """How well a sample stands for its track: quality less a share of its distance from the prototype."""
    return quality - 0.35 * distance


def part_distance(a: Column, b: Column, va: Column, vb: Column, least: int = 2) -> Column:
    """Mean distance of parts visible in both, weighted by visibility and halved; null with under ``least`` such parts."""
    weight = F.zip_with(va, vb, lambda x, y: F.sqrt(x * y))
    apart = F.zip_with(a, b, lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    common = F.size(F.filter(weight, lambda w: w > 0))
    return F.when(common >= least, total(F.zip_with(weight, apart, lambda w, d: w * d)) / total(weight) / 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def reasons(*tests: tuple[Column, str]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))


def top_classes(scores: Column, k: int) -> Column:
    """The k best (score, class) of an array of scores, best first, the lower class on a tie."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("cost"), i.alias("class"))))
    return F.slice(F.transform(ranked, lambda r: F.struct((-r["cost"]).alias("score"), r["class"].alias("class"))), 1, k)


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers: Euclid's steps, at most 64 for each number."""
    def two(a: Column, b: Column) -> Column:
        first = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda p, i: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b"))), lambda p: p["a"])

    return F.aggregate(values, F.lit(0).cast("bigint"), two)


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    ranked = F.array_sort(values)
    n = F.size(values)
    return (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2

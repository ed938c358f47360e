"""How filters share out what they remove, in every order that they can be applied in.

A text fails A with under 50 words, B with under 65 different words in 100, C with over 5 capitals A-Z in 100 characters,
D with one of # $ % & * |, and E if it is the text of a smaller doc_id too. A and B are read off the document-term matrix:
sums and non-zero entries of its rows. Each document is one of 32 patterns of failures; all that is reported of any order
is a sum over counts of patterns, so documents are aggregated once and orders see a row for each part.

A null text is an empty one; a null source is the part ''. Rows of one id and text are equal: none of them has a smaller
id than the others. A null id is neither smaller nor larger than any. A document is good or toxic if any row of labels
says so. An empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.term_matrix import SHARD, document_term_matrix, row_totals
from vidlake.llm.text import byte_table
from vidlake.storage import saved

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
MARKS, CAPITALS = byte_table(b"#$%&*|"), byte_table(bytes(range(65, 91)))
CONTINUED = byte_table(bytes(range(0x80, 0xC0)))


def per_text(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in the table."""
    total = np.append(0, np.cumsum(table[data]))
    return total[offs[1:]] - total[offs[:-1]]


def capitals(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.array(100 * per_text(CAPITALS, data, offs) > MAX_CAPITALS * (np.diff(offs) - per_text(CONTINUED, data, offs)))


def marks(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.array(per_text(MARKS, data, offs) > 0)


def checksum(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    view, at = memoryview(np.ascontiguousarray(data)), offs.tolist()
    return pa.array([hashlib.sha256(view[a:b]).digest() for a, b in zip(at, at[1:])], pa.binary())


NOTES = [("__c", pa.bool_(), capitals), ("__d", pa.bool_(), marks), ("__sum", pa.binary(), checksum)]


def document_flags(docs: DataFrame, part: str, limit: int = SHARD) -> DataFrame:
    """(doc_id, part, text checksum, failures of A to D as bits) of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("__in"), "text")
    _, matrix = document_term_matrix(rows, notes=NOTES, limit=limit)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "__in", "__c", "__d", "__sum", "n_words", "n_distinct"]
    totals = row_totals(matrix, f"doc_id {kind}, __in string, __c boolean, __d boolean, __sum binary, n_words bigint, n_distinct bigint", names)
    failed = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), F.col("__c"), F.col("__d")]
    return totals.select("doc_id", "__in", "__sum", sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).alias("__bits"))


def patterns(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, pattern, documents, good, toxic): documents by what they fail.

    Equal texts have equal bits, so E is decided on counts: those of a text and id first, then the least id of a text over
    its parts and labels. No row of a document meets the others of its text.
    """
    truth = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("__good"), F.max(F.col("toxic") == 1).alias("__toxic"))
    marked = flags.join(truth, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("__good", "__toxic")})
    kinds = ["__sum", "__bits", "__in", "__good", "__toxic"]
    of_id = marked.groupBy(*kinds, "doc_id").agg(F.count("*").alias("__n"))
    of_text = of_id.groupBy(*kinds).agg(F.sum("__n").alias("__n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("__n")).otherwise(0)).alias("__free"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "__n"))).alias("__low"))
    of_text = saved(of_text)
    least = of_text.groupBy("__sum").agg(F.min("__low.doc_id").alias("__least"))
    joined = of_text.join(least, "__sum")
    first = F.col("__free") + F.when(F.col("__low.doc_id") == F.col("__least"), F.col("__low.__n")).otherwise(0)
    sides = joined.select("__in", "__good", "__toxic", F.explode(F.array(F.struct(F.col("__bits").alias("bits"), first.alias("n")), F.struct((F.col("__bits") + 16).alias("bits"), (F.col("__n") - first).alias("n")))).alias("__side"))
    n = F.col("__side.n")
    return sides.groupBy(F.col("__in"), F.col("__side.bits").alias("pattern")).agg(F.sum(n).alias("documents"), F.sum(F.when(F.col("__good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("__toxic"), n).otherwise(0)).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of those before) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, 1 << f, before))
            before |= 1 << f
    return out


def report(found: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    full = (1 << len(FILTERS)) - 1
    cell = lambda name: F.array(*(F.coalesce(F.sum(F.when(F.col("pattern") == p, F.col(name))), F.lit(0)) for p in range(full + 1)))
    parts = found.groupBy(F.col("__in").alias("part")).agg(*(cell(c).alias(f"__{c}") for c in ("documents", "good", "toxic")))
    steps = F.array(*(F.struct(F.lit(o).alias("order"), F.lit(s).alias("step"), F.lit(b).alias("own"), F.lit(p).alias("before")) for o, s, b, p in orders()))
    rows = parts.select("*", F.explode(steps).alias("__at"))
    own, before = F.col("__at.own"), F.col("__at.before")

    def total(of: str, weight) -> Column:
        terms = F.transform(F.col(f"__{of}"), lambda n, p: n * weight(p.cast("int")))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))

    has = lambda p, bits: p.bitwiseAND(bits) != 0
    here = lambda p: F.when(has(p, own) & ~has(p, before), 1).otherwise(0)
    turns = 1
    for k in range(2, len(FILTERS) + 1):
        turns *= k
    # of all orders, those in which the filter comes before the others that the pattern fails
    share = lambda p: F.when(has(p, own), (F.lit(turns) / F.greatest(F.bit_count(p), F.lit(1))).cast("int")).otherwise(0)
    return rows.select(
        "part", F.col("__at.order").alias("filter_order"), F.col("__at.step").alias("step"),
        total("documents", lambda p: F.when(has(p, own.bitwiseOR(before)), 0).otherwise(1)).alias("kept"),
        total("documents", here).alias("removed"),
        total("documents", lambda p: F.when(has(p, own) & has(p, before), 1).otherwise(0)).alias("redundant"),
        total("documents", lambda p: F.when(p == own, 1).otherwise(0)).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("documents", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", limit: int = SHARD) -> DataFrame:
    return report(patterns(document_flags(docs, part, limit), labels))


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


def op11_sql() -> str:
    # bits of the filters stand in the order of their letters; a pattern's share of an order goes to the first filter that it fails
    return r"""WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce("text", '') AS t, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
truth AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS pattern, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM words JOIN firsts USING (t) LEFT JOIN truth USING (doc_id)),
cells AS (SELECT part, pattern, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS before FROM orders, range(1, 6) AS r(step)),
placed AS (SELECT part, filter_order, step, f, n, good, toxic, pattern, contains(pattern, f) AS fails, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(pattern, x))) > 0 AS gone FROM cells, steps),
by_order AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN pattern = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM placed GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM by_order"""

"""URL filters: allow and block rules, and logistic regression on hashed character n-grams where no rule fits.

A null URL, or one without ``://``, has an empty host and path: no rule fits, and the model judges the empty
string. Equal rows get equal verdicts; an empty table gives an empty table; added columns replace those of
the same name, others pass through. URLs are judged whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query: what they say, and host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Words of hosts and paths of pages that are wanted, and of those that are not; written for this library.
WANTED = "library museum university school science history garden recipes weather city parks health physics courses articles guide docs wiki news journal forum music books travel maps research archive council nature poetry chemistry astronomy biology geography economics law theatre cinema cooking knitting hiking sailing railway bridges painting sculpture grammar dictionary lessons".split()
UNWANTED = "casino slots poker roulette jackpot betting viagra cialis pills pharmacy-discount porn xxx adult sex escort cams nude replica rolex cheap-watches loan payday fast-cash win-prize giveaway free-bitcoin crypto-double torrent warez crack keygen serial hack-tool backlinks seo-links clickbait miracle-diet lose-weight weight-loss hot-girls dating-now lottery free-spins bonus-code vip-bets cheap-meds forex-robot get-rich spam-blast".split()
ENDS = ("org", "com", "net", "info", "biz", "co", "site", "online", "top", "eu")


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """A small labelled table: two urls for each word, on hosts under all ends; 1 is to be blocked."""
    made = []
    for label, words_ in ((0, WANTED), (1, UNWANTED)):
        for i, word in enumerate(words_):
            other, third = words_[(i * 7 + 3) % len(words_)], words_[(i * 11 + 5) % len(words_)]
            made.append((f"https://www.{word}-{other}.example.{ENDS[i % len(ENDS)]}/{third}/{i}", label))
            made.append((f"http://{third}.sample{i % 9}.{ENDS[(i * 3 + label) % len(ENDS)]}/{'en' if i % 2 else 'de'}/{word}/{other}.html?page={i}", label))
    return tuple(made)


LABELLED = labelled_urls()
BUCKETS = 1 << 14


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), letters, letters.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits the host or a parent of it, and how the path starts."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def buckets(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams (3 to 5 bytes) of the host and, apart from them, of the path."""
    out = []
    for mark, part in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        data = part.encode("utf-8", "surrogatepass")
        out += [zlib.crc32(mark + data[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(data) - n + 1)]
    return np.array(out, np.int64)


def split_url(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def fit(labelled: tuple[tuple[str, int], ...], epochs: int = 200, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of logistic regression on mean-scaled n-gram counts, by gradient descent over the small table."""
    rows = [buckets(*split_url(url)) for url, _ in labelled]
    x = np.zeros((len(rows), BUCKETS))
    for r, ids in zip(x, rows, strict=True):
        np.add.at(r, ids, 1 / np.sqrt(max(len(ids), 1)))
    y, w, b = np.array([label for _, label in labelled], float), np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    return w, b


def url_filter(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_probability and verdict; a rule's verdict stands before the model's."""
    weights, bias = fit(labelled)
    weights = weights.astype(np.float32)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [buckets(h, p) for h, p in zip(part["host"], part["path"], strict=True)]
            yield pd.Series([float(1 / (1 + np.exp(-(weights[i].sum() / np.sqrt(max(len(i), 1)) + bias)))) for i in rows], dtype="float64")

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("block_probability", F.pandas_udf(score, "double")(F.struct("host", "path")))
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", F.when(F.col("block_probability") >= threshold, "block").otherwise("allow"))}).drop("__rule")


def op5(pages: DataFrame) -> DataFrame:
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))

"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Byte n-grams of the whole text are hashed to embedding rows; their mean goes through one linear layer. The
model is trained by stochastic gradient descent in numpy on a bounded sample of labelled texts: PER_LANG for
each language, those with the smallest hashes of their ids. Every fifth of a language is kept back to calibrate
the score; with none kept back every prediction counts as rejected. A null text, or one without a letter, is
``und`` with score 0 and rejected; so is every text if there is nothing to learn from. Equal texts get equal
results; an empty table gives an empty one; other columns pass through, whatever their names, but for those named
like an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.text import chunks, lower_table

BUCKETS, DIM, ORDERS = 1 << 14, 16, (3, 4)
PER_LANG, WINDOW = 250, 400


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each byte on."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    low = lower_table()[data].astype(np.uint32)
    key = np.full(len(data) - n + 1, n, np.uint32)
    for i in range(n):
        key = key * np.uint32(0x01000193) ^ low[i : len(data) - n + 1 + i]
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (key >> np.uint32(32 - 14)).astype(np.int64)


def features(texts: list[np.ndarray]) -> np.ndarray:
    """Share of each bucket among a text's n-grams, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, data in zip(out, texts, strict=True):
        ids = np.concatenate([grams(data, n) for n in ORDERS])
        row += np.bincount(ids, minlength=BUCKETS) / max(len(ids), 1)
    return out


class Model:
    """logits = mean embedding @ layer; the two are kept as their product, a row of logits for each bucket."""

    def __init__(self, langs: list[str], logits: np.ndarray, heat: float, least: float):
        self.langs, self.logits, self.heat, self.least = langs, logits, heat, least


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 8.0, batch: int = 64, seed: int = 7) -> Model | None:
    """Every fifth sampled text of a language is kept back to set the softmax's temperature and the score under which a prediction is rejected."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    back, pieces, labels, met = [], [], [], dict.fromkeys(langs, 0)
    for text, lang in rows:
        met[lang] += 1
        if met[lang] % 5 == 0:
            back.append((text, lang))
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        cut = [data[k : k + WINDOW] for k in range(0, max(len(data), 1), WINDOW)]
        pieces += cut
        labels += [langs.index(lang)] * len(cut)
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = random.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    truth = np.array(labels)
    weight = 1 / np.maximum(np.bincount(truth, minlength=len(langs)), 1)
    weight = weight / (weight[truth].mean() or 1)
    for epoch in range(epochs):
        order = random.permutation(len(pieces))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            x = features([pieces[i] for i in ids])
            hidden = x @ table
            p = softmax(hidden @ layer)
            p[np.arange(len(ids)), truth[ids]] -= 1
            p *= (weight[truth[ids]] / len(ids))[:, None].astype(np.float32)
            down = p @ layer.T
            layer -= 0.1 * step * (hidden.T @ p)
            table -= 10 * step * (x.T @ down)
    logits = (table @ layer).astype(np.float32)
    if not back:
        return Model(langs, logits, 1.0, np.inf)
    raw = np.concatenate([features([np.frombuffer(t.encode(), np.uint8)]) @ logits for t, _ in back])
    right = np.array([langs.index(lang) for _, lang in back])
    heats = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
    heat = min(heats, key=lambda h: float(-np.log(softmax(raw / h)[np.arange(len(right)), right] + 1e-12).mean()))
    return Model(langs, logits, heat, rejection(softmax(raw / heat), right))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def rejection(p: np.ndarray, truth: np.ndarray, wanted: float = 0.99) -> float:
    """The smallest score over which predictions were right as often as wanted."""
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= wanted)
    return float(best[order][good[-1]]) if len(good) else 1.0


def score_texts(data: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Probabilities of every language for each text, whole."""
    n = len(offs) - 1
    total, count = np.zeros((n, len(model.langs))), np.zeros(n)
    for order in ORDERS:
        ids = grams(data, order)
        first = np.minimum(offs[:-1], len(ids))
        last = np.clip(offs[1:] - order + 1, first, len(ids))
        count += last - first
        for k in range(len(model.langs)):
            run = np.concatenate([[0.0], np.cumsum(model.logits[:, k][ids], dtype=np.float64)])
            total[:, k] += run[last] - run[first]
    return softmax(total / np.maximum(count, 1)[:, None] / model.heat)


def sampled(docs: DataFrame, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """PER_LANG labelled rows of each language."""
    known = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter("_text is not null and _lang is not null")
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.select("_id", "_lang").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= PER_LANG).select("_id").distinct()
    rows = known.join(F.broadcast(chosen), "_id", "left_semi")  # PER_LANG ids for each language at most
    return [(r[1], r[2]) for r in sorted(rows.collect(), key=lambda r: (str(r[0]), r[1], r[2]))]


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Adds lang_pred, score and rejected; ``learn`` tells which rows may be learnt from."""
    model = train(sampled(docs.filter(learn), text, lang, key))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    if model is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            best, score = [], []
            for _, _, data, offs in chunks(column):
                p = score_texts(data, offs, model)
                best.append(p.argmax(axis=1))
                score.append(p.max(axis=1))
            at = np.concatenate(best) if best else np.zeros(0, int)
            yield pa.StructArray.from_arrays([pa.array([model.langs[i] for i in at], pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], ["lang", "score"])

    own = {c: f"_kept{i}" for i, c in enumerate(kept)}
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), letters.alias("_letters"), F.arrow_udf(predict, "struct<lang string, score double>")(F.col(text)).alias("_p"))
    said, score = F.when(F.col("_letters"), F.col("_p.lang")).otherwise("und"), F.when(F.col("_letters"), F.round("_p.score", 6)).otherwise(0.0)
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), said.alias("lang_pred"), score.alias("score"), (~F.col("_letters") | (F.col("_p.score") < model.least)).alias("rejected"))


def op10(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify(docs.select("doc_id", "text", "lang"), ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

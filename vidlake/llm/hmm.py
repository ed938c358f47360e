"""Hidden Markov language model: Baum-Welch counts summed across partitions, then exact likelihoods by scaled forward recursion.

A token's class is the word itself for the HEAD most frequent training words, one of BUCKETS hash buckets for
the rest, and one class for the end of a text. States emit classes; within a bucket a word has its add-one
share, so the model gives every word, known or not, a probability. Training reads every training token once a
round, and expected counts of whole texts are summed over all partitions. Texts over RUN tokens are worked through in
runs side by side: each run becomes the product of its transition and emission matrices, scaled, and the products are
applied in order, forward and backward, which are the recursions themselves; nothing is cut.

Words are told apart by 64-bit hashes of their bytes. A null text is an empty one and has the end token alone.
Without training rows every count is zero. Equal rows each get their result; an empty table gives an empty one. Other
columns pass through under their names, whatever these are; those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.text import chunks, words
from vidlake.storage import saved

HEAD, BUCKETS, STATES, RUN, ROUNDS = 60_000, 1_024, 8, 1_024, 4
#: Tokens handled at once.
TOKENS = 200_000


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(h, c): how often each word occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            for _, _, data, offs in chunks(batch.column(0)):
                held.append(words(data, offs)[0])
            h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select(text).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Lexicon:
    """Bounded part of the training counts: the HEAD most frequent words, and what each bucket holds of the others."""

    def __init__(self, counts: DataFrame, n_texts: int):
        head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toPandas()
        order = np.argsort(head["h"].to_numpy(np.int64).view(np.uint64))
        self.hashes = head["h"].to_numpy(np.int64).view(np.uint64)[order]
        self.counts = head["c"].to_numpy(np.int64)[order]
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n = int(total[0]) + n_texts
        self.v = int(total[1]) + (n_texts > 0)
        least = tuple(head[["c", "h"]].iloc[-1]) if len(head) == HEAD else (0, 0)
        rest = counts.filter((F.col("c") < int(least[0])) | ((F.col("c") == int(least[0])) & (F.col("h") > int(least[1]))))
        by = rest.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("c"), F.count("*")).collect()
        self.bucket_total = np.zeros(BUCKETS, np.int64)
        for b, c, d in by:
            self.bucket_total[b] = c + d
        self.n_texts = n_texts
        self.end = len(self.hashes) + BUCKETS
        #: For each class, log10 of what a word's count plus one is divided by within it.
        self.share = np.concatenate([np.log10(self.counts + 1.0), np.log10(self.bucket_total + 1.0), [np.log10(n_texts + 1.0)]])

    def unigram(self) -> np.ndarray:
        """Add-one share of each class."""
        p = np.concatenate([self.counts + 1.0, self.bucket_total + 1.0, [self.n_texts + 1.0]])
        return p / p.sum()

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and whether it is one of the frequent words."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        head = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return np.where(head, at, len(self.hashes) + (h & np.uint64(BUCKETS - 1)).astype(np.int64)), head


class Model:
    """Initial, transition and emission probabilities; emission has a row for each class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_model(lexicon: Lexicon, states: int = STATES, seed: int = 5) -> Model:
    """Sticky states that emit the classes' shares, each shaken by itself so that training can tell them apart."""
    shake = np.random.default_rng(seed).gamma(1.0, 1.0, (len(lexicon.share), states)) + 0.05
    emit = lexicon.unigram()[:, None] * shake
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Runs:
    """Runs of at most RUN tokens that cover all but the first token of each text; long ones first.

    text, rank: whose they are and which of its; first, size: token and length; live: how many runs are longer than t.
    """

    def __init__(self, lengths: np.ndarray):
        self.base = np.cumsum(lengths) - lengths
        n = -(-(lengths - 1) // RUN)
        text = np.repeat(np.arange(len(lengths)), n)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(RUN, lengths[text] - 1 - rank * RUN)
        order = np.argsort(-size, kind="stable")
        self.text, self.rank, self.size, self.n = text[order], rank[order], size[order], n
        self.first = self.base[self.text] + 1 + self.rank * RUN
        self.steps = int(size.max(initial=0))
        self.live = np.searchsorted(-self.size, -np.arange(self.steps), "left").tolist()
        # by rank, the runs of texts with several
        later = np.flatnonzero(n[self.text] > 1)
        self.by_rank = [later[self.rank[later] == r] for r in range(int(n.max(initial=0)))] if len(later) else []
        self.at = np.full((len(lengths), max(len(self.by_rank), 1)), -1, np.int64)
        self.at[self.text[later], self.rank[later]] = later


def products(seq: np.ndarray, first: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Product of the scaled transition and emission matrices over each run, and the logs of the scales; long runs first."""
    k = len(model.start)
    product, logs = np.tile(np.eye(k), (len(first), 1, 1)), np.zeros(len(first))
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        product[:n] = (product[:n].reshape(n * k, k) @ model.move).reshape(n, k, k) * model.emit[seq[first[:n] + t]][:, None, :]
        if t % 8 == 7:
            total = product[:n].sum(axis=(1, 2))
            product[:n] /= total[:, None, None]
            logs[:n] += np.log(total)
    return product, logs


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=1, keepdims=True)


def expected(seq: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and, for each token, states, over whole texts; all runs take each step together."""
    k, runs = len(model.start), Runs(lengths)
    begun = _scaled(model.start * model.emit[seq[runs.base]])
    # vectors that come into each run from both sides
    before, after = begun[runs.text], np.ones((len(runs.text), k))
    several = np.flatnonzero(runs.n[runs.text] > 1)
    if len(several):
        product = np.zeros((len(runs.text), k, k))
        product[several] = products(seq, runs.first[several], runs.size[several], model)[0]
        for r in range(1, len(runs.by_rank)):
            now = runs.by_rank[r]
            last = runs.at[runs.text[now], r - 1]
            before[now] = _scaled(np.einsum("dk,dkj->dj", before[last], product[last]))
        for r in range(len(runs.by_rank) - 1, 0, -1):
            now = runs.by_rank[r]
            after[runs.at[runs.text[now], r - 1]] = _scaled(np.einsum("dkj,dj->dk", product[now], after[now]))
    # tokens of one step stand in a row, so that a step reads and writes one stretch
    live = np.array(runs.live, np.int64)
    at = np.append(0, np.cumsum(live))
    token = runs.first[np.arange(at[-1]) - np.repeat(at[:-1], live)] + np.repeat(np.arange(runs.steps), live)
    b = model.emit[seq[token]]
    ahead, scales = np.empty((len(token), k)), {}
    alpha, at = before, at.tolist()
    for t, n in enumerate(runs.live):
        now = ahead[at[t] : at[t + 1]]
        np.matmul(alpha[:n], model.move, out=now)
        now *= b[at[t] : at[t + 1]]
        if t % 8 == 7:  # a row's scale cancels out below
            scales[t] = now.sum(axis=1)
            now /= scales[t][:, None]
        alpha = now
    moves, back, one = np.zeros((k, k)), after, np.ones(k)
    for t in range(runs.steps - 1, -1, -1):
        n = runs.live[t]
        now, weighted = ahead[at[t] : at[t + 1]], b[at[t] : at[t + 1]]
        weighted *= back[:n]
        # what comes in, moved and weighted, is the state before it is scaled; b keeps states from here on, as ahead is read once more
        held = now * back[:n]
        total = (held @ one)[:, None]
        held /= total
        np.matmul(weighted, model.move.T, out=back[:n])
        weighted /= total if t not in scales else total * scales[t][:, None]
        moves += (ahead[at[t - 1] : at[t - 1] + n] if t else before[:n]).T @ weighted
        weighted[:] = held
        if t % 8 == 0:
            back[:n] /= back[:n].sum(axis=1, keepdims=True)
    state = np.empty((len(seq), k))
    state[token] = b
    state[runs.base] = begun
    heads = np.flatnonzero(runs.rank == 0)
    first = runs.base[runs.text[heads]]
    state[first] *= back[heads]
    state[first] /= state[first].sum(axis=1, keepdims=True)
    return state[runs.base].sum(axis=0), moves * model.move, state


def log_likelihoods(seq: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Natural log-probability of each text's classes. Every text has a token."""
    runs = Runs(lengths)
    vector = model.start * model.emit[seq[runs.base]]
    out = np.log(vector.sum(axis=1))
    vector = _scaled(vector)
    # first runs step by step, later ones as products
    heads = np.flatnonzero(runs.rank == 0)
    size, first, text = runs.size[heads], runs.first[heads], runs.text[heads]
    alpha, logs = vector[text], np.zeros(len(heads))
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        alpha[:n] = (alpha[:n] @ model.move) * model.emit[seq[first[:n] + t]]
        if t % 8 == 7:
            total = alpha[:n].sum(axis=1)
            alpha[:n] /= total[:, None]
            logs[:n] += np.log(total)
    total = alpha.sum(axis=1)
    vector[text] = alpha / total[:, None]
    out[text] += logs + np.log(total)
    later = np.flatnonzero(runs.rank > 0)
    if len(later):
        product, logs = products(seq, runs.first[later], runs.size[later], model)
        place = np.full(len(runs.text), -1)
        place[later] = np.arange(len(later))
        for r in range(1, len(runs.by_rank)):
            now = runs.by_rank[r]
            d, p = runs.text[now], place[now]
            v = np.einsum("dk,dkj->dj", vector[d], product[p])
            total = v.sum(axis=1)
            vector[d] = v / total[:, None]
            out[d] += np.log(total) + logs[p]
    return out


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, classes, lengths) of runs of rows of about TOKENS tokens."""
    for batch in batches:
        values = batch.column(column).to_pylist()
        size = np.array([len(v) // 2 for v in values], np.int64)
        lo, total = 0, np.cumsum(size)
        while lo < len(values):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TOKENS, "right")))
            yield batch, lo, hi, np.frombuffer(b"".join(values[lo:hi]), np.uint16), size[lo:hi]
            lo = hi


def round_of(train: DataFrame, model: Model, lexicon: Lexicon, prior: float = 20.0) -> Model:
    """One Baum-Welch round: each partition sums its expected counts, a row for each class it has met; sums over partitions give the next model."""
    k, n_classes = len(model.start), len(lexicon.share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((n_classes, k))
        for _, _, _, seq, lengths in gathered(batches, "seq"):
            s, m, state = expected(seq, lengths, model)
            start += s
            moves += m
            order = np.argsort(seq, kind="stable")  # equal classes side by side
            held = seq[order]
            cut = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            emitted[held[cut]] += np.add.reduceat(state[order], cut, axis=0)
        met = np.flatnonzero(emitted.sum(axis=1))
        keys = np.concatenate([met, -1 - np.arange(k), [-1 - k]]).astype(np.int32)
        rows = np.concatenate([emitted[met], moves, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, j].copy()) for j in range(k))], ["cls", *(f"g{j}" for j in range(k))])

    summed = train.select("seq").mapInArrow(run, "cls int, " + ", ".join(f"g{j} double" for j in range(k)))
    got = summed.groupBy("cls").agg(*(F.sum(f"g{j}").alias(f"g{j}") for j in range(k))).toPandas()
    keys, rows = got["cls"].to_numpy(), got[[f"g{j}" for j in range(k)]].to_numpy()
    start, moves, emit = np.ones(k), np.full((k, k), 0.1) + np.eye(k), lexicon.unigram()[:, None] * prior * np.ones(k)
    emit[keys[keys >= 0]] += rows[keys >= 0]
    for key, row in zip(keys[keys < 0], rows[keys < 0], strict=True):
        if key == -1 - k:
            start += row
        else:
            moves[-1 - key] += row
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def score_texts(docs: DataFrame, learn: Column, text: str = "text", rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score; ``learn`` tells which rows are learnt from."""
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    own = {c: f"_kept{i}" for i, c in enumerate(kept)}  # names of the rows' own columns are no concern of what follows
    marked = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col(text).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.monotonically_increasing_id().alias("_row"))
    lessons = marked.filter("_learn")
    counts = saved(count_words(lessons, "_text"))
    lexicon = Lexicon(counts, lessons.count())
    codes = saved(_with_codes(marked, list(own.values()), "_text", lexicon))
    model = first_model(lexicon, states)
    for _ in range(rounds if lexicon.n else 0):
        model = round_of(codes.filter("_learn"), model, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = -lexicon.share
        inside[: len(lexicon.hashes)] = 0.0
        inside[-1] = 0.0
        for batch, lo, hi, seq, lengths in gathered(batches, "seq"):
            log10 = log_likelihoods(seq, lengths, model) / np.log(10)
            ends = np.cumsum(lengths)
            share = np.array([inside[seq[a:b]].sum() for a, b in zip(ends - lengths, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(lo, hi - lo), pa.array(log10 + share)], ["_row", "_score"])

    scored = codes.select("_row", "seq").mapInArrow(run, "_row bigint, _score double")
    rest = codes.select("_row", F.explode("rest").alias("h")).join(counts, "h", "left")
    rest = rest.groupBy("_row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_rest"), F.count("c").alias("_seen"))
    out = codes.drop("rest", "seq").join(scored, "_row").join(rest, "_row", "left")
    more = F.coalesce("_rest", F.lit(0.0))
    whole = float(np.log10(lexicon.n + lexicon.v + 1))
    seen_end = 1 if lexicon.n_texts else 0
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), "n_tokens", (F.col("n_head") + F.coalesce("_seen", F.lit(0)) + seen_end).alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"),
                      (F.col("base") + more - F.col("n_tokens") * whole).alias("base_score"), (F.col("_score") + more).alias("score"))


def _with_codes(marked: DataFrame, kept: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """Codes beside the columns that are kept, in one pass over the texts."""
    fields = [f for f in marked.schema.fields if f.name in kept]
    names = [f.name for f in fields]
    made = ["n_tokens", "n_head", "base", "rest", "seq"]
    inner = _coder(text, lexicon, ["_row", "_learn", *names], made)
    schema = ", ".join(["_row bigint", "_learn boolean", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens bigint, n_head bigint, base double, rest array<bigint>, seq binary"])
    return marked.select("_row", "_learn", *names, text).mapInArrow(inner, schema)


def _coder(text: str, lexicon: Lexicon, carried: list[str], made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_head = np.log10(lexicon.counts + 1.0)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(text)):
                h, at, _, _ = words(data, offs)
                cls, head = lexicon.classes(h)
                seq = np.insert(cls, at[1:], lexicon.end).astype(np.uint16)
                value = np.where(head, log_head[np.minimum(cls, len(log_head) - 1)], 0.0) if len(log_head) else np.zeros(len(h))
                pairs = list(zip(at[:-1], at[1:], strict=True))
                rest_at = np.concatenate([[0], np.cumsum(~head)])[at]
                ends = np.arange(len(at), dtype=np.int64) + at
                columns = [
                    pa.array(np.diff(at) + 1), pa.array(np.array([head[a:b].sum() for a, b in pairs], np.int64)),
                    pa.array(np.array([value[a:b].sum() for a, b in pairs]) + np.log10(lexicon.n_texts + 1.0)),
                    pa.ListArray.from_arrays(pa.array(rest_at.astype(np.int32)), pa.array(h[~head].view(np.int64))),
                    pa.array([seq[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in carried), *columns], [*carried, *made])

    return run


def op1(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = score_texts(docs.select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))

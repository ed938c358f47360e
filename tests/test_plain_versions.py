"""Operators whose queries have no SQL, against plain versions of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vidlake.functions import values as v
from vidlake.operators import evaluation as evl
from vidlake.operators import identity as ident
from vidlake.operators import tracks as tr

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"


@pytest.mark.parametrize("seed", range(3))
def test_number_consensus(spark, seed):
    draw = random.Random(seed)
    rows = [(t, draw.choice(["7", "7", "7", "9", None]) if t % 2 else draw.choice(["5", None]), draw.randint(0, 20) / 4) for t in range(8) for _ in range(draw.randint(0, 5))]
    got = {r.track: r for r in ident.number_consensus(spark.createDataFrame(rows, "track int, number string, timestamp_s double"), "track").collect()}
    assert set(got) == {t for t, _, _ in rows}
    for t, r in got.items():
        numbers, support = {n for k, n, _ in rows if k == t and n}, 0
        for n in numbers:
            kept: list[float] = []
            for at in sorted({s for k, m, s in rows if k == t and m == n}):
                if not kept or at - kept[-1] >= 0.5:
                    kept.append(at)
            support = max(support, len(kept))
        status = "unreadable" if not numbers else "conflict" if len(numbers) > 1 else "consensus" if support >= 2 else "partial"
        assert (r.status, r.support, r.n_numbers, r.number) == (status, support, len(numbers), numbers.pop() if status == "consensus" else None)


@pytest.mark.parametrize("seed", range(3))
def test_suppressed_duplicates(spark, seed):
    draw = random.Random(seed)
    boxes = [(1, f, t, (float(x), 0.0, x + 10.0, 10.0), draw.choice([0.5, 0.9])) for f in range(4) for t in range(6) for x in [draw.choice([0, 1, 2, 30])]]
    facts = {t: (draw.choice(["accepted", "tentative"]), draw.choice([10, 20])) for t in range(6)}
    table = spark.createDataFrame(boxes, f"video_id bigint, frame_idx bigint, track_id bigint, box {BOX}, det_score double")
    status = spark.createDataFrame([(1, t, *x) for t, x in facts.items()], "video_id bigint, track_id bigint, status string, observations bigint")
    got = {(r.frame_idx, r.track_id): (r.duplicate_of, r.duplicate_iou) for r in tr.suppress_duplicates(table, status, 0.7).collect()}
    overlap = lambda a, b: max(0.0, 10 - abs(a - b)) / (10 + min(10.0, abs(a - b)))
    for f in range(4):
        own, kept = sorted((b for b in boxes if b[1] == f), key=lambda b: (facts[b[2]][0] != "accepted", -facts[b[2]][1], -b[4], b[2])), []
        for b in own:
            near = [(overlap(b[3][0], k[3][0]), k[2]) for k in kept if overlap(b[3][0], k[3][0]) >= 0.7]
            best = max(near, key=lambda x: x[0]) if near else (None, None)
            assert got[f, b[2]][0] == best[1] and got[f, b[2]][1] == (pytest.approx(best[0]) if near else None)
            if not near:
                kept.append(b)


@pytest.mark.parametrize("seed", range(3))
def test_spaced_best(spark, seed):
    draw = random.Random(seed)
    rows = [(g, draw.randint(0, 40) / 4, draw.random(), k) for g in range(3) for k in range(15)]
    got: dict = {}
    for r in tr.spaced_best(spark.createDataFrame(rows, "g int, at double, quality double, k int"), ["g"], "at", "quality", 1.5, 4).collect():
        got.setdefault(r.g, set()).add(r.k)
    for g in range(3):
        chosen: list = []
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(chosen) < 4 and all(abs(row[1] - c[1]) >= 1.5 for c in chosen):
                chosen.append(row)
        assert got[g] == {c[3] for c in chosen}


def test_kinds_of_error(spark):
    preds = spark.createDataFrame([(1, p) for p in range(7)], "video_id int, pred int")
    overlaps = spark.createDataFrame([(1, 1, True, True, True, 0.9), (1, 2, True, False, True, 0.9), (1, 2, False, True, True, 0.9), (1, 3, False, True, True, 0.9), (1, 4, True, True, False, 0.1), (1, 5, False, False, True, 0.9)],
                                     "video_id int, pred int, same_label boolean, same_actor boolean, enough boolean, tiou double")
    got = evl.error_kinds(preds, spark.createDataFrame([(1, 0)], "video_id int, pred int"), overlaps).collect()
    assert {r.pred: r.kind for r in got} == {1: "duplicate", 2: "wrong_actor", 3: "wrong_class", 4: "wrong_interval", 5: "false_positive", 6: "false_positive"}


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_have_as_many_pairs_as_can_be(spark, seed):
    from itertools import permutations

    draw = random.Random(seed)
    edges = [(r, "s", t, p, draw.random()) for r in range(3) for t in range(4) for p in range(4) if draw.random() < 0.4]
    got = evl.match_boundaries(spark.createDataFrame(edges, "range int, stage string, truth int, pred int, distance double")).collect()
    for r in range(3):
        mine = [(x.truth, x.pred) for x in got if x.range == r]
        near = {(t, p) for k, _, t, p, _ in edges if k == r}
        assert set(mine) <= near and len({t for t, _ in mine}) == len({p for _, p in mine}) == len(mine)
        assert len(mine) == max(sum((t, p) in near for t, p in enumerate(order)) for order in permutations(range(4)))


def test_plain_answers_and_queries(spark):
    texts = ["The Cat!", "two  dogs, a cat", "An (odd) #answer; it's", "", None, "none of ten"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(v.plain_answer(F.col("t")).alias("a"), v.query_words(F.col("t"), 3).alias("q")).collect()
    for t, r in zip(texts, got, strict=True):
        if t is None:
            assert r.a is None
            continue
        words = [w for w in re.sub(r"[^\w\s]|_", " ", t.lower()).split() if w not in v.ARTICLES]
        assert r.a == " ".join(v.DIGITS.get(w, w) for w in words)
        assert r.q == " ".join(re.sub(r'[.!"()*#:;~]', " ", t.lower()).split()[:3])

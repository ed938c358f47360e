"""Evaluation of events, classes, retrieval, detection and grounding results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators.assignment import most_pairs
from vidlake.operators.curves import envelope, running


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp, fn; null where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": v.ratio(tp, tp + fp), "recall": v.ratio(tp, tp + fn), "f1": v.ratio(2 * tp, 2 * tp + fp + fn)})


def binary_counts(rows: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))


def micro(per_video: DataFrame) -> DataFrame:
    """All videos together: counts are summed before the ratios are taken."""
    return prf(per_video.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of all pairs of labels met on either side, and shares of the true, the predicted and of all rows (0 for none)."""
    # labels are the classes of a task, few by nature
    labels = rows.select(F.col(truth).alias("label")).union(rows.select(F.col(predicted).alias("label"))).distinct()
    grid = labels.select(F.col("label").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    n = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    out = grid.join(n, ["truth", "predicted"], "left").na.fill(0, ["n"])
    share = lambda *w: F.coalesce(v.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*w))), F.lit(0.0))
    return out.withColumns({"of_true": share("truth"), "of_predicted": share("predicted"), "of_all": share(F.lit(1))})


def mean_class_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    by = rows.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("_a"))
    return by.agg(F.avg("_a").alias("mean_class_accuracy"))


def top_k_accuracy(rows: DataFrame, scores: str, truth: str, ks: list[int]) -> DataFrame:
    """Share of rows whose class is among the k best scores; the lower class first on ties."""
    best = F.transform(v.top_classes(F.col(scores), max(ks)), lambda t: t["class"])
    return rows.withColumn("_b", best).agg(*(F.avg(F.array_contains(F.slice("_b", 1, k), F.col(truth)).cast("double")).alias(f"top{k}") for k in ks))


def class_ranks(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Classes from the most to the least accurate, the smaller label first on ties."""
    by = rows.groupBy(F.col(truth).alias("label")).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return by.withColumns({"best_rank": F.row_number().over(Window.orderBy(F.desc("accuracy"), "label")), "worst_rank": F.row_number().over(Window.orderBy("accuracy", "label"))})


def _points(rows: DataFrame, by: list[str], score: str, hit: str) -> DataFrame:
    points = rows.groupBy(*by, score).agg(F.sum(F.col(hit).cast("long")).alias("_tp"), F.count("*").alias("_n"))
    whole = rows.groupBy(*by).agg(F.sum(F.col(hit).cast("long")).alias("_all"))
    out = running(points, by, [F.desc(score)], {"tp": F.col("_tp"), "n": F.col("_n")}).join(whole, by)
    return out.withColumns({"precision": v.ratio(F.col("tp"), F.col("n")), "recall": v.ratio(F.col("tp"), F.col("_all")), "_gain": v.ratio(F.col("_tp"), F.col("_all"))})


def pr_curve(rows: DataFrame, by: list[str], score: str, hit: str) -> DataFrame:
    """A point for each distinct score, ties taken together: cumulative tp and fp, precision and recall."""
    return _points(rows, by, score, hit).select(*by, score, "tp", (F.col("n") - F.col("tp")).alias("fp"), "precision", "recall")


def average_precision(rows: DataFrame, by: list[str], score: str, hit: str) -> DataFrame:
    """Sum of precision times the gain in recall over the curve, no envelope."""
    return _points(rows, by, score, hit).groupBy(*by).agg(F.sum(F.col("_gain") * F.col("precision")).alias("ap"))


def envelope_ap(ranked: DataFrame, by: list[str], order: list[Column], hit: str, n_truth: str) -> DataFrame:
    """Area under the running maximum, from the right, of precision over recall; one point a prediction. Recall grows by one truth at each hit."""
    at = running(ranked, by, order, {"_tp": F.col(hit).cast("long"), "_n": F.lit(1)})
    at = envelope(at, by, {"_e": F.col("_tp") / F.col("_n")})
    return at.groupBy(*by).agg(F.sum(F.when(F.col(hit), v.ratio(F.col("_e"), F.col(n_truth))).when(F.col(n_truth) > 0, 0.0)).alias("ap"))


def argmax_hits(pairs: DataFrame, predictions: DataFrame, keys: list[str], pred: str, truth: str, similarity: str, score: str, least: float) -> DataFrame:
    """Predictions with hit: their most similar truth is similar enough, and no better-scored prediction has it already."""
    best = pairs.groupBy(*keys, pred).agg(F.max_by(F.struct(truth, similarity), F.struct(F.col(similarity), -F.col(truth))).alias("_b"))
    near = best.filter(F.col(f"_b.{similarity}") >= least).select(*keys, pred, F.col(f"_b.{truth}").alias("_t"))
    first = near.join(predictions.select(*keys, pred, score), [*keys, pred]).groupBy(*keys, "_t").agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(pred))).alias("_f"))
    hits = first.select(*keys, F.col(f"_f.{pred}").alias(pred), F.lit(True).alias("hit"))
    return predictions.join(hits, [*keys, pred], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall_at_proposals(best_ranks: DataFrame, n_truth: Column, fractions: list[float], total: Column) -> DataFrame:
    """Recall for each share of the ranked proposals; best_ranks: truth and rank of its first good proposal (null if none)."""
    cut = F.explode(F.array(*map(F.lit, fractions)))
    at = best_ranks.withColumn("fraction", cut)
    return at.groupBy("fraction").agg((F.count_if(F.col("rank") <= F.floor(F.col("fraction") * total)) / F.first(n_truth)).alias("recall"))


def average_recall(proposals: DataFrame, truth: DataFrame, thresholds: list[float], most: float | None = None, steps: int = 100) -> DataFrame:
    """(step, per_video, threshold, recall): recall when each video's best proposals are taken, ``step`` hundredths of what makes ``most`` of them a video (all, without ``most``).

    A truth is found from the step on at which its first proposal with enough overlap is taken, so each truth is one row for
    each threshold, whatever the number of steps. proposals: video, prop, start, end, score; truth: video, truth, start, end.
    """
    w = Window.partitionBy("video").orderBy(F.desc("score"), "prop")
    ranked = proposals.withColumns({"rank": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("video"))}).select("video", F.col("start").alias("_s"), F.col("end").alias("_e"), "rank", "n")
    total = proposals.agg(F.count("*").alias("proposals"))
    whole = truth.agg(F.count("*").alias("truths"), F.count_distinct("video").alias("videos")).crossJoin(total)  # single rows
    share = F.col("videos") * (most if most is not None else F.col("proposals") / F.col("videos")) / F.col("proposals")
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    near = truth.join(ranked, "video").withColumn("tiou", g.tiou(F.col("_s"), F.col("_e"), F.col("start"), F.col("end"))).filter(F.col("tiou") >= min(thresholds))
    first = near.select("video", "truth", "rank", "n", "tiou", levels).filter("tiou >= threshold").groupBy("video", "truth", "n", "threshold").agg(F.min("rank").alias("rank"))
    found = first.crossJoin(whole).select("threshold", F.ceil(F.col("rank") * steps / (F.col("n") * share) - 1e-9).cast("int").alias("step")).groupBy("threshold", "step").agg(F.count("*").alias("_n"))
    grid = whole.select("truths", (share * F.col("proposals") / F.col("videos")).alias("_most"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select("*", levels)
    upto = Window.partitionBy("threshold").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = grid.join(found, ["threshold", "step"], "left").withColumn("_n", F.sum(F.coalesce("_n", F.lit(0))).over(upto))
    return at.select("step", (F.col("step") / steps * F.col("_most")).alias("per_video"), "threshold", (F.col("_n") / F.col("truths")).alias("recall"))


def recall_area(curve: DataFrame) -> DataFrame:
    """(auc): area under the mean recall over the proposals a video, in hundredths of the widest."""
    mean = curve.groupBy("per_video").agg(F.avg("recall").alias("recall"))
    return trapezoid(mean, "per_video", "recall").crossJoin(mean.agg(F.max("per_video").alias("_m"))).select((100 * F.col("auc") / F.col("_m")).alias("auc"))  # single rows


def trapezoid(points: DataFrame, x: str, y: str) -> DataFrame:
    """Area under a curve of few points."""
    w = Window.orderBy(x)
    return points.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).agg(F.sum("_a").alias("auc"))


def retrieval(scores: DataFrame, query: str, item: str, score: str, right: str) -> DataFrame:
    """Recall at 1, 5, 10, median and mean rank; the rank of the right item is one more than the items with a better score."""
    own = scores.filter(F.col(item) == F.col(right)).select(query, F.col(score).alias("_own"))
    rank = scores.join(own, query).groupBy(query).agg((F.count_if(F.col(score) > F.col("_own")) + 1).alias("_k"))
    return rank_summary(rank, "_k")


def rank_summary(ranks: DataFrame, rank: str) -> DataFrame:
    """Share of queries ranked 1, up to 5 and up to 10, median and mean rank."""
    return ranks.agg(*(F.avg((F.col(rank) <= k).cast("double")).alias(f"r{k}") for k in (1, 5, 10)), F.median(rank).alias("median_rank"), F.avg(rank).alias("mean_rank"))


def pair_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pairs of rows of one true identity that one predicted identity joins, from group sizes alone; a row without prediction is joined to none."""
    two = lambda c: c * (c - 1) / 2
    cells = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    tp = F.sum(F.when(F.col(predicted).isNotNull(), two(F.col("n")))).alias("tp")
    true = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("_t"))
    said = cells.filter(F.col(predicted).isNotNull()).groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("_p"))
    out = cells.agg(tp).crossJoin(true).crossJoin(said)  # single rows
    whole = lambda c: F.coalesce(c, F.lit(0.0)).cast("long")
    return prf(out.select(whole(F.col("tp")).alias("tp"), whole(F.col("_p") - F.coalesce("tp", F.lit(0.0))).alias("fp"), whole(F.col("_t") - F.coalesce("tp", F.lit(0.0))).alias("fn")))


def grounding_recall(rows: DataFrame, proposals: str, start: str, end: str, ks: list[int], thetas: list[float]) -> DataFrame:
    """Share of queries with one of their first k proposals over the threshold, strictly."""
    def good(k: int, t: float) -> Column:
        return F.exists(F.slice(proposals, 1, k), lambda p: g.grounding_iou(p["start"], p["end"], F.col(start), F.col(end)) > t)

    return rows.agg(*(F.avg(good(k, t).cast("double")).alias(f"r{k}_at_{round(t * 100)}") for k in ks for t in thetas))


def label_recall(rows: DataFrame, ranked: str, labels: str, ks: list[int]) -> DataFrame:
    """Share of rows with one of their labels among the first k."""
    return rows.agg(*(F.avg(F.arrays_overlap(F.slice(ranked, 1, k), F.col(labels)).cast("double")).alias(f"recall{k}") for k in ks))


def answer_accuracy(rows: DataFrame, predicted: str, answers: str) -> DataFrame:
    """Each answer counts a third of how many people gave it, one at most."""
    p = v.plain_answer(F.col(predicted))
    hits = F.size(F.filter(answers, lambda a: v.plain_answer(a) == p))
    return rows.agg(F.avg(F.least(F.lit(1.0), hits / 3)).alias("accuracy"))


def match_events(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Matching with the most pairs of predictions and references in each video and label.

    edges: video_id, event, pred, ref, tiou; seeds: video_id, event, pred, raw_score. Predictions go by score, their references by overlap.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.drop_duplicates("pred").sort_values(["raw_score", "pred"], ascending=[False, True])
        near = {p: r.sort_values(["tiou", "ref"], ascending=[False, True])["ref"].tolist() for p, r in rows.groupby("pred")}
        pairs = most_pairs(own["pred"].tolist(), near)
        return pd.DataFrame({"video_id": rows["video_id"].iloc[0], "event": rows["event"].iloc[0], "pred": list(pairs), "ref": list(pairs.values())})

    kinds = dict(edges.dtypes)
    rows = edges.join(seeds, ["video_id", "event", "pred"])
    return rows.groupBy("video_id", "event").applyInPandas(run, f"video_id {kinds['video_id']}, event string, pred {kinds['pred']}, ref {kinds['ref']}")


def error_kinds(predictions: DataFrame, matched: DataFrame, overlaps: DataFrame) -> DataFrame:
    """What each unmatched prediction is, in this order: duplicate (its label and actor at a threshold overlap), wrong_actor, wrong_class, wrong_interval, false_positive.

    overlaps: video_id, pred, same_label, same_actor, enough (the overlap reaches the threshold), tiou.
    """
    o = overlaps.groupBy("video_id", "pred").agg(
        F.bool_or(F.col("same_label") & F.col("same_actor") & F.col("enough")).alias("_dup"), F.bool_or(F.col("same_label") & ~F.col("same_actor") & F.col("enough")).alias("_actor"),
        F.bool_or(~F.col("same_label") & F.col("same_actor") & F.col("enough")).alias("_class"), F.bool_or(F.col("same_label") & F.col("same_actor") & (F.col("tiou") > 0)).alias("_span"))
    rest = predictions.join(matched.select("video_id", "pred"), ["video_id", "pred"], "left_anti").join(o, ["video_id", "pred"], "left")
    kind = F.when(F.col("_dup"), "duplicate").when(F.col("_actor"), "wrong_actor").when(F.col("_class"), "wrong_class").when(F.col("_span"), "wrong_interval").otherwise("false_positive")
    return rest.withColumn("kind", kind).drop("_dup", "_actor", "_class", "_span")


def match_boundaries(edges: DataFrame) -> DataFrame:
    """Matching with the most pairs of boundaries and proposals in each range and stage, nearest middles first. edges: range, stage, truth, pred, distance."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (range_, stage), one in rows.groupby(["range", "stage"], sort=False):
            near: dict = {}
            for t, p in zip(*(one.sort_values(["distance", "pred"])[c].tolist() for c in ("truth", "pred")), strict=True):
                near.setdefault(t, []).append(p)
            out += [(range_, stage, t, p) for t, p in most_pairs(sorted(near), near).items()]
        return pd.DataFrame(out, columns=["range", "stage", "truth", "pred"])

    k = dict(edges.dtypes)
    # many small ranges share a group of the grouped map
    parts = edges.withColumn("_part", F.pmod(F.xxhash64("range", "stage"), F.lit(256)))
    return parts.groupBy("_part").applyInPandas(run, f"range {k['range']}, stage {k['stage']}, truth {k['truth']}, pred {k['pred']}")

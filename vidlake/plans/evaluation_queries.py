"""Queries that evaluate: classes, curves, average precision, events, proposals, retrieval, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators import detection as det
from vidlake.operators import evaluation as evl
from vidlake.operators import events as ev
from vidlake.plans import views as vw

R = lambda c, n=6: F.round(c, n)
TRUE, SAID = lambda: F.col("quality") == 1, lambda: F.col("predicted") == 1


def prf(spark: SparkSession, d: str) -> DataFrame:
    c = evl.prf(evl.binary_counts(vw.classified(spark, d), TRUE(), SAID(), ["source"]))
    return c.select("source", "tp", "fp", "fn", *(R(F.col(x)).alias(x) for x in ("precision", "recall", "f1")))


PRF = "count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality <> 1 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted <> 1) AS fn"
RATIOS = "round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1"


def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    by = evl.binary_counts(vw.classified(spark, d), TRUE(), SAID(), ["source"])
    macro = evl.prf(by).agg(F.avg("f1").alias("macro_f1"))
    return evl.micro(by).crossJoin(macro).select("tp", "fp", "fn", R(F.col("f1")).alias("micro_f1"), R(F.col("macro_f1")).alias("macro_f1"))  # single rows


def confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = vw.classified(spark, d).select(F.concat("lang", F.col("quality").cast("string")).alias("truth"), F.concat("lang", F.col("predicted").cast("string")).alias("predicted"))
    return evl.confusion(rows, "truth", "predicted").select("truth", "predicted", "n", *(R(F.col(c)).alias(c) for c in ("of_true", "of_predicted", "of_all")))


CONFUSION = f"""WITH {vw.CLASSIFIED}, r AS (SELECT lang || quality::VARCHAR AS t, lang || predicted::VARCHAR AS p FROM classified), l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
 c AS (SELECT a.label AS truth, b.label AS predicted, (SELECT count(*) FROM r WHERE r.t = a.label AND r.p = b.label) AS n FROM l a CROSS JOIN l b)
 SELECT truth, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0)::DOUBLE, 0), 6) AS of_true, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY predicted), 0)::DOUBLE, 0), 6) AS of_predicted, round(coalesce(n / nullif(sum(n) OVER (), 0)::DOUBLE, 0), 6) AS of_all FROM c"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Four class scores made from the key, and the true class."""
    c = vw.classified(spark, d)
    s = F.array(*((F.col("doc_id") * k % 101 / 100.0) for k in (3, 7, 11, 13)))
    return c.select("doc_id", s.alias("scores"), (F.col("doc_id") % 4).cast("int").alias("class"))


def top_k(spark: SparkSession, d: str) -> DataFrame:
    out = evl.top_k_accuracy(scored(spark, d), "scores", "class", [1, 2, 3])
    return out.select(*(R(F.col(f"top{k}")).alias(f"top{k}") for k in (1, 2, 3)))


SCORED = f"""{vw.CLASSIFIED}, s AS (SELECT doc_id, doc_id % 4 AS class, unnest([0, 1, 2, 3]) AS k, unnest([doc_id * 3 % 101 / 100.0::DOUBLE, doc_id * 7 % 101 / 100.0::DOUBLE, doc_id * 11 % 101 / 100.0::DOUBLE, doc_id * 13 % 101 / 100.0::DOUBLE]) AS score FROM classified),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS n FROM s)"""


def fusion(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    mixed = v.fused([v.softmax(F.col("scores")), F.transform("scores", lambda x: x / 2)], [1.0, 0.5])
    best = v.top_classes(mixed, 1)[0]
    return s.select("doc_id", best["class"].cast("bigint").alias("best"), R(best["score"]).alias("score"))


def class_ranks(spark: SparkSession, d: str) -> DataFrame:
    r = vw.classified(spark, d).select(F.col("lang").alias("truth"), F.when(F.col("predicted") == 1, F.col("lang")).otherwise("none").alias("predicted"))
    return evl.class_ranks(r, "truth", "predicted").select("label", R(F.col("accuracy")).alias("accuracy"), F.col("best_rank").cast("bigint").alias("best_rank"), F.col("worst_rank").cast("bigint").alias("worst_rank"))


def mean_class(spark: SparkSession, d: str) -> DataFrame:
    return evl.mean_class_accuracy(vw.classified(spark, d), "quality", "predicted").select(R(F.col("mean_class_accuracy")).alias("mean_class_accuracy"))


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    c = vw.classified(spark, d).withColumn("hit", TRUE())
    return evl.pr_curve(c, ["lang"], "score", "hit").select("lang", "score", "tp", "fp", R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"))


CURVE = f"""{vw.CLASSIFIED}, p AS (SELECT lang, score, sum(quality)::BIGINT AS t, count(*) AS n FROM classified GROUP BY 1, 2),
 c AS (SELECT lang, score, (sum(t) OVER w)::BIGINT AS tp, (sum(n) OVER w - sum(t) OVER w)::BIGINT AS fp, sum(t) OVER (PARTITION BY lang) AS total FROM p WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 q AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / nullif(total, 0)::DOUBLE AS re FROM c)"""


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evl.average_precision(vw.classified(spark, d).withColumn("hit", TRUE()), ["lang"], "score", "hit").select("lang", R(F.col("ap")).alias("ap"))


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth spans and scored predictions of the same label and actor."""
    i = vw.intervals(spark, d)
    return i.filter("side = 'O'"), i.filter("side = 'F'")


def argmax_ap(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by label: a prediction's most overlapping truth of its actor counts, once."""
    truth, said = _spans(spark, d)
    cols = ["label", "actor", "interval_id", "start", "end"]
    pairs = ev.overlapping(said.select(*cols), truth.select(*cols), ["label", "actor"], 8.0, 0.0).select("label", F.col("a_interval_id").alias("pred"), F.col("b_interval_id").alias("truth"), "tiou")
    hits = evl.argmax_hits(pairs, said.select("label", F.col("interval_id").alias("pred"), "score"), ["label"], "pred", "truth", "tiou", "score", 0.3)
    n = truth.groupBy("label").agg(F.count("*").alias("n_truth"))
    return evl.envelope_ap(hits.join(n, "label"), ["label"], [F.desc("score"), F.col("pred")], "hit", "n_truth").select("label", R(F.col("ap")).alias("ap"))


SPAN_PAIRS = f"""{vw.INTERVALS}, t AS (SELECT * FROM intervals WHERE side = 'O'), p AS (SELECT * FROM intervals WHERE side = 'F'),
 e AS (SELECT p.label, p.actor, p.interval_id AS pred, t.interval_id AS truth, p.score, (least(p."end", t."end") - greatest(p."start", t."start")) / (greatest(p."end", t."end") - least(p."start", t."start")) AS iou FROM p JOIN t ON p.label = t.label AND p.actor = t.actor AND p."start" < t."end" AND t."start" < p."end")"""
ARGMAX_AP = f"""WITH {SPAN_PAIRS}, b AS (SELECT label, pred, truth, iou FROM e QUALIFY row_number() OVER (PARTITION BY pred ORDER BY iou DESC, truth) = 1),
 h AS (SELECT p.label, p.interval_id AS pred, p.score, CASE WHEN b.iou >= 0.3 THEN b.truth END AS tr FROM p LEFT JOIN b ON b.pred = p.interval_id),
 k AS (SELECT label, pred, score, tr IS NOT NULL AND row_number() OVER (PARTITION BY label, tr ORDER BY score DESC, pred) = 1 AS hit FROM h),
 n AS (SELECT label, count(*) AS n FROM t GROUP BY 1),
 c AS (SELECT k.label, k.score, k.pred, sum(hit::INT) OVER w AS tp, row_number() OVER w AS r, n.n FROM k JOIN n USING (label) WINDOW w AS (PARTITION BY k.label ORDER BY k.score DESC, k.pred)),
 q AS (SELECT *, max(tp / r::DOUBLE) OVER (PARTITION BY label ORDER BY score DESC, pred ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, tp / n::DOUBLE - coalesce(lag(tp) OVER (PARTITION BY label ORDER BY score DESC, pred) / n::DOUBLE, 0) AS gain FROM c)
 SELECT label, round(sum(gain * env), 6) AS ap FROM q GROUP BY 1"""


def greedy_ap(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by label at several overlaps, predictions trying the next best truth."""
    truth, said = _spans(spark, d)
    cols = ["label", "actor", "interval_id", "start", "end"]
    pairs = ev.overlapping(said.select(*cols), truth.select(*cols), ["label", "actor"], 8.0, 0.0).select("label", "actor", F.col("a_interval_id").alias("pred"), F.col("b_interval_id").alias("truth"), "tiou")
    out = det.localisation_map(pairs, said.select("label", "actor", F.col("interval_id").alias("pred"), "score"), truth.select("label", F.col("interval_id").alias("truth")), [0.3, 0.5])
    return out.select("label", "threshold", R(F.col("ap")).alias("ap"))


def ar_at_an(spark: SparkSession, d: str) -> DataFrame:
    """Recall of truths over growing shares of an actor's proposals, at one overlap."""
    truth, said = _spans(spark, d)
    cols = ["actor", "interval_id", "start", "end"]
    ranked = said.withColumn("rank", F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("score"), "interval_id")))
    pairs = ev.overlapping(said.select(*cols), truth.select(*cols), ["actor"], 8.0, 0.3).select(F.col("a_interval_id").alias("interval_id"), F.col("b_interval_id").alias("truth"))
    first = pairs.join(ranked.select("interval_id", "rank"), "interval_id").groupBy("truth").agg(F.min("rank").alias("rank"))
    every = truth.select(F.col("interval_id").alias("truth")).join(first, "truth", "left")
    n = truth.agg(F.count("*").alias("n_truth"))
    rows = every.crossJoin(F.broadcast(n))  # a single row
    out = evl.recall_at_proposals(rows, F.col("n_truth"), [0.1, 0.25, 0.5, 1.0], F.lit(20))
    return out.select("fraction", R(F.col("recall")).alias("recall"))


def event_match(spark: SparkSession, d: str) -> DataFrame:
    truth, said = _spans(spark, d)
    cols = ["label", "actor", "interval_id", "start", "end"]
    e = ev.overlapping(said.select(*cols), truth.select(*cols), ["label", "actor"], 8.0, 0.2)
    edges = e.select((F.col("actor") % 16).alias("video_id"), F.col("label").alias("event"), F.col("a_interval_id").alias("pred"), F.col("b_interval_id").alias("ref"), "tiou")
    seeds = said.select((F.col("actor") % 16).alias("video_id"), F.col("label").alias("event"), F.col("interval_id").alias("pred"), F.col("score").alias("raw_score"))
    return evl.match_events(edges, seeds)


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each unmatched prediction is; predictions and truths of one group of actors are compared."""
    truth, said = _spans(spark, d)
    matched = event_match(spark, d)
    cols = ["video_id", "label", "actor", "interval_id", "start", "end"]
    grouped = lambda t: t.withColumn("video_id", F.col("actor") % 16).select(*cols)
    o = ev.overlapping(grouped(said), grouped(truth), ["video_id"], 8.0, 0.0)
    o = o.select("video_id", F.col("a_interval_id").alias("pred"), (F.col("a_label") == F.col("b_label")).alias("same_label"), (F.col("a_actor") == F.col("b_actor")).alias("same_actor"), (F.col("tiou") >= 0.2).alias("enough"), "tiou")
    preds = said.select((F.col("actor") % 16).alias("video_id"), F.col("interval_id").alias("pred"))
    return evl.error_kinds(preds, matched, o).groupBy("kind").agg(F.count("*").alias("n"))


def boundary_match(spark: SparkSession, d: str) -> DataFrame:
    r = vw.intervals(spark, d)
    p = r.filter("side = 'F'").select(F.col("label").alias("stage"), F.col("actor").alias("range"), F.col("interval_id").alias("pred"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    t = r.filter("side = 'O'").select(F.col("label").alias("stage"), F.col("actor").alias("range"), F.col("interval_id").alias("truth"), F.col("start").alias("at"))
    met = ev.near_ranges(t, p, ["stage", "range"], 2.0, 10.0).withColumn("distance", F.abs(F.col("at") - (F.col("lo") + F.col("hi")) / 2))
    return evl.match_boundaries(met.select("range", "stage", "truth", "pred", "distance"))


def average_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over the number of proposals, at ten overlaps; actors are videos."""
    truth, said = _spans(spark, d)
    p = said.select(F.col("actor").alias("video"), F.col("interval_id").alias("prop"), "start", "end", "score")
    t = truth.select(F.col("actor").alias("video"), F.col("interval_id").alias("truth"), "start", "end")
    curve = evl.average_recall(p, t, [round(0.05 * k, 2) for k in range(1, 11)])
    return curve.select("step", R(F.col("per_video")).alias("per_video"), "threshold", R(F.col("recall")).alias("recall"))


AVERAGE_RECALL = f"""WITH {vw.INTERVALS}, t AS (SELECT * FROM intervals WHERE side = 'O'), p AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY score DESC, interval_id) AS rank, count(*) OVER (PARTITION BY actor) AS n FROM intervals WHERE side = 'F'),
 x AS (SELECT unnest([{", ".join(str(round(0.05 * k, 2)) for k in range(1, 11))}])::DOUBLE AS threshold), f AS (SELECT t.interval_id, p.n, threshold, min(p.rank) AS rank FROM t JOIN p ON p.actor = t.actor CROSS JOIN x
   WHERE greatest(0, least(p."end", t."end") - greatest(p."start", t."start")) / (greatest(p."end", t."end") - least(p."start", t."start")) >= threshold GROUP BY 1, 2, 3),
 k AS (SELECT unnest(range(1, 101))::INT AS step), w AS (SELECT (SELECT count(*) FROM t) AS truths, (SELECT count(DISTINCT actor) FROM t) AS videos, (SELECT count(*) FROM p) AS proposals)
 SELECT step, round(step / 100.0::DOUBLE * proposals / videos, 6) AS per_video, x.threshold, round((SELECT count(*) FROM f WHERE f.threshold = x.threshold AND floor(f.n * k.step / 100.0::DOUBLE + 1e-9) >= f.rank) / truths::DOUBLE, 6) AS recall FROM k CROSS JOIN x CROSS JOIN w"""


def temporal_pairs(spark: SparkSession, d: str) -> DataFrame:
    truth, said = _spans(spark, d)
    p = said.select("actor", F.col("interval_id").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1")).join(truth.select("actor", F.col("interval_id").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2")), "actor")
    c = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    return p.select("a", "b", R(g.tiou(*c)).alias("tiou"), R(g.tiop(*c)).alias("tiop"), R(g.grounding_iou(*c)).alias("grounding"), R(g.span_to_xw(*c)["dx"]).alias("dx"), R(g.span_to_xw(*c)["dw"]).alias("dw"), R(g.span_to_se(*c)["ds"]).alias("ds"))


COSINES = """c AS (SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score, q.label = e.label AS same
 FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)"""


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose id is divisible by 20, against all, in blocks."""
    from vidlake.operators.identity import nearest_by_cosine

    e = vw.features(spark, d)
    n = nearest_by_cosine(e, e.filter("vec_id % 20 = 0"), "vec_id", "vec_id", "embedding", 5)
    return n.select("query", "item", F.col("rank").cast("bigint").alias("rank"))


def retrieval(spark: SparkSession, d: str) -> DataFrame:
    """A query's right item is the smallest id of its label, its own aside."""
    from vidlake.operators.identity import rank_by_cosine

    e = vw.features(spark, d)
    two = e.groupBy("label").agg(F.min("vec_id").alias("_one")).join(e, "label").groupBy("label", "_one").agg(F.min(F.when(F.col("vec_id") > F.col("_one"), F.col("vec_id"))).alias("_two"))
    q = e.filter("vec_id % 20 = 0").join(two, "label").withColumn("right", F.when(F.col("vec_id") == F.col("_one"), F.col("_two")).otherwise(F.col("_one")))
    rank = rank_by_cosine(e, q.filter("right is not null"), "vec_id", "embedding", "right")
    return evl.rank_summary(rank, "rank").select(*(R(F.col(c)).alias(c) for c in ("r1", "r5", "r10", "median_rank", "mean_rank")))


def pair_f1(spark: SparkSession, d: str) -> DataFrame:
    e = vw.features(spark, d).select("label", F.when(F.col("vec_id") % 11 > 0, F.col("label") * 2 + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)).alias("person"))
    return evl.pair_f1(e, "label", "person").select("tp", "fp", "fn", R(F.col("f1")).alias("f1"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    c = vw.table(spark, d, "conversations")
    return c.select("conv_id", "turn", v.plain_answer(F.col("text")).alias("plain"), v.query_words(F.col("text"), 8).alias("query")).groupBy(F.length("plain").alias("length")).agg(F.count("*").alias("n"), F.count_distinct("query").alias("queries"))


def vqa(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a user's turn, taken together, to the last of them."""
    e = vw.table(spark, d, "events").groupBy("user_id", F.col("event_id") % 16).agg(F.collect_list("event_type").alias("answers"), F.max_by("event_type", "event_id").alias("said"))
    return evl.answer_accuracy(e, "said", "answers").select(R(F.col("accuracy")).alias("accuracy"))


def grounding(spark: SparkSession, d: str) -> DataFrame:
    truth, said = _spans(spark, d)
    p = said.groupBy("actor").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_c"), "start", "end"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("proposals"))
    t = truth.groupBy("actor").agg(F.min(F.struct("start", "end")).alias("_t")).select("actor", F.col("_t.start").alias("start"), F.col("_t.end").alias("end"))
    return evl.grounding_recall(t.join(p, "actor"), "proposals", "start", "end", [1, 5], [0.1, 0.3]).select(*(R(F.col(c)).alias(c) for c in ("r1_at_10", "r1_at_30", "r5_at_10", "r5_at_30")))


def label_recall(spark: SparkSession, d: str) -> DataFrame:
    o = vw.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("labels"), F.array("o_custkey").alias("_k"))
    ranked = F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT"), F.lit("5-LOW"))
    return evl.label_recall(o.withColumn("ranked", ranked), "ranked", "labels", [1, 2, 3]).select(*(R(F.col(f"recall{k}")).alias(f"recall{k}") for k in (1, 2, 3)))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    from vidlake.operators.identity import cosine_quantiles

    e = vw.features(spark, d)
    found = cosine_quantiles(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "label", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return found.select("query", *(R(F.col(c)).alias(c) for c in ("mean", "p10", "median", "p90", "most")))


def corloc(spark: SparkSession, d: str) -> DataFrame:
    """Share of actors whose surest span overlaps one of their truths."""
    truth, said = _spans(spark, d)
    best = said.groupBy("actor").agg(F.max_by(F.struct("start", "end"), F.struct("score", -F.col("interval_id"))).alias("_b"))
    t = best.join(truth.select("actor", F.col("start").alias("s"), F.col("end").alias("e")), "actor").groupBy("actor").agg(F.max(g.tiou(F.col("_b.start"), F.col("_b.end"), F.col("s"), F.col("e")) >= 0.1).alias("hit"))
    return t.agg(F.count("*").alias("n"), R(F.avg(F.col("hit").cast("double"))).alias("corloc"))


QUERIES = {
    "precision_recall_f1": (prf, f"WITH {vw.CLASSIFIED}, c AS (SELECT source, {PRF} FROM classified GROUP BY 1) SELECT source, tp, fp, fn, {RATIOS} FROM c"),
    "micro_vs_macro": (micro_macro, f"WITH {vw.CLASSIFIED}, c AS (SELECT source, {PRF} FROM classified GROUP BY 1) SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE, 6) AS micro_f1, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS macro_f1 FROM c"),
    "confusion_matrix": (confusion, CONFUSION),
    "topk_accuracy": (top_k, f"WITH {SCORED} SELECT " + ", ".join(f"round(count(DISTINCT CASE WHEN n <= {k} AND k = class THEN doc_id END) / count(DISTINCT doc_id)::DOUBLE, 6) AS top{k}" for k in (1, 2, 3)) + " FROM r"),
    "score_fusion": (fusion, f"WITH {SCORED}, m AS (SELECT doc_id, max(score) AS m, sum(exp(score)) AS z FROM s GROUP BY 1), f AS (SELECT s.doc_id, k, exp(score) / z + 0.25 * score AS f FROM s JOIN m USING (doc_id)) SELECT doc_id, k::BIGINT AS best, round(f, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(f, 12) DESC, k) = 1"),
    "class_ranks": (class_ranks, f"WITH {vw.CLASSIFIED}, a AS (SELECT lang AS label, avg(predicted::DOUBLE) AS acc FROM classified GROUP BY 1) SELECT label, round(acc, 6) AS accuracy, row_number() OVER (ORDER BY acc DESC, label) AS best_rank, row_number() OVER (ORDER BY acc, label) AS worst_rank FROM a"),
    "mean_class_accuracy": (mean_class, f"WITH {vw.CLASSIFIED} SELECT round(avg(a), 6) AS mean_class_accuracy FROM (SELECT quality, avg((quality = predicted)::INT::DOUBLE) AS a FROM classified GROUP BY 1)"),
    "pr_curve": (pr_curve, f"WITH {CURVE} SELECT lang, score, tp, fp, round(pr, 6) AS precision, round(re, 6) AS recall FROM q"),
    "average_precision": (average_precision, f"WITH {CURVE}, g AS (SELECT lang, pr, re - coalesce(lag(re) OVER (PARTITION BY lang ORDER BY score DESC), 0) AS gain FROM q) SELECT lang, round(sum(gain * pr), 6) AS ap FROM g GROUP BY 1"),
    "argmax_ap": (argmax_ap, ARGMAX_AP),
    "greedy_ap_k": (greedy_ap, None),
    "ar_at_an": (ar_at_an, f"""WITH {vw.INTERVALS}, t AS (SELECT * FROM intervals WHERE side = 'O'), p AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY score DESC, interval_id) AS rank FROM intervals WHERE side = 'F'),
      f AS (SELECT t.interval_id AS truth, min(p.rank) AS rank FROM t JOIN p ON p.actor = t.actor AND p."start" < t."end" AND t."start" < p."end" WHERE (least(p."end", t."end") - greatest(p."start", t."start")) / (greatest(p."end", t."end") - least(p."start", t."start")) >= 0.3 GROUP BY 1),
      x AS (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS fraction) SELECT fraction, round((SELECT count(*) FROM f WHERE rank <= floor(fraction * 20)) / (SELECT count(*) FROM t)::DOUBLE, 6) AS recall FROM x"""),
    "average_recall_curve": (average_recall, AVERAGE_RECALL),
    "event_match_k": (event_match, None),
    "error_kinds_k": (error_kinds, None),
    "boundary_match_k": (boundary_match, None),
    "temporal_iou_pairs": (temporal_pairs, f"""WITH {vw.INTERVALS}, p AS (SELECT a.interval_id AS a, b.interval_id AS b, a."start" AS s1, a."end" AS e1, b."start" AS s2, b."end" AS e2 FROM intervals a JOIN intervals b ON a.actor = b.actor AND a.side = 'F' AND b.side = 'O')
      SELECT a, b, round(greatest(0, least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)), 6) AS tiou, round(greatest(0, least(e1, e2) - greatest(s1, s2)) / (e1 - s1), 6) AS tiop, round((least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)), 6) AS grounding,
      round(((s2 + e2) - (s1 + e1)) / 2 / (e1 - s1), 6) AS dx, round(ln((e2 - s2) / (e1 - s1)), 6) AS dw, round((s2 - s1) / (e1 - s1), 6) AS ds FROM p"""),
    "cosine_topk": (cosine_topk, f"WITH {COSINES} SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY 1 - score, item) AS rank FROM c QUALIFY rank <= 5"),
    "retrieval_recall": (retrieval, f"""WITH {COSINES}, f AS (SELECT query, min(item) AS r FROM c WHERE same GROUP BY 1), o AS (SELECT c.query, c.score AS own FROM c JOIN f ON c.query = f.query AND c.item = f.r), k AS (SELECT c.query, count(*) FILTER (c.score > o.own) + 1 AS k FROM c JOIN o USING (query) GROUP BY 1)
      SELECT round(avg((k <= 1)::INT), 6) AS r1, round(avg((k <= 5)::INT), 6) AS r5, round(avg((k <= 10)::INT), 6) AS r10, round(median(k), 6)::DOUBLE AS median_rank, round(avg(k), 6) AS mean_rank FROM k"""),
    "identity_pair_f1": (pair_f1, """WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 11 > 0 THEN label * 2 + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END END AS person FROM embeddings),
      p AS (SELECT a.label = b.label AS t, coalesce(a.person = b.person, false) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id), c AS (SELECT count(*) FILTER (t AND s) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (t AND NOT s) AS fn FROM p) SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c"""),
    "text_normalise": (answers, None),
    "vqa_accuracy": (vqa, """WITH o AS (SELECT user_id, event_id % 16 AS turn, event_type, max_by(event_type, event_id) OVER (PARTITION BY user_id, event_id % 16) AS said FROM events), u AS (SELECT user_id, turn, least(1.0, count(*) FILTER (event_type = said) / 3.0::DOUBLE) AS a FROM o GROUP BY 1, 2) SELECT round(avg(a), 6) AS accuracy FROM u"""),
    "grounding_recall": (grounding, f"""WITH {vw.INTERVALS}, t AS (SELECT actor, min(row("start", "end")) AS k, arg_min("start", "start") AS s FROM intervals WHERE side = 'O' GROUP BY 1), tt AS (SELECT actor, "start" AS s, "end" AS e FROM intervals WHERE side = 'O' QUALIFY row_number() OVER (PARTITION BY actor ORDER BY "start", "end") = 1),
      p AS (SELECT actor, "start" AS ps, "end" AS pe, row_number() OVER (PARTITION BY actor ORDER BY score DESC, "start", "end") AS n FROM intervals WHERE side = 'F'), j AS (SELECT tt.actor, n, (least(e, pe) - greatest(s, ps)) / (greatest(e, pe) - least(s, ps)) AS i FROM tt JOIN p USING (actor)),
      h AS (SELECT actor, coalesce(max(i) FILTER (n <= 1), -1) AS i1, coalesce(max(i) FILTER (n <= 5), -1) AS i5 FROM j GROUP BY 1) SELECT round(avg((i1 > 0.1)::INT), 6) AS r1_at_10, round(avg((i1 > 0.3)::INT), 6) AS r1_at_30, round(avg((i5 > 0.1)::INT), 6) AS r5_at_10, round(avg((i5 > 0.3)::INT), 6) AS r5_at_30 FROM h"""),
    "label_recall": (label_recall, "WITH o AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS l FROM orders GROUP BY 1) SELECT round(avg((list_has_any(l, ['3-MEDIUM']))::INT), 6) AS recall1, round(avg((list_has_any(l, ['3-MEDIUM', '1-URGENT']))::INT), 6) AS recall2, round(avg((list_has_any(l, ['3-MEDIUM', '1-URGENT', '5-LOW']))::INT), 6) AS recall3 FROM o"),
    "offdiag_quantiles": (quantiles, f"WITH {COSINES} SELECT query, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.1), 6) AS p10, round(median(score), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90, round(max(score), 6) AS most FROM c WHERE same GROUP BY 1"),
    "corloc": (corloc, f"""WITH {vw.INTERVALS}, b AS (SELECT actor, "start" AS s, "end" AS e FROM intervals WHERE side = 'F' QUALIFY row_number() OVER (PARTITION BY actor ORDER BY score DESC, interval_id) = 1), h AS (SELECT b.actor, max(CASE WHEN greatest(0, least(b.e, t."end") - greatest(b.s, t."start")) / (greatest(b.e, t."end") - least(b.s, t."start")) >= 0.1 THEN 1 ELSE 0 END) AS h FROM b JOIN intervals t ON t.actor = b.actor AND t.side = 'O' GROUP BY 1)
      SELECT count(*) AS n, round(avg(h), 6) AS corloc FROM h"""),
}

"""Tracking metrics of predictions against ground truth: CLEAR, identity, HOTA, VACE, counts.

All start from one table of frames: the ids of both sides in each, and the pairs whose boxes overlap. What a metric needs
besides sums and joins is the pairing of largest summed weight: in each frame (HOTA, VACE), of whole tracks (identity,
VACE), or frame after frame with pairs that last (CLEAR). Counts are sums for each sequence, ratios are taken after
sequences are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.functions import values as v
from vidlake.operators.assignment import max_score
from vidlake.storage import saved

#: Similarities from which HOTA counts a pair.
ALPHAS = [k / 20 for k in range(1, 20)]
EPS = float(np.finfo(float).eps)


def similarities(truth: DataFrame, tracks: DataFrame) -> DataFrame:
    """(seq, t, gt_id, tr_id, sim) of all boxes in each frame; a side alone has a null on the other.

    Both tables: seq, t, id, box.
    """
    a = truth.select("seq", "t", F.col("id").alias("gt_id"), F.col("box").alias("_a"))
    b = tracks.select("seq", "t", F.col("id").alias("tr_id"), F.col("box").alias("_b"))
    return a.join(b, ["seq", "t"], "full").select("seq", "t", "gt_id", "tr_id", F.coalesce(g.iou(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("sim"))


def frames(sim: DataFrame) -> DataFrame:
    """(seq, t, gts, trs, pairs): a row for each frame with the ids of both sides and the pairs that are alike at all."""
    pair = F.when(F.col("sim") > 0, F.struct("gt_id", "tr_id", F.col("sim").cast("double").alias("sim")))
    return sim.groupBy("seq", "t").agg(F.collect_set("gt_id").alias("gts"), F.collect_set("tr_id").alias("trs"), F.collect_list(pair).alias("pairs"))


def _kind(fr: DataFrame, name: str) -> str:
    kinds = {f.name: f.dataType for f in fr.schema["pairs"].dataType.elementType.fields} | {f.name: f.dataType for f in fr.schema.fields}
    return kinds[name].simpleString()


def _pairs(fr: DataFrame) -> DataFrame:
    return fr.select("seq", "t", F.inline("pairs"))


def _lengths(fr: DataFrame, side: str, id_: str, n: str) -> DataFrame:
    """In how many frames each id is."""
    return fr.select("seq", F.explode(side).alias(id_)).groupBy("seq", id_).agg(F.count("*").alias(n))


def _totals(fr: DataFrame) -> DataFrame:
    return fr.groupBy("seq").agg(F.sum(F.size("gts")).alias("n_gt"), F.sum(F.size("trs")).alias("n_tr"), F.sum((F.size("gts") + F.size("trs") > 0).cast("long")).alias("frames"))


def heaviest(gt: np.ndarray, tr: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs make the pairing of the largest summed weight; ids are numbers, weights over zero."""
    lone = (np.bincount(gt)[gt] == 1) & (np.bincount(tr)[tr] == 1)
    rest = np.flatnonzero(~lone)
    if len(rest):
        rows, i = np.unique(gt[rest], return_inverse=True)
        cols, j = np.unique(tr[rest], return_inverse=True)
        made, at = np.zeros((len(rows), len(cols))), np.full((len(rows), len(cols)), -1)
        made[i, j], at[i, j] = weight[rest], rest
        taken = at[max_score(made)]
        lone[taken[taken >= 0]] = True
    return lone


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def best_pairs(pairs: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Of pairs (by, gt_id, tr_id and more) those of the pairing of the largest summed weight in each group; weights are over zero."""
    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for gt, tr, w in columns:
            at = np.r_[0, np.cumsum(pa.compute.list_value_length(gt).to_numpy(zero_copy_only=False))].astype(np.int64)
            i, j, x = _numbers(gt.flatten()), _numbers(tr.flatten()), w.flatten().to_numpy(zero_copy_only=False)
            ok = np.zeros(len(i), bool)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ok[a:b] = heaviest(i[a:b], j[a:b], x[a:b])
            yield pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ok))

    held = pairs.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in pairs.columns if c not in by))).alias("_p"))
    ok = F.arrow_udf(run, "array<boolean>")(F.col("_p.gt_id"), F.col("_p.tr_id"), F.col(f"_p.{weight}").cast("array<double>"))
    return held.select(*by, F.explode(F.arrays_zip(F.col("_p").alias("p"), ok.alias("ok"))).alias("_x")).filter("_x.ok").select(*by, "_x.p.*")


def clear_matches(fr: DataFrame, least: float = 0.5) -> DataFrame:
    """(seq, t, frame, gt_id, tr_id, sim): a truth keeps its last frame's track while they are alike enough; the others are paired so that similarities sum up to the most.

    Frames of one sequence pass by in order, one at a time; frames without truth or without tracks are passed over. frame: number of the frame among the others.
    """
    names = ["seq", "t", "frame", "gt_id", "tr_id", "sim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, last, frame = None, {}, 0
        for batch in batches:
            out: list[tuple] = []
            for s, t, pairs in zip(*(batch.column(x).to_pylist() for x in ("seq", "t", "pairs")), strict=True):
                if s != seq:
                    seq, last, frame = s, {}, 0
                now = {p["gt_id"]: p for p in pairs if last.get(p["gt_id"]) == p["tr_id"]}
                taken = {p["tr_id"] for p in now.values()}
                free = [p for p in pairs if p["gt_id"] not in now and p["tr_id"] not in taken]
                if free:
                    number = lambda key: np.unique([p[key] for p in free], return_inverse=True)[1]  # noqa: E731, B023
                    now |= {free[k]["gt_id"]: free[k] for k in np.flatnonzero(heaviest(number("gt_id"), number("tr_id"), np.array([p["sim"] for p in free]))).tolist()}
                out += [(s, t, frame, i, p["tr_id"], p["sim"]) for i, p in now.items()]
                last, frame = {i: p["tr_id"] for i, p in now.items()}, frame + 1
            made = [batch.schema.field("seq").type, batch.schema.field("t").type, pa.int64(), *(batch.schema.field("pairs").type.value_type.field(x).type for x in names[3:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, made, strict=True)], names)

    both = fr.filter((F.size("gts") > 0) & (F.size("trs") > 0)).select("seq", "t", F.filter("pairs", lambda p: p["sim"] >= least - EPS).alias("pairs"))
    schema = f"seq {_kind(fr, 'seq')}, t {_kind(fr, 't')}, frame bigint, gt_id {_kind(fr, 'gt_id')}, tr_id {_kind(fr, 'tr_id')}, sim double"
    return both.repartition("seq").sortWithinPartitions("seq", "t").mapInArrow(run, schema)


CLEAR = ["tp", "fn", "fp", "idsw", "mt", "pt", "ml", "frag", "sim_sum", "frames"]


def clear(sim: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts of each sequence: pairs, missed and false boxes, switches of track, truths by the share of their frames that are paired, and how often they are found anew."""
    fr = saved(frames(sim))
    before = Window.partitionBy("seq", "gt_id").orderBy("frame")
    steps = clear_matches(fr, least).withColumns({"_tr": F.lag("tr_id").over(before), "_frame": F.lag("frame").over(before)})
    anew = F.col("_frame").isNull() | (F.col("frame") - F.col("_frame") > 1)
    found = steps.groupBy("seq", "gt_id").agg(F.count("*").alias("hits"), F.sum("sim").alias("sim"), F.count_if(F.col("_tr") != F.col("tr_id")).alias("switches"), F.count_if(anew).alias("runs"))
    each = _lengths(fr, "gts", "gt_id", "n").join(found, ["seq", "gt_id"], "left").na.fill(0, ["hits", "sim", "switches", "runs"])
    share = F.col("hits") / F.col("n")
    made = each.groupBy("seq").agg(
        F.sum("hits").alias("tp"), F.sum("switches").alias("idsw"), F.count_if(share > 0.8).alias("mt"), F.count_if((share >= 0.2) & (share <= 0.8)).alias("pt"),
        F.count_if(share < 0.2).alias("ml"), F.sum(F.greatest(F.col("runs") - 1, F.lit(0))).alias("frag"), F.sum("sim").alias("sim_sum"),
    )
    out = _totals(fr).join(made, "seq", "left").na.fill(0).withColumns({"fn": F.col("n_gt") - F.col("tp"), "fp": F.col("n_tr") - F.col("tp")})
    return out.select("seq", *(F.col(c).cast("double").alias(c) for c in CLEAR))


def identity(sim: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes under the one pairing of whole tracks that has the most frames in common: paired, missed and false."""
    fr = saved(frames(sim))
    shared = _pairs(fr).filter(F.col("sim") >= least).groupBy("seq", "gt_id", "tr_id").agg(F.count("*").alias("n"))
    tp = best_pairs(shared, ["seq"], "n").groupBy("seq").agg(F.sum("n").alias("idtp"))
    out = _totals(fr).join(tp, "seq", "left").na.fill(0)
    made = {"idtp": F.col("idtp"), "idfn": F.col("n_gt") - F.col("idtp"), "idfp": F.col("n_tr") - F.col("idtp")}
    return out.select("seq", *(c.cast("double").alias(n) for n, c in made.items()))


def alignments(fr: DataFrame) -> DataFrame:
    """(seq, gt_id, tr_id, n_gt, n_tr, align): how alike whole tracks are, each frame's similarity taken as a share of what both boxes have with any."""
    p = _pairs(fr)
    sums = {n: F.sum("sim").over(Window.partitionBy("seq", "t", id_)) for n, id_ in (("_g", "gt_id"), ("_t", "tr_id"))}
    soft = p.repartition("seq", "t").withColumns(sums).withColumn("x", F.col("sim") / (F.col("_g") + F.col("_t") - F.col("sim")))
    summed = soft.groupBy("seq", "gt_id", "tr_id").agg(F.sum("x").alias("x"))
    made = summed.join(_lengths(fr, "gts", "gt_id", "n_gt"), ["seq", "gt_id"]).join(_lengths(fr, "trs", "tr_id", "n_tr"), ["seq", "tr_id"])
    return made.select("seq", "gt_id", "tr_id", "n_gt", "n_tr", (F.col("x") / (F.col("n_gt") + F.col("n_tr") - F.col("x"))).alias("align"))


HOTA = ["alpha", "tp", "fn", "fp", "ass_a", "ass_re", "ass_pr", "loc"]


def hota(sim: DataFrame) -> DataFrame:
    """For each sequence and alpha: counts, and association and localisation sums weighted by true positives."""
    fr = saved(frames(sim))
    align = saved(alignments(fr))
    scored = _pairs(fr).join(align, ["seq", "gt_id", "tr_id"]).select("seq", "t", "gt_id", "tr_id", "sim", (F.col("align") * F.col("sim")).alias("score"))
    level = F.size(F.filter(F.array(*(F.lit(a - EPS) for a in ALPHAS)), lambda a: F.col("sim") >= a))
    by_level = best_pairs(scored, ["seq", "t"], "score").groupBy("seq", "gt_id", "tr_id", level.alias("level")).agg(F.count("*").alias("n"), F.sum("sim").alias("loc"))
    alphas = F.explode(F.filter(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(a).alias("alpha")) for k, a in enumerate(ALPHAS))), lambda a: a["k"] <= F.col("level")))
    each = by_level.select("*", alphas.alias("_a")).groupBy("seq", F.col("_a.alpha").alias("alpha"), "gt_id", "tr_id").agg(F.sum("n").alias("n"), F.sum("loc").alias("loc"))
    each = each.join(align, ["seq", "gt_id", "tr_id"])
    square = lambda below: F.sum(F.col("n") * F.col("n") / below)
    made = each.groupBy("seq", "alpha").agg(F.sum("n").alias("tp"), F.sum("loc").alias("loc"), square(F.col("n_gt") + F.col("n_tr") - F.col("n")).alias("ass_a"), square(F.col("n_gt")).alias("ass_re"), square(F.col("n_tr")).alias("ass_pr"))
    every = _totals(fr).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    out = every.join(made, ["seq", "alpha"], "left").na.fill(0).withColumns({"fn": F.col("n_gt") - F.col("tp"), "fp": F.col("n_tr") - F.col("tp")})
    return out.select("seq", *(F.col(c).cast("double").alias(c) for c in HOTA))


def vace(sim: DataFrame, least: float = 0.5) -> DataFrame:
    """Sums behind average tracking accuracy (over the pairing of whole tracks) and sequence frame detection accuracy (over that of each frame)."""
    fr = saved(frames(sim))
    alike = _pairs(fr).filter(F.col("sim") >= least).groupBy("seq", "gt_id", "tr_id").agg(F.count("*").alias("n"))
    met = fr.select("seq", F.explode("gts").alias("gt_id"), "trs").select("seq", "gt_id", F.explode("trs").alias("tr_id")).groupBy("seq", "gt_id", "tr_id").agg(F.count("*").alias("both"))
    lengths = [_lengths(fr, "gts", "gt_id", "a"), _lengths(fr, "trs", "tr_id", "b")]
    share = alike.join(met, ["seq", "gt_id", "tr_id"]).join(lengths[0], ["seq", "gt_id"]).join(lengths[1], ["seq", "tr_id"])
    share = share.select("seq", "gt_id", "tr_id", (F.col("n") / (F.col("a") + F.col("b") - F.col("both"))).alias("share"))
    stda = best_pairs(share, ["seq"], "share").groupBy("seq").agg(F.sum("share").alias("stda"))
    fda = best_pairs(_pairs(fr), ["seq", "t"], "sim").groupBy("seq", "t").agg(F.sum("sim").alias("sim")).join(fr.select("seq", "t", (F.size("gts") + F.size("trs")).alias("n")), ["seq", "t"])
    fda = fda.groupBy("seq").agg(F.sum(F.col("sim") / (0.5 * F.col("n"))).alias("fda"))
    ids = lengths[0].select("seq").unionByName(lengths[1].select("seq")).groupBy("seq").agg((0.5 * F.count("*")).alias("n_ids"))
    out = _totals(fr).select("seq", "frames").join(stda, "seq", "left").join(fda, "seq", "left").join(ids, "seq", "left").na.fill(0)
    return out.select("seq", *(F.col(c).cast("double").alias(c) for c in ("stda", "n_ids", "fda", "frames")))


def combined(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of all sequences together: sums, never means of ratios."""
    cols = [c for c in counts.columns if c not in ("seq", *by)]
    return counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in cols))


def clear_finals(c: DataFrame) -> DataFrame:
    gt, ids = F.col("tp") + F.col("fn"), F.col("mt") + F.col("pt") + F.col("ml")
    return c.withColumns({
        "mota": v.ratio(F.col("tp") - F.col("fp") - F.col("idsw"), gt), "moda": v.ratio(F.col("tp") - F.col("fp"), gt), "smota": v.ratio(F.col("sim_sum") - F.col("fp") - F.col("idsw"), gt),
        "motal": v.ratio(F.col("tp") - F.col("fp") - F.when(F.col("idsw") > 0, F.log10(F.greatest("idsw", F.lit(1.0)))).otherwise(0.0), gt),
        "motp": v.ratio(F.col("sim_sum"), F.col("tp")), "f1": v.ratio(F.col("tp"), F.col("tp") + 0.5 * F.col("fn") + 0.5 * F.col("fp")),
        "recall": v.ratio(F.col("tp"), gt), "precision": v.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "mtr": v.ratio(F.col("mt"), ids), "ptr": v.ratio(F.col("pt"), ids), "mlr": v.ratio(F.col("ml"), ids), "fp_per_frame": v.ratio(F.col("fp"), F.col("frames")),
    })


def identity_finals(c: DataFrame) -> DataFrame:
    return c.withColumns({"idf1": v.ratio(F.col("idtp"), F.col("idtp") + 0.5 * F.col("idfp") + 0.5 * F.col("idfn")), "idr": v.ratio(F.col("idtp"), F.col("idtp") + F.col("idfn")), "idp": v.ratio(F.col("idtp"), F.col("idtp") + F.col("idfp"))})


def hota_finals(c: DataFrame, by: list[str]) -> DataFrame:
    """Means over alpha of the combined counts' scores, and the scores at the least alpha."""
    tp = F.greatest("tp", F.lit(1.0))
    at = c.withColumns({
        "det_a": v.ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.col("fp")), "det_re": v.ratio(F.col("tp"), F.col("tp") + F.col("fn")), "det_pr": v.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "ass_a": F.col("ass_a") / tp, "ass_re": F.col("ass_re") / tp, "ass_pr": F.col("ass_pr") / tp, "loc_a": F.greatest(F.lit(1e-10), F.col("loc")) / F.greatest(F.lit(1e-10), F.col("tp")),
    })
    at = at.withColumns({"hota": F.sqrt(F.col("det_a") * F.col("ass_a")), "rhota": F.sqrt(F.col("det_re") * F.col("ass_a"))})
    means = [F.avg(x).alias(x) for x in ("hota", "det_a", "ass_a", "det_re", "det_pr", "ass_re", "ass_pr", "loc_a", "rhota")]
    at_least: list[Column] = [F.min_by(x, "alpha").alias(n) for x, n in (("hota", "hota_0"), ("loc_a", "loc_a_0"))]
    return at.groupBy(*by).agg(*means, *at_least).withColumn("hota_loc_a_0", F.col("hota_0") * F.col("loc_a_0"))


def vace_finals(c: DataFrame) -> DataFrame:
    return c.withColumns({"ata": v.ratio(F.col("stda"), F.col("n_ids")), "sfda": v.ratio(F.col("fda"), F.col("frames"))})


def counts(truth: DataFrame, tracks: DataFrame) -> DataFrame:
    """Detections and ids of both sides, for each sequence."""
    side = lambda d, n: d.groupBy("seq").agg(F.count("*").alias(f"{n}_dets"), F.count_distinct("id").alias(f"{n}_ids"))
    return side(truth, "gt").join(side(tracks, "tr"), "seq", "full").na.fill(0)

"""Detections and proposals: greedy matching over thresholds, suppression, tubes, trackers and candidate windows.

What is sequential runs for one video (or one label of it) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.functions import geometry as g
from vidlake.operators.assignment import box_iou, link_tubes, max_score, soft_nms
from vidlake.operators.curves import envelope, running
from vidlake.operators.ordered import per_key
from vidlake.operators.tracking_metrics import EPS, best_pairs


def locked_hits(pairs: DataFrame, predictions: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """hit of each prediction at each threshold: predictions by score take their most similar free truth, else the next.

    pairs: keys, pred, truth, tiou; predictions: keys, pred, score. A truth is reached by predictions of one group of keys only.
    """
    near = pairs.groupBy(*keys, "pred").agg(F.array_sort(F.collect_list(F.struct((-F.col("tiou")).alias("cost"), "truth"))).alias("near"))
    rows = predictions.join(near, [*keys, "pred"])
    kinds = dict(predictions.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "pred"], ascending=[False, True])
        out = []
        for t in thresholds:
            taken: set = set()
            for pred, close in zip(p["pred"], p["near"], strict=True):
                for c in close:
                    if -c["cost"] < t:
                        break
                    if c["truth"] not in taken:
                        taken.add(c["truth"])
                        out.append((pred, t))
                        break
        made = pd.DataFrame(out, columns=["pred", "threshold"])
        for k in keys:
            made[k] = p[k].iloc[0]
        return made[[*keys, "pred", "threshold"]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"pred {kinds['pred']}", "threshold double"])
    hits = rows.groupBy(*keys).applyInPandas(run, schema).withColumn("hit", F.lit(True))
    every = predictions.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return every.join(hits, [*keys, "pred", "threshold"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def localisation_map(pairs: DataFrame, predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Average precision of each label at each threshold. pairs: label, actor, pred, truth, tiou; predictions: label, actor, pred, score; truth: label, truth."""
    from vidlake.operators.evaluation import envelope_ap

    # truths are reached from their own actor only, so actors can share a group
    part = F.pmod(F.xxhash64("actor"), F.lit(64)).alias("part")
    hits = locked_hits(pairs.select("label", part, "pred", "truth", "tiou"), predictions.select("label", part, "pred", "score"), ["label", "part"], thresholds)
    n = truth.groupBy("label").agg(F.count("*").alias("n_truth"))
    return envelope_ap(hits.join(n, "label"), ["label", "threshold"], [F.desc("score"), F.col("pred")], "hit", "n_truth")


def suppressed_spans(proposals: DataFrame, keys: list[str], low: float = 0.0, high: float = 0.8, alpha: float = 0.4, top: int = 100) -> DataFrame:
    """Soft suppression of each video's spans (start, end in shares of the video, score)."""
    kinds = dict(proposals.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "start", "end"], ascending=[False, True, True])
        out = pd.DataFrame(soft_nms(p[["start", "end"]].to_numpy(float), p["score"].to_numpy(float), low, high, alpha, top), columns=["start", "end", "score"])
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "start", "end", "score"]]

    return proposals.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start double, end double, score double")


def _frames(p: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    p = p.sort_values(["frame_idx", "score", "x1", "y1"], ascending=[True, False, True, True])
    return [(int(f), r[["x1", "y1", "x2", "y2"]].to_numpy(float), r["score"].to_numpy(float)) for f, r in p.groupby("frame_idx")]


def tubes(detections: DataFrame, keys: list[str], least: float = 0.5, min_length: int = 15) -> DataFrame:
    """Tubes of linked detections (keys, frame_idx, box, score): a row for each frame of a tube, with the tube's mean score."""
    kinds = dict(detections.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, f, *b, s, float(np.mean([x for *_, x in tube]))) for i, tube in enumerate(link_tubes(_frames(p), least, min_length)) for f, b, s in tube]
        out = pd.DataFrame(rows, columns=["tube_id", "frame_idx", "x1", "y1", "x2", "y2", "score", "tube_score"])
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "tube_id", "frame_idx", "x1", "y1", "x2", "y2", "score", "tube_score"]]

    flat = detections.select(*keys, "frame_idx", "box.*", "score")
    return flat.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tube_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, score double, tube_score double")


def baseline_tracks(detections: DataFrame, keys: list[str], least_score: float = 0.0, least: float = 0.1, skip: int = 5) -> DataFrame:
    """Tracks from detections by assignment in each frame on overlap with the last boxes, a tenth of it for each frame of absence."""
    kinds = dict(detections.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        live: dict[int, tuple[np.ndarray, int]] = {}
        rows, fresh = [], 0
        for frame, boxes, _ in _frames(p[p["score"] >= least_score]):
            ids = sorted(live)
            age = np.array([frame - live[i][1] - 1 for i in ids])
            score = box_iou(np.array([live[i][0] for i in ids]).reshape(-1, 4), boxes) * (10.0 ** -age)[:, None]
            a, b = max_score(score) if score.size else ([], [])
            given = {int(j): ids[i] for i, j in zip(a, b, strict=True) if score[i, j] > least}
            for j, box in enumerate(boxes):
                if j not in given:
                    given[j], fresh = fresh, fresh + 1
                live[given[j]] = (box, frame)
                rows.append((given[j], frame, *box))
            live = {i: x for i, x in live.items() if frame - x[1] < skip}
        out = pd.DataFrame(rows, columns=["track_id", "frame_idx", "x1", "y1", "x2", "y2"])
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "track_id", "frame_idx", "x1", "y1", "x2", "y2"]]

    flat = detections.select(*keys, "frame_idx", "box.*", "score")
    return flat.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")


def paired_boxes(truth: DataFrame, tracks: DataFrame, least: float, *carried: str) -> DataFrame:
    """(seq, t, gt_id, tr_id, sim and columns of the truth): the pairing of each frame with the largest summed overlap of those from ``least``. Both tables: seq, t, id, box."""
    a = truth.select("seq", "t", F.col("id").alias("gt_id"), F.col("box").alias("_a"), *carried)
    b = tracks.select("seq", "t", F.col("id").alias("tr_id"), F.col("box").alias("_b"))
    near = a.join(b, ["seq", "t"]).withColumn("sim", g.iou(F.col("_a"), F.col("_b"))).filter(F.col("sim") >= least - EPS).drop("_a", "_b")
    return best_pairs(near, ["seq", "t"], "sim")


def without_distractors(truth: DataFrame, tracks: DataFrame, least: float = 0.5) -> DataFrame:
    """Tracks without the boxes that are assigned to a distractor in their frame; assignment is over all truth, by overlap.

    truth: seq, t, id, box, distractor, counted; tracks: seq, t, id, box. Truth to be scored is that with counted.
    """
    gone = paired_boxes(truth, tracks, least, "distractor").filter("distractor").select("seq", "t", F.col("tr_id").alias("id"))
    return tracks.join(gone, ["seq", "t", "id"], "left_anti")


def not_in_crowd(tracks: DataFrame, crowds: DataFrame, most: float = 0.95) -> DataFrame:
    """Tracks without boxes that lie inside a crowd region of their frame. crowds: seq, t, box."""
    c = crowds.select("seq", "t", F.col("box").alias("_c"))
    gone = tracks.join(c, ["seq", "t"]).filter(g.ioa(F.col("box"), F.col("_c")) > most).select("seq", "t", "id").distinct()
    return tracks.join(gone, ["seq", "t", "id"], "left_anti")


def best_truth(proposals: DataFrame, truth: DataFrame, keys: list[str], positive: float = 0.5, negative: float = 0.5, least_positive: float = 0.3) -> DataFrame:
    """Assigns boxes: the truth a proposal overlaps most if by ``positive``, none under ``negative``; each truth also takes its own best proposal from ``least_positive``.

    proposals: keys, pred, box; truth: keys, truth, box. assigned is null for background, and -1 between the limits.
    """
    p = proposals.select(*keys, "pred", F.col("box").alias("_p"))
    met = p.join(truth.select(*keys, "truth", F.col("box").alias("_t")), keys).withColumn("iou", g.iou(F.col("_p"), F.col("_t")))
    own = met.groupBy(*keys, "pred").agg(F.max_by(F.struct("truth", "iou"), F.struct("iou", -F.col("truth"))).alias("_b"))
    top = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "truth").orderBy(F.desc("iou"), "pred"))).filter((F.col("_n") == 1) & (F.col("iou") >= least_positive))
    forced = top.groupBy(*keys, "pred").agg(F.max("truth").alias("_f"))
    out = p.join(own, [*keys, "pred"], "left").join(forced, [*keys, "pred"], "left")
    iou = F.coalesce("_b.iou", F.lit(0.0))
    assigned = F.when(F.col("_f").isNotNull(), F.col("_f")).when(iou >= positive, F.col("_b.truth")).when(iou >= negative, F.lit(-1))
    return out.select(*keys, "pred", iou.alias("iou"), assigned.cast("bigint").alias("assigned"))


def candidate_spans(starts: DataFrame, ends: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Pairs of a start and a later end no more than ``most`` apart, scored by the product. starts, ends: keys, t, score."""
    cell = lambda t: F.floor(t / most).cast("bigint")
    s = starts.select(*keys, F.col("t").alias("start"), F.col("score").alias("start_score")).withColumn("_cell", F.explode(F.array(cell(F.col("start")), cell(F.col("start")) + 1)))
    e = ends.select(*keys, F.col("t").alias("end"), F.col("score").alias("end_score")).withColumn("_cell", cell(F.col("end")))
    return s.join(e, [*keys, "_cell"]).filter((F.col("start") < F.col("end")) & (F.col("end") - F.col("start") <= most)).drop("_cell").withColumn("score", F.col("start_score") * F.col("end_score"))


def at_positions(curve: Column, positions: Column) -> Column:
    """Values of a curve (an array, one value a step) at real positions, straight between steps, the ends beyond them."""
    last = F.size(curve) - 1
    def value(p: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(p.cast("double"), last.cast("double")))
        low = F.floor(x).cast("int")
        return F.get(curve, low) + (F.get(curve, F.least(low + 1, last)) - F.get(curve, low)) * (x - low)

    return F.transform(positions, value)


def track_precision(hits: DataFrame, by: list[str], n_truth: str, recalls: list[float]) -> DataFrame:
    """Mean precision at fixed recalls: at each, the envelope's value at the first point that reaches it, 0 if none does. hits: by, score, pred, hit.

    Recall moves at hits only, so each hit stands for the recalls above that of the hit before, up to its own; the first for all from 0.
    """
    at = running(hits, by, [F.desc("score"), F.col("pred")], {"_tp": F.col("hit").cast("long"), "_n": F.lit(1)})
    at = envelope(at, by, {"_e": F.col("_tp") / F.col("_n")})
    upto = lambda tp: F.when(tp <= 0, F.lit(-1.0)).otherwise(tp / F.col(n_truth)) + 1e-9
    served = F.size(F.filter(F.array(*map(F.lit, recalls)), lambda w: (w > upto(F.col("_tp") - 1)) & (w <= upto(F.col("_tp")))))
    return at.groupBy(*by).agg((F.sum(F.when(F.col("hit"), F.col("_e") * served).otherwise(0.0)) / len(recalls)).alias("ap"))


def boundary_features(curve: Column, gap: Column, start: Column, end: Column, ratio: float = 0.2, edge: int = 8, inside: int = 16, fine: int = 3) -> Column:
    """What a proposal's curve looks like: means around ``inside`` moments of its span, then around ``edge`` moments at its start and at its end.

    The curve has a value in the middle of each step of ``gap`` seconds, and is 0 outside. A moment's mean is over ``fine`` + 1
    places from half a moment before it to half a moment after it.
    """
    def values(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for curves, *numbers in parts:
            step, low, high = (n.to_numpy(zero_copy_only=False).astype(float) for n in numbers)
            out: list[list[float] | None] = []
            for i, own in enumerate(curves):
                if not own.is_valid or np.isnan([step[i], low[i], high[i]]).any():
                    out.append(None)
                    continue
                whole = np.concatenate([[0.0], own.values.to_numpy(zero_copy_only=False).astype(float), [0.0]])
                off = (high[i] - low[i]) * ratio
                made = []
                for lo, hi, n in ((low[i], high[i], inside), (low[i] - off, low[i] + off, edge), (high[i] - off, high[i] + off, edge)):
                    each = (hi - lo) / (n - 1)
                    at = np.interp((lo - each / 2 + each / fine * np.arange(n * fine + 1)) / step[i] + 0.5, np.arange(len(whole)), whole)
                    made.append(np.lib.stride_tricks.sliding_window_view(at, fine + 1)[::fine].sum(axis=1) / (fine + 1))
                found = np.concatenate(made).tolist()
                out.append([None if x != x else x for x in found] if own.values.null_count else found)
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(values, "array<double>")(curve, *(c.cast("double") for c in (gap, start, end)))


def gap_tracks(detections: DataFrame, keys: list[str], least: float = 0.6, missing: int = 10) -> DataFrame:
    """(keys, track_id, frame_idx, box, score): boxes joined frame by frame to the latest track whose last box they overlap by ``least``, that has no box
    in the frame yet, and that has been without one in fewer than ``missing`` frames since it began."""
    kinds, k = dict(detections.dtypes), len(keys)
    rows = detections.select(*keys, "frame_idx", "box", "score").withColumn("_order", -F.col("score"))

    def step(held: list[tuple]) -> list[tuple]:
        out, last, begun, seen, at = [], [], [], [], []
        for row in held:
            frame, box = row[k], row[k + 1]
            corners = np.array([[box[c] for c in ("x1", "y1", "x2", "y2")]], float)
            track = next((i for i in range(len(last) - 1, -1, -1) if at[i] != frame and frame - begun[i] - seen[i] < missing and box_iou(last[i], corners)[0, 0] >= least), None)
            if track is None:
                track = len(last)
                for values, value in ((last, corners), (begun, frame), (seen, 0), (at, frame)):
                    values.append(value)
            last[track], at[track], seen[track] = corners, frame, seen[track] + 1
            out.append((*row[:k], track, frame, box, row[k + 2]))
        return out

    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"track_id bigint, frame_idx {kinds['frame_idx']}, box {kinds['box']}, score {kinds['score']}"])
    return per_key(rows, keys, ["frame_idx", "_order"], step, fields)


def solid(tracks: DataFrame, keys: list[str], more_than: int = 5, area: float = 5000.0) -> DataFrame:
    """Tracks with more boxes and a larger mean area than so."""
    facts = tracks.groupBy(*keys, "track_id").agg(F.count("*").alias("_n"), F.avg(g.area(F.col("box"))).alias("_a"))
    return tracks.join(facts.filter((F.col("_n") > more_than) & (F.col("_a") > area)).select(*keys, "track_id"), [*keys, "track_id"], "left_semi")


def main_person(tracks: DataFrame, frames: DataFrame, keys: list[str], centre: tuple[float, float] = (480.0, 270.0), near: float = 50.0) -> DataFrame:
    """(keys, frame_idx, box, filled): one box for each frame of a video, from its tracks by how near to the picture's centre they are on average.

    Tracks farther than twice the nearest one that lasts for half of the frames do not count (``near`` at least; all count
    without such a track). A frame without a box takes that of the nearest frame that has one, the earlier on ties. frames: keys, frames (from 0).
    """
    x, y = (F.col("box.x1") + F.col("box.x2")) / 2 - centre[0], (F.col("box.y1") + F.col("box.y2")) / 2 - centre[1]
    facts = tracks.groupBy(*keys, "track_id").agg(F.count("*").alias("_n"), F.avg(F.sqrt(x * x + y * y)).alias("_d")).join(frames, keys)
    bound = facts.groupBy(*keys).agg(F.min(F.when(F.col("_n") >= F.col("frames") / 2, F.col("_d"))).alias("_b"))
    kept = facts.join(bound, keys).filter(F.col("_b").isNull() | (F.col("_d") < F.greatest(2 * F.col("_b"), F.lit(near)))).select(*keys, "track_id", "_d")
    first = tracks.join(kept, [*keys, "track_id"]).groupBy(*keys, "frame_idx").agg(F.min_by("box", F.struct("_d", "track_id")).alias("box"))
    every = frames.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames").cast("bigint") - 1)).alias("frame_idx"))
    at = every.join(first, [*keys, "frame_idx"], "left").withColumn("_own", F.when(F.col("box").isNotNull(), F.struct("frame_idx", "box")))
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    at = at.withColumns({"_p": F.last("_own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_q": F.first("_own", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    back = F.col("_q").isNull() | (F.col("frame_idx") - F.col("_p.frame_idx") <= F.col("_q.frame_idx") - F.col("frame_idx"))
    return at.select(*keys, "frame_idx", F.when(F.col("_p").isNotNull() & back, F.col("_p.box")).otherwise(F.col("_q.box")).alias("box"), F.col("_own").isNull().alias("filled"))

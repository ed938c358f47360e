"""Boxes and time spans as column expressions. A box is a struct (x1, y1, x2, y2); a span is (start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def to_centre(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The box inside the frame; null if nothing of it is left."""
    edge = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    made = box(edge(b["x1"], width), edge(b["y1"], height), edge(b["x2"], width), edge(b["y2"], height))
    return F.when((made["x2"] > made["x1"]) & (made["y2"] > made["y1"]), made)


def area(b: Column, plus: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"] + plus) * F.greatest(F.lit(0.0), b["y2"] - b["y1"] + plus)


def intersection(a: Column, b: Column, plus: float = 0.0) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + plus
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + plus
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column, plus: float = 0.0) -> Column:
    """Intersection over union; 0 when the union is empty. plus: 1 where pixels are counted."""
    both = intersection(a, b, plus)
    union = area(a, plus) + area(b, plus) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def ioa(a: Column, b: Column) -> Column:
    """Share of a inside b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, which counts as 1 at least."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1.0))


def giou(a: Column, b: Column) -> Column:
    """IoU less the share of the hull that neither covers."""
    hull = (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])) * (F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]))
    union = area(a) + area(b) - intersection(a, b)
    return iou(a, b) - F.when(hull > 0, (hull - union) / hull).otherwise(F.lit(0.0))


def iou_distance(a: Column, b: Column, least: float) -> Column:
    """1 - IoU, null for pairs under the threshold."""
    return F.when(iou(a, b) >= least, 1 - iou(a, b))


def point_similarity(x1: Column, y1: Column, x2: Column, y2: Column, zero: float) -> Column:
    """1 at no distance, 0 from ``zero`` on."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) / zero)


def diagonal(b: Column) -> Column:
    return F.sqrt((b["x2"] - b["x1"]) ** 2 + (b["y2"] - b["y1"]) ** 2)


def centre_distance(a: Column, b: Column) -> Column:
    return F.sqrt(((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2) ** 2 + ((a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2) ** 2)


def crop(b: Column, side: float, top: float, bottom: float) -> Column:
    """A part of the box: ``side`` trimmed left and right, from ``top`` to ``bottom`` of its height."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return box(b["x1"] + w * side, b["y1"] + h * top, b["x2"] - w * side, b["y1"] + h * bottom)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal IoU over the hull of both spans."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def tiop(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share of the first span inside the second."""
    return F.when(e1 > s1, overlap(s1, e1, s2, e2) / (e1 - s1)).otherwise(F.lit(0.0))


def grounding_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """As temporal IoU, but below 0 for spans apart."""
    return (F.least(e1, e2) - F.greatest(s1, s2)) / F.nullif(F.greatest(e1, e2) - F.least(s1, s2), F.lit(0.0))


def gap_frames(first1: Column, last1: Column, first2: Column, last2: Column) -> Column:
    """Frames strictly between two spans, 0 if they meet."""
    return F.greatest(F.lit(0), F.greatest(first1, first2) - F.least(last1, last2) - 1)


def span_to_xw(anchor_start: Column, anchor_end: Column, start: Column, end: Column) -> Column:
    """Regression target: shift of the centre and log ratio of widths, in units of the anchor's width (1e-5 at least)."""
    aw, w = F.greatest(anchor_end - anchor_start, F.lit(1e-5)), F.greatest(end - start, F.lit(1e-5))
    return F.struct((((start + end) - (anchor_start + anchor_end)) / 2 / aw).alias("dx"), F.log(w / aw).alias("dw"))


def xw_to_span(anchor_start: Column, anchor_end: Column, dx: Column, dw: Column) -> Column:
    aw = F.greatest(anchor_end - anchor_start, F.lit(1e-5))
    centre, w = (anchor_start + anchor_end) / 2 + dx * aw, F.exp(dw) * aw
    return F.struct((centre - w / 2).alias("start"), (centre + w / 2).alias("end"))


def span_to_se(anchor_start: Column, anchor_end: Column, start: Column, end: Column) -> Column:
    aw = F.greatest(anchor_end - anchor_start, F.lit(1e-5))
    return F.struct(((start - anchor_start) / aw).alias("ds"), ((end - anchor_end) / aw).alias("de"))


def se_to_span(anchor_start: Column, anchor_end: Column, ds: Column, de: Column) -> Column:
    aw = F.greatest(anchor_end - anchor_start, F.lit(1e-5))
    return F.struct((anchor_start + ds * aw).alias("start"), (anchor_end + de * aw).alias("end"))

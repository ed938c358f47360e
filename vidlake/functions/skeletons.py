"""Skeletons as nested arrays: people x frames x joints x coordinates (x, y and depth or score), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The joint that each joint's bone comes from, by the number of the joint; a joint that is its own has no bone. Fixed values.
PARENTS = {
    "nturgb+d": [1, 20, 20, 2, 20, 4, 5, 6, 20, 8, 9, 10, 0, 12, 13, 14, 0, 16, 17, 18, 20, 22, 7, 24, 11],
    "openpose": [0, 0, 1, 2, 3, 1, 5, 6, 2, 8, 9, 5, 11, 12, 0, 0, 14, 15],
    "coco": [0, 0, 0, 1, 2, 0, 0, 5, 6, 7, 8, 0, 0, 11, 12, 13, 14],
}
#: Layouts whose third coordinate is a score. Fixed values.
SCORED = ("openpose", "coco")


def _mixed(a: Column, b: Column, scored: bool) -> Column:
    """a - b; of a score, which is third, the mean."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.when(F.lit(scored) & (i == 2), (p["a"] + p["b"]) / 2).otherwise(p["a"] - p["b"]))


def bones(keypoints: Column, layout: str) -> Column:
    """Each joint less the one that its bone comes from."""
    parents = F.array(*map(F.lit, PARENTS[layout]))
    frame = lambda joints: F.transform(joints, lambda j, i: _mixed(j, F.get(joints, F.get(parents, i)), layout in SCORED))
    return F.transform(keypoints, lambda person: F.transform(person, frame))


def motion(keypoints: Column, layout: str) -> Column:
    """Each frame's joints (or bones) taken from the next frame's; the last frame has none: zeros."""
    scored = layout in SCORED

    def person(frames: Column) -> Column:
        def one(joints: Column, t: Column) -> Column:
            after = F.get(frames, t + 1)
            return F.transform(joints, lambda j, i: F.when(after.isNull(), F.transform(j, lambda x: x * 0)).otherwise(_mixed(F.get(after, i), j, scored)))

        return F.transform(frames, one)

    return F.transform(keypoints, person)


def normalised(keypoints: Column, height: Column, width: Column) -> Column:
    """x and y as shares of half the picture from its middle; further coordinates as they are."""
    half = lambda i: F.when(i == 0, width / 2).when(i == 1, height / 2)
    joint = lambda j: F.transform(j, lambda x, i: F.when(i < 2, (x - half(i)) / half(i)).otherwise(x))
    return F.transform(keypoints, lambda person: F.transform(person, lambda frame: F.transform(frame, joint)))


def merged(streams: list[Column]) -> Column:
    """Coordinates of several streams of one shape behind each other."""
    def joint(p: Column, f: Column, j: Column) -> Column:
        return F.concat(*(F.get(F.get(F.get(s, p), f), j) for s in streams))

    return F.transform(streams[0], lambda person, p: F.transform(person, lambda frame, f: F.transform(frame, lambda x, j: joint(p, f, j))))

"""A tracker as a stream: scores of detections against labels come frame by frame; ids are given, kept over gaps and used again.

Rows of frames that a video has passed already are not tracked but come out as violations. A video of which nothing comes
for ``idle_ms`` is over: its state ends, and what comes later starts anew. Without it state stays, as a query that only runs
over what is there would else wait for times to pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vidlake.operators.assignment import max_score

OUTPUT = "video_id bigint, frame_idx bigint, detection bigint, track_id bigint, is_newborn boolean, violation string"
STATE = "labels array<bigint>, tracks array<bigint>, last array<bigint>, next bigint, frame bigint"


def by_assignment(scores: np.ndarray, own: list[int], least: float) -> list[tuple[int, int]]:
    """(detection, column): most score in all."""
    if not own:
        return []
    i, j = max_score(scores[:, own])
    return [(int(a), own[b]) for a, b in zip(i, j, strict=True) if scores[a, own[b]] >= least]


def by_object(scores: np.ndarray, own: list[int], least: float) -> list[tuple[int, int]]:
    """Each detection asks for its best column, the newborn one among them; a label goes to the one that asks with the most score, the first on ties."""
    best = scores.argmax(axis=1)
    asked = {}
    for a, k in enumerate(best.tolist()):
        if k in own and scores[a, k] >= least and (k not in asked or scores[a, k] > scores[asked[k], k]):
            asked[k] = a
    return sorted((a, k) for k, a in asked.items())


def by_label(scores: np.ndarray, own: list[int], least: float) -> list[tuple[int, int]]:
    """Each label, the newborn one too, asks for its best detection; a detection goes to the label that asks with the most score, the later on ties. A label that is not alive wins nothing, but the detection is not another's then."""
    best, most = scores.argmax(axis=0), scores.max(axis=0)
    won: dict[int, int] = {}
    for k, a in enumerate(best.tolist()):
        if a not in won or most[k] >= most[won[a]]:
            won[a] = k
    return sorted((a, k) for a, k in won.items() if k in own and most[k] >= least)


PROTOCOLS = {"assignment": by_assignment, "object": by_object, "label": by_label}


def step(live: dict[int, tuple[int, int]], next_id: int, frame: int, detections: list[int], scores: np.ndarray, labels: list[int], least: float, newborn: float, miss: int, protocol: str = "assignment") -> tuple[list[tuple[int, int, bool]], int]:
    """One frame. live: label -> (track, last frame), changed in place. scores: detection by label; the last column is the newborn score.

    A detection takes a live label's track by the protocol; one that takes none starts a track if its newborn score is
    enough. A label is free again when its track has been missing for ``miss`` frames.
    """
    for label in [x for x, (_, seen) in live.items() if frame - seen > miss]:
        del live[label]
    own = [k for k, x in enumerate(labels) if x in live]
    out: list[tuple[int, int, bool]] = []
    taken: set[int] = set()
    for a, k in PROTOCOLS[protocol](scores, own, least) if len(detections) else ():
        label = labels[k]
        live[label] = (live[label][0], frame)
        out.append((detections[a], live[label][0], False))
        taken.add(a)
    free = iter([x for x in labels if x not in live])
    for a in range(len(detections)):
        if a not in taken and scores[a, -1] >= newborn:
            label = next(free, None)
            if label is None:
                break
            live[label] = (next_id, frame)
            out.append((detections[a], next_id, True))
            next_id += 1
    return out, next_id


def track(scores: DataFrame, least: float = 0.5, newborn: float = 0.5, miss: int = 30, protocol: str = "assignment", idle_ms: int | None = None) -> DataFrame:
    """scores: video_id, frame_idx, detection, scores (array: one for each label, the newborn score last). Frames of a video come in order; a frame comes whole."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        labels, tracks, last, next_id, passed = state.get if state.exists else ([], [], [], 0, None)
        live = {x: (t, s) for x, t, s in zip(labels, tracks, last, strict=True)}
        rows = pd.concat(list(batches)).sort_values(["frame_idx", "detection"])
        out = []
        for frame, f in rows.groupby("frame_idx"):
            if passed is not None and frame <= passed:
                out += [(key[0], int(frame), d, None, None, "late_frame") for d in f["detection"].tolist()]
                continue
            matrix = np.array(f["scores"].tolist(), float)
            made, next_id = step(live, next_id, int(frame), f["detection"].tolist(), matrix, list(range(matrix.shape[1] - 1)), least, newborn, miss, protocol)
            out += [(key[0], int(frame), d, t, new, None) for d, t, new in made]
            passed = int(frame)
        state.update((list(live), [t for t, _ in live.values()], [s for _, s in live.values()], next_id, passed))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "detection", "track_id", "is_newborn", "violation"]).astype({"track_id": "Int64", "is_newborn": "boolean"})

    return scores.groupBy("video_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def violations(tracked: DataFrame) -> DataFrame:
    """The sink's rows of frames that came too late."""
    return tracked.filter("violation is not null").select("video_id", "frame_idx", "detection", "violation")

"""The gallery plan: its kernels against plain versions, and built matches in both modes."""

import random

import numpy as np
import pytest

from vidlake.operators import gallery as gal

OBS = """scope bigint, obs bigint, clip string, kind string, team string, number string, number_consensus boolean, strong_identity boolean, video string, clip_start_s double, spans array<struct<start: double, end: double>>,
 at_s double, samples int, box struct<x1: double, y1: double, x2: double, y2: double>, holds array<string>, rejected boolean, non_player boolean, detached boolean, locked boolean, established boolean, invalidated boolean, player bigint"""
FIELDS = [f.split(" ")[0] for f in "scope obs clip kind team number number_consensus strong_identity video clip_start_s spans at_s samples box holds rejected non_player detached locked established invalidated player".split()]
PICTURE = "scope bigint, obs bigint, key string, feature array<double>, visible_parts int, quality double, frame string, view string, active boolean"


def seen(obs, **own):
    base = {"scope": 1, "obs": obs, "clip": f"c{obs}", "kind": "track", "team": None, "number": None, "number_consensus": False, "strong_identity": False, "video": None, "clip_start_s": 0.0, "spans": [(0.0, 1.0)], "at_s": float(obs * 10), "samples": 3,
            "box": None, "holds": [], "rejected": False, "non_player": False, "detached": False, "locked": False, "established": False, "invalidated": False, "player": obs}
    return tuple((base | own)[f] for f in FIELDS)


def at(angle):
    return [float(np.cos(angle)), float(np.sin(angle))]


def picture(obs, angle, key="a", **own):
    base = {"scope": 1, "obs": obs, "key": key, "feature": at(angle), "visible_parts": 4, "quality": 0.8, "frame": f"{obs}{key}", "view": None, "active": True} | own
    return tuple(base[c.strip().split(" ")[0]] for c in PICTURE.split(","))


def planned(spark, observations, pictures, **how):
    return gal.plan(spark.createDataFrame(observations, OBS), spark.createDataFrame(pictures, PICTURE), **how)


def states(p):
    return {r.obs: r for r in p.states.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_support_distance(seed):
    draw = np.random.default_rng(seed)
    sizes = [draw.integers(1, 4, 4), draw.integers(1, 4, 3)]
    d = np.round(draw.random((sizes[0].sum(), sizes[1].sum())), 1)  # ties as well
    at_ = [np.cumsum(s) - s for s in sizes]
    got = gal.support(d, *at_)
    for i in range(4):
        for j in range(3):
            block = d[at_[0][i] : at_[0][i] + sizes[0][i], at_[1][j] : at_[1][j] + sizes[1][j]]
            k = min(2, *block.shape)
            assert got[i, j] == pytest.approx(max(np.mean(sorted(block.min(axis=1))[:k]), np.mean(sorted(block.min(axis=0))[:k])))


def test_support_distances_over_blocks(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(s, u, str(k), draw.normal(size=3).tolist()) for s in (1, 2) for u in range(9) for k in range(1 + u % 3)]
    table = spark.createDataFrame(rows, "scope bigint, unit bigint, key string, feature array<double>")
    whole = {(r.scope, r.a, r.b): r.distance for r in gal.support_distances(table).collect()}
    monkeypatch.setattr(gal, "SIDE", 2)
    cut = {(r.scope, r.a, r.b): r.distance for r in gal.support_distances(table).collect()}
    assert len(whole) == 2 * 36 and whole.keys() == cut.keys()
    assert all(whole[k] == pytest.approx(cut[k]) for k in whole)


def test_templates_are_good_and_different():
    rows = [{"feature": at(0.0), "quality": 0.9, "frame": "1", "view": "front"}, {"feature": at(0.01), "quality": 0.89, "frame": "2", "view": "front"}, {"feature": at(1.0), "quality": 0.7, "frame": "3", "view": "front"},
            {"feature": at(2.0), "quality": 0.6, "frame": "4", "view": "front"}, {"feature": at(0.5), "quality": 0.65, "frame": "5", "view": "back"}, {"feature": at(3.0), "quality": 0.99, "frame": "1", "view": "left"}]
    assert gal.picked(rows, 8) == [5, 2, 3, 4] or gal.picked(rows, 8)[0] == 5
    chosen = gal.picked(rows, 8)
    assert not {0, 5} <= set(chosen) and not {0, 1} <= set(chosen)  # one frame; one look in one view
    assert sum(rows[i]["view"] == "front" for i in chosen) <= 2
    assert gal.picked(rows, 2, first=4)[0] == 4 and len(gal.picked(rows, 2)) == 2 and gal.picked(rows, 0) == []


@pytest.mark.parametrize("seed", range(20))
def test_picks_against_a_plain_greedy_choice(seed):
    draw = random.Random(seed)
    rows = [{"feature": at(draw.random() * 3), "quality": draw.choice([0.5, 0.6, 0.9]), "frame": str(draw.randint(0, 6)), "view": draw.choice([None, "unknown", "front", "back"])} for _ in range(9)]
    away = lambda i, j: 1 - np.dot(rows[i]["feature"], rows[j]["feature"])
    known = lambda i: rows[i]["view"] not in (None, "unknown")
    chosen = []
    while len(chosen) < 4:
        free = [i for i in range(9) if i not in chosen and all(rows[i]["frame"] != rows[j]["frame"] and not (away(i, j) < 0.025 and (rows[i]["view"] or "") == (rows[j]["view"] or "")) for j in chosen) and not (known(i) and sum(rows[j]["view"] == rows[i]["view"] for j in chosen) >= 2)]
        if not free:
            break
        worth = {i: rows[i]["quality"] * (1 + (min(0.3, *(away(i, j) for j in chosen)) if chosen else 0) + 0.15 * (known(i) and all(rows[j]["view"] != rows[i]["view"] for j in chosen))) for i in free}
        chosen.append(max(free, key=lambda i: (round(worth[i], 12), -i)))
    assert gal.picked(rows, 4) == chosen


def test_merging_keeps_to_rules():
    one = lambda o, **k: {"obs": o, "team": None, "number": None, "clip": f"c{o}", "consensus": False, "strong": False, "lock": None} | k
    p = gal.Policy()
    alone = lambda *m: {x["obs"]: [x] for x in m}
    sets = lambda g: sorted(sorted(m["obs"] for m in own) for own in g.values())
    assert sets(gal.merged(alone(one(1), one(2), one(3)), {(1, 2): 0.05, (1, 3): 0.9, (2, 3): 0.9}, set(), p)) == [[1, 2], [3]]
    assert sets(gal.merged(alone(one(1), one(2), one(3)), {(1, 2): 0.05, (1, 3): 0.9, (2, 3): 0.08}, set(), p)) == [[1], [2], [3]]  # a rival about as near
    assert sets(gal.merged(alone(one(1), one(2), one(3)), {(1, 2): 0.02, (1, 3): 0.2, (2, 3): 0.1}, set(), p)) == [[1, 2], [3]]  # the farthest pair counts
    assert sets(gal.merged(alone(one(1), one(2)), {(1, 2): 0.02}, {(1, 2)}, p)) == [[1], [2]]
    names = {"team": "a", "number": "7", "strong": True}
    assert sets(gal.merged(alone(one(1, **names), one(2, **names)), {(1, 2): 0.9}, set(), p)) == [[1, 2]]
    read = {"team": "a", "number": "7"}
    assert sets(gal.merged(alone(one(1, **read), one(2, **read)), {(1, 2): 0.18}, set(), p)) == [[1, 2]]  # a number read on both sides
    assert sets(gal.merged(alone(one(1, **read), one(2, team="a")), {(1, 2): 0.18}, set(), p)) == [[1], [2]]
    assert sets(gal.merged(alone(one(1, lock=1), one(2, lock=2)), {(1, 2): 0.01}, set(), p)) == [[1], [2]]


def test_full_plan_of_a_built_match(spark):
    people = [(1, 0.0), (2, 0.1), (3, 1.2), (4, 1.25), (5, 2.2)]
    observations = [seen(o) for o, _ in people] + [seen(6, holds=["blurred"]), seen(7, rejected=True), seen(8), seen(9, kind="tracklet")]
    pictures = [picture(o, a) for o, a in people] + [picture(6, 0.05), picture(7, 0.05), picture(8, 0.5, quality=0.1), picture(9, -1.2)]
    p = planned(spark, observations, pictures)
    s = states(p)
    assert s[1].grp == s[2].grp != s[3].grp == s[4].grp and s[5].grp == 5
    assert {o: s[o].status for o in s} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "accepted", 6: "pending", 7: "rejected", 8: "rejected", 9: "pending"}
    assert s[6].reasons == ["blurred"] and s[7].reasons == ["manually_rejected"] and s[8].reasons == ["no_usable_quality_templates"] and s[9].reasons == ["initial_identity_needs_team_and_number"]
    assert {(r.grp, r.obs) for r in p.templates.collect()} == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)} - {(1, 2), (3, 4)}  # too alike in one view
    assert s[1].new_player == s[2].new_player == 1 and s[3].new_player == 3


def test_both_modes_agree(spark):
    """What one batch groups in full, arrivals find one by one against the frozen groups of the rest."""
    people = [(1, 0.0), (2, 0.1), (3, 1.2), (4, 1.25), (5, 2.2), (6, 2.25)]
    pictures = [picture(o, a) for o, a in people]
    full = states(planned(spark, [seen(o) for o, _ in people], pictures))
    first = {1, 3, 5}
    later = states(planned(spark, [seen(o, established=o in first) for o, _ in people], pictures, incremental=True))
    assert {o: r.grp for o, r in full.items()} == {o: r.grp for o, r in later.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert all(r.status == "accepted" for r in later.values())


def test_arrivals_are_no_bridges_and_abstain(spark):
    # 2 is near anchor 1, 3 near 2 only; 5 lies between anchors 1 and 4; 7 and 8 claim one moment of anchor 6
    where = [(1, 0.0), (2, 0.4), (3, 0.8), (4, 0.5), (5, 0.25), (6, 2.0), (7, 2.05), (8, 1.95)]
    observations = [seen(o, established=o in (1, 4, 6)) for o, _ in where[:6]] + [seen(7, clip="x"), seen(8, clip="x")]
    s = states(planned(spark, observations, [picture(o, a) for o, a in where], incremental=True, policy=gal.Policy(strong=0.1)))
    assert s[3].grp == 4 or s[3].grp == 3
    assert s[5].grp == 5 and s[7].grp == 7 and s[8].grp == 8
    assert s[5].status == s[7].status == "pending"


def test_duplicates_overlaps_and_claims(spark):
    box, over, far = (0.0, 0.0, 100.0, 200.0), (2.0, 0.0, 102.0, 200.0), (40.0, 0.0, 140.0, 200.0)
    observations = [seen(1, kind="photo", clip="a", box=box), seen(2, kind="photo", clip="a", box=over), seen(3, kind="photo", clip="b", box=box), seen(4, kind="photo", clip="b", box=far),
                    seen(5, clip="d", team="x", number="9", strong_identity=True), seen(6, clip="d", team="x", number="9", strong_identity=True)]
    pictures = [picture(1, 0.0, quality=0.9), picture(2, 0.05, quality=0.7), picture(3, 1.0), picture(4, 2.0), picture(5, 3.0), picture(6, 4.0)]
    s = states(planned(spark, observations, pictures))
    assert (s[2].status, s[2].duplicate_of, s[2].new_player) == ("duplicate", 1, s[1].new_player)
    assert s[3].reasons == s[4].reasons == ["overlapping_person_targets"]
    assert s[5].reasons == s[6].reasons == ["simultaneous_strong_identity_conflict"]


def test_names_and_hand_made_groups(spark):
    observations = [seen(1, player=10), seen(2, player=10), seen(3, player=10, locked=True), seen(4, player=11), seen(5, player=None)]
    pictures = [picture(1, 0.0), picture(2, 0.05), picture(3, 1.5), picture(4, 2.5), picture(5, -2.5)]
    s = states(planned(spark, observations, pictures))
    assert s[3].new_player == 10 and s[4].new_player == 11
    assert s[1].new_player == s[2].new_player == 12 and s[5].new_player == 13  # 10 is taken


def test_nothing_to_plan(spark):
    p = planned(spark, [], [])
    assert p.states.collect() == [] and p.groups.collect() == [] and p.templates.collect() == []

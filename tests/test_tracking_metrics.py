"""Tracking metrics against cases with known values and against exhaustive search."""

from itertools import permutations

import numpy as np
import pytest

from vidlake.operators import tracking_metrics as tm

SCHEMA = "seq string, t bigint, gt_id bigint, tr_id bigint, sim double"


def rows_of(name, gt, tr, sim):
    """gt, tr: frames by ids, 1 where present; sim: (truth, track) -> one value a frame."""
    out = []
    for t in range(len(gt[0])):
        a, b = [i for i, x in enumerate(gt) if x[t]], [j for j, x in enumerate(tr) if x[t]]
        out += [(name, t, i, j, float(sim.get((i, j), [0] * 9)[t])) for i in a for j in b]
        out += [(name, t, i, None, 0.0) for i in a if not b] + [(name, t, None, j, 0.0) for j in b if not a]
    return out


TWO = ([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], [[1, 1, 1, 1, 0], [1, 1, 1, 1, 1]])
APART = {(0, 1): [0, 0, 0, 1, 1], (1, 0): [1, 1, 0, 0, 0]}
# The results that these small sequences must have.
KNOWN = {
    "apart": (rows_of("apart", *TWO, APART), {"tp": 4, "fn": 4, "fp": 5, "idsw": 0, "mota": 1 - 9 / 8}, {"idtp": 4, "idfn": 4, "idfp": 5, "idr": 4 / 8, "idp": 4 / 9, "idf1": 2 * 4 / 17}, {"stda": 2 / 5 + 2 / 4, "ata": (2 / 5 + 2 / 4) / 2}),
    "mixed": (rows_of("mixed", *TWO, APART | {(0, 0): [0, 0, 1, 0, 0], (1, 1): [0, 1, 0, 0, 0]}), {"tp": 5, "fn": 3, "fp": 4, "idsw": 1, "mota": 0}, {"idtp": 4, "idfn": 4, "idfp": 5, "idf1": 2 * 4 / 17}, {"stda": 2 / 5 + 2 / 4}),
    "split": (
        rows_of("split", [[1, 1, 0, 1, 1], [1, 1, 1, 1, 1]], [[1, 1, 0, 0, 0], [0, 0, 1, 1, 1], [0, 0, 0, 0, 1], [0, 0, 1, 1, 1], [1, 1, 0, 0, 0]],
                {(0, 0): [1, 1, 0, 0, 0], (0, 3): [0, 0, 0, 1, 1], (1, 1): [0, 0, 1, 1, 0], (1, 2): [0, 0, 0, 0, 1], (1, 4): [1, 1, 0, 0, 0]}),
        {"tp": 9, "fn": 0, "fp": 2, "idsw": 3, "mota": 1 - 5 / 9}, {"idtp": 4, "idfn": 5, "idfp": 7, "idr": 4 / 9, "idp": 4 / 11, "idf1": 2 * 4 / 20}, {"stda": 2 / 4 + 2 / 5, "ata": (2 / 4 + 2 / 5) / (0.5 * (2 + 5))}),
    "same": (rows_of("same", [[1] * 5] * 2, [[1] * 5] * 2, {(i, i): [1] * 5 for i in (0, 1)}), {"tp": 10, "fn": 0, "fp": 0, "idsw": 0, "mt": 2, "frag": 0, "fp_per_frame": 0}, {"idtp": 10, "idfn": 0, "idfp": 0}, {"ata": 1, "sfda": 1}),
    "none": ([("none", t, 1, None, 0.0) for t in range(2)], {"tp": 0, "fn": 2, "fp": 0, "ml": 1, "mlr": 1}, {"idtp": 0, "idfn": 2, "idfp": 0}, {"stda": 0, "sfda": 0}),
    "gone": ([("gone", t, 1, 1, 0.9 if t in (0, 1, 4) else 0.1) for t in range(5)], {"tp": 3, "pt": 1, "frag": 1, "idsw": 0, "frames": 5, "fp_per_frame": 2 / 5}, {"idtp": 3}, {}),
}


@pytest.fixture(scope="module")
def known(spark):
    sim = spark.createDataFrame([r for rows, *_ in KNOWN.values() for r in rows], SCHEMA)
    by = lambda d: {r["seq"]: r for r in d.collect()}
    return by(tm.clear_finals(tm.clear(sim))), by(tm.identity_finals(tm.identity(sim))), by(tm.vace_finals(tm.vace(sim))), tm.hota(sim), sim


@pytest.mark.parametrize("name", KNOWN)
def test_known_values(known, name):
    for got, wanted in zip(known[:3], KNOWN[name][1:], strict=True):
        for field, value in wanted.items():
            assert got[name][field] == pytest.approx(value), (name, field)


def test_hota(known):
    rows = {(r["seq"], round(r["alpha"], 2)): r for r in known[3].collect()}
    assert len(rows) == 19 * len(KNOWN)
    assert rows["same", 0.05]["tp"] == 10 and rows["same", 0.95]["ass_a"] == pytest.approx(10)
    assert rows["none", 0.5]["fn"] == 2 and rows["none", 0.5]["tp"] == 0
    assert rows["gone", 0.1]["tp"] == 5 and rows["gone", 0.15]["tp"] == 3 and rows["gone", 0.95]["tp"] == 0
    # a truth that two tracks follow: 2 of its 4 frames each
    assert rows["split", 0.5]["ass_a"] == pytest.approx(2 * 2 / 4 + 2 * 2 / (4 + 3 - 2) + 2 * 2 / (5 + 3 - 2) + 1 / 5 + 2 * 2 / 5)
    final = {r["seq"]: r for r in tm.hota_finals(known[3], ["seq"]).collect()}
    assert all(final["same"][x] == pytest.approx(1) for x in ("hota", "det_a", "ass_a", "rhota", "hota_0", "loc_a_0", "hota_loc_a_0"))
    assert final["gone"]["hota_0"] == pytest.approx(1) and final["gone"]["loc_a_0"] == pytest.approx((3 * 0.9 + 2 * 0.1) / 5)


def test_heaviest_pairing_by_exhaustive_search():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        n, m = rnd.integers(1, 5, 2)
        gt, tr = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m)))
        keep = rnd.random(len(gt)) < 0.6
        gt, tr, w = gt[keep], tr[keep], rnd.integers(1, 20, len(gt))[keep].astype(float)
        full = np.zeros((5, 5))
        full[gt, tr] = w
        best = max(sum(full[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        ok = tm.heaviest(gt, tr, w)
        assert w[ok].sum() == best and len(set(gt[ok])) == len(set(tr[ok])) == ok.sum()


def test_clear_keeps_pairs_that_last(spark):
    """Frame by frame, a plain version: valid old pairs stay, the rest by exhaustive search."""
    rnd = np.random.default_rng(7)
    rows = [("s", t, i, j, float(np.round(rnd.random(), 3))) for t in range(30) for i in range(3) for j in range(3)]
    got = {(r["t"], r["gt_id"], r["tr_id"]) for r in tm.clear_matches(tm.frames(spark.createDataFrame(rows, SCHEMA))).collect()}
    last, wanted = {}, set()
    for t in range(30):
        sim = {(i, j): x for _, u, i, j, x in rows if u == t and x >= 0.5}
        kept = {i: j for i, j in last.items() if (i, j) in sim}
        free = [i for i in range(3) if i not in kept]
        choices = [dict(zip(free, p, strict=False)) for p in permutations([j for j in range(3) if j not in kept.values()], len(free))]
        best = max(choices, key=lambda c: sum(sim.get(x, 0) for x in c.items()))
        last = kept | {i: j for i, j in best.items() if (i, j) in sim}
        wanted |= {(t, i, j) for i, j in last.items()}
    assert got == wanted


def test_nothing(spark):
    sim = spark.createDataFrame([], SCHEMA)
    assert tm.clear(sim).count() == 0 and tm.hota(sim).count() == 0 and tm.vace(sim).count() == 0

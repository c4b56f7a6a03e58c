"""Matching as plans against the search of a small table on the driver, and the gates against all pairs."""

from itertools import combinations, permutations

import numpy as np
import pytest

from karst.operators import constellations, geometry, landmarks

KIND = "id long, x double, y double, z double"


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], KIND)


def two(seed, n=9, stray=3, turn=((0, 0, 1), 0.7)):
    """a, b: n landmarks of a, those of b moved back and a little off, and stray ones on both sides."""
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 60, (n + stray, 3))
    m = geometry.motion(geometry.about(*turn), (5, -8, 2))
    back = geometry.invert(m)
    b = a[:n] @ back[:3, :3].T + back[:3, 3] + rng.uniform(-0.05, 0.05, (n, 3))
    return a, np.concatenate([b, rng.uniform(0, 60, (stray, 3))]), m


@pytest.mark.parametrize("mode,turn", [("4dof", ((0, 0, 1), 0.7)), ("6dof", ((0.2, 0.5, 0.8), 1.1))])
def test_best_motion_equals_the_search(spark, mode, turn):
    a, b, _ = two(3, turn=turn)
    got = constellations.best_motion(frame(spark, a), frame(spark, b), mode, 0.4).first()
    want = landmarks.match(a, b, mode, 0.4)
    assert [(p["b"], p["a"]) for p in got["pairs"]] == want.inliers and got["n"] == 9
    assert (got["mode"], got["margin"]) == (mode, want.margin)
    assert abs(got["rms"] - want.rms) < 1e-9
    matrix = [[*(got[f"r{i}{j}"] for j in range(3)), got[f"t{t}"]] for i, t in enumerate("xyz")]
    assert np.allclose(matrix, want.matrix[:3], atol=1e-9)


def test_auto_takes_the_turn_that_four_degrees_cannot_make(spark):
    a, b, _ = two(4, n=6, stray=1, turn=((1, 0.3, 0.2), 1.4))
    got = constellations.best_motion(frame(spark, a), frame(spark, b), "auto", 0.4).first()
    assert (got["mode"], got["n"]) == ("6dof", 6)
    a, b, _ = two(5, n=5, stray=1)
    assert constellations.best_motion(frame(spark, a), frame(spark, b), "auto", 0.4).first()["mode"] == "4dof"


def test_gates_equal_all_pairs_and_triplets_whatever_the_tiles(spark, monkeypatch):
    a, b, _ = two(6, n=5, stray=2)
    da, db = (np.linalg.norm(p[:, None] - p[None], axis=2) for p in (a, b))
    pairs = {(i, j, p, q) for i, j in permutations(range(7), 2) for p, q in combinations(range(7), 2) if abs(da[i, j] - db[p, q]) <= 1.5}
    triplets = {
        (*s, *t) for s in permutations(range(7), 3) for t in combinations(range(7), 3) if all(abs(da[s[u], s[v]] - db[t[u], t[v]]) <= 1.5 for u, v in ((0, 1), (0, 2), (1, 2)))
    }
    for tile in (4096, 2):
        monkeypatch.setattr(constellations, "TILE", tile)
        fa, fb = frame(spark, a), frame(spark, b)
        got = [tuple(r)[:4] for r in constellations.pair_gate(fa, fb, 1.5).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        got = [tuple(r) for r in constellations.triplet_gate(fa, fb, 1.5).collect()]
        assert len(got) == len(set(got)) and set(got) == triplets
        assert constellations.best_motion(fa, fb, "4dof", 0.4).first()["n"] == 5


def test_two_landmarks_that_want_the_same_leave_it_to_the_nearer(spark):
    a = frame(spark, [(0, 0, 0), (10, 0, 0)])
    b = frame(spark, [(0.3, 0, 0), (0.1, 0, 0), (10.2, 0, 0), (50, 0, 0)])
    still = spark.createDataFrame([("m", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "motion string, " + ", ".join(f"{c} double" for c in constellations.MOTION))
    got = {(r["b_id"], r["a_id"]) for r in constellations.inliers(still, a, b, 0.5).collect()}
    assert got == {(1, 0), (2, 1)}


def test_shapes_decide_between_equal_motions(spark):
    # a rectangle fits itself turned by half; only the areas tell which way round
    rows = [(0, 0.0, 0.0, 0.0, 1.0), (1, 8.0, 0.0, 0.0, 2.0), (2, 8.0, 5.0, 0.0, 3.0), (3, 0.0, 5.0, 0.0, 4.0)]
    mark = spark.createDataFrame([(*r, 2.0, 1.0, 0.0) for r in rows], f"{KIND}, area double, semi_major double, semi_minor double, orientation double")
    got = constellations.best_motion(mark, mark, "4dof", 0.1).first()
    assert [(p["b"], p["a"]) for p in got["pairs"]] == [(i, i) for i in range(4)]
    assert got["margin"] == 0 and got["shape"] == 0


def test_nothing_to_match(spark):
    a, b, _ = two(7, n=4, stray=0)
    none = spark.createDataFrame([], KIND)
    assert constellations.best_motion(none, frame(spark, b), "auto").collect() == []
    assert constellations.best_motion(frame(spark, a), frame(spark, b), "4dof", 0.4, least=5).collect() == []
    holes = frame(spark, a).unionAll(spark.createDataFrame([(9, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], KIND))
    assert constellations.best_motion(holes, frame(spark, b), "4dof", 0.4).first()["n"] == 4
    with pytest.raises(ValueError):
        constellations.best_motion(none, none, "5dof")

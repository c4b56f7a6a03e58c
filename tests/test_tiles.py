"""Rasters in tiles against loops over the whole raster."""

import numpy as np
import pytest

from karst.operators import tiles


def raster(spark, mask, values=None, low=(-5, 3)):
    ix, iy = mask.nonzero()
    v = np.zeros(len(ix)) if values is None else values[ix, iy]
    rows = list(zip((ix + low[0]).tolist(), (iy + low[1]).tolist(), v.tolist(), strict=True))
    return spark.createDataFrame(rows, "ix long, iy long, v double").repartition(3)


def flood(mask):
    """4-connected components by their first cell in row order."""
    name = np.full(mask.shape, -1)
    for i, j in zip(*mask.nonzero(), strict=True):
        if name[i, j] < 0:
            todo = [(i, j)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and name[a, b] < 0:
                    name[a, b] = i * 1000 + j
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return name


def spiral(n):
    mask = np.zeros((n, n), bool)
    i = j = 0
    di, dj = 0, 1
    mask[0, 0] = True
    while True:
        a, b = i + di, j + dj
        if not (0 <= a < n and 0 <= b < n) or mask[a, b] or (0 <= a + di < n and 0 <= b + dj < n and mask[a + di, b + dj]):
            di, dj = dj, -di
            a, b = i + di, j + dj
            if not (0 <= a < n and 0 <= b < n) or mask[a, b] or (0 <= a + di < n and 0 <= b + dj < n and mask[a + di, b + dj]):
                return mask
        i, j = a, b
        mask[i, j] = True


MASKS = {"random": np.random.default_rng(0).random((23, 31)) < 0.6, "spiral": spiral(21), "full": np.ones((9, 9), bool), "cell": np.ones((1, 1), bool), "frame": np.pad(np.zeros((15, 18), bool), 2, constant_values=True)}


@pytest.mark.parametrize(("kind", "side"), [("random", 7), ("spiral", 5), ("frame", 4), ("cell", 4)])
def test_components_and_enclosed_cells(spark, kind, side):
    mask, low = MASKS[kind], (-5, 3)
    got = {(r["ix"] - low[0], r["iy"] - low[1]): r["component"] for r in tiles.label(raster(spark, mask), side).collect()}
    want = flood(mask)
    key = lambda x: ((int(x) // 1000 + low[0]) << 32) + int(x) % 1000 + low[1]
    assert got == {(int(i), int(j)): key(want[i, j]) for i, j in zip(*mask.nonzero(), strict=True)}
    void = flood(~mask)
    outer = set(np.concatenate([void[0], void[-1], void[:, 0], void[:, -1]]).tolist())
    want = {(int(i), int(j)): key(void[i, j]) for i, j in zip(*(~mask).nonzero(), strict=True) if void[i, j] not in outer}
    assert {(r["ix"] - low[0], r["iy"] - low[1]): r["component"] for r in tiles.enclosed(raster(spark, mask), side).collect()} == want


@pytest.mark.parametrize(("size", "side"), [(9, 4), (41, 16), (4, 100)])
def test_medians_of_windows(spark, size, side):
    rng = np.random.default_rng(size)
    mask, values, half = rng.random((19, 26)) < 0.5, rng.integers(0, 30, (19, 26)).astype(float), size // 2
    mask[[0, -1]], mask[:, [0, -1]] = True, True
    got = {(r["ix"] + 5, r["iy"] - 3): r["median"] for r in tiles.median_filter(raster(spark, mask, values), size, "v", side).collect()}
    full = np.pad(np.where(mask, values, np.nan), half, mode="edge")
    want = {}
    for i, j in np.ndindex(mask.shape):
        near = full[i : i + 2 * half + 1, j : j + 2 * half + 1]
        if not np.isnan(near).all():
            want[i, j] = float(np.nanmedian(near))
    assert got == want


@pytest.mark.parametrize("kinds", [1, 3, 400])
def test_window_medians_of_ties_and_gaps(kinds):
    rng = np.random.default_rng(kinds)
    for size in (1, 2, 5, 9):
        v = rng.integers(0, kinds, (25, 17)).astype(float)
        v[rng.random(v.shape) < 0.6] = np.nan
        near = np.lib.stride_tricks.sliding_window_view(v, (size, size))
        want = np.array([[np.median(w[~np.isnan(w)]) if (~np.isnan(w)).any() else np.nan for w in row] for row in near])
        assert np.array_equal(tiles.window_medians(v, size), want, equal_nan=True)

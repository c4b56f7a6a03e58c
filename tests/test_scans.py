"""Scans of one sequence against plain loops, over blocks shorter and longer than frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.operators import curves, scans


def line(spark, n, seed=0, keys=1):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(s), "abc"[int(c)], float(v), None if m else float(v)) for k, s, c, v, m in zip(rng.integers(0, keys, n), rng.permutation(n) * 3, rng.integers(0, 3, n) // 2 * 2, rng.integers(0, 50, n), rng.random(n) < 0.3, strict=True)]
    df = spark.createDataFrame(rows, "k long, s long, c string, v double, m double").repartition(3)
    return df, sorted(rows)


def column(df, *names):
    return [tuple(r) for r in df.orderBy("k", "s").select(*names).collect()]


@pytest.mark.parametrize(("n", "size"), [(0, 4), (1, 4), (40, 7), (41, 1 << 16)])
def test_scans_of_one_sequence(spark, n, size):
    df, rows = line(spark, n)
    v, c = [r[3] for r in rows], [r[2] for r in rows]
    steps = [0.0, *(abs(b - a) for a, b in zip(v, v[1:], strict=False))][:n]
    assert column(scans.arc_length(df, "s", ["v"], size=size), "step", "arc") == list(zip(steps, np.cumsum(steps).tolist(), strict=True))
    run = np.cumsum([i == 0 or c[i] != c[i - 1] for i in range(n)]).tolist()
    assert column(scans.islands(df, "s", "c", size=size), "run") == [(x,) for x in run]
    top = [max(v[:i], default=None) for i in range(n)]
    assert column(scans.running_max_flag(df, "s", "v", 5.0, size=size), "top", "near_top") == [(t, t is None or x >= t - 5) for t, x in zip(top, v, strict=True)]
    slope = column(scans.gradient(df, "s", "v", size=size), "gradient")
    assert slope == ([(x,) for x in np.gradient(v).tolist()] if n > 1 else [(None,)] * n)
    gaps = np.cumsum([i > 0 and rows[i][1] - rows[i - 1][1] > 3 for i in range(n)]).tolist()
    assert column(scans.sessions(df, "s", 3, size=size), "cluster") == [(x,) for x in gaps]


@pytest.mark.parametrize("edge", ["nearest", "reflect"])
@pytest.mark.parametrize(("n", "half", "size"), [(3, 5, 2), (25, 9, 4)])
def test_medians_of_frames(spark, n, half, size, edge):
    df, rows = line(spark, n, 1)
    v = np.array([r[3] for r in rows])
    padded = np.pad(v, half, {"nearest": "edge", "reflect": "symmetric"}[edge])
    want = [(float(np.median(padded[i : i + 2 * half + 1])),) for i in range(n)]
    assert column(scans.median_filter(df, "s", "v", half, edge, size), "median") == want
    # and of a key, which may be shorter than the frame
    assert column(curves.median_filter(df, "s", "v", half, ["k"], edge), "median") == want


def test_sinuosity_reaches_over_blocks(spark):
    df, rows = line(spark, 30, 2)
    v = [r[3] for r in rows]
    want = []
    for i in range(30):
        own = v[max(i - 3, 0) : i + 4]
        path, chord = sum(abs(b - a) for a, b in zip(own, own[1:], strict=False)), abs(own[-1] - own[0])
        want.append(path / chord if len(own) >= 0.9 * 7 and chord else None)
    for size in (2, 5):
        assert [x for (x,) in column(scans.sinuosity(df, "s", ["v"], 3, size=size), "sinuosity")] == pytest.approx(want)


def test_keys_of_any_size_start_anew(spark):
    df, rows = line(spark, 80, 3, keys=3)
    got = scans.Line.of(df, ["s"], ["k"], 9).running(n=("sum", F.lit(1)), last=("last", F.col("m")), low=("min", F.col("v"))).done()
    want = []
    for i, r in enumerate(rows):
        own = [x for x in rows[: i + 1] if x[0] == r[0]]
        want.append((len(own), next((x[4] for x in own[::-1] if x[4] is not None), None), min(x[3] for x in own)))
    assert column(got, "n", "last", "low") == want


def test_many_blocks_are_scanned_in_blocks_again(spark):
    df, rows = line(spark, 70, 4)  # 35 blocks of two rows, summed over blocks of two, and so on
    got = scans.Line.of(df, ["s"], size=2).running(sum=("sum", F.col("v"))).done()
    assert column(got, "sum") == [(x,) for x in np.cumsum([r[3] for r in rows]).tolist()]


def test_no_window_without_a_key_over_rows(spark):
    df, _ = line(spark, 50, 5)
    plan = scans.arc_length(df, "s", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in x or "_pos" in x for x in plan.split("\n") if "Window" in x)

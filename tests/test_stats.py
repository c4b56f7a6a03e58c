"""Aggregates against numpy, on sizes and rows that are odd."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import stats


def drawn(n, rounds, block, seed=7):
    """Each round's positions, drawn one by one."""
    k = np.arange(-(-n // block))
    for b in range(rounds):
        s = (b * 7919 + k * 104729 + seed) * 16807 % 2147483647 * 48271 % 2147483647 % (n - block + 1)
        yield (s[:, None] + np.arange(block)).ravel()[:n]


@pytest.mark.parametrize(("n", "rounds", "block"), [(600_000, 2, 1), (2_500, 9, 10), (1, 3, 1)])
def test_bootstrap_draws_as_many_as_there_are(spark, n, rounds, block):
    # at 600,000 the draws were once a literal of the plan, which the driver could not hold
    rows = spark.range(n).select("id", F.when(F.col("id") % 7 != 3, F.col("id") * 7919 % 1013 / 8).alias("v"))
    v = np.array([i * 7919 % 1013 / 8 if i % 7 != 3 else np.nan for i in range(n)])
    want = np.percentile([np.nanmedian(v[i]) for i in drawn(n, rounds, block)], [2.5, 97.5])
    got = stats.bootstrap(rows, "id", "v", n, rounds, block).first()
    assert got["rounds"] == rounds and np.allclose([got["p2"], got["p98"]], want, rtol=0, atol=1e-9)


def test_bootstrap_of_missing_repeated_and_no_rows(spark):
    rows = spark.createDataFrame([(0, 4.0), (0, 9.0), (2, None), (3, float("inf")), (4, -0.5), (None, 1.0), (9, 2.0)], "id long, v double")
    values = {0: [4.0, 9.0], 3: [np.inf], 4: [-0.5]}
    rounds = [[v for i in ids for v in values.get(int(i), [])] for ids in drawn(5, 8, 1)]
    want = sorted(np.median(r) for r in rounds if r)
    got = stats.bootstrap(rows, "id", "v", 5, 8, 1, shares=(0.0, 1.0)).first()
    assert (got["p0"], got["p100"]) == (want[0], want[-1]) and got["rounds"] == sum(bool({0, 2, 3, 4} & set(ids.tolist())) for ids in drawn(5, 8, 1))
    for n, block in ((0, 1), (9, 10)):
        assert tuple(stats.bootstrap(rows.limit(0), "id", "v", n, 3, block).first()) == (None, None, 0)


def test_blocks_of_many_stations(spark):
    n, rounds, block = 600_000, 2, 10
    v = np.arange(n) * 7919 % 1013 / 8
    want = np.percentile([np.median(v[i]) for i in drawn(n, rounds, block)], [2.5, 97.5])
    got = stats.bootstrap(spark.range(n).select("id", (F.col("id") * 7919 % 1013 / 8).alias("v")), "id", "v", n, rounds, block).first()
    assert got["rounds"] == rounds and np.allclose([got["p2"], got["p98"]], want, rtol=0, atol=1e-9)


def test_halves_are_rounded_as_in_sql(spark):
    import duckdb

    values = [34.68975, -34.68975, 0.00005, 1.00005, 2.5, 1e15 + 0.5, float("inf"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = [r["r"] for r in rows.select("k", C.rounded("v", 4).alias("r")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values] and got[0] == 34.6897


def test_percentiles_of_rounds_are_interpolated_as_in_sql(spark):
    import duckdb

    # weighed from both ends, p98 was 34.79024999999999, which rounds to the other side
    v = np.array([34.79 if k % 4 else 34.8 for k in range(11)])
    medians = [float(np.median(v[i])) for i in drawn(11, 40, 1)]
    want = duckdb.execute("SELECT quantile_cont(m, 0.025), quantile_cont(m, 0.975) FROM (SELECT unnest(?::DOUBLE[]) AS m)", [medians]).fetchone()
    rows = spark.createDataFrame(list(enumerate(v.tolist())), "id long, v double")
    got = stats.bootstrap(rows, "id", "v", 11, 40)
    assert tuple(got.select("p2", "p98").first()) == want and got.select(C.rounded("p98", 4)).first()[0] == 34.7903


def test_interpolation_as_in_sql():
    import duckdb

    rng = np.random.default_rng(3)
    low = rng.integers(1, 10_000, 300) / 100
    pairs = [(-np.inf, 1.0), (1.0, np.inf), (np.inf, np.inf), (-1e308, 1e308), (34.79, 34.8), (2.0, 2.0), (34.68975, 34.68975), *zip(low, low + rng.integers(0, 300, 300) / 100, strict=True)]
    for part in (0.025, 0.3, 0.5, 0.975):
        want = [duckdb.execute(f"SELECT quantile_cont(m, {part}) FROM (SELECT unnest(?::DOUBLE[]) AS m)", [list(map(float, p))]).fetchone()[0] for p in pairs]
        assert [stats.between(*map(float, p), part) for p in pairs] == want


def test_a_round_is_the_sql_s_with_its_range_lifted(spark):
    import duckdb

    from karst.plans.queries import BOOT, DRAW

    # the SQL ends at 100,000 draws a round: the query is not cut to that
    rows = spark.range(120_000).select("id", (F.col("id") * 7919 % 1013 / 8).alias("v"))
    assert "range(0, 100000)" in DRAW
    sql = (BOOT + DRAW.replace("BLOCK", "1").replace("range(0, 100000)", "range(0, 120000)")).replace("WITH r AS", "WITH stn AS (SELECT i AS s, (i * 7919 % 1013) / 8.0::DOUBLE AS value FROM range(0, 120000) AS g(i)), r AS")
    got = stats.bootstrap(rows, "id", "v", 120_000, 40).select(C.rounded("p2", 4), C.rounded("p98", 4), "rounds").first()
    assert tuple(got) == duckdb.execute(sql).fetchone()

"""Processes on inducing points against dense algebra."""

import numpy as np
import pytest

from tidewell.operators import gridmodels
from tidewell.operators.kernels import matern32
from tidewell.plans.building import k3_hours

SCALE, AMPLITUDE, NOISE = [0.7, 1.3], 0.8, 0.05


def dense(x, y, at):
    """Mean and sd of the full process."""
    k = AMPLITUDE * matern32(x, x, np.array(SCALE)) + NOISE * np.eye(len(x))
    cross = AMPLITUDE * matern32(at, x, np.array(SCALE))
    return cross @ np.linalg.solve(k, y), np.sqrt(np.maximum(AMPLITUDE - (cross * np.linalg.solve(k, cross.T).T).sum(1), 0))


def made(spark, groups=3, n=40):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (n, 2))
    rows = [(h, i, *x[i].tolist(), float(np.sin(3 * x[i, 0]) + 0.2 * h + 0.1 * rng.standard_normal()) if i % 3 else None, 0.2 * h) for h in range(groups) for i in range(n)]
    return x, rows, spark.createDataFrame(rows, "hour int, site int, a double, b double, y double, mean double").repartition(5)


def test_all_rows_as_points_are_the_full_process(spark):
    x, rows, df = made(spark)
    for model_bytes in (64 << 20, 1):  # one pack, and one a group
        got = {(r["hour"], r["site"]): (r["mu"], r["sd"]) for r in gridmodels.grid_process(df, "hour", ["a", "b"], "y", "mean", SCALE, AMPLITUDE, NOISE, points=x, model_bytes=model_bytes).collect()}
        assert len(got) == len(rows)
        for h in range(3):
            own = [r for r in rows if r[0] == h]
            seen = [r for r in own if r[4] is not None]
            mu, sd = dense(np.array([r[2:4] for r in seen]), np.array([r[4] - r[5] for r in seen]), x)
            assert np.allclose([got[h, i][0] for i in range(40)], mu + 0.2 * h, atol=1e-5)
            assert np.allclose([got[h, i][1] for i in range(40)], sd, atol=1e-4)


def test_few_points_come_near_and_bands_cover(spark):
    x, rows, df = made(spark, 2, 300)
    out = gridmodels.grid_process(df, "hour", ["a", "b"], "y", "mean", SCALE, AMPLITUDE, NOISE, most=40).collect()
    off = np.array([np.sin(3 * r["a"]) + 0.2 * r["hour"] - r["mu"] for r in out])
    assert np.sqrt((off**2).mean()) < 0.08 and np.mean([abs(o) <= 2.6 * r["sd"] + 0.05 for o, r in zip(off, out, strict=True)]) > 0.95


def test_groups_without_readings_and_empty_tables(spark):
    _, _, df = made(spark, 1, 10)
    odd = df.unionByName(spark.createDataFrame([(9, 1, 0.1, 0.2, None, 4.0), (None, 2, 0.1, 0.2, 1.0, 5.0)], df.schema))
    got = {r["site"]: r for r in gridmodels.grid_process(odd, "hour", ["a", "b"], "y", "mean", SCALE, AMPLITUDE, NOISE).where("hour is null or hour = 9").collect()}
    assert got[1]["mu"] == 4.0 and got[2]["mu"] == 5.0 and got[1]["sd"] == pytest.approx(np.sqrt(AMPLITUDE))
    assert gridmodels.grid_process(df.limit(0), "hour", ["a", "b"], "y", "mean", SCALE).count() == 0


def test_points_are_a_fixed_choice(spark):
    _, _, df = made(spark)
    one, two = (gridmodels.inducing_points(d, ["a", "b"], 7) for d in (df, df.repartition(2)))
    assert one.shape == (7, 2) and (one == two).all()


def test_query_is_dense_where_points_allow(spark):
    """The query's rows of the smallest tables, of which a label's vectors are fewer than its points, against the dense process on the same points' span."""
    out = k3_hours(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len({r["site"] for r in out}) and all(r["low"] <= r["mu"] <= r["high"] for r in out)

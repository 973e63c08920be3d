"""Resampled trees against loops over draws, and georeferences against refits."""

import hashlib

import numpy as np
import pytest

from tidewell.operators import geometry, trees


def test_each_level_is_resampled_by_the_same_draws(spark):
    rows = [(f"s{i % 5}", "A" if i % 3 else "B", i % 4, float(i % 7), float(i % 2 if i % 3 == 0 else 1 + i % 5)) for i in range(60)] + [(None, "A", 1, 1.0, 1.0), ("s1", "C", 1, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "seed string, model string, month int, top double, bottom double")
    got = {(r["depth"], r["model"], r["month"]): r for r in trees.bootstrap_tree(df, "seed", [[], ["model"], ["model", "month"]], "top", "bottom", draws=60).collect()}
    seeds = sorted({r[0] for r in rows if r[0]})
    picks = [[seeds[int(hashlib.md5(f"{d}-{i}".encode()).hexdigest()[:8], 16) % 5] for i in range(1, 6)] for d in range(1, 61)]
    keys = {(0, None, None)} | {(1, r[1], None) for r in rows} | {(2, r[1], r[2]) for r in rows}
    assert set(got) == keys
    for depth, model, month in keys:
        own = [r for r in rows if (model is None or r[1] == model) and (month is None or r[2] == month)]
        values = []
        for pick in picks:
            top, bottom = (sum(r[k] * pick.count(r[0]) for r in own if r[0]) for k in (3, 4))
            if bottom:
                values.append(top / bottom)
        row = got[depth, model, month]
        assert row["valid"] == len(values) and row["invalid"] == 60 - len(values)
        whole = sum(r[4] for r in own)
        assert row["ratio"] == (pytest.approx(sum(r[3] for r in own) / whole) if whole else None)
        if values:
            assert (row["lo"], row["hi"]) == (pytest.approx(np.quantile(values, 0.05)), pytest.approx(np.quantile(values, 0.95)))
    assert got[1, "C", None]["valid"] == 0 and trees.bootstrap_tree(df.limit(0), "seed", [[]], "top", "bottom", 10).count() == 0


def test_left_out_is_a_refit_without_the_point(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 100, (8, 2))
    u = x @ np.array([[0.9, 0.2], [-0.1, 1.1]]) + 5 + rng.standard_normal((8, 2))
    pairs = spark.createDataFrame([(i, *x[i].tolist(), *u[i].tolist()) for i in range(8)] + [(99, None, 1.0, 1.0, 1.0)], "id int, x double, y double, u double, v double")
    fit, found = geometry.georeference(pairs)
    whole = {r["target"]: (r["a"], r["b"], r["c"]) for r in fit.collect()}
    plain = np.linalg.lstsq(np.column_stack((x, np.ones(8))), u, rcond=None)[0]
    assert np.allclose([whole["u"], whole["v"]], plain.T)
    for r in found.collect():
        rest = np.arange(8) != r["id"]
        f = np.linalg.lstsq(np.column_stack((x[rest], np.ones(7))), u[rest], rcond=None)[0]
        assert r["left_out"] == pytest.approx(np.hypot(*(u[r["id"]] - np.append(x[r["id"]], 1) @ f)))
    moved = {r["id"]: (r["u"], r["v"]) for r in geometry.apply_affine(pairs.where("id < 8").select("id", "x", "y"), fit).collect()}
    assert np.allclose([moved[i] for i in range(8)], np.column_stack((x, np.ones(8))) @ plain)


def test_a_point_that_decides_alone_has_no_left_out(spark):
    rows = [(float(i), 0.0, float(i), 1.0) for i in range(4)] + [(0.0, 9.0, 3.0, 3.0)]
    _, found = geometry.georeference(spark.createDataFrame(rows, "x double, y double, u double, v double"))
    assert [r["left_out"] is None for r in sorted(found.collect(), key=lambda r: r["y"])] == [False] * 4 + [True]


def test_refusals_and_places(spark):
    make = lambda rows: spark.createDataFrame([(float(a), float(b), 0.0, 0.0) for a, b in rows], "x double, y double, u double, v double")
    with pytest.raises(ValueError, match="2 distinct"):
        geometry.georeference(make([(0, 0), (0.5, 0), (9, 9), (9, 9.2)]))
    with pytest.raises(ValueError, match="one line"):
        geometry.georeference(make([(0, 0), (5, 5), (9, 9), (20, 20)]))
    with pytest.raises(ValueError, match="0 distinct"):
        geometry.georeference(make([]) if False else make([(0, 0)]).limit(0))
    assert geometry.distinct_places(make([(0, 0), (10, 0), (4, 0), (10, 0.5)]), 1.0) == [(0.0, 0.0), (10.0, 0.5), (4.0, 0.0)]
    centre = geometry.plane_centre(make([(1, 5), (2, 6), (3, 7), (1000, -1000), (float("nan"), 6)])).first()
    assert (centre["x"], centre["y"]) == (2.0, 6.0) or (centre["x"], centre["y"]) == (2.0, 5.0)

"""Rolling frames against loops over months."""

import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ranks, validation


def test_frames_hold_what_earlier_months_tell(spark):
    rows = [("a", "2024-01", 1, 0.4), ("a", "2024-01", 2, 0.6), ("b", "2024-01", 3, 1.0), (None, "2024-01", 4, 2.0), ("a", "2024-03", 5, 0.5), ("c", "2024-03", 6, 0.7), ("b", "2024-04", 7, None), ("b", "2024-07", 8, 0.9), (None, "2024-07", 9, 0.3), ("a", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "site string, month string, ts int, y double")
    got = {r["ts"]: r for r in validation.rolling_frames(df, 1).collect()}
    assert set(got) == {5, 6, 8, 9}  # the first month has nothing before it; nulls take no part
    assert (got[5]["n_train"], got[5]["network_mean"], got[5]["n_site"], got[5]["persistence"], got[5]["seen"]) == (4, 1.0, 2, 0.6, True)
    assert (got[6]["persistence"], got[6]["seen"], got[6]["site_sum"]) == (1.0, False, 0.0)
    assert (got[8]["n_train"], got[8]["seen"], got[8]["persistence"]) == (2, False, pytest.approx(0.6)) and not got[9]["seen"]
    wide = {r["ts"]: r for r in validation.rolling_frames(df, 2).collect()}
    assert (wide[8]["n_train"], wide[8]["persistence"], wide[8]["seen"]) == (6, 1.0, True)
    assert validation.rolling_frames(df.limit(0)).count() == 0 and validation.rolling_frames(df.where("month = '2024-03'")).count() == 0


def test_summary_counts_and_null_recall(spark):
    z = math.log(0.5)
    preds = spark.createDataFrame([("m", 0.3, z, 0.1, True, 0.5, 0.6, 9), ("m", 0.5, z, 0.1, True, 0.4, 0.6, 9), ("m", 0.9, math.log(0.2), 0.1, False, 0.9, 0.6, 9)], "month string, y double, z_mu double, z_sd double, seen boolean, persistence double, network_mean double, n_train long")
    got = {r["subset"]: r for r in validation.validation_summary(preds, 0.4).collect()}
    assert set(got) == {"all", "seen", "new"} and (got["all"]["n_test"], got["all"]["n_true_below"], got["all"]["recall_below"], got["all"]["false_alarms"]) == (3, 1, 0.0, 1)
    assert got["new"]["recall_below"] is None and got["seen"]["coverage95"] == 0.5 and got["seen"]["rmse_persistence"] == pytest.approx(math.sqrt((0.04 + 0.01) / 2))


def test_quantiles_are_those_of_one_task(spark):
    df = spark.range(101).select((F.col("id") % 2).alias("g"), F.when(F.col("id") != 7, F.pmod(F.col("id") * 37, F.lit(50)).cast("double")).alias("v")).unionByName(spark.createDataFrame([(0, float("nan")), (5, None)], "g long, v double"))
    want = {r["g"]: r for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", F.lit(0.1)).alias("a"), F.median("v").alias("b")).collect()}
    got = {r["g"]: r for r in ranks.quantiles(df, "v", {"a": 0.1, "b": 0.5}, ["g"]).collect()}
    assert set(got) == {0, 1} and all(got[g]["a"] == pytest.approx(want[g]["a"]) and got[g]["b"] == pytest.approx(want[g]["b"]) for g in got)
    assert ranks.quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(df.where("not isnan(v)").agg(F.median("v")).first()[0])

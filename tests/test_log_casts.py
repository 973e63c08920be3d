"""Dates and clock times of logs: no cell that a pattern doesn't match is given to a cast, which would throw for each."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import parsing
from tidewell.sources import logs

DAYS = [
    ("2024-03-05", "DMY", "2024-03-05"), ("2024-13-05", "DMY", None), ("5/3/2024", "DMY", "2024-03-05"), ("5/3/2024", "MDY", "2024-05-03"), ("5.3.24 9:15 UTC", "DMY", "2024-03-05"), ("31/2/2024", "DMY", None), ("3 Mar 2024", "MDY", "2024-03-03"),
    ("3 MARCH, 2024", "MDY", "2024-03-03"), ("March 3, 2024", "DMY", "2024-03-03"), ("3 Foo 2024", "DMY", None), ("soon", "DMY", None), ("", "DMY", None), (None, "DMY", None), ("5/3/2024", None, "2024-05-03"),
]


def casts_to_int(df):
    """Casts to int in a query's plan that stand on a pattern's match itself."""
    plan, found, at = df._jdf.queryExecution().optimizedPlan().toString(), [], 0
    while (at := plan.find("cast(regexp_extract(", at)) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        found.append(plan[at:end])
        at += 1
    return [x for x in found if x.endswith(" as int)")]


def test_only_matches_are_cast(spark):
    rows = spark.createDataFrame([("f", *d) for d in DAYS], "file string, date string, order string, want string")
    days, clock = rows.select(logs.day_of(F.col("date"), F.col("order")).cast("string").alias("day"), "want"), rows.select(parsing.clock_minutes(F.col("date")))
    assert [r["day"] for r in days.collect()] == [r["want"] for r in days.collect()]
    assert not casts_to_int(days) and not casts_to_int(clock) and not casts_to_int(logs.date_orders(rows, "file", "date"))


@pytest.mark.parametrize(("dates", "order"), [(["", None, "x"], "MDY"), (["13/2/2024", "1/2/2024"], "DMY"), (["2/13/2024", ""], "MDY"), (["2/13/2024", "13/2/2024"], "both"), (["2/3/2024", "soon"], "either"), (["2/2/2024"], "MDY")])
def test_orders(spark, dates, order):
    rows = spark.createDataFrame([("f", d) for d in dates], "file string, date string")
    assert [tuple(r) for r in logs.date_orders(rows, "file", "date").collect()] == [("f", order)]

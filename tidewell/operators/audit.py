"""Accounting and audits: numbers in prose, differences between result sets, coverage of declared names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def numbers_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, token, value, half): each number of a text, and half a unit of its last printed place."""
    found = docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(f"({NUMBER})"), 1)).alias("place", "token"))
    decimals = F.length(F.regexp_extract("token", r"\.([0-9]+)$", 1))
    return found.select(id_col, "place", "token", F.col("token").try_cast("double").alias("value"), (0.5 * F.pow(F.lit(10.0), -decimals)).alias("half"))


def trace_numbers(numbers: DataFrame, pool: DataFrame, value: str = "pool_value") -> DataFrame:
    """numbers with `found`: whether some pool value rounds to it at its printed precision. A join on cells of the precision.

    The rounding unit has few distinct sizes; each number meets its own cell and the two beside it. Cells are doubles, as a
    long number, or one of many decimals, is in no cell that a bigint could count; they are no narrower than ten times the
    slack of the comparison.
    """
    n = numbers.withColumn("_unit", F.greatest(F.col("half") * 2, F.lit(1e-11)))
    units = n.select("_unit").distinct()
    cells = pool.select(F.col(value).cast("double").alias("_v")).distinct().crossJoin(F.broadcast(units)).select("_v", "_unit", F.rint(F.col("_v") / F.col("_unit")).alias("_cell"))
    asked = n.select("value", "half", "_unit").distinct().withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.rint(F.col("value") / F.col("_unit")) + i for i in (-1.0, 0.0, 1.0)]))))
    hit = asked.join(cells, ["_unit", "_cell"]).where(F.abs(F.col("value") - F.col("_v")) <= F.col("half") + 1e-12).select("value", "half").distinct().withColumn("_hit", F.lit(True))
    return numbers.join(hit, ["value", "half"], "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other hasn't as often, with `side`; empty when the results are the same."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def coverage(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): declared and found, declared only, or found only."""
    a, b = declared.select(key).distinct().withColumn("_a", F.lit(1)), actual.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "declared only").when(F.col("_a").isNull(), "found only").otherwise("both").alias("status"))

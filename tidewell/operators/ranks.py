"""Ranks and running sums over whole tables or hot groups: rows are dealt by ranges, counted per range, and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(df: DataFrame, amount: Column, order: list[str], by: list[str] | None = None, into: str = "running") -> DataFrame:
    """Adds the sum of `amount` up to each row in the order of `order`, within `by`, as `into`, and the group's whole as `into`_all.

    Rows are range-partitioned by group and order, so that no task gets a whole group but one that fits its range; only one
    row for each group and range meets in a window. `order` must tell a group's rows apart, or equal ones come in any order.
    """
    by = by or []
    placed = df.withColumn("_amount", amount).repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id())
    placed = cut(placed)  # the ranges stay as they were dealt
    parts = placed.groupBy("_part", *by).agg(F.sum("_amount").alias("_own"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_own").over(group)})
    parts = parts.drop("_own").withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)}).withColumnRenamed("_part", "_range")
    own = F.sum("_amount").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_within", own)
    same = F.col("_part") == F.col("_range")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = placed.join(parts, same).withColumns({into: F.col("_within") + F.col("_before"), f"{into}_all": F.col("_all")})
    return out.select(*df.columns, into, f"{into}_all")


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds `rank`, 1 to n in the order within `by`, and `rank_all`, n."""
    return running_sum(df, F.lit(1).cast("long"), order, by, "rank")


def weighted_quantiles(df: DataFrame, value: str, weight: str, by: list[str], at: list[float]) -> DataFrame:
    """by columns, and q_<percent> for each share: the least value whose cumulative share of weight reaches it less 1e-12.

    Null values and weights are left out. For groups of any size.
    """
    known = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    summed = running_sum(known.groupBy(*by, value).agg(F.sum(weight).alias("_w")), F.col("_w"), [value], by, "_c")
    share = F.col("_c") / F.col("_c_all")
    return summed.groupBy(*by).agg(*[F.min(F.when(share >= q - 1e-12, F.col(value))).alias(f"q_{round(q * 100):02d}") for q in at])


def upper_medians(df: DataFrame, value: str, tie: str, by: list[str]) -> DataFrame:
    """by, upper_median: the value at place n // 2 (from 0) of each sorted group, of any size."""
    r = ranked(df, [value, tie], by).where(F.col("rank") == F.floor(F.col("rank_all") / 2) + 1)
    return r.select(*by, F.col(value).alias("upper_median"))


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by columns, and a column for each name in `at`: the group's quantile, interpolated between the two values beside it. Null and NaN values are left out.

    Exact for groups of any size: equal values are counted first, the counts summed over ranges, and each quantile is a maximum
    over the two values that it lies between.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*(by or []), F.col(value).cast("double").alias("_v"))
    r = running_sum(known.groupBy(*(by or []), "_v").agg(F.count(F.lit(1)).alias("_n")), F.col("_n"), ["_v"], by, "rank")
    holds = lambda at: (F.col("rank") >= at) & (F.col("rank") - F.col("_n") < at)
    out = {}
    for name, q in at.items():
        place = F.lit(q) * (F.col("rank_all") - 1)
        out[f"{name}_lo"] = F.max(F.when(holds(F.floor(place) + 1), F.col("_v")))
        out[f"{name}_hi"] = F.max(F.when(holds(F.ceil(place) + 1), F.col("_v")))
        out[f"{name}_part"] = F.max(place - F.floor(place))
    wide = r.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in out.items()])
    return wide.select(*(by or []), *[(F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n in at])

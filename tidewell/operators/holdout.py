"""Plans of hold-outs, guards and gates around an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import number, plant_month
from .ranks import ranked


def require_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """(key, n) of facts whose key the dimension hasn't; empty if all are there. Null keys count as missing."""
    return facts.join(dimension.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def leave_out_groups(sites: DataFrame, site: str, size: int, seed: str) -> DataFrame:
    """(site, fold): sites in an order shuffled by a hash, in folds of `size`."""
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.col(site).cast("string")).cast("binary"))
    r = ranked(sites.select(site).distinct().withColumn("_order", shuffled), ["_order", site])
    return r.select(site, F.ceil(F.col("rank") / size).cast("int").alias("fold"))


def last_months(months: DataFrame, month: str, n: int) -> DataFrame:
    """The n latest months that hold rows."""
    return months.select(month).where(F.col(month).isNotNull()).distinct().orderBy(F.desc(month)).limit(n)


def gates(values: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """(bar, value, limit, passed) for the one row of `values`: each limit names a column, 'most' or 'least', and a number.

    A null value passes nothing.
    """
    bars = [
        F.struct(F.lit(name).alias("bar"), F.col(name).cast("double").alias("value"), F.lit(limit).alias("limit"), F.coalesce(F.col(name) <= limit if side == "most" else F.col(name) >= limit, F.lit(False)).alias("passed"))
        for name, side, limit in limits
    ]
    return values.select(F.inline(F.array(*bars)))


def ratio_to_max(df: DataFrame, value: str, by: list[str], into: str = "ratio") -> DataFrame:
    """Adds the value over its group's largest; null where that is 0. Groups number few and are broadcast by size, if at all."""
    top = df.groupBy(*by).agg(F.max(value).alias("_top")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return df.join(top, same, "left").withColumn(into, F.col(value) / F.when(F.col("_top") != 0, F.col("_top"))).select(*df.columns, into)


def parameter_grid(spark, axes: dict[str, list[float]]) -> DataFrame:
    """member and one column per axis: the product of the axes, the first the slowest."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    place = F.lit(0)
    for name, values in axes.items():
        place = place * len(values) + F.col(f"_{name}")
    return df.select(place.cast("int").alias("member"), *axes)


def check_ratios(ratios: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, problem): entry points without a ratio, ratios without an entry point, and ratios that are negative or no number. Empty: all is well."""
    given = ratios.groupBy("node").agg(F.max(F.coalesce((F.col("ratio") < 0) | F.isnan("ratio"), F.lit(True))).alias("_bad"))
    j = given.withColumn("_a", F.lit(True)).join(entries.select("node").distinct().withColumn("_b", F.lit(True)), "node", "full_outer")
    problem = F.when(F.col("_a").isNull(), "no ratio").when(F.col("_b").isNull(), "no entry point").when(F.col("_bad"), "no ratio of at least 0")
    return j.select("node", problem.alias("problem")).where("problem is not null")


def normal_ratios(ratios: DataFrame) -> DataFrame:
    """(node, ratio) rounded to six places; empty where all are 1."""
    r = ratios.select("node", F.round("ratio", 6).alias("ratio"))
    return r.crossJoin(F.broadcast(r.agg(F.max(F.col("ratio") != 1).alias("_some")))).where("_some").drop("_some")


def plant_problems(rows: DataFrame, line: str, month: str, celsius: str, least: float = 0.0, most: float = 35.0) -> DataFrame:
    """(line, problem) of a plant log's rows, whose cells are text: no month, month given twice, no temperature, temperature out of range."""
    read = rows.select(line, plant_month(F.col(month)).alias("_m"), number(F.col(celsius)).alias("_t"))
    twice = read.where("_m is not null").groupBy("_m").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    j = read.join(twice, "_m", "left")
    found = F.array_compact(F.array(
        F.when(F.col("_m").isNull(), "no month"), F.when(F.col("_n") > 1, "month given twice"), F.when(F.col("_t").isNull(), "no temperature"), F.when((F.col("_t") < least) | (F.col("_t") > most), "temperature out of range"),
    ))
    return j.select(line, F.explode(found).alias("problem"))

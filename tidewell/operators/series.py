"""Window operators over readings and lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import upper_median
from .ranks import ranked


def analyzer_sites(readings: DataFrame, site: str, day: str, minute: str, per_day: int = 12, gap: int = 30, days: int = 2, many_days: int = 7) -> DataFrame:
    """(site, is_analyzer): at least per_day readings with an upper-median gap of at most `gap` minutes on `days` days, or per_day on many_days."""
    w = Window.partitionBy(site, day).orderBy(minute)
    gaps = readings.select(site, day, (F.col(minute) - F.lag(minute).over(w)).alias("gap"))
    daily = gaps.groupBy(site, day).agg(F.count(F.lit(1)).alias("n"), upper_median(F.col("gap")).alias("typical"))
    full = F.col("n") >= per_day
    sums = daily.groupBy(site).agg(F.count_if(full & (F.col("typical") <= gap)).alias("dense"), F.count_if(full).alias("full"))
    return sums.select(site, ((F.col("dense") >= days) | (F.col("full") >= many_days)).alias("is_analyzer"))


def islands(df: DataFrame, number: str, by: list[str]) -> DataFrame:
    """Runs of consecutive whole numbers: by columns, first, last, n. Groups of any size."""
    keyed = ranked(df.select(*by, number).distinct(), [number], by).withColumn("_island", F.col(number) - F.col("rank"))
    return keyed.groupBy(*by, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def dropped_lines(dropped: DataFrame, reason: str, row: str, value: str, most_values: int = 20, most_lines: int = 50) -> DataFrame:
    """(reason, value, rows): row numbers as ranges, by reason and value; reasons with over most_values values in one line, at most most_lines ranges a line."""
    many = dropped.groupBy(reason).agg(F.count_distinct(value).alias("_n"))
    named = dropped.join(many, reason).select(reason, F.when(F.col("_n") <= most_values, F.col(value)).alias("value"), row)
    runs = islands(named, row, [reason, "value"])
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    runs = ranked(runs.withColumn("text", text), ["first"], [reason, "value"]).where(F.col("rank") <= most_lines)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda s: s["text"]), ", ")
    return runs.groupBy(reason, "value").agg(F.concat(line, F.when(F.max("rank_all") > most_lines, F.lit(", ...")).otherwise("")).alias("rows"))


def forward_fill(df: DataFrame, value: str, by: list[str], order: list[str], into: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def unique_ids(df: DataFrame, name: str, tie: str, into: str) -> DataFrame:
    """Suffixes _2, _3 ... to repeated names, in the order of `tie`."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(tie))
    return df.withColumn(into, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


#: Seasons by month.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}


def month_labels(months: DataFrame, month: str, value: str) -> DataFrame:
    """months (one row each, yyyy-MM) with `season` and `change`, the value against that of the row before, less one."""
    number = F.substring(month, 6, 2).try_cast("int")
    season = F.lit(None).cast("string")
    for m, name in SEASONS.items():
        season = F.when(number == m, name).otherwise(season)
    before = F.lag(value).over(Window.orderBy(month))  # one row a month
    return months.withColumns({"season": season, "change": F.col(value) / F.when(before != 0, before) - 1})

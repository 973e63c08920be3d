"""Resampled ratios at every level of a tree of results at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .ranks import ranked


def pick_counts(units: DataFrame, unit: str, draws: int) -> DataFrame:
    """(draw, unit, times): how often each unit is drawn in resamples of as many as there are, by a hash of (draw, place).

    units: one row each (null units are left out). A draw without a unit has no row of it. Picks are counted before anything
    else is joined, so what follows has a row for each draw and unit at most, however many rows a unit has.
    """
    numbered = ranked(units.where(F.col(unit).isNotNull()).select(unit).distinct(), [unit]).select(unit, F.col("rank").alias("place"), F.col("rank_all").alias("n"))
    each = numbered.select("n", F.col("place").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("-", "draw", "i").cast("binary")), 1, 8), 16, 10).cast("bigint")
    picks = each.select("draw", (F.pmod(hashed, F.col("n")) + 1).alias("place")).groupBy("draw", "place").agg(F.count(F.lit(1)).alias("times"))
    return picks.join(numbered.select(unit, "place"), "place").select("draw", unit, "times")


def bootstrap_tree(rows: DataFrame, unit: str, levels: list[list[str]], top: str, bottom: str, draws: int = 2000, ends: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """One row for each node of each level: depth, the levels' columns (null where a level lacks them), ratio, lo, hi, valid, invalid.

    rows: unit (what is resampled), columns of the levels, top, bottom. levels: say [[], ["network"], ["network", "month"]].
    ratio: of all rows' sums; lo and hi: its quantiles over the draws, interpolated; a draw in which a node's bottom sums to 0,
    or that drew none of its units, is invalid, and counted. Rows are summed once for all levels, to a row for each node and
    unit, and meet the counted picks in one join; so draws cost units, not rows. Null units count in the ratio, not in draws.
    """
    names = list(dict.fromkeys(c for level in levels for c in level))
    at = F.array(*[F.struct(F.lit(d).alias("depth"), *[(F.col(c) if c in level else F.lit(None).cast(dict(rows.dtypes)[c])).alias(c) for c in names]) for d, level in enumerate(levels)])
    # Map-side sums come first, so a level above doesn't see a row again for each of its rows.
    leaves = rows.groupBy(unit, *names).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"))
    nodes = leaves.select(unit, F.explode(at).alias("at"), "top", "bottom").select(unit, "at.*", "top", "bottom").groupBy(unit, "depth", *names).agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    key = F.struct("depth", *names)
    whole = nodes.groupBy(key.alias("key")).agg(ratio(F.sum("top"), F.sum("bottom")).alias("ratio"))
    drawn = nodes.join(pick_counts(rows, unit, draws), unit).groupBy(key.alias("key"), "draw").agg(ratio(F.sum(F.col("times") * F.col("top")), F.sum(F.col("times") * F.col("bottom"))).alias("r"))
    # At most `draws` values a node, so its quantiles fit a task.
    bands = drawn.groupBy("key").agg(F.percentile("r", F.lit(ends[0])).alias("lo"), F.percentile("r", F.lit(ends[1])).alias("hi"), F.count("r").alias("valid"))
    out = whole.join(bands, "key", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    return out.select("key.*", "ratio", "lo", "hi", "valid", (F.lit(draws) - F.col("valid")).alias("invalid"))

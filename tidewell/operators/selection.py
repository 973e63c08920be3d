"""Choosing what to sample next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranks import quantiles


def straddle(mu: Column, sd: Column, level: Column) -> Column:
    """High where a value is uncertain and near a level."""
    return 1.96 * sd - F.abs(mu - level)


def take_best(candidates: DataFrame, score: str, tie: str, n: int = 1) -> DataFrame:
    """The n best candidates; ties go to the least `tie`. Spark keeps n rows a task, not a full sort."""
    return candidates.orderBy(F.desc(score), tie).limit(n)


def diversified_route(candidates: DataFrame, n: int, repulsion: float, reach: float, key: str = "id", x: str = "x", y: str = "y", score: str = "score") -> DataFrame:
    """(rank, key, gain): greedily the best of score - repulsion * exp(-d / reach), d to the nearest already taken.

    Each step is one pass of a distributed argmax; only the winner's place, one row, comes to the driver.
    """
    pool = cut(candidates.select(key, x, y, score).withColumn("_near", F.lit(float("inf"))))
    taken = []
    for rank in range(1, n + 1):
        gain = F.col(score) - repulsion * F.exp(-F.col("_near") / reach)
        best = pool.withColumn("_gain", gain).orderBy(F.desc("_gain"), key).limit(1).first()
        if best is None:
            break
        taken.append((rank, best[key], float(best["_gain"])))
        d = F.sqrt((F.col(x) - best[x]) ** 2 + (F.col(y) - best[y]) ** 2)
        pool = pool.where(F.col(key) != best[key]).withColumn("_near", F.least("_near", d))
    return candidates.sparkSession.createDataFrame(taken, f"rank int, `{key}` {dict(candidates.dtypes)[key]}, gain double")


def spread_hours(visits: Column, first: int, last: int) -> Column:
    """Array of the hours of so many visits, evenly from first to last (ties to even); one visit is at the first."""
    step = F.when(visits > 1, F.lit(float(last - first)) / (visits - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), (visits - 1).cast("int")), lambda i: F.bround(first + i * step).cast("int"))


def acquire_time(hourly: DataFrame, minima: DataFrame, level: float) -> DataFrame:
    """(strategy, junction, hour) by three rules; ties go to the earlier hour, then the lesser junction.

    hourly: junction, hour, mu, sd. minima: junction, mu, sd of daily minima. 'uncertainty': the widest band. 'straddle': the
    most ambiguous about the level. 'straddle_min': the junction whose minimum is, at the hour of its widest band.
    """
    place = lambda score: F.min(F.struct((-score).alias("s"), "hour", "junction")).alias("best")
    rule = lambda name, rows, score: rows.agg(place(score)).select(F.lit(name).alias("strategy"), "best.junction", "best.hour")
    ambiguous = straddle(F.col("mu"), F.col("sd"), F.lit(level))
    at = minima.agg(F.min(F.struct((-ambiguous).alias("s"), "junction")).alias("best")).select("best.junction")
    one = hourly.join(F.broadcast(at), "junction", "left_semi")
    found = rule("uncertainty", hourly, F.col("sd")).union(rule("straddle", hourly, ambiguous)).union(rule("straddle_min", one, F.col("sd")))
    return found.where("junction is not null")


def demand_route(demands: DataFrame, demand: str, key: str, n: int, first: int, last: int) -> DataFrame:
    """(rank, key, hour): the n greatest demands (ties: least key), at hours spread from first to last."""
    best = demands.orderBy(F.desc(demand), key).limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.col(demand)).alias("d"), F.col(key).alias("k")))).alias("a"))
    hours = spread_hours(F.size("a"), first, last)
    return best.where(F.size("a") > 0).select(F.posexplode(F.zip_with("a", hours, lambda a, h: F.struct(a["k"].alias("k"), h.alias("h")))).alias("i", "s")).select((F.col("i") + 1).alias("rank"), F.col("s.k").alias(key), F.col("s.h").alias("hour"))


def random_route(candidates: DataFrame, key: str, n: int, seed: str, first: int, last: int) -> DataFrame:
    """(rank, key, hour): n candidates in an order shuffled by a hash."""
    shuffled = candidates.select(key).distinct().withColumn("_d", -F.xxhash64(F.lit(seed), key).cast("double"))
    return demand_route(shuffled, "_d", key, n, first, last)


def baselines(rows: DataFrame, key: str, place: str, age: str, y: str) -> DataFrame:
    """(key, mean, line, nearest): the mean of the sampled (y known), a least-squares line in age, and the value of the sampled row
    of the same place that is nearest by age (ties: least key; null without one).

    The nearest is the nearer of the last sampled before and the next after, found by ordered windows within a place.
    """
    c = F.col
    fit = rows.where(c(y).isNotNull()).agg(F.avg(y).alias("mean"), F.regr_slope(y, age).alias("_b"), F.regr_intercept(y, age).alias("_a"))
    first = rows.where(c(y).isNotNull()).groupBy(place, age).agg(F.min(F.struct(c(age).alias("a"), c(key).alias("k"), c(y).alias("v"))).alias("_s"))
    marked = rows.drop(y).join(first, [place, age], "left")
    up = Window.partitionBy(place).orderBy(age).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The rows after are those before in the other order: a frame to the partition's end is summed anew for each row.
    down = Window.partitionBy(place).orderBy(c(age).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.withColumns({"_l": F.last("_s", ignorenulls=True).over(up), "_r": F.last("_s", ignorenulls=True).over(down)})
    d = lambda s: F.struct(F.abs(c(f"{s}.a") - c(age)).alias("d"), c(f"{s}.k").alias("k"), c(f"{s}.v").alias("v"))
    near = F.when(c("_l").isNull(), c("_r.v")).when(c("_r").isNull(), c("_l.v")).otherwise(F.least(d("_l"), d("_r"))["v"])
    return both.crossJoin(F.broadcast(fit)).select(key, "mean", (c("_a") + c("_b") * c(age)).alias("line"), near.alias("nearest"))


def watch_flags(rows: DataFrame, p_below: str, age: str, celsius: float, chance: float = 0.5, quantile: float = 0.75, least_celsius: float = 15.0) -> DataFrame:
    """rows with `watch`: likely low, among the oldest, and the water warm enough."""
    old = quantiles(rows, age, {"_old": quantile})
    flag = (F.col(p_below) > chance) & (F.col(age) >= F.col("_old")) & F.lit(celsius >= least_celsius)
    return rows.crossJoin(F.broadcast(old)).withColumn("watch", F.coalesce(flag, F.lit(False))).drop("_old")

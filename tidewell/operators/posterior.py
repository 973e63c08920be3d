"""Weighing a grid of simulated hypotheses against readings.

A grid has a row per (hour, junction) with one array of ln C over its members, so that weights and moments are array
arithmetic inside a row and need no shuffle. Samples are few and grids wide: weights are one small array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import weighted_quantiles

FLOOR = 0.02  # mg/L, before logarithms


def log_likelihood(grid: DataFrame, samples: DataFrame, sd: float, student: float | None = None) -> DataFrame:
    """(member, loglik): Gaussian, or Student-t, log-likelihood of the samples' ln values, less n ln sd.

    grid: hour, junction, z array. samples: hour, junction, y.
    """
    hit = grid.join(samples, ["hour", "junction"]).select(F.posexplode("z").alias("member", "z"), F.log(F.greatest("y", F.lit(FLOOR))).alias("ly"))
    u = (F.col("ly") - F.col("z")) / sd
    term = -0.5 * u * u if student is None else -0.5 * (student + 1) * F.log1p(u * u / student)
    return hit.groupBy("member").agg((F.sum(term) - F.count(F.lit(1)) * math.log(sd)).alias("loglik"))


def log_likelihood_of_sds(grid: DataFrame, samples: DataFrame, sds: list[float], student: float | None = None) -> DataFrame:
    """(member, loglik) where the readings' deviation is one of sds, each as likely as the others: ln of the mean likelihood over them. One pass over the samples."""
    hit = grid.join(samples, ["hour", "junction"]).select(F.posexplode("z").alias("member", "z"), F.log(F.greatest("y", F.lit(FLOOR))).alias("ly"))

    def one(sd: float) -> Column:
        u = (F.col("ly") - F.col("z")) / sd
        term = -0.5 * u * u if student is None else -0.5 * (student + 1) * F.log1p(u * u / student)
        return F.sum(term) - F.count(F.lit(1)) * math.log(sd)

    each = hit.groupBy("member").agg(*[one(sd).alias(f"l{i}") for i, sd in enumerate(sds)])
    return each.select("member", (log_sum_exp(*[F.col(f"l{i}") for i in range(len(sds))]) - math.log(len(sds))).alias("loglik"))


def weights(loglik: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(member, w): softmax of loglik over all members; the members number as many as the grid has, not as the data.

    prior: (member, log_prior), up to a constant; members that it lacks have weight 0.
    """
    if prior is not None:
        loglik = loglik.join(prior, "member").select("member", (F.col("loglik") + F.col("log_prior")).alias("loglik"))
    top = loglik.agg(F.max("loglik").alias("top"))
    e = loglik.crossJoin(F.broadcast(top)).select("member", F.exp(F.col("loglik") - F.col("top")).alias("e"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("e").alias("total")))).select("member", (F.col("e") / F.col("total")).alias("w"))


def weight_array(w: DataFrame) -> DataFrame:
    """One row: the weights as an array in member order."""
    return w.agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "w"))), lambda s: s["w"]).alias("w"))


def moments(grid: DataFrame, w: DataFrame, least_var: float = 1e-6) -> DataFrame:
    """(hour, junction, mu, var) of ln C; one pass over the grid, no shuffle."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), zero, lambda a, b: a + b)
    one = grid.crossJoin(F.broadcast(weight_array(w)))
    mu = dot(F.col("z"), F.col("w"))
    second = dot(F.transform("z", lambda z: (z - F.col("mu")) * (z - F.col("mu"))), F.col("w"))
    return one.withColumn("mu", mu).select("hour", "junction", "mu", F.greatest(second, F.lit(least_var)).alias("var"))


def edge_mass(w: DataFrame, members: DataFrame, axis: str) -> DataFrame:
    """(axis, at_least, at_most): posterior mass on an axis's ends; null for an axis of one value."""
    joined = w.join(F.broadcast(members), "member")
    ends = members.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    mass = lambda end: F.sum(F.when(F.col(axis) == F.col(end), F.col("w")).otherwise(0.0))
    both = joined.crossJoin(F.broadcast(ends)).groupBy("lo", "hi").agg(mass("lo").alias("a"), mass("hi").alias("b"))
    real = F.col("lo") != F.col("hi")
    return both.select(F.lit(axis).alias("axis"), F.when(real, F.col("a")).alias("at_least"), F.when(real, F.col("b")).alias("at_most"))


def best_member() -> Column:
    """Aggregate over (member, w): the member of the largest weight; ties go to the first."""
    return F.max_by("member", F.struct("w", -F.col("member")))


def with_doses(grid: DataFrame, doses: list[float]) -> DataFrame:
    """hour, junction, dose, z: each member's ln C under each dose (a fixed few). One row becomes as many as there are doses."""
    return grid.withColumn("dose", F.explode(F.array(*map(F.lit, doses)))).withColumn("z", F.transform("z", lambda z: z + F.log("dose")))


def own_condition(samples: DataFrame, bank: DataFrame, condition: list[str]) -> DataFrame:
    """(condition columns, hour, junction, y, z): each sample with the grid of its own condition; samples without one are left out."""
    return samples.join(bank, [*condition, "hour", "junction"])


def local_variance(grid: DataFrame, w: DataFrame, siblings: int) -> DataFrame:
    """(hour, junction, var): population variance over each run of `siblings` members, weighed by the run's weight. w: member, w."""
    groups = w.groupBy(F.floor(F.col("member") / siblings).alias("g")).agg(F.sum("w").alias("w"))
    array = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "w"))), lambda s: s["w"]).alias("w"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def variance(g: Column) -> Column:
        own = F.slice("z", (g * siblings + 1).cast("int"), F.lit(siblings))
        mean = total(own) / siblings
        return total(F.transform(own, lambda z: (z - mean) * (z - mean))) / siblings

    each = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda g: F.get("w", g) * variance(g))
    return grid.crossJoin(F.broadcast(array)).select("hour", "junction", total(each).alias("var"))


def hydraulic_weights(w: DataFrame, siblings: int) -> DataFrame:
    """(sibling, w): weights summed over all members that share a place among their siblings."""
    return w.groupBy((F.col("member") % siblings).alias("sibling")).agg(F.sum("w").alias("w"))


def weighted_mean_and_band(values: DataFrame, w: DataFrame, key: str, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """by, mean, low, high: over members weighed by w (key, w)."""
    joined = values.join(w, key)
    mean = joined.groupBy(*by).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    ends = weighted_quantiles(joined, value, "w", by, [low, high])
    return mean.join(ends.withColumnsRenamed({f"q_{round(low * 100):02d}": "low", f"q_{round(high * 100):02d}": "high"}), by)


def loss_split(runs: DataFrame, least: float = 0.02, floor: float = 1e-6) -> DataFrame:
    """(junction, total, bulk, wall, bulk_share, wall_share, nonadditivity) from runs: junction, hour, run, value.

    Runs are 'full', 'bulk_only', 'wall_only' and 'no_decay'; losses are mean logarithms of no_decay over each. Shares are
    null where the total is under `least`.
    """
    c = F.col
    cell = lambda r: F.log(F.greatest(F.max(F.when(c("run") == r, c("value"))), F.lit(floor)))
    hours = runs.groupBy("junction", "hour").agg(*[(cell("no_decay") - cell(r)).alias(n) for r, n in (("full", "total"), ("bulk_only", "bulk"), ("wall_only", "wall"))])
    m = hours.groupBy("junction").agg(*[F.avg(n).alias(n) for n in ("total", "bulk", "wall")])
    some = lambda x: F.when(c("total") >= least, x)
    return m.select("junction", "total", "bulk", "wall", some(c("bulk") / c("total")).alias("bulk_share"), some(1 - c("bulk") / c("total")).alias("wall_share"), some((c("bulk") + c("wall")) / c("total")).alias("nonadditivity"))


def oracle_member(grid: DataFrame, truth: DataFrame, doses: list[float]) -> DataFrame:
    """One row: the member and dose of the least root mean square error against the truth (hour, junction, value), and that error.

    Per member only three moments are summed; ties go to the first member, then to the first dose.
    """
    c = F.col
    hit = grid.join(truth, ["hour", "junction"]).select(F.posexplode("z").alias("member", "z"), "value")
    m = hit.groupBy("member").agg(F.avg(F.exp(2 * c("z"))).alias("a"), F.avg(F.exp("z") * c("value")).alias("b"), F.avg(c("value") * c("value")).alias("t"))
    d = m.select("member", "a", "b", "t", F.posexplode(F.array(*map(F.lit, doses))).alias("place", "dose"))
    error = F.sqrt(F.greatest(c("dose") * c("dose") * c("a") - 2 * c("dose") * c("b") + c("t"), F.lit(0.0)))
    best = d.withColumn("rmse", error).agg(F.min(F.struct("rmse", "member", "place", "dose")).alias("best"))
    return best.select("best.member", "best.dose", "best.rmse")


def hypothesis_weights(w: DataFrame, members: DataFrame, hypothesis: str, rate: str) -> DataFrame:
    """(hypothesis, w, mean_rate): posterior of each hypothesis and its mean rate (null without weight)."""
    j = w.join(members, "member").groupBy(hypothesis).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(rate)).alias("_r"))
    return j.select(hypothesis, "w", F.when(F.col("w") > 0, F.col("_r") / F.col("w")).alias("mean_rate"))


def log_sum_exp(*terms: Column) -> Column:
    """ln of the sum of exp of the terms, by their largest, so that none overflows."""
    top = F.greatest(*terms)
    return top + F.log(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))


def two_rate_grid(grid: DataFrame, rate: str, shared: list[str], z: str, shares: tuple[float, ...]) -> DataFrame:
    """(fast, slow, share, shared, z): the grid's members, and mixtures of each two of its rates at each share of the faster.

    Water of two parts that decay at two rates and are alike in all else has f C(fast) + (1 - f) C(slow), as decay of the first
    order is linear; z is its logarithm. A single rate has no slow one and a share of 1. Rates meet on the shared axes, so rows
    are joined with those of one place and hour only. Raises ValueError where a rate lacks some of the others' places.
    """
    counts = grid.groupBy(rate).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*shared).alias("places"))
    seen = counts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("places").alias("places")).first()
    if seen["least"] != seen["most"] or seen["places"] != seen["most"]:
        raise ValueError("each rate must have the same members once")
    one = grid.select(F.col(rate).alias("fast"), F.lit(None).cast(dict(grid.dtypes)[rate]).alias("slow"), F.lit(1.0).alias("share"), *shared, F.col(z).alias("z"))
    fast, slow = grid.select(*shared, F.col(rate).alias("fast"), F.col(z).alias("za")), grid.select(*shared, F.col(rate).alias("slow"), F.col(z).alias("zb"))
    met = fast.join(slow, shared).where("fast > slow").withColumn("share", F.explode(F.array(*[F.lit(f) for f in shares])))
    mixed = log_sum_exp(F.col("za") + F.log("share"), F.col("zb") + F.log(1 - F.col("share")))
    return one.unionByName(met.select("fast", "slow", "share", *shared, mixed.alias("z")))

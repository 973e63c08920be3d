"""Sampling in turn: each reading updates the posterior in place, which chooses the next place to read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .selection import straddle


def posterior_by_run(loglik: DataFrame) -> DataFrame:
    """(run, member, w): softmax of loglik within each run."""
    top = loglik.groupBy("run").agg(F.max("loglik").alias("top"))
    e = loglik.join(top, "run").select("run", "member", F.exp(F.col("loglik") - F.col("top")).alias("e"))
    return e.join(e.groupBy("run").agg(F.sum("e").alias("total")), "run").select("run", "member", (F.col("e") / F.col("total")).alias("w"))


def add_readings(loglik: DataFrame, readings: DataFrame, grid: DataFrame, sd: float) -> DataFrame:
    """loglik (run, member) with the log-likelihood of new readings (run, hour, junction, y) added; y and the grid's z are logarithms."""
    term = -0.5 * ((F.col("y") - F.col("z")) / sd) ** 2 - math.log(sd)
    new = readings.join(grid, ["hour", "junction"]).groupBy("run", "member").agg(F.sum(term).alias("more"))
    return loglik.join(new, ["run", "member"], "left").select("run", "member", (F.col("loglik") + F.coalesce("more", F.lit(0.0))).alias("loglik"))


def sample_in_turn(grid: DataFrame, truth: DataFrame, seeds: DataFrame, steps: int, sd: float, level: float) -> DataFrame:
    """(run, n, junction, hour, y): the seeds, numbered by hour and junction, and `steps` more readings of each run, one a step.

    grid: hour, junction, member, z. truth: run, junction, hour, y, what a reading there would give. seeds: rows of truth, one
    or more of each run. Each step takes the place that is most ambiguous about the level (ties: the earlier hour, then the
    lesser junction) at a junction that its run hasn't read; a run without one is done. Steps follow one another, runs go side
    by side: a step is one pass over the grid for all runs, and its state, a row for each run and member, is a table, so a
    lost executor costs one step.
    """
    runs = seeds.select("run").distinct()
    members = grid.select("member").distinct()
    number = F.expr("transform(array_sort(collect_list(struct(hour, junction, y))), (s, i) -> struct(i + 1 as n, s.junction as junction, s.hour as hour, s.y as y))")
    taken = keep(seeds.groupBy("run").agg(number.alias("s")).select("run", F.explode("s").alias("s")).select("run", F.col("s.n").cast("long").alias("n"), "s.junction", "s.hour", "s.y"))
    start = runs.crossJoin(members).select("run", "member", F.lit(0.0).alias("loglik"))  # runs times members: the state's own size
    state = keep(add_readings(start, taken, grid, sd))
    for _ in range(steps):
        w = posterior_by_run(state)
        placed = grid.join(w, "member").groupBy("run", "junction", "hour").agg(F.sum(F.col("w") * F.col("z")).alias("mu"), F.sum(F.col("w") * F.col("z") ** 2).alias("square"))
        sd_of = F.sqrt(F.greatest(F.col("square") - F.col("mu") ** 2, F.lit(1e-12)))
        score = F.round(straddle(F.col("mu"), sd_of, F.lit(level)), 9)
        open_ = placed.join(taken.select("run", "junction"), ["run", "junction"], "left_anti").join(truth, ["run", "junction", "hour"])
        best = open_.groupBy("run").agg(F.min(F.struct((-score).alias("s"), "hour", "junction", "y")).alias("b"))
        count = taken.groupBy("run").agg(F.max("n").alias("n"))
        new = keep(best.join(count, "run").select("run", (F.col("n") + 1).alias("n"), "b.junction", "b.hour", "b.y"))
        state = keep(add_readings(state, new, grid, sd))
        taken = keep(taken.unionByName(new))
    return taken


def refit(grid: DataFrame, samples: DataFrame, sd: float) -> DataFrame:
    """(run, member, w) from all samples at once, as sample_in_turn arrives at step by step."""
    start = samples.select("run").distinct().crossJoin(grid.select("member").distinct()).select("run", "member", F.lit(0.0).alias("loglik"))
    return posterior_by_run(add_readings(start, samples, grid, sd))

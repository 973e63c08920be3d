"""Evaluation: hold-out metrics, mergeable sums, rank bins, bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .ranks import quantiles, ranked


def error_sums(truth: Column, pred: Column, low: Column, high: Column, limit: float) -> dict[str, Column]:
    """Sufficient statistics that merge by addition."""
    t, p = truth < limit, pred < limit
    count = lambda c: F.count_if(c)
    return {
        "n": F.count(F.lit(1)), "sse": F.sum((pred - truth) ** 2), "sae": F.sum(F.abs(pred - truth)), "tp": count(t & p), "fp": count(~t & p), "fn": count(t & ~p),
        "inside": count(truth.between(low, high)),
    }


def rates(undefined: float | None) -> dict[str, Column]:
    """Final step from error_sums' columns; undefined ratios are null, or a value the caller's convention gives."""
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp"), undefined), ratio(c("tp"), c("tp") + c("fn"), undefined)
    return {
        "rmse": F.sqrt(c("sse") / c("n")), "mae": c("sae") / c("n"), "precision": precision, "recall": recall,
        "f1": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"), undefined), "coverage": c("inside") / c("n"),
    }


def rank_bins(df: DataFrame, value: str, tie: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Adds `bin`, 1 to bins: quantile bins of the ranks 1..n with ties broken by order, as interpolated rank quantiles cut them.

    Ranks come from ranges and their counts, so no task gets all rows.
    """
    r = ranked(df, [value, tie], by)
    return r.withColumn("bin", F.greatest(F.lit(1), F.ceil((F.col("rank") - 1) * bins / F.greatest(F.col("rank_all") - 1, F.lit(1)))).cast("int")).drop("rank", "rank_all")


def learning_curve(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, runs, and the mean of each metric over the runs; nulls (not testable) are left out."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(m).alias(m) for m in metrics])


def metrics_time(rows: DataFrame, by: list[str], limit: float, night: int = 22) -> DataFrame:
    """Scores of daily minima and of the night hour. rows: truth, mid, low, high, p_below, hour; hour null for daily minima.

    Undefined ratios are 1, f1 without any hit 0.
    """
    c = F.col

    def part(of: Column, tag: str) -> dict[str, Column]:
        t, p = of & (c("truth") < limit), of & (c("p_below") > 0.5)
        tp, fp, fn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p)
        precision, recall = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
        return {
            f"rmse_{tag}": F.sqrt(F.avg(F.when(of, (c("truth") - c("mid")) ** 2))), f"precision_{tag}": precision, f"recall_{tag}": recall, f"f1_{tag}": ratio(2 * precision * recall, precision + recall, 0.0),
            f"true_{tag}": F.count_if(t), f"coverage_{tag}": F.avg(F.when(of, c("truth").between(c("low"), c("high")).cast("int"))),
        }

    parts = part(c("hour").isNull(), "min") | {k: v for k, v in part(c("hour") == night, "night").items() if k.split("_")[0] in ("rmse", "recall", "coverage")}
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in parts.items()])


def compact(df: DataFrame, by: list[str], total: str, first: str, order: list[str]) -> DataFrame:
    """by, total (null where all parts are), size, first (by `order`)."""
    return df.groupBy(*by).agg(F.sum(total).alias("total"), F.count(F.lit(1)).alias("size"), F.min_by(first, F.struct(*order, first)).alias("first"))


def tree(df: DataFrame, levels: list[str], metrics: dict[str, Column]) -> DataFrame:
    """The metrics by all levels, by all but the last, and so on up to the whole; 'all' stands for a level that is summed over."""
    named = {c: F.when(F.grouping(c) == 1, "all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in levels}
    return df.rollup(*levels).agg(*[v.alias(f"_l_{c}") for c, v in named.items()], *[v.alias(k) for k, v in metrics.items()]).select(*[F.col(f"_l_{c}").alias(c) for c in levels], *metrics)


def paired(df: DataFrame, keys: list[str], which: str, sides: tuple[str, str], value: str) -> DataFrame:
    """keys and the value of both sides as <value>_<side>; keys that only one side has are kept."""
    cell = lambda s: F.max(F.when(F.col(which) == s, F.col(value))).alias(f"{value}_{s}")
    return df.where(F.col(which).isin(*sides)).groupBy(*keys).agg(cell(sides[0]), cell(sides[1]))


def prefixed(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """left with right's other columns under a prefix; rows without a partner keep nulls."""
    return left.join(right.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in keys]), keys, "left")


def recomputed(stated: DataFrame, again: DataFrame, key: str, value: str, relative: float) -> DataFrame:
    """(key, status): same (within the relative tolerance), differs, stated only, computed only; two nulls are the same."""
    j = stated.select(key, F.col(value).alias("_s"), F.lit(1).alias("_a")).join(again.select(key, F.col(value).alias("_c"), F.lit(1).alias("_b")), key, "full_outer")
    near = F.col("_s").eqNullSafe(F.col("_c")) | F.coalesce(F.abs(F.col("_s") - F.col("_c")) <= relative * F.abs("_s"), F.lit(False))
    return j.select(key, F.when(F.col("_a").isNull(), "computed only").when(F.col("_b").isNull(), "stated only").when(near, "same").otherwise("differs").alias("status"))


def alarm_cells(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, the sums of both sides, their ratio (null where b has none), and in how many pairs a, or b, is more."""
    return pairs.groupBy(*by).agg(F.sum(a).alias(a), F.sum(b).alias(b), F.count_if(F.col(a) > F.col(b)).alias("more_a"), F.count_if(F.col(a) < F.col(b)).alias("more_b")).withColumn("ratio", ratio(F.col(a).cast("double"), F.col(b).cast("double")))


def near_limit(df: DataFrame, value: str, limit: float, widths: list[float], by: list[str]) -> DataFrame:
    """by, and for each width the rows in [limit - width, limit + width)."""
    return df.groupBy(*by).agg(*[F.count_if((F.col(value) >= limit - w) & (F.col(value) < limit + w)).alias(f"within_{str(w).replace('.', '_')}") for w in widths])


def daily_least(readings: DataFrame, by: list[str], hour: str, value: str) -> DataFrame:
    """by, least, at: the least value and its first hour."""
    return readings.groupBy(*by).agg(F.min(value).alias("least"), F.min_by(hour, F.struct(value, hour)).alias("at"))


def share_below(rows: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col(value) < limit).cast("int")).alias("share"))


def draw_summary(draws: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Of Monte Carlo draws: median, the ends of bands of 50, 80, 90 and 95 % (interpolated), mean, population deviation, share under the limit."""
    ends = {f"{end}{q}": 0.5 + sign * q / 200 for q in (50, 80, 90, 95) for end, sign in (("lo", -1), ("hi", 1))}
    bands = quantiles(draws, value, {"median": 0.5, **ends}, by)
    rest = draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg((F.col(value) < limit).cast("int")).alias("p_below"))
    keys = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in by]
    joined = rest.alias("_r").join(bands.alias("_b"), keys, "left") if by else rest.alias("_r").crossJoin(bands.alias("_b"))  # one row each
    return joined.select(*[F.col(f"_r.{c}").alias(c) for c in by], *[F.col(f"_b.{c}").alias(c) for c in ("median", *ends)], "_r.mean", "_r.sd", "_r.p_below")


def bootstrap_ratio(sums: DataFrame, seed_col: str, top: str, bottom: str, draws: int) -> DataFrame:
    """(draw, ratio): seeds resampled with replacement by a hash of (draw, place); draws with nothing below the line are null.

    sums has a row per seed; seeds are numbered in order and the n draws of each resample are joined to them.
    """
    numbered = sums.select(F.row_number().over(Window.orderBy(seed_col)).alias("place"), top, bottom)  # one row a seed
    n = sums.agg(F.count(F.lit(1)).alias("n"))
    picks = (
        n.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("n", "draw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
        .select("draw", (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", "draw", "i").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.col("n")) + 1).alias("place"))
    )
    return picks.join(numbered, "place").groupBy("draw").agg(ratio(F.sum(top), F.sum(bottom)).alias("ratio"))

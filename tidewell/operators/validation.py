"""Rolling hold-outs: each month is predicted from the months before it and scored beside its baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import norm_cdf
from ..session import keep
from .ranks import quantiles

#: How many deviations a band of so many percent reaches to either side.
LEVELS = {50: 0.6745, 80: 1.2816, 90: 1.645, 95: 1.96}


def rolling_frames(readings: DataFrame, months: int = 3, site: str = "site", month: str = "month", order: str = "ts", value: str = "y") -> DataFrame:
    """readings of each month after the first, with what the `months` months before it that hold a reading tell of them.

    Adds n_train, network_mean, n_site, site_sum, persistence (the site's last training value, else the network's mean) and
    seen (whether the site has one). Null sites are never seen; null values train nothing and are left out; ties in order go
    to the larger value. Training rows are summed by site and month first, so a frame is made of those sums: no row is copied
    into the frames that it trains, and a hot month or site costs a row a task.
    """
    c = F.col
    known = readings.where(c(value).isNotNull() & c(month).isNotNull())
    sums = keep(known.groupBy(site, month).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.max(F.struct(order, value)).alias("last")))
    calendar = sums.select(month).distinct().withColumn("at", F.row_number().over(Window.orderBy(month)))  # one row a month
    held = sums.join(F.broadcast(calendar), month).withColumn("for_at", F.explode(F.sequence(c("at") + 1, c("at") + months)))
    net = held.groupBy("for_at").agg(F.sum("n").alias("n_train"), (F.sum("s") / F.sum("n")).alias("network_mean"), F.count_distinct("at").alias("months"))
    own = held.where(c(site).isNotNull()).groupBy(c(site).alias("_site"), c("for_at").alias("_for")).agg(F.sum("n").alias("n_site"), F.sum("s").alias("site_sum"), F.max(F.struct("at", c(f"last.{order}").alias("o"), c(f"last.{value}").alias("v"))).alias("last"))
    placed = known.join(F.broadcast(calendar), month)
    out = placed.join(F.broadcast(net.drop("months")), c("at") == c("for_at")).drop("for_at").join(own, (c(site) == c("_site")) & (c("at") == c("_for")), "left")
    return out.select(
        *readings.columns, "n_train", "network_mean", F.coalesce("n_site", F.lit(0)).alias("n_site"), F.coalesce("site_sum", F.lit(0.0)).alias("site_sum"), F.coalesce("last.v", "network_mean").alias("persistence"), c("n_site").isNotNull().alias("seen")
    )


def validation_summary(preds: DataFrame, limit: float, by: str = "month", value: str = "y", baselines: tuple[str, ...] = ("persistence", "network_mean")) -> DataFrame:
    """One row for each month and subset (all, seen, new; those without rows are left out) of predictions.

    preds: by, value (above 0), z_mu and z_sd of its logarithm, seen, baselines, n_train. Gives n_train, n_test, rmse, mae, the
    baselines' rmse, the share inside each band, the median width of the 90 % band, how many were truly below the limit, what
    share of those was flagged (chance of being below over a half; null if there are none) and how many others were.
    """
    c = F.col
    each = preds.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(c("seen"), "seen").otherwise("new"))))
    mean, z = F.exp("z_mu"), (F.log(value) - c("z_mu")) / c("z_sd")
    below, flagged = c(value) < limit, norm_cdf((F.log(F.lit(limit)) - c("z_mu")) / c("z_sd")) > 0.5
    root = lambda x: F.sqrt(F.avg((c(value) - x) ** 2))
    scores: list[Column] = [
        F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), root(mean).alias("rmse"), F.avg(F.abs(c(value) - mean)).alias("mae"), *[root(c(b)).alias(f"rmse_{b}") for b in baselines],
        *[F.avg((F.abs(z) <= q).cast("double")).alias(f"coverage{p}") for p, q in LEVELS.items()], F.count_if(below).alias("n_true_below"),
        (F.count_if(below & flagged) / F.nullif(F.count_if(below), F.lit(0).cast("long"))).alias("recall_below"), F.count_if(~below & flagged).alias("false_alarms"),
    ]
    width = each.withColumn("_width", F.exp(c("z_mu") + LEVELS[90] * c("z_sd")) - F.exp(c("z_mu") - LEVELS[90] * c("z_sd")))
    return each.groupBy(by, "subset").agg(*scores).join(quantiles(width, "_width", {"band90_width": 0.5}, [by, "subset"]), [by, "subset"])

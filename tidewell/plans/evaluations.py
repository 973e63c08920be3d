"""Hold-out evaluation over the driver's tables: line items' prices are truths, part prices their predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..operators import audit, evaluation, ranks, selection
from .readings import table


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth, pred and a band, with a model, a seed, a month and whether the key was seen before."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    pred = F.col("l_quantity") * F.col("p_retailprice")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("truth"), pred.alias("pred"), (pred * (1 - F.col("l_discount"))).alias("low"), (pred * (1 + F.col("l_tax"))).alias("high"),
        F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 8).alias("seed"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_partkey") % 3 != 0).alias("seen"),
    )


PRED = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS truth, l_quantity * p_retailprice AS pred, l_quantity * p_retailprice * (1 - l_discount) AS low, l_quantity * p_retailprice * (1 + l_tax) AS high,
           l_returnflag AS model, l_suppkey % 8 AS seed, strftime(l_shipdate, '%Y-%m') AS month, l_partkey % 3 != 0 AS seen FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
LIMIT = 20000.0
SUMS_SQL = f"""count(*) AS n, sum((pred - truth) ** 2) AS sse, sum(abs(pred - truth)) AS sae, count(*) FILTER (truth < {LIMIT} AND pred < {LIMIT}) AS tp,
 count(*) FILTER (truth >= {LIMIT} AND pred < {LIMIT}) AS fp, count(*) FILTER (truth < {LIMIT} AND pred >= {LIMIT}) AS fn, count(*) FILTER (truth BETWEEN low AND high) AS inside"""
RATES_SQL = "round(sqrt(sse / n), 2) AS rmse, round(sae / n, 2) AS mae, round({d}tp / nullif(tp + fp, 0){e}, 6) AS precision, round({d}tp / nullif(tp + fn, 0){e}, 6) AS recall, round(inside / n, 6) AS coverage"


def sums(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    c = F.col
    stats = evaluation.error_sums(c("truth"), c("pred"), c("low"), c("high"), LIMIT)
    return predictions(spark, sf_dir).groupBy(*by).agg(*[x.alias(k) for k, x in stats.items()])


def with_rates(df: DataFrame, by: list[str], undefined: float | None) -> DataFrame:
    r = evaluation.rates(undefined)
    places = {"rmse": 2, "mae": 2}
    return df.select(*by, *[F.round(r[k], places.get(k, 6)).alias(k) for k in ("rmse", "mae", "precision", "recall", "coverage")])


def a1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undefined ratios are 1 by this convention."""
    return with_rates(sums(spark, sf_dir, ["model"]), ["model"], 1.0)


A1_SQL = PRED + f", s AS (SELECT model, {SUMS_SQL} FROM p GROUP BY model) SELECT model, {RATES_SQL.format(d='coalesce(', e=', 1.0)')} FROM s"


def a4_holdout_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By month, and by month for seen and new keys, in one pass of grouping sets over mergeable sums."""
    c = F.col
    stats = evaluation.error_sums(c("truth"), c("pred"), c("low"), c("high"), LIMIT)
    sets = predictions(spark, sf_dir).groupingSets([[c("month")], [c("month"), c("seen")]], c("month"), c("seen")).agg(F.grouping("seen").alias("all"), *[x.alias(k) for k, x in stats.items()])
    subset = F.when(c("all") == 1, "all").when(c("seen"), "seen").otherwise("new")
    return with_rates(sets.withColumn("subset", subset), ["month", "subset", "n"], None)


A4_SQL = PRED + f""", s AS (SELECT month, CASE WHEN grouping(seen) = 1 THEN 'all' WHEN seen THEN 'seen' ELSE 'new' END AS subset, {SUMS_SQL} FROM p GROUP BY GROUPING SETS ((month), (month, seen)))
SELECT month, subset, n, {RATES_SQL.format(d='', e='')} FROM s"""


def a6_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by model and seed pool by addition into rates by model."""
    by_seed = sums(spark, sf_dir, ["model", "seed"])
    pooled = by_seed.groupBy("model").agg(*[F.sum(k).alias(k) for k in ("n", "sse", "sae", "tp", "fp", "fn", "inside")])
    return with_rates(pooled, ["model"], None)


A6_SQL = PRED + f", s AS (SELECT model, {SUMS_SQL} FROM p GROUP BY model) SELECT model, {RATES_SQL.format(d='', e='')} FROM s"


def a8_rollup_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return evaluation.tree(o, ["priority", "status"], {"n": F.count(F.lit(1)), "mean": F.round(F.avg("o_totalprice"), 2)})


A8_SQL = "SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"


def a10_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).groupBy("month").pivot("model", ["A", "N", "R"]).agg(F.avg(F.abs(F.col("pred") - F.col("truth"))))
    return p.select("month", *[F.round(m, 4).alias(f"mae_{m.lower()}") for m in ("A", "N", "R")])


A10_SQL = PRED + "SELECT month, " + ", ".join(f"round(avg(abs(pred - truth)) FILTER (model = '{m}'), 4) AS mae_{m.lower()}" for m in "ANR") + " FROM p GROUP BY month"


def a18_weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("w", F.lit(1.0) + F.col("s_suppkey") % 5)
    return ranks.weighted_quantiles(s, "s_acctbal", "w", ["s_nationkey"], [0.5]).withColumnRenamed("q_50", "q50")


A18_SQL = """
SELECT s_nationkey, min(s_acctbal) FILTER (c / t >= 0.5 - 1e-12) AS q50 FROM (
  SELECT s_nationkey, s_acctbal, sum(1.0 + s_suppkey % 5) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey % 5 ROWS UNBOUNDED PRECEDING) AS c, sum(1.0 + s_suppkey % 5) OVER (PARTITION BY s_nationkey) AS t FROM supplier) GROUP BY s_nationkey
"""


def a21_inlet_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind its median, rows and days, and its first five users by number."""
    e = table(spark, sf_dir, "events")
    first = ranks.ranked(e.select("event_type", "user_id").distinct(), ["user_id"], ["event_type"]).where("rank <= 5")
    taps = first.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("user_id")).cast("array<string>"), ",").alias("taps"))
    sums = e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.count(F.lit(1)).alias("n"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return sums.join(taps, "event_type")


A21_SQL = """
SELECT event_type, round(median(value), 6) AS median, count(*) AS n, array_to_string(list_sort(list_distinct(list(user_id)))[1:5], ',') AS taps, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last FROM events GROUP BY event_type
"""


def a23_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a ratio of pooled errors over 500 resamples of the seeds."""
    by_seed = predictions(spark, sf_dir).groupBy("seed").agg(F.sum(F.abs(F.col("pred") - F.col("truth"))).alias("top"), F.sum("truth").alias("bottom"))
    draws = evaluation.bootstrap_ratio(by_seed, "seed", "top", "bottom", 500)
    return draws.agg(F.count("ratio").alias("valid"), *[F.round(F.percentile("ratio", F.lit(q)), 8).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])


A23_SQL = PRED + """
, s AS (SELECT row_number() OVER (ORDER BY seed) AS place, sum(abs(pred - truth)) AS top, sum(truth) AS bottom FROM p GROUP BY seed),
d AS (SELECT draw, i, CAST(('0x' || substr(md5(draw || '-' || i), 1, 8)) AS BIGINT) % (SELECT count(*) FROM s) + 1 AS place FROM range(1, 501) a(draw), range(1, 1 + (SELECT count(*) FROM s)) b(i)),
r AS (SELECT draw, sum(top) / nullif(sum(bottom), 0) AS ratio FROM d JOIN s USING (place) GROUP BY draw)
SELECT count(ratio) AS valid, round(quantile_cont(ratio, 0.05), 8) AS q05, round(quantile_cont(ratio, 0.5), 8) AS q50, round(quantile_cont(ratio, 0.95), 8) AS q95 FROM r
"""


def a24_near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("truth") / LIMIT
    bins = {"b1": (0.0, 0.5), "b2": (0.5, 0.9), "b3": (0.9, 1.1), "b4": (1.1, 99.0)}
    return predictions(spark, sf_dir).groupBy("model").agg(*[F.count_if((x >= a) & (x < b)).alias(k) for k, (a, b) in bins.items()])


A24_SQL = PRED + f"""SELECT model, count(*) FILTER (truth / {LIMIT} >= 0 AND truth / {LIMIT} < 0.5) AS b1, count(*) FILTER (truth / {LIMIT} >= 0.5 AND truth / {LIMIT} < 0.9) AS b2,
 count(*) FILTER (truth / {LIMIT} >= 0.9 AND truth / {LIMIT} < 1.1) AS b3, count(*) FILTER (truth / {LIMIT} >= 1.1 AND truth / {LIMIT} < 99) AS b4 FROM p GROUP BY model"""


def a25_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample deviation by seed, then the median over the seeds."""
    by_seed = predictions(spark, sf_dir).groupBy("model", "seed").agg(F.stddev_samp(F.col("pred") - F.col("truth")).alias("sd"))
    return by_seed.groupBy("model").agg(F.round(F.median("sd"), 4).alias("sd"))


A25_SQL = PRED + "SELECT model, round(median(sd), 4) AS sd FROM (SELECT model, seed, stddev_samp(pred - truth) AS sd FROM p GROUP BY model, seed) GROUP BY model"


def a26_error_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error by model and rank decile of the truth, by model over all deciles, and over all."""
    p = predictions(spark, sf_dir).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    binned = evaluation.rank_bins(p, "truth", "line", 10, ["model"])
    return evaluation.tree(binned, ["model", "bin"], {"n": F.count(F.lit(1)), "mae": F.round(F.avg(F.abs(F.col("pred") - F.col("truth"))), 2)})


A26_SQL = PRED + """
, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY truth, l_orderkey * 10 + l_linenumber) AS r, count(*) OVER (PARTITION BY model) AS n FROM p)
SELECT coalesce(model, 'all') AS model, coalesce(CAST(CAST(bin AS INTEGER) AS VARCHAR), 'all') AS bin, count(*) AS n, round(avg(abs(pred - truth)), 2) AS mae
FROM (SELECT *, greatest(1, ceil((r - 1) * 10 / greatest(n - 1, 1))) AS bin FROM r) GROUP BY ROLLUP (model, bin)
"""


def a31_daily_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value")
    return evaluation.daily_least(e, ["user_id", "day"], "hour", "value").withColumnRenamed("at", "hour")


A31_SQL = "SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS least, CAST(arg_min(hour(ts), (value, hour(ts), event_id)) AS INTEGER) AS hour FROM events GROUP BY 1, 2"


def a33_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    found, bad = F.col("n_chars") < 1000, F.col("quality") == 0
    return j.groupBy("lang").agg(F.count_if(bad & found).alias("found"), F.count_if(bad).alias("total"), F.count_if(found & ~bad).alias("false_alarms")).select("*", F.round(ratio(F.col("found"), F.col("total")), 6).alias("recall"))


A33_SQL = """
SELECT lang, count(*) FILTER (quality = 0 AND n_chars < 1000) AS found, count(*) FILTER (quality = 0) AS total, count(*) FILTER (quality != 0 AND n_chars < 1000) AS false_alarms,
 round(count(*) FILTER (quality = 0 AND n_chars < 1000) / nullif(count(*) FILTER (quality = 0), 0), 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY lang
"""


def t1_straddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    s = e.withColumn("score", F.round(selection.straddle(F.col("mu"), F.col("sd"), F.lit(50.0)), 6))
    return selection.take_best(s, "score", "user_id", 10).select("user_id", "score")


T1_SQL = "SELECT user_id, round(1.96 * stddev_pop(value) - abs(avg(value) - 50.0), 6) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 10"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("score"))


def t3_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.diversified_route(points(spark, sf_dir), 3, 0.5, 0.1).select("rank", "id", F.round("gain", 6).alias("gain"))


T3_SQL = """
WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS score FROM embeddings),
a AS (SELECT id, x, y, score AS gain FROM p ORDER BY gain DESC, id LIMIT 1),
b AS (SELECT p.id, p.x, p.y, p.score - 0.5 * exp(-sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2) / 0.1) AS gain FROM p, a WHERE p.id != a.id ORDER BY gain DESC, p.id LIMIT 1),
c AS (SELECT p.id, p.score - 0.5 * exp(-least(sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2), sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2)) / 0.1) AS gain FROM p, a, b WHERE p.id NOT IN (a.id, b.id) ORDER BY gain DESC, p.id LIMIT 1)
SELECT 1::INT AS rank, id, round(gain, 6) AS gain FROM a UNION ALL SELECT 2, id, round(gain, 6) FROM b UNION ALL SELECT 3, id, round(gain, 6) FROM c
"""


def u3_numbers_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = audit.numbers_in(table(spark, sf_dir, "documents"), "doc_id", "text")
    pool = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("pool_value"))
    return audit.trace_numbers(n, pool).select("doc_id", "place", "token", "found")


U3_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?')) AS token, generate_subscripts(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?'), 1) - 1 AS place FROM documents),
n AS (SELECT *, CAST(token AS DOUBLE) AS v, 0.5 * pow(10.0, -length(regexp_extract(token, '\.([0-9]+)$', 1))) AS half FROM t),
h AS (SELECT DISTINCT v, half FROM n WHERE EXISTS (SELECT 1 FROM part WHERE abs(p_retailprice - v) <= half + 1e-12))
SELECT doc_id, CAST(place AS INTEGER) AS place, token, h.v IS NOT NULL AS found FROM n LEFT JOIN h ON n.v = h.v AND n.half = h.half
"""


def u4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-F.col("doc_id")).alias("doc_id")), "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


U4_SQL = """
SELECT CASE WHEN d.doc_id IS NULL THEN 'declared only' WHEN l.doc_id IS NULL THEN 'found only' ELSE 'both' END AS status, count(*) AS n
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END AS doc_id FROM documents) d ON l.doc_id = d.doc_id GROUP BY 1
"""


def u9_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    again = o.withColumn("o_custkey", F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    return audit.differences(o, again).groupBy("side", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


U9_SQL = """
WITH a AS (SELECT o_custkey, o_orderpriority FROM orders), b AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders)
SELECT 'left' AS side, o_orderpriority, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 2 UNION ALL SELECT 'right', o_orderpriority, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 2
"""

QUERIES = {
    "a1_metrics": (a1_metrics, A1_SQL), "a4_holdout_validation": (a4_holdout_validation, A4_SQL), "a6_pooled": (a6_pooled, A6_SQL), "a8_rollup_tree": (a8_rollup_tree, A8_SQL), "a10_pivot": (a10_pivot, A10_SQL),
    "a18_weighted_quantile": (a18_weighted_quantile, A18_SQL), "a21_inlet_medians": (a21_inlet_medians, A21_SQL), "a23_bootstrap": (a23_bootstrap, A23_SQL), "a24_near_threshold": (a24_near_threshold, A24_SQL),
    "a25_spread": (a25_spread, A25_SQL), "a26_error_by_bin": (a26_error_by_bin, A26_SQL), "a31_daily_minimum": (a31_daily_minimum, A31_SQL), "a33_confusion": (a33_confusion, A33_SQL), "t1_straddle": (t1_straddle, T1_SQL),
    "t3_route": (t3_route, T3_SQL), "u3_numbers_audit": (u3_numbers_audit, U3_SQL), "u4_coverage": (u4_coverage, U4_SQL), "u9_differences": (u9_differences, U9_SQL),
}

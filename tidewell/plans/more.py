"""Further operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chemistry, parsing
from ..operators import audit, evaluation, holdout, network, ranks
from . import models
from .evaluations import PRED, predictions
from .models import LINKS_SQL
from .readings import table


def r5_clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour")).distinct()
    return e.select("hour", parsing.clock_label(F.col("hour"), 390).alias("label"))


R5_SQL = "SELECT DISTINCT CAST(hour(ts) AS INTEGER) AS hour, lpad(CAST(floor(((hour(ts) * 60 + 390) % 1440) / 60) AS INT)::VARCHAR, 2, '0') || ':' || lpad(((hour(ts) * 60 + 390) % 60)::VARCHAR, 2, '0') AS label FROM events"


def m4_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(chemistry.roughness_factor(80.0 + F.col("p_size"), 0.7), 8).alias("factor"))


M4_SQL = "SELECT p_partkey, round(pow(2.0, -0.7 * (80.0 + p_size - 130) / 30), 8) AS factor FROM part"


def m12_median_longitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes that straddle the antimeridian are shifted by 360 before the median."""
    e = table(spark, sf_dir, "embeddings").select("label", (170 + 20 * F.element_at("embedding", 1).cast("double")).alias("raw"))
    lon = e.withColumn("lon", F.when(F.col("raw") > 180, F.col("raw") - 360).otherwise(F.col("raw")))
    spread = lon.groupBy("label").agg((F.max("lon") - F.min("lon") > 180).alias("over"), F.median("lon").alias("plain"), F.median(F.pmod("lon", F.lit(360.0))).alias("shifted"))
    m = F.when(F.col("over"), F.when(F.col("shifted") > 180, F.col("shifted") - 360).otherwise(F.col("shifted"))).otherwise(F.col("plain"))
    return spread.select("label", F.round(m, 6).alias("lon"))


M12_SQL = """
WITH e AS (SELECT label, 170 + 20 * CAST(embedding[1] AS DOUBLE) AS r FROM embeddings), l AS (SELECT label, CASE WHEN r > 180 THEN r - 360 ELSE r END AS lon FROM e),
s AS (SELECT label, max(lon) - min(lon) > 180 AS o, median(lon) AS p, median(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS q FROM l GROUP BY label)
SELECT label, round(CASE WHEN o THEN CASE WHEN q > 180 THEN q - 360 ELSE q END ELSE p END, 6) AS lon FROM s
"""


def j6_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return holdout.require_keys(o, table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'"), "c_custkey")


J6_SQL = "SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING') GROUP BY 1"


def j12_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' mean errors side by side for each month."""
    p = predictions(spark, sf_dir).groupBy("model", "month").agg(F.round(F.avg(F.abs(F.col("pred") - F.col("truth"))), 2).alias("mae"))
    return evaluation.paired(p, ["month"], "model", ("A", "N"), "mae").withColumnsRenamed({"mae_A": "mae_a", "mae_N": "mae_n"})


J12_SQL = PRED + ", m AS (SELECT model, month, round(avg(abs(pred - truth)), 2) AS mae FROM p GROUP BY 1, 2) SELECT coalesce(a.month, n.month) AS month, a.mae AS mae_a, n.mae AS mae_n FROM (SELECT * FROM m WHERE model = 'A') a FULL JOIN (SELECT * FROM m WHERE model = 'N') n ON a.month = n.month"


def j14_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the sum of their lines; every tenth order goes by another number."""
    key = F.when(F.col("o_orderkey") % 10 == 3, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("key")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = table(spark, sf_dir, "orders").select(key, F.round("o_totalprice", 2).alias("total"))
    return evaluation.recomputed(o, li, "key", "total", 0.01).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


J14_SQL = """
WITH l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS lines FROM lineitem GROUP BY 1), o AS (SELECT CASE WHEN o_orderkey % 10 = 3 THEN -o_orderkey ELSE o_orderkey END AS k, round(o_totalprice, 2) AS stated FROM orders)
SELECT CASE WHEN stated IS NULL THEN 'computed only' WHEN lines IS NULL THEN 'stated only' WHEN abs(stated - lines) <= 0.01 * stated THEN 'same' ELSE 'differs' END AS status, count(*) AS n FROM o FULL JOIN l ON o.k = l.k GROUP BY 1
"""


def j16_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.parameter_grid(spark, {"kb": [0.1, 0.3, 0.5], "kw": [0.0, 0.05], "demand": [0.9, 1.0, 1.1]})


J16_SQL = "SELECT CAST((i * 2 + j) * 3 + k AS INTEGER) AS member, ([0.1, 0.3, 0.5])[i + 1]::DOUBLE AS kb, ([0.0, 0.05])[j + 1]::DOUBLE AS kw, ([0.9, 1.0, 1.1])[k + 1]::DOUBLE AS demand FROM range(3) a(i), range(2) b(j), range(3) c(k)"


def g2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the first kind of source that it has: suppliers in credit, else all suppliers, else customers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(2).alias("rank"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.lit(3).alias("rank"))
    all_ = s.union(c)
    best = all_.groupBy("nation").agg(F.min("rank").alias("rank"))
    return all_.join(best, ["nation", "rank"]).groupBy("nation", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


G2_SQL = """
WITH a AS (SELECT s_nationkey AS nation, CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 2 END AS rank FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 3 FROM customer)
SELECT nation, rank, count(*) AS n, min(id) AS first FROM a WHERE rank = (SELECT min(rank) FROM a b WHERE b.nation = a.nation) GROUP BY nation, rank
"""


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links: against their order where b is one over a multiple of 4, and both ways where it is a multiple of 3."""
    e, turned = models.edges(spark, sf_dir).select("a", "b"), F.col("b") % 4 == 1
    ends = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    ways = F.array_compact(F.array(F.when(~turned | (F.col("b") % 3 == 0), ends("a", "b")), F.when(turned | (F.col("b") % 3 == 0), ends("b", "a"))))
    return e.select(F.inline(ways))


REACH_SQL = f"WITH RECURSIVE {LINKS_SQL}, f AS (SELECT a, b FROM e WHERE b % 4 != 1 OR b % 3 = 0 UNION ALL SELECT b, a FROM e WHERE b % 4 = 1 OR b % 3 = 0), r AS (SELECT 0::BIGINT AS node UNION SELECT f.b FROM r JOIN f ON r.node = f.a)"


def g10_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    return network.reachable(directed(spark, sf_dir), source).select("node")


def a3_coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truths inside bands of a normal with the band's width."""
    p = predictions(spark, sf_dir).withColumn("sd", (F.col("high") - F.col("low")) / 2)
    inside = lambda z: F.round(F.avg((F.abs(F.col("truth") - F.col("pred")) <= z * F.col("sd")).cast("int")), 8)
    return p.groupBy("model").agg(inside(0.6745).alias("in50"), inside(1.2816).alias("in80"), inside(1.96).alias("in95"))


A3_SQL = PRED + "SELECT model, " + ", ".join(f"round(avg(CASE WHEN abs(truth - pred) <= {z} * (high - low) / 2 THEN 1 ELSE 0 END), 8) AS in{q}" for q, z in ((50, 0.6745), (80, 1.2816), (95, 1.96))) + " FROM p GROUP BY model"


def a7_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that are null where all parts are null, sizes and first values by several keys."""
    li = table(spark, sf_dir, "lineitem").withColumn("maybe", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")))
    return evaluation.compact(li, ["l_orderkey", "l_returnflag"], "maybe", "l_linestatus", ["l_linenumber"])


A7_SQL = "SELECT l_orderkey, l_returnflag, sum(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS total, count(*) AS size, arg_min(l_linestatus, (l_linenumber, l_linestatus)) AS first FROM lineitem GROUP BY 1, 2"


def a19_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest over the members of a grid, by junction, and whether they differ by a tenth."""
    g = models.grid(spark, sf_dir).select("junction", F.explode("z").alias("z"))
    b = g.groupBy("junction").agg(F.min("z").alias("lo"), F.median("z").alias("mid"), F.max("z").alias("hi"))
    return b.select("junction", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")], (F.col("hi") - F.col("lo") > 0.1).alias("wide"))


def a28_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).agg(F.round(F.sqrt(F.avg((F.col("pred") - F.col("truth")) ** 2)), 4).alias("rmse"), F.round(F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("int")), 8).alias("coverage"), F.count(F.lit(1)).alias("n"))
    return holdout.gates(p, [("rmse", "most", 30000.0), ("coverage", "least", 0.85), ("n", "least", 100.0)])


A28_SQL = PRED + """, v AS (SELECT round(sqrt(avg((pred - truth) ** 2)), 4) AS rmse, round(avg(CASE WHEN truth BETWEEN low AND high THEN 1 ELSE 0 END), 8) AS coverage, count(*) AS n FROM p)
SELECT 'rmse' AS bar, rmse AS value, 30000.0::DOUBLE AS "limit", rmse <= 30000 AS passed FROM v UNION ALL SELECT 'coverage', coverage, 0.85, coverage >= 0.85 FROM v UNION ALL SELECT 'n', n, 100, n >= 100 FROM v"""


def a30_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_linestatus").alias("pairs"))


A30_SQL = "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linestatus)) AS pairs FROM lineitem GROUP BY 1"


def a35_share_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.min("value").alias("least"))
    return evaluation.share_below(e, ["hour"], "least", 10).select("hour", F.round("share", 8).alias("share"))


A35_SQL = "SELECT CAST(hour AS INTEGER) AS hour, round(avg(CASE WHEN least < 10 THEN 1 ELSE 0 END), 8) AS share FROM (SELECT user_id, hour(ts) AS hour, min(value) AS least FROM events GROUP BY 1, 2) GROUP BY 1"


def a36_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of an even number of readings decides."""
    hour, e = F.hour("ts"), table(spark, sf_dir, "events")
    middle = ranks.upper_medians(e.where("value is not null"), "value", "event_id", ["event_type"])
    sums = e.groupBy("event_type").agg((F.count_if((hour < 6) | (hour >= 18)) * 2 > F.count(F.lit(1))).alias("mostly_at_night"), F.count_if(F.col("value") > 90).alias("over"))
    return sums.join(middle, "event_type", "left").select("event_type", (F.col("upper_median") > 50).alias("high_median"), "mostly_at_night", "over")


A36_SQL = "SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL))[CAST(floor(count(value) / 2) AS INT) + 1] > 50 AS high_median, count(*) FILTER (hour(ts) < 6 OR hour(ts) >= 18) * 2 > count(*) AS mostly_at_night, count(*) FILTER (value > 90) AS over FROM events GROUP BY 1"


def w5_last_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return o.join(F.broadcast(holdout.last_months(o, "month", 6)), "month", "left_semi").groupBy("month").agg(F.count(F.lit(1)).alias("n"))


W5_SQL = "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders) SELECT month, count(*) AS n FROM o WHERE month IN (SELECT DISTINCT month FROM o ORDER BY month DESC LIMIT 6) GROUP BY month"


def w9_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_nationkey", "c_custkey", "rank")


W9_SQL = "SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3"


def w11_ratio_to_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.ratio_to_max(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", F.round("ratio", 8).alias("ratio"))


W11_SQL = "SELECT c_custkey, round(c_acctbal / nullif(max(c_acctbal) OVER (PARTITION BY c_mktsegment), 0), 8) AS ratio FROM customer"


def w13_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.leave_out_groups(table(spark, sf_dir, "supplier"), "s_suppkey", 7, "2026")


W13_SQL = "SELECT s_suppkey, CAST(ceil(row_number() OVER (ORDER BY md5('2026|' || s_suppkey), s_suppkey) / 7) AS INTEGER) AS fold FROM (SELECT DISTINCT s_suppkey FROM supplier)"


def t5_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.max("o_totalprice").alias("most"))


T5_SQL = "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS most FROM orders GROUP BY 1"


def u2_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell is used, censored, blank or refused: the parts sum to the file's rows."""
    from .readings import cells

    c = cells(spark, sf_dir).withColumn("r", parsing.reading(F.col("cell")))
    g = c.groupBy(F.col("r.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return g.union(c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all rows"), "n"))


def u5_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed tags of configurations."""
    grid = holdout.parameter_grid(spark, {"kb": [0.1, 0.3], "kw": [0.0, 0.05]})
    text = F.concat_ws(";", F.concat(F.lit("kb="), F.format_string("%.3f", "kb")), F.concat(F.lit("kw="), F.format_string("%.3f", "kw")))
    return grid.select("member", F.substring(F.sha1(text.cast("binary")), 1, 12).alias("tag"))


U5_SQL = "SELECT CAST(i * 2 + j AS INTEGER) AS member, substr(sha1('kb=' || printf('%.3f', ([0.1, 0.3])[i + 1]::DOUBLE) || ';kw=' || printf('%.3f', ([0.0, 0.05])[j + 1]::DOUBLE)), 1, 12) AS tag FROM range(2) a(i), range(2) b(j)"


def x23_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 multipliers of a day turned so that the pattern starts at the model's hour."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    m = e.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda s: s["n"]).alias("m"), F.avg("n").alias("mean"))
    turned = F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.element_at("m", ((i + 6) % F.size("m") + 1).cast("int")) / F.col("mean"))
    return m.select("event_type", F.posexplode(turned).alias("step", "multiplier")).select("event_type", "step", F.round("multiplier", 8).alias("multiplier"))


X23_SQL = """
WITH e AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, n, avg(n) OVER (PARTITION BY event_type) AS mean, count(*) OVER (PARTITION BY event_type) AS k, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i FROM e)
SELECT event_type, CAST((i - 6 + k) % k AS INTEGER) AS step, round(n / mean, 8) AS multiplier FROM r
"""


def a5_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficient statistics per seed; sums of them are those of the whole."""
    c = F.col
    stats = evaluation.error_sums(c("truth"), c("pred"), c("low"), c("high"), 20000.0)
    return predictions(spark, sf_dir).groupBy("seed").agg(*[stats[k].alias(k) for k in ("n", "tp", "fp", "fn", "inside")], F.round(stats["sae"], 2).alias("sae"))


A5_SQL = PRED + """SELECT seed, count(*) AS n, count(*) FILTER (truth < 20000 AND pred < 20000) AS tp, count(*) FILTER (truth >= 20000 AND pred < 20000) AS fp, count(*) FILTER (truth < 20000 AND pred >= 20000) AS fn,
 count(*) FILTER (truth BETWEEN low AND high) AS inside, round(sum(abs(pred - truth)), 2) AS sae FROM p GROUP BY seed"""


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result frames with different columns under each other."""
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


U1_SQL = "SELECT n_name AS name, n_regionkey AS region, NULL AS kind FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region"


def u4_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared keys against those that are there, in both directions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return audit.coverage(table(spark, sf_dir, "customer"), o, "c_custkey").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


U4_SQL = "SELECT CASE WHEN o IS NULL THEN 'declared only' WHEN c_custkey IS NULL THEN 'found only' ELSE 'both' END AS status, count(*) AS n FROM customer FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c_custkey = o GROUP BY 1"

QUERIES = {
    "r5_clock_labels": (r5_clock_labels, R5_SQL), "m4_roughness": (m4_roughness, M4_SQL), "m12_median_longitude": (m12_median_longitude, M12_SQL), "j6_missing_keys": (j6_missing_keys, J6_SQL), "j12_paired": (j12_paired, J12_SQL),
    "j14_recomputed": (j14_recomputed, J14_SQL), "j16_parameters": (j16_parameters, J16_SQL), "g2_sources": (g2_sources, G2_SQL), "g10_reachable": (g10_reachable, REACH_SQL + " SELECT node FROM r"), "a3_coverage_levels": (a3_coverage_levels, A3_SQL),
    "a5_sums": (a5_sums, A5_SQL), "a7_compact": (a7_compact, A7_SQL),
    "a19_age_band": (a19_age_band, models.GRID_SQL + "SELECT junction, round(min(z), 6) AS lo, round(median(z), 6) AS mid, round(max(z), 6) AS hi, max(z) - min(z) > 0.1 AS wide FROM g GROUP BY junction"),
    "a28_gates": (a28_gates, A28_SQL), "a30_distinct": (a30_distinct, A30_SQL), "a35_share_by_hour": (a35_share_by_hour, A35_SQL), "a36_plausibility": (a36_plausibility, A36_SQL), "w5_last_months": (w5_last_months, W5_SQL),
    "w9_top_per_group": (w9_top_per_group, W9_SQL), "w11_ratio_to_max": (w11_ratio_to_max, W11_SQL), "w13_leave_out": (w13_leave_out, W13_SQL), "t5_oldest": (t5_oldest, T5_SQL),
    "u1_union": (u1_union, U1_SQL), "u2_accounting": (u2_accounting, "WITH c AS (SELECT event_id % 6 AS k FROM events) SELECT CASE k WHEN 1 THEN 'censored_below' WHEN 2 THEN 'censored_below' WHEN 4 THEN 'blank' WHEN 5 THEN 'censored_above' ELSE 'used' END AS state, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'all rows', count(*) FROM c"),
    "u4_contract": (u4_contract, U4_SQL), "u5_tags": (u5_tags, U5_SQL), "x23_pattern": (x23_pattern, X23_SQL),
}

"""Readings from the driver's tables: events stand for grab samples, orders for monthly plant rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import matching, series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_of(ts):
    return F.hour(ts) * 60 + F.minute(ts)


CELL = "CASE event_id % 6 WHEN 0 THEN CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) || ' mg/L' WHEN 1 THEN '<' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 2 THEN 'ND' WHEN 3 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',5' WHEN 4 THEN '-' ELSE '>' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.25 ppm' END"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(CELL.replace("VARCHAR", "STRING")).alias("cell"))


def r1_parse_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("r", parsing.reading(F.col("cell"))).select("event_id", "cell", "r.value", "r.state")


R1_SQL = f"""
WITH c AS (SELECT event_id, {CELL} AS cell FROM events),
p AS (SELECT *, regexp_replace(lower(trim(cell)), '\\s*(mg/l|ppm)$', '') AS b FROM c),
n AS (SELECT *, TRY_CAST(replace(regexp_replace(b, '^[<>]', ''), ',', '.') AS DOUBLE) AS v FROM p)
SELECT event_id, cell, CASE WHEN b = 'nd' OR b = '-' THEN NULL ELSE v END AS value,
       CASE WHEN b = '-' THEN 'blank' WHEN b = 'nd' OR b LIKE '<%' THEN 'censored_below' WHEN b LIKE '>%' THEN 'censored_above' WHEN v IS NOT NULL THEN 'used' ELSE 'refused' END AS state
FROM n
"""


def r2_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "H:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "h:mm a")).otherwise(F.date_format("ts", "HHmm"))
    m = parsing.clock_minutes(F.col("clock"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("clock")).select("event_id", m.alias("minute"), parsing.model_hour(m, 360).alias("model_hour"))


R2_SQL = """
SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, CAST(floor(((hour(ts) * 60 + minute(ts) - 360 + 1440) % 1440) / 60) AS INTEGER) AS model_hour FROM events
"""


def r9_header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parsing.header_words(F.concat("p_name", F.lit("SampleDate (ug/L)"))).alias("words"), parsing.header_unit(F.concat("p_brand", F.lit(" ug/L"))).alias("unit"))


R9_SQL = r"""
SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || 'SampleDate (ug/L)', '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9µ]+', ' ', 'g')) AS words, CAST(0.001 AS DOUBLE) AS unit FROM part
"""


def r13_clean_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", parsing.clean_id(F.concat("c_name", F.lit(" ; "), "c_mktsegment", F.lit(" main street"))).alias("id"))


R13_SQL = """
WITH s AS (SELECT c_custkey, c_name || ' ; ' || c_mktsegment || ' main street' AS whole, regexp_replace(regexp_replace(regexp_replace(c_name || ' ; ' || c_mktsegment || ' main street', '[^A-Za-z0-9_.:+/#@-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS safe FROM customer)
SELECT c_custkey, CASE WHEN strlen(safe) <= 31 THEN safe ELSE substr(safe, 1, 22) || '_' || substr(sha1(whole), 1, 8) END AS id FROM s
"""


def r10_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    cell = F.when(F.col("p_partkey") % 5 == 0, F.concat(n, F.lit('" CI'))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("DN"), n)).when(F.col("p_partkey") % 5 == 2, F.concat(n, F.lit("mm PVC"))).when(F.col("p_partkey") % 5 == 3, F.concat(n, F.lit("-1/2 in"))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")).select("p_partkey", "cell", F.round(parsing.diameter_mm(F.col("cell")), 6).alias("mm"))


R10_SQL = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '" CI' WHEN 1 THEN 'DN' || p_size WHEN 2 THEN p_size || 'mm PVC' WHEN 3 THEN p_size || '-1/2 in' ELSE CAST(p_size AS VARCHAR) END AS cell,
       round(CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) * 25.4 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN (CAST(p_size AS DOUBLE) + 0.5) * 25.4 END, 6) AS mm FROM part
"""


def r11_bare_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return g.select("p_brand", parsing.bare_unit(F.col("lo"), F.col("hi")).alias("unit"))


R11_SQL = """
SELECT p_brand, CASE WHEN min(p_size) >= 2 AND max(p_size) <= 48 THEN 'in' WHEN min(p_size) >= 50 AND max(p_size) <= 1200 THEN 'mm' WHEN min(p_size) >= 0.05 AND max(p_size) <= 1.2 THEN 'm' END AS unit FROM part GROUP BY p_brand
"""


def r15_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.concat(F.lit("laid "), F.date_format("o_orderdate", "yyyy"), F.lit(" CI")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.year(text).alias("year"))


R15_SQL = "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


def j1_map_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings meet their sites by exact key, else by number; the rest is dropped with a reason."""
    readings = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.lpad(F.col("user_id").cast("string"), 8, "0")).otherwise(F.col("user_id").cast("string")).alias("tap"))
    tap = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("X"), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    sites = table(spark, sf_dir, "customer").select(tap.alias("tap_id"), F.col("c_nationkey").alias("junction"))
    return matching.map_readings(readings, sites, "tap", "tap_id", "junction").groupBy("disposition", "reason", "site").agg(F.count(F.lit(1)).alias("n"))


J1_SQL = """
WITH r AS (SELECT event_id, user_id FROM events), s AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS c_custkey, c_nationkey FROM customer)
SELECT CASE WHEN c_custkey IS NULL THEN 'dropped' ELSE 'used' END AS disposition, CASE WHEN c_custkey IS NULL THEN 'unknown key' END AS reason, c_nationkey AS site, count(*) AS n
FROM r LEFT JOIN s ON user_id = c_custkey GROUP BY 1, 2, 3
"""


def j8_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order value before 1997, else the mean of all before it."""
    orders = table(spark, sf_dir, "orders")
    cutoff = F.lit("1997-01-01").cast("timestamp_ntz")
    last = matching.last_before(orders, cutoff, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    mean = orders.where(F.col("o_orderdate") < cutoff).agg(F.avg("o_totalprice").alias("mean"))
    return orders.where(F.col("o_orderdate") >= cutoff).join(last, "o_custkey", "left").crossJoin(F.broadcast(mean)).select("o_orderkey", F.round(F.coalesce("persisted", "mean"), 6).alias("persistence"))


J8_SQL = """
WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM t GROUP BY o_custkey)
SELECT o_orderkey, round(coalesce(p, (SELECT avg(o_totalprice) FROM t)), 6) AS persistence FROM orders LEFT JOIN l USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1997-01-01'
"""


def j9_nearest_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), minute_of("ts").alias("minute"), "value")
    return matching.nearest_to_clock(e, F.col("minute"), 600, 60, ["user_id", "day"], ["event_id"]).select("user_id", "day", "event_id", "value")


J9_SQL = """
SELECT user_id, day, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY abs(minute - 600), minute, event_id) AS r
  FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute, value FROM events) WHERE abs(minute - 600) <= 60) WHERE r = 1
"""


def j10_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    return matching.tolerance_counts(s, c, "s_suppkey", "a", "b", "c_custkey", 25.0)


J10_SQL = "SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 25.0 GROUP BY s_suppkey"


def j11_trailing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    sums = o.groupBy("month").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    pairs = matching.trailing_months(sums, "month", 6)
    return pairs.join(sums, pairs["train_month"] == sums["month"]).groupBy("held_month").agg(F.count(F.lit(1)).alias("months"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


J11_SQL = """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY month) AS k FROM m)
SELECT h.month AS held_month, count(*) AS months, round(sum(t.s) / sum(t.n), 6) AS mean FROM r h JOIN r t ON t.k BETWEEN h.k - 6 AND h.k - 1 GROUP BY h.month
"""


def j21_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return matching.nearby_points(p, 0.01).select("a", "b", F.round("d", 6).alias("d"))


J21_SQL = """
WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT p.id AS a, q.id AS b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS d FROM p JOIN p q ON p.id < q.id AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 0.01
"""


def w1_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(5)).alias("site"), F.to_date("ts").alias("day"), minute_of("ts").alias("minute"))
    return series.analyzer_sites(e, "site", "day", "minute")


W1_SQL = """
WITH e AS (SELECT user_id % 5 AS site, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute FROM events),
g AS (SELECT site, day, minute - lag(minute) OVER (PARTITION BY site, day ORDER BY minute) AS gap FROM e),
d AS (SELECT site, day, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS s FROM g GROUP BY 1, 2),
k AS (SELECT site, n, s[CAST(floor(len(s) / 2) AS INT) + 1] AS typical FROM d)
SELECT site, count(*) FILTER (n >= 12 AND typical <= 30) >= 2 OR count(*) FILTER (n >= 12) >= 7 AS is_analyzer FROM k GROUP BY site
"""


def w4_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    return series.islands(e, "event_id", ["event_type", "high"])


W4_SQL = """
SELECT event_type, high, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (
  SELECT event_type, value > 50 AS high, event_id, event_id - row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY event_id) AS i FROM events) GROUP BY event_type, high, i
"""


def w7_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    return series.forward_fill(c, "head", ["conv_id"], ["turn", "text"], "section").select("conv_id", "turn", "role", "section")


W7_SQL = """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations
"""


def w8_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.unique_ids(table(spark, sf_dir, "part"), "p_name", "p_partkey", "id").select("p_partkey", "id")


W8_SQL = """
SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)
"""

QUERIES = {
    "r1_parse_reading": (r1_parse_reading, R1_SQL), "r2_clock": (r2_clock, R2_SQL), "r9_header_words": (r9_header_words, R9_SQL), "r10_diameter": (r10_diameter, R10_SQL), "r11_bare_unit": (r11_bare_unit, R11_SQL),
    "r13_clean_id": (r13_clean_id, R13_SQL), "r15_year": (r15_year, R15_SQL), "j1_map_readings": (j1_map_readings, J1_SQL), "j8_persistence": (j8_persistence, J8_SQL), "j9_nearest_clock": (j9_nearest_clock, J9_SQL),
    "j10_tolerance": (j10_tolerance, J10_SQL), "j11_trailing_months": (j11_trailing_months, J11_SQL), "j21_nearby_points": (j21_nearby, J21_SQL), "w1_analyzers": (w1_analyzers, W1_SQL), "w4_islands": (w4_islands, W4_SQL),
    "w7_forward_fill": (w7_forward_fill, W7_SQL), "w8_unique_ids": (w8_unique_ids, W8_SQL),
}

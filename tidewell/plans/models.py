"""Closed forms, the hypothesis grid and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import network, posterior
from .readings import table


def m1_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.pmod(F.col("value"), F.lit(30.0))
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(chemistry.arrhenius(t, 50000.0), 8).alias("rate"), F.round(chemistry.viscosity(t) * 1e6, 6).alias("viscosity"), F.round(chemistry.seasonal(F.dayofyear("ts").cast("double"), 12.0, 8.0, 210.0), 6).alias("temperature"),
        F.round(chemistry.warming(t, F.lit(5.0), F.lit(15.0), 24.0), 6).alias("warmed"),
    )


M1_SQL = """
SELECT event_id, round(exp(-50000.0 / 8.314 * (1 / (value % 30 + 273.15) - 1 / 293.15)), 8) AS rate, round(497e-6 / pow(value % 30 + 42.5, 1.5) * 1e6, 6) AS viscosity,
 round(round_even((12.0 + 8.0 * cos(2 * pi() * (dayofyear(ts) - 210.0) / 365.0)) * 2, 0) / 2, 6) AS temperature, round(15.0 - 10.0 * exp(-(value % 30) / 24.0), 6) AS warmed FROM events
"""


def m3_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(-1)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    c = chemistry.decay(F.lit(1.2), F.col("l_quantity"), F.col("l_discount"), order, F.lit(0.2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 8).alias("c"), F.round(chemistry.norm_cdf((c - 0.4) / 0.3), 8).alias("p_above"))


M3_SQL = """
WITH d AS (SELECT l_orderkey, l_linenumber, greatest(CASE l_linenumber % 4 WHEN 0 THEN 1.2 - l_discount * l_quantity WHEN 1 THEN 1.2 * exp(-l_discount * l_quantity) WHEN 2 THEN 1.2 / (1 + 1.2 * l_quantity * l_discount) ELSE 0.2 + 1.0 * exp(-l_discount * l_quantity) END, 0.0) AS c FROM lineitem),
z AS (SELECT *, (c - 0.4) / 0.3 AS x, 1 / (1 + 0.2316419 * abs((c - 0.4) / 0.3)) AS t FROM d),
q AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM z)
SELECT l_orderkey, l_linenumber, round(c, 8) AS c, round(CASE WHEN x >= 0 THEN 1 - tail ELSE tail END, 8) AS p_above FROM q
"""

MEMBERS, KB, KW = 15, 5, 3  # 5 bulk rates by 3 wall rates, bulk rate major


def members(spark: SparkSession) -> DataFrame:
    return spark.range(MEMBERS).select(F.col("id").cast("int").alias("member"), (0.1 + 0.1 * F.floor(F.col("id") / KW)).alias("kb"), (0.05 * (F.col("id") % KW)).alias("kw"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, junction, z): ln C of each member by plug flow to a nation's age."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("junction"), (F.col("n_nationkey") % 9 + 1).alias("age"))
    z = F.transform(F.sequence(F.lit(0), F.lit(MEMBERS - 1)), lambda m: -(0.1 + 0.1 * F.floor(m / KW)) * F.col("age") / 3 - 0.05 * (m % KW) * F.col("age") - 0.01 * F.col("hour"))
    return n.select("junction", "age", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).select("hour", "junction", z.alias("z"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading for each event."""
    return table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), (F.col("user_id") % 25).cast("int").alias("junction"), (0.05 + F.pmod(F.col("value"), F.lit(1.0))).alias("y"))


GRID_SQL = """
WITH g AS (SELECT n_nationkey AS junction, h.hour, m.member, -(0.1 + 0.1 * floor(m.member / 3)) * (n_nationkey % 9 + 1) / 3 - 0.05 * (m.member % 3) * (n_nationkey % 9 + 1) - 0.01 * h.hour AS z FROM nation, range(24) h(hour), range(15) m(member)),
s AS (SELECT hour(ts) AS hour, user_id % 25 AS junction, 0.05 + value % 1.0 AS y FROM events),
l AS (SELECT member, sum(-0.5 * ((ln(greatest(y, 0.02)) - z) / 0.3) ** 2) - count(*) * ln(0.3) AS loglik FROM g JOIN s USING (hour, junction) GROUP BY member),
w AS (SELECT member, exp(loglik - max(loglik) OVER ()) / sum(exp(loglik - (SELECT max(loglik) FROM l))) OVER () AS w FROM l)
"""


def member_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.weights(posterior.log_likelihood(grid(spark, sf_dir), samples(spark, sf_dir), 0.3))


def a11_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.log_likelihood(grid(spark, sf_dir), samples(spark, sf_dir), 0.3).select("member", F.round("loglik", 1).alias("loglik"))


def a12_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_weights(spark, sf_dir).select("member", F.round("w", 5).alias("w"))


def a13_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.moments(grid(spark, sf_dir), member_weights(spark, sf_dir)).select("hour", "junction", F.round("mu", 4).alias("mu"), F.round("var", 4).alias("var"))


def a15_edge_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = member_weights(spark, sf_dir)
    both = posterior.edge_mass(w, members(spark), "kb").union(posterior.edge_mass(w, members(spark), "kw"))
    return both.select("axis", F.round("at_least", 5).alias("at_least"), F.round("at_most", 5).alias("at_most"))


def a16_best_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_weights(spark, sf_dir).agg(posterior.best_member().alias("member"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of suppliers and nations: pipes of a supplier to its nation and to the next one; every seventh supplier is on islands of their own."""
    s = table(spark, sf_dir, "supplier")
    link = lambda to, tag: s.select((F.col("s_suppkey") + 1000).cast("bigint").alias("p"), (to + F.when(F.col("s_suppkey") % 7 == 0, 500).otherwise(0)).cast("bigint").alias("q"), F.round(F.abs("s_acctbal") + 1, 2).alias("weight"), F.concat("s_name", F.lit(tag)).alias("name"))
    return link(F.col("s_nationkey"), "-a").union(link((F.col("s_nationkey") + F.col("s_suppkey") % 7) % 25, "-b"))


LINKS_SQL = """
l AS (SELECT * FROM (SELECT CAST(s_suppkey + 1000 AS BIGINT) AS p, CAST(s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 500 ELSE 0 END AS BIGINT) AS q, round(abs(s_acctbal) + 1, 2) AS weight, s_name || '-a' AS name FROM supplier
 UNION ALL SELECT s_suppkey + 1000, (s_nationkey + s_suppkey % 7) % 25 + CASE WHEN s_suppkey % 7 = 0 THEN 500 ELSE 0 END, round(abs(s_acctbal) + 1, 2), s_name || '-b' FROM supplier)),
e AS (SELECT least(p, q) AS a, greatest(p, q) AS b, min(weight) AS weight, arg_min(name, (weight, name)) AS link FROM l WHERE p != q GROUP BY 1, 2),
d AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.undirected(links(spark, sf_dir), "p", "q", "weight", "name")


def g1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def g3_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    return network.shortest_paths(network.both_ways(edges(spark, sf_dir)), source).select("node", F.round("dist", 4).alias("dist"))


G3_SQL = f"""
WITH RECURSIVE {LINKS_SQL}, r AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS i UNION
 SELECT node, dist, i FROM (SELECT d.b AS node, min(r.dist + d.weight) AS dist, max(r.i) + 1 AS i FROM r JOIN d ON r.node = d.a WHERE r.i < 60 GROUP BY d.b))
SELECT node, round(min(dist), 4) AS dist FROM r GROUP BY node
"""


def g5_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.incident(edges(spark, sf_dir), "weight").select("node", "degree", F.round("mean", 4).alias("mean"), "least")


def g8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return network.components(nodes, e)


def g13_length_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each link's length to each end, as a share of all."""
    ends = edges(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("node"), (F.col("weight") / 2).alias("half")).groupBy("node").agg(F.sum("half").alias("half"))
    total = ends.agg(F.sum("half").alias("total"))
    return ends.crossJoin(F.broadcast(total)).select("node", F.round(F.col("half") / F.col("total"), 9).alias("share"))


QUERIES = {
    "m1_chemistry": (m1_chemistry, M1_SQL), "m3_decay": (m3_decay, M3_SQL),
    "a11_loglik": (a11_loglik, GRID_SQL + "SELECT CAST(member AS INTEGER) AS member, round(loglik, 1) AS loglik FROM l"),
    "a12_weights": (a12_weights, GRID_SQL + "SELECT CAST(member AS INTEGER) AS member, round(w, 5) AS w FROM w"),
    "a13_moments": (a13_moments, GRID_SQL + ", m AS (SELECT hour, junction, sum(w * z) AS mu FROM g JOIN w USING (member) GROUP BY 1, 2) SELECT CAST(hour AS INTEGER) AS hour, junction, round(any_value(mu), 4) AS mu, round(greatest(sum(w * (z - mu) ** 2), 1e-6), 4) AS var FROM g JOIN w USING (member) JOIN m USING (hour, junction) GROUP BY hour, junction"),
    "a15_edge_mass": (a15_edge_mass, GRID_SQL + "SELECT 'kb' AS axis, round(sum(w) FILTER (member < 3), 5) AS at_least, round(sum(w) FILTER (member >= 12), 5) AS at_most FROM w UNION ALL SELECT 'kw', round(sum(w) FILTER (member % 3 = 0), 5), round(sum(w) FILTER (member % 3 = 2), 5) FROM w"),
    "a16_best_member": (a16_best_member, GRID_SQL + "SELECT CAST(arg_max(member, (w, -member)) AS INTEGER) AS member FROM w"),
    "g1_edges": (g1_edges, f"WITH {LINKS_SQL} SELECT a, b, weight, link FROM e"), "g3_shortest_paths": (g3_shortest_paths, G3_SQL),
    "g5_incident": (g5_incident, f"WITH {LINKS_SQL} SELECT a AS node, count(*) AS degree, round(avg(weight), 4) AS mean, min(weight) AS least FROM d GROUP BY a"), "g8_components": (g8_components, f"WITH RECURSIVE {LINKS_SQL}, r AS (SELECT DISTINCT a AS node, a AS part FROM d UNION SELECT d.b, r.part FROM r JOIN d ON r.node = d.a) SELECT node, min(part) AS part FROM r GROUP BY node"),
    "g13_length_shares": (g13_length_shares, f"WITH {LINKS_SQL} SELECT a AS node, round(sum(weight / 2) / (SELECT sum(weight / 2) FROM d), 9) AS share FROM d GROUP BY a"),
}

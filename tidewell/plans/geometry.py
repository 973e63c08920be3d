"""Geometry and kernels over the driver's tables: embeddings' components are coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, kernels, network, ranks
from .readings import table


def at(i: int):
    return F.element_at("embedding", i).cast("double")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(at(1), 1).alias("x"), F.round(at(2), 1).alias("y"))


V = "WITH v AS (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE), 1) AS x, round(CAST(embedding[2] AS DOUBLE), 1) AS y FROM embeddings)"


def g20_clean_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.clean_vertices(vertices(spark, sf_dir), "label", "vec_id").select("label", "vec_id")


G20_SQL = V + " SELECT label, vec_id FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE px IS NULL OR x != px OR y != py"


def g21_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.arc_positions(vertices(spark, sf_dir), "label", "vec_id").select("vec_id", F.round("arc", 6).alias("arc"))


G21_SQL = V + """, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, round(sum(s) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 6) AS arc FROM d"""


def j18_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as points, and as segments; a vector's own segment isn't looked at."""
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("p"), at(1).alias("x"), at(2).alias("y"))
    segments = e.select(F.col("vec_id").alias("s"), F.col("label").alias("group"), at(1).alias("ax"), at(2).alias("ay"), (at(1) + at(3) / 10).alias("bx"), (at(2) + at(4) / 10).alias("by"))
    n = geometry.nearest_segments(points, segments, 0.1, F.col("p") != F.col("s"))
    return n.select("p", "s", F.round("d", 6).alias("d"), "second", F.round("second_d", 6).alias("second_d"))


J18_SQL = """
WITH p AS (SELECT vec_id AS p, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (SELECT vec_id AS s, label AS g, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) / 10 AS dx, CAST(embedding[4] AS DOUBLE) / 10 AS dy FROM embeddings),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM p JOIN s ON p != s),
d AS (SELECT p, s, g, sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) AS d FROM t),
b AS (SELECT p, g, min(d) AS d, arg_min(s, (d, s)) AS s FROM d WHERE d <= 0.1 GROUP BY p, g), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, s) AS r FROM b)
SELECT p, max(s) FILTER (r = 1) AS s, round(max(d) FILTER (r = 1), 6) AS d, max(s) FILTER (r = 2) AS second, round(max(d) FILTER (r = 2), 6) AS second_d FROM r WHERE r <= 2 GROUP BY p
"""


def g18_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crowding(vertices(spark, sf_dir), 0.5).select("cells", "most", F.round("seen", 6).alias("seen"))


G18_SQL = V + ", c AS (SELECT count(*) AS n FROM v GROUP BY floor(x / 0.5), floor(y / 0.5)) SELECT count(*) AS cells, max(n) AS most, round(sum(n * n) / sum(n), 6) AS seen FROM c"


def g22_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "embeddings").select(at(1).alias("x"), at(2).alias("y"), at(3).alias("u"), at(4).alias("v"))
    fit = geometry.solve_affine(geometry.affine_sums(pairs))
    return fit.select("target", *[F.round(c, 6).alias(c) for c in "abc"])


def g22_part(t: int, name: str) -> str:
    return f"""SELECT '{name}' AS target, round((xt * yy - yt * xy) / det, 6) AS a, round((yt * xx - xt * xy) / det, 6) AS b, round(mt - (xt * yy - yt * xy) / det * mx - (yt * xx - xt * xy) / det * my, 6) AS c FROM (
 SELECT *, xx * yy - xy * xy AS det FROM (SELECT avg(x) AS mx, avg(y) AS my, avg(t{t}) AS mt, count(*) * var_pop(x) AS xx, count(*) * var_pop(y) AS yy, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(x, t{t}) AS xt, count(*) * covar_pop(y, t{t}) AS yt
 FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS t3, CAST(embedding[4] AS DOUBLE) AS t4 FROM embeddings)))"""


def m11_east_north(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = geometry.east_north(40 + at(1) / 100, -75 + at(2) / 100, 40.0, -75.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(en["east"], 3).alias("east"), F.round(en["north"], 3).alias("north"))


M11_SQL = f"""
WITH a AS (SELECT vec_id, radians(40 + CAST(embedding[1] AS DOUBLE) / 100) AS p, radians(-75 + CAST(embedding[2] AS DOUBLE) / 100) AS q FROM embeddings UNION ALL SELECT -1, radians(40), radians(-75)),
n AS (SELECT *, {geometry.AXIS} / sqrt(1 - {geometry.ECCENTRICITY2} * sin(p) ** 2) AS n FROM a),
e AS (SELECT vec_id, n * cos(p) * cos(q) AS x, n * cos(p) * sin(q) AS y, n * (1 - {geometry.ECCENTRICITY2}) * sin(p) AS z FROM n)
SELECT e.vec_id, round(-sin(radians(-75)) * (e.x - o.x) + cos(radians(-75)) * (e.y - o.y), 3) AS east,
 round(-sin(radians(40)) * cos(radians(-75)) * (e.x - o.x) - sin(radians(40)) * sin(radians(-75)) * (e.y - o.y) + cos(radians(40)) * (e.z - o.z), 3) AS north FROM e, e o WHERE o.vec_id = -1 AND e.vec_id >= 0
"""


def g6_mds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of a label from their distances to its thirty landmarks, those whose hash is least."""
    p = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("node"), at(1).alias("x"), at(2).alias("y"))
    few = ranks.ranked(p.select("label", "node", F.xxhash64("node").alias("h")), ["h", "node"], ["label"]).where("rank <= 30").select("label", "node")
    marks = p.join(few, ["label", "node"], "left_semi").select("label", F.col("node").alias("landmark"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = p.join(marks, "label").select("label", "node", "landmark", F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2).alias("d"))
    return kernels.landmark_mds(d, "label")


def g17_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"))
    return kernels.complete_linkage(kernels.linkage_groups(points, "label", 0.005), "piece", 0.005).select("id", "cluster")


def g7_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    links = s.select(F.col("s_suppkey").alias("link"), (F.floor(F.col("s_suppkey") / 2) + 1000).cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b"))
    return network.bridges(links)


def k1_gaussian_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in strips of the plane, so narrow that each has some 500 of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("f1"), at(2).alias("f2"), F.when(F.col("vec_id") % 4 != 0, at(3)).alias("y"))
    strips = ranks.ranked(rows, ["f1", "id"]).withColumn("strip", F.floor((F.col("rank") - 1) / 500))
    return kernels.gaussian_process(strips, "strip", ["f1", "f2"], "y").drop("strip")


QUERIES = {
    "g20_clean_line": (g20_clean_line, G20_SQL), "g21_arc": (g21_arc, G21_SQL), "j18_nearest_segment": (j18_nearest_segment, J18_SQL), "g18_crowding": (g18_crowding, G18_SQL),
    "g22_affine": (g22_affine, g22_part(3, "u") + " UNION ALL " + g22_part(4, "v")), "m11_east_north": (m11_east_north, M11_SQL), "g6_mds": (g6_mds, None), "g7_bridges": (g7_bridges, None), "g17_clusters": (g17_clusters, None),
    "k1_gaussian_process": (k1_gaussian_process, None),
}

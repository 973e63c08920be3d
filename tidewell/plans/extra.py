"""Cells of forms, doses and hypotheses, path and flow features, and choices of samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chemistry, forms
from ..operators import evaluation, geometry, holdout, network, posterior, selection, series
from . import models
from .evaluations import PRED, predictions
from .models import GRID_SQL, LINKS_SQL
from .readings import table


def chosen(texts: list[str | None], by) -> object:
    """One of some texts, by a number."""
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.pmod(by, F.lit(len(texts))).cast("int"))


ANALYTES = {
    "Free Chlorine (mg/L)": "free", "Chlorine (Free)": "free", "TotalChlorine": "total", "TCL2": "total", "Chlorine Residual": "chlorine", "Chloride": "other", "pH": "other", "Free Cl": "free", "Cl (total)": "total",
    "Chlorine (Combined)": "other", "CL2-F": "free", "Monochloramine": "other", "Chloramine mg/L": "total", "Free chlorine temp": "other",
}


def r8_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", chosen(list(ANALYTES), F.col("event_id")).alias("header"))
    return e.select("event_id", forms.analyte_kind(F.col("header")).alias("kind"))


R8_SQL = "SELECT event_id, ([" + ", ".join(f"'{v}'" for v in ANALYTES.values()) + f"])[event_id % {len(ANALYTES)} + 1] AS kind FROM events"

MATERIAL_CELLS = {"DIP": ("concrete or concrete lined", 130.0), "PVC C900": ("plastic", 145.0), "Cast Iron 1921": ("cast iron", 135.0), "old steel main": ("steel", 145.0), "A.C.": (None, 130.0), "AC": ("concrete or concrete lined", 130.0),
                  "mystery": (None, 130.0), "HDPE": ("plastic", 145.0), "vitrified-clay": ("vitrified clay", 110.0), "GALV.": ("galvanized iron", 120.0)}


def r12_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", forms.material(chosen(list(MATERIAL_CELLS), F.col("p_partkey"))).alias("m"))
    return p.select("p_partkey", "m.class", "m.c")


R12_SQL = "SELECT p_partkey, ([" + ", ".join("NULL" if c is None else f"'{c}'" for c, _ in MATERIAL_CELLS.values()) + f"])[p_partkey % {len(MATERIAL_CELLS)} + 1] AS class, ([" + ", ".join(str(c) for _, c in MATERIAL_CELLS.values()) + f"])[p_partkey % {len(MATERIAL_CELLS)} + 1]::DOUBLE AS c FROM part"


def r14_node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: 1000 * F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", forms.node_id(at(1), at(2)).alias("id"))


R14_SQL = "SELECT vec_id, 'N' || CAST(round_even(1000 * CAST(embedding[1] AS DOUBLE), 0) AS BIGINT) || '_' || CAST(round_even(1000 * CAST(embedding[2] AS DOUBLE), 0) AS BIGINT) AS id FROM embeddings"


def r16_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in five ways of writing: plain, with a letter behind or before, with a decimal comma, with a letter of the other axis."""
    v = F.format_string("%.2f", F.pmod("value", F.lit(80.0)))
    k = F.pmod("event_id", F.lit(5))
    cell = F.when(k == 0, v).when(k == 1, F.concat(v, F.lit(" S"))).when(k == 2, F.concat(F.lit("N "), v)).when(k == 3, F.replace(v, F.lit("."), F.lit(","))).otherwise(F.concat(v, F.lit("° W")))
    return table(spark, sf_dir, "events").select("event_id", forms.coordinate(cell, "lat").alias("lat"))


R16_SQL = "SELECT event_id, CASE event_id % 5 WHEN 1 THEN -x WHEN 4 THEN NULL ELSE x END AS lat FROM (SELECT event_id, CAST(printf('%.2f', value % 80.0) AS DOUBLE) AS x FROM events)"


def r17_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice"), 2)
    pair = F.concat_ws("; ", F.format_number(cents, 2), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", forms.number(F.format_number(cents, 2)).alias("price"), F.size(forms.numbers(F.concat_ws("; ", F.col("o_custkey").cast("string"), F.lit("1,5")))).alias("n"), forms.numbers(F.concat(F.lit("x "), pair)).isNull().alias("refused"))


R17_SQL = "SELECT o_orderkey, CAST(printf('%.2f', round(o_totalprice, 2)) AS DOUBLE) AS price, CAST(2 AS INTEGER) AS n, true AS refused FROM orders"


def r19_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    month = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/M")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM.yyyy"))
    return o.select("o_orderkey", forms.cell_text(F.col("o_custkey").cast("double")).alias("cell"), forms.plant_month(month).alias("month"))


R19_SQL = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cell, CASE WHEN o_orderkey % 3 != 2 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders"


def r21_ratio_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios must name each entry point, and nothing else: nations with suppliers against those with customers in debt, shifted."""
    ratios = table(spark, sf_dir, "customer").where("c_acctbal < 0").select((F.col("c_nationkey") + 1).alias("node"), F.lit(0.5).alias("ratio"))
    return holdout.check_ratios(ratios, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node")))


R21_SQL = """
SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'no ratio' ELSE 'no entry point' END AS problem
FROM (SELECT DISTINCT c_nationkey + 1 AS node FROM customer WHERE c_acctbal < 0) a FULL JOIN (SELECT DISTINCT s_nationkey AS node FROM supplier) b ON a.node = b.node WHERE a.node IS NULL OR b.node IS NULL
"""


def m5_equivalent_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chemistry.hazen_williams_equivalent(F.col("p_size") * 0.0254, F.lit(0.00026), F.lit(0.5), chemistry.viscosity(F.lit(15.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("c"))


M5_SQL = """
WITH p AS (SELECT p_partkey, p_size * 0.0254 AS d, 497e-6 / pow(57.5, 1.5) AS nu FROM part), f AS (SELECT *, 0.25 / pow(log10(0.00026 / (3.7 * d) + 5.74 / pow(0.5 * d / nu, 0.9)), 2) AS f, 0.5 * pi() * d * d / 4 AS q FROM p)
SELECT p_partkey, round(pow(10.67 * pow(q, 1.852) * 2 * 9.81 * d / (pow(d, 4.8704) * f * 0.25), 1 / 1.852), 6) AS c FROM f
"""


def m7_rate_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 4 != 0, F.pmod("value", F.lit(25.0)))
    toc = F.when(F.col("event_id") % 3 != 0, 1.0 + F.pmod("value", F.lit(3.0)))
    mode = F.when(F.col("event_id") % 5 == 0, "mass_transfer_only").otherwise("arrhenius")
    return table(spark, sf_dir, "events").select("event_id", F.round(chemistry.bulk_scale(t, 6000.0, toc, 2.0), 8).alias("bulk"), F.round(chemistry.wall_scale(t, 4000.0, mode), 8).alias("wall"))


M7_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 != 0 THEN value % 25 END AS t, CASE WHEN event_id % 3 != 0 THEN 1 + value % 3 END AS toc FROM events)
SELECT event_id, round(coalesce(exp(6000.0 * (t - 20) / (293.15 * (t + 273.15))), 1) * coalesce(toc / 2, 1), 8) AS bulk, round(CASE WHEN t IS NULL OR event_id % 5 = 0 THEN 1.0 ELSE exp(4000.0 * (t - 20) / (293.15 * (t + 273.15))) END, 8) AS wall FROM e
"""


def m10_hour_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = chemistry.hour_encoding(F.hour("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(s, 8).alias("s"), F.round(c, 8).alias("c"))


M10_SQL = "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 8) AS s, round(cos(2 * pi() * hour(ts) / 24), 8) AS c FROM events"


def j4_own_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each event type with the grid of that type's condition."""
    types = spark.createDataFrame([("click", 1.0), ("view", 2.0), ("error", 3.0)], "condition string, scale double")
    bank = models.grid(spark, sf_dir).crossJoin(F.broadcast(types)).select("condition", "hour", "junction", F.transform("z", lambda z: z * F.col("scale")).alias("z"))
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.hour("ts").alias("hour"), (F.col("user_id") % 25).cast("int").alias("junction"), "event_id", F.col("value").alias("y"))
    return posterior.own_condition(s, bank, ["condition"]).select("event_id", F.round(F.get("z", F.lit(0)), 6).alias("z0"), F.size("z").alias("members"))


J4_SQL = """
SELECT event_id, round((-0.1 * (user_id % 25 % 9 + 1) / 3 - 0.01 * hour(ts)) * CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, 6) AS z0, CAST(15 AS INTEGER) AS members
FROM events WHERE event_type IN ('click', 'view', 'error') AND user_id % 25 IN (SELECT n_nationkey FROM nation)
"""


def j13_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda name, col, acct: table(spark, sf_dir, name).groupBy(F.col(col).alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(acct), 2).alias("most"))
    return evaluation.prefixed(by("customer", "c_nationkey", "c_acctbal"), by("supplier", "s_nationkey", "s_acctbal"), ["nation"], "supplier_")


J13_SQL = """
SELECT c.nation, c.n, c.most, s.n AS supplier_n, s.most AS supplier_most FROM (SELECT c_nationkey AS nation, count(*) AS n, round(max(c_acctbal), 2) AS most FROM customer GROUP BY 1) c
LEFT JOIN (SELECT s_nationkey AS nation, count(*) AS n, round(max(s_acctbal), 2) AS most FROM supplier GROUP BY 1) s ON c.nation = s.nation
"""


def j15_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = posterior.with_doses(models.grid(spark, sf_dir), [0.8, 1.0, 1.25])
    return g.select("hour", "junction", "dose", F.posexplode("z").alias("member", "z")).groupBy("junction", "dose", "member").agg(F.round(F.sum("z"), 6).alias("total"))


J15_SQL = GRID_SQL.split("s AS (SELECT hour")[0] + "x AS (SELECT unnest([0.8, 1.0, 1.25])::DOUBLE AS dose) SELECT junction, dose, CAST(member AS INTEGER) AS member, round(sum(z + ln(dose)), 6) AS total FROM g, x GROUP BY ALL"


def j20_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' third and fourth components against the places of all by their first two."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings")
    n = geometry.nearest_nodes(e.select(F.col("vec_id").alias("p"), at(3).alias("x"), at(4).alias("y")), e.select(F.col("vec_id").alias("node"), at(1).alias("x"), at(2).alias("y")), 0.05)
    return n.select("p", "node", F.round("d", 6).alias("d"))


J20_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
j AS (SELECT p.vec_id AS p, n.vec_id AS node, sqrt((p.c - n.a) ** 2 + (p.d - n.b) ** 2) AS d FROM e p JOIN e n ON sqrt((p.c - n.a) ** 2 + (p.d - n.b) ** 2) <= 0.05)
SELECT p, arg_min(node, (d, node)) AS node, round(min(d), 6) AS d FROM j GROUP BY p
"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), at(1).alias("ax"), at(2).alias("ay"), (at(1) + at(3) / 5).alias("bx"), (at(2) + at(4) / 5).alias("by"))


LINES = "s AS (SELECT vec_id AS line, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) / 5 AS dx, CAST(embedding[4] AS DOUBLE) / 5 AS dy FROM embeddings)"


def j22_tees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of each vector's line against the others' interiors."""
    s = lines_of(spark, sf_dir)
    ends = s.select((F.col("line") * 2).alias("e"), "line", F.col("ax").alias("x"), F.col("ay").alias("y")).union(s.select(F.col("line") * 2 + 1, "line", "bx", "by"))
    return geometry.tee_candidates(ends, s, 0.01).select("line", "e", F.round("d", 6).alias("d"))


J22_SQL = f"""
WITH {LINES}, e AS (SELECT line, line * 2 AS e, ax AS x, ay AS y FROM s UNION ALL SELECT line, line * 2 + 1, ax + dx, ay + dy FROM s),
t AS (SELECT s.line, e.e, x, y, ax, ay, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM e JOIN s ON e.line != s.line),
d AS (SELECT *, sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) AS d FROM t)
SELECT line, e, round(d, 6) AS d FROM d WHERE d <= 0.01 AND sqrt((x - ax) ** 2 + (y - ay) ** 2) > 0.01 AND sqrt((x - ax - dx) ** 2 + (y - ay - dy) ** 2) > 0.01
"""


def g4_path_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shortest paths from node 0 add up to, over links as pipes."""
    e = models.edges(spark, sf_dir)
    both = e.select("a", "b", "weight", "link").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "link"))
    source = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    before = network.predecessors(both, network.shortest_paths(both, source))
    pipes = e.select("link", F.col("weight").alias("length"), (0.1 + F.pmod("b", F.lit(7)) / 20).alias("diameter"), (90.0 + F.pmod("a", F.lit(50))).alias("roughness"))
    p = network.path_aggregates(before, pipes)
    return p.select("node", *[F.round(c, 4).alias(c) for c in ("length", "mean_roughness", "least_roughness", "mean_diameter", "least_diameter")])


G4_SQL = f"""
WITH RECURSIVE {LINKS_SQL}, f AS (SELECT a, b, weight, link FROM e UNION ALL SELECT b, a, weight, link FROM e),
r AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS i UNION SELECT node, dist, i FROM (SELECT f.b AS node, min(r.dist + f.weight) AS dist, max(r.i) + 1 AS i FROM r JOIN f ON r.node = f.a WHERE r.i < 60 GROUP BY f.b)),
m AS (SELECT node, min(dist) AS dist FROM r GROUP BY node),
u AS (SELECT f.b AS node, min((f.a, f.link)) AS best FROM f JOIN m x ON f.a = x.node JOIN m y ON f.b = y.node WHERE y.dist > 0 AND abs(x.dist + f.weight - y.dist) <= 1e-9 * (1 + y.dist) AND x.dist < y.dist GROUP BY f.b),
t AS (SELECT u.node, u.best[1] AS before, e.weight AS l, 0.1::DOUBLE + (e.b % 7) / 20 AS d, 90.0::DOUBLE + e.a % 50 AS c FROM u JOIN e ON e.link = u.best[2]),
w AS (SELECT node, before, l, l * c AS lc, c AS c, l * d AS ld, d AS d FROM t UNION ALL SELECT w.node, t.before, w.l + t.l, w.lc + t.l * t.c, least(w.c, t.c), w.ld + t.l * t.d, least(w.d, t.d) FROM w JOIN t ON w.before = t.node),
z AS (SELECT * FROM w WHERE before = 0)
SELECT node, round(l, 4) AS length, round(lc / l, 4) AS mean_roughness, round(c, 4) AS least_roughness, round(ld / l, 4) AS mean_diameter, round(d, 4) AS least_diameter FROM z
UNION ALL SELECT 0, 1.0::DOUBLE, 130.0::DOUBLE, 130.0::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE
"""


def g9_unfed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the network without a nation under 25: its islands."""
    e = models.edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    kinds = nodes.select("node", F.when(F.col("node") < 25, "source").when(F.col("node") >= 1000, "junction").otherwise("tank").alias("kind"))
    return network.unfed_parts(network.components(nodes, e), kinds)


G9_SQL = f"""
WITH RECURSIVE {LINKS_SQL}, r AS (SELECT DISTINCT a AS node, a AS part FROM d UNION SELECT d.b, r.part FROM r JOIN d ON r.node = d.a), p AS (SELECT node, min(part) AS part FROM r GROUP BY node)
SELECT part, count(*) FILTER (node >= 1000) AS junctions FROM p GROUP BY part HAVING count(*) FILTER (node >= 1000) > 0 AND count(*) FILTER (node < 25) = 0
"""


def g11_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that node 0 loses once each third supplier's links are shut."""
    e = models.edges(spark, sf_dir)
    both = e.select("a", "b", "link").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "link"))
    source = spark.range(1).select(F.lit(0).cast("bigint").alias("node"))
    return network.cut_off(both.select(F.col("a").alias("node")).distinct(), both, source, e.where("b % 3 = 0").select("link"))


G11_SQL = f"""
WITH RECURSIVE {LINKS_SQL}, f AS (SELECT a, b, b % 3 = 0 AS shut FROM e UNION ALL SELECT b, a, b % 3 = 0 FROM e),
r AS (SELECT 0::BIGINT AS node UNION SELECT f.b FROM r JOIN f ON r.node = f.a), q AS (SELECT 0::BIGINT AS node UNION SELECT f.b FROM q JOIN f ON q.node = f.a WHERE NOT shut)
SELECT node FROM r WHERE node NOT IN (SELECT node FROM q)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow for each user and hour."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 500).alias("link"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    return e.select("link", "hour", F.when(F.col("link") % 50 == 7, 0.0).otherwise(F.round((F.col("v") - 10 - F.col("link") % 17), 4)).alias("flow"))


FLOWS = "fl AS (SELECT link, hour, CASE WHEN link % 50 = 7 THEN 0.0 ELSE round(v - 10 - link % 17, 4) END AS flow FROM (SELECT user_id % 500 AS link, hour(ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2))"


def g14_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.mean_direction(flows(spark, sf_dir), ["link"]).select("link", F.round("mean", 3).alias("mean"), "direction")


G14_SQL = f"WITH {FLOWS} SELECT link, round(avg(flow), 3) AS mean, CAST(CASE WHEN avg(abs(flow)) > 0 AND abs(avg(flow)) > 0.8 * avg(abs(flow)) THEN sign(avg(flow)) ELSE 0 END AS INTEGER) AS direction FROM fl GROUP BY link"


def g15_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes from node link % 25 to node link % 40; nodes under 3 aren't junctions."""
    f = flows(spark, sf_dir)
    pipes = f.select("link").distinct().select("link", (F.col("link") % 25).alias("start"), (F.col("link") % 40 + 25).alias("stop"))
    nodes = spark.range(65).select(F.col("id").alias("node"))
    ages = nodes.select("node", (F.col("node") % 7).cast("double").alias("age"))
    return network.downstream_ends(f, pipes, ages, nodes.where("node >= 3"))


G15_SQL = f"""
WITH {FLOWS}, m AS (SELECT link, link % 25 AS s, link % 40 + 25 AS e, avg(flow) AS m, max(abs(flow)) AS top, bool_or(flow > 1e-7) AS fwd, bool_or(flow < -1e-7) AS back FROM fl GROUP BY link),
c AS (SELECT *, top <= 1e-7 AS still, top > 1e-7 AND (abs(m) <= 1e-7 OR (m > 0 AND back) OR (m < 0 AND fwd)) AS turns, CASE WHEN top <= 1e-7 OR abs(m) <= 1e-7 THEN CASE WHEN s % 7 != e % 7 THEN s % 7 > e % 7 ELSE s < e END ELSE m < 0 END AS at_start FROM m),
x AS (SELECT *, CASE WHEN at_start THEN s ELSE e END AS down, CASE WHEN at_start THEN e ELSE s END AS up FROM c)
SELECT link, CASE WHEN down >= 3 THEN down WHEN up >= 3 THEN up END AS junction, CASE WHEN turns AND (down >= 3 AND up >= 3) THEN up END AS other,
 array_to_string(list_filter([CASE WHEN still THEN 'no_flow' END, CASE WHEN turns THEN 'reverses' END, CASE WHEN down < 3 AND up >= 3 THEN 'end_not_junction' END], lambda x: x IS NOT NULL), ',') AS codes FROM x
"""


def g24_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select((F.abs("c_acctbal") * (3.2 + F.pmod("c_custkey", F.lit(20)) / 100)).alias("drawn"), F.abs("c_acctbal").alias("declared"))
    s = geometry.coordinate_scale(p, "drawn", "declared")
    return s.select("pipes", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")], "status", "units")


G24_SQL = """
WITH r AS (SELECT abs(c_acctbal) * (3.2 + (c_custkey % 20) / 100) / abs(c_acctbal) AS r FROM customer WHERE abs(c_acctbal) > 0), q AS (SELECT count(*) AS pipes, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95 FROM r)
SELECT pipes, round(p5, 6) AS p5, round(p50, 6) AS p50, round(p95, 6) AS p95, CASE WHEN pipes < 2 THEN 'too few pipes drawn' WHEN p95 / p5 > 1.5 THEN 'schematic' ELSE 'to scale' END AS status,
 CASE WHEN pipes < 2 OR p95 / p5 > 1.5 THEN 'unknown' WHEN abs(p50 * 0.3048 - 1) <= 0.1 THEN 'feet' WHEN abs(p50 - 1) <= 0.1 THEN 'metres' ELSE 'unknown' END AS units FROM q
"""


def g26_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") / 100 * F.when(F.col("s_nationkey") % 3 == 0, 0.5).otherwise(1.7)).alias("x"), (F.col("s_suppkey") % 89 * F.when(F.col("s_nationkey") % 3 == 1, 1.9).otherwise(1.0)).alias("y"))
    return geometry.looks_lonlat(s, ["s_nationkey"])


G26_SQL = """
WITH s AS (SELECT s_nationkey, s_acctbal / 100 * CASE WHEN s_nationkey % 3 = 0 THEN 0.5 ELSE 1.7 END AS x, s_suppkey % 89 * CASE WHEN s_nationkey % 3 = 1 THEN 1.9 ELSE 1.0 END AS y FROM supplier),
m AS (SELECT s_nationkey, min(x) >= -180 AND max(x) <= 180 AND min(y) >= -90 AND max(y) <= 90 AS f, min(y) >= -180 AND max(y) <= 180 AND min(x) >= -90 AND max(x) <= 90 AS g, max(x) > min(x) OR max(y) > min(y) AS several FROM s GROUP BY 1)
SELECT s_nationkey, f AND several AS lonlat, NOT f AND g AND several AS swapped FROM m
"""


def a2_metrics_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model: line items of every fourth line number stand for hour 22, the rest for daily minima."""
    p = predictions(spark, sf_dir).select("model", "truth", F.col("pred").alias("mid"), "low", "high", F.when(F.col("pred") < 20000, 0.9).otherwise(0.1).alias("p_below"), F.when(F.col("l_linenumber") % 4 == 0, 22).alias("hour"))
    m = evaluation.metrics_time(p, ["model"], 20000.0)
    return m.select("model", "true_min", *[F.round(c, 2 if c.startswith("rmse") else 6).alias(c) for c in m.columns if c not in ("model", "true_min")])


def metrics_sql(of: str, tag: str) -> dict[str, str]:
    tp, fp, fn = (f"count(*) FILTER ({of} AND truth {a} 20000 AND pred {b} 20000)" for a, b in (("<", "<"), (">=", "<"), ("<", ">=")))
    return {f"rmse_{tag}": f"round(sqrt(avg((truth - pred) ** 2) FILTER ({of})), 2)", f"precision_{tag}": f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 1), 6)", f"recall_{tag}": f"round(coalesce({tp} / nullif({tp} + {fn}, 0), 1), 6)",
            f"f1_{tag}": f"round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6)", f"true_{tag}": f"count(*) FILTER ({of} AND truth < 20000)", f"coverage_{tag}": f"round(avg(CASE WHEN truth BETWEEN low AND high THEN 1 ELSE 0 END) FILTER ({of}), 6)"}


_MIN, _NIGHT = metrics_sql("l_linenumber % 4 != 0", "min"), metrics_sql("l_linenumber % 4 = 0", "night")
A2_SQL = PRED + "SELECT model, " + ", ".join(f"{v} AS {k}" for k, v in (_MIN | {k: v for k, v in _NIGHT.items() if k.split("_")[0] in ("rmse", "recall", "coverage")}).items()) + " FROM p GROUP BY model"


def a9_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = predictions(spark, sf_dir).groupBy("model", "seed", (F.col("l_linenumber")).alias("n")).agg(F.sqrt(F.avg((F.col("pred") - F.col("truth")) ** 2)).alias("rmse"), F.avg(F.when(F.col("seen"), F.abs(F.col("pred") - F.col("truth")))).alias("mae_seen"))
    curve = evaluation.learning_curve(runs, ["model", "n"], ["rmse", "mae_seen"])
    return curve.select("model", "n", "runs", F.round("rmse", 2).alias("rmse"), F.round("mae_seen", 2).alias("mae_seen"))


A9_SQL = PRED + ", r AS (SELECT model, seed, l_linenumber AS n, sqrt(avg((pred - truth) ** 2)) AS rmse, avg(abs(pred - truth)) FILTER (seen) AS mae_seen FROM p GROUP BY 1, 2, 3) SELECT model, n, count(*) AS runs, round(avg(rmse), 2) AS rmse, round(avg(mae_seen), 2) AS mae_seen FROM r GROUP BY 1, 2"


def even_weights(spark: SparkSession) -> DataFrame:
    """Weights that fall with the member's number."""
    return spark.range(models.MEMBERS).select(F.col("id").cast("int").alias("member"), ((models.MEMBERS - F.col("id")) / (models.MEMBERS * (models.MEMBERS + 1) / 2)).alias("w"))


W_SQL = "w AS (SELECT CAST(m AS INTEGER) AS member, (15 - m) / 120 AS w FROM range(15) t(m))"
G_SQL = GRID_SQL.split("s AS (SELECT hour")[0]


def a14_local_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over three siblings for each of five rates."""
    return posterior.local_variance(models.grid(spark, sf_dir), even_weights(spark), 3).select("hour", "junction", F.round("var", 8).alias("var"))


A14_SQL = G_SQL + W_SQL + ", v AS (SELECT hour, junction, floor(member / 3) AS k, var_pop(z) AS var FROM g GROUP BY ALL), k AS (SELECT floor(member / 3) AS k, sum(w) AS w FROM w GROUP BY 1) SELECT CAST(hour AS INTEGER) AS hour, junction, round(sum(var * w), 8) AS var FROM v JOIN k USING (k) GROUP BY hour, junction"


def a17_posterior_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and band of z over the three siblings, by junction and hour."""
    w = posterior.hydraulic_weights(even_weights(spark), 3)
    z = models.grid(spark, sf_dir).select("hour", "junction", F.posexplode(F.slice("z", 1, 3)).alias("sibling", "z"))
    b = posterior.weighted_mean_and_band(z, w, "sibling", ["hour", "junction"], "z")
    return b.select("hour", "junction", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


A17_SQL = G_SQL + W_SQL + """, k AS (SELECT member % 3 AS k, sum(w) AS w FROM w GROUP BY 1), j AS (SELECT hour, junction, z, w FROM g JOIN k ON g.member = k.k),
c AS (SELECT *, sum(w) OVER (PARTITION BY hour, junction ORDER BY z ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY hour, junction) AS c FROM j)
SELECT CAST(hour AS INTEGER) AS hour, junction, round(sum(z * w) / sum(w), 6) AS mean, round(min(z) FILTER (c >= 0.05 - 1e-12), 6) AS low, round(min(z) FILTER (c >= 0.95 - 1e-12), 6) AS high FROM c GROUP BY hour, junction"""


def a20_loss_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs whose decay follows the junction's number."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("k")) for r, k in (("full", 0.03), ("bulk_only", 0.02), ("wall_only", 0.009), ("no_decay", 0.0))]))
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("junction"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    g = g.withColumn("r", runs).select("junction", "hour", "r.run", (1.2 * F.exp(-F.col("r.k") * F.col("junction") - 0.001 * F.col("hour"))).alias("value"))
    s = posterior.loss_split(g)
    return s.select("junction", *[F.round(c, 6).alias(c) for c in s.columns if c != "junction"])


A20_SQL = """
SELECT n_nationkey AS junction, round(0.03::DOUBLE * n_nationkey, 6) AS total, round(0.02::DOUBLE * n_nationkey, 6) AS bulk, round(0.009::DOUBLE * n_nationkey, 6) AS wall, CASE WHEN n_nationkey > 0 THEN round(2.0 / 3, 6) END AS bulk_share,
 CASE WHEN n_nationkey > 0 THEN round(1.0 / 3, 6) END AS wall_share, CASE WHEN n_nationkey > 0 THEN round(0.029 / 0.03, 6) END AS nonadditivity FROM nation
"""


def a22_dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dropped for their type or their user's ending, as row ranges."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.when(F.col("value") < 1, "too small").when(F.col("user_id") % 97 == 0, "unknown tap").alias("reason"), F.col("user_id").cast("string").alias("user"), "event_type")
    d = e.where("reason is not null").select("reason", "row", F.when(F.col("reason") == "too small", F.col("event_type")).otherwise(F.col("user")).alias("value"))
    return series.dropped_lines(d, "reason", "row", "value", most_values=5, most_lines=4)


A22_SQL = """
WITH d AS (SELECT event_id AS row, CASE WHEN value < 1 THEN 'too small' ELSE 'unknown tap' END AS reason, CASE WHEN value < 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS value FROM events WHERE value < 1 OR user_id % 97 = 0),
m AS (SELECT reason, count(DISTINCT value) AS k FROM d GROUP BY reason), n AS (SELECT d.reason, CASE WHEN k <= 5 THEN value END AS value, row FROM d JOIN m ON d.reason = m.reason),
i AS (SELECT reason, value, min(row) AS a, max(row) AS b FROM (SELECT *, row - row_number() OVER (PARTITION BY reason, value ORDER BY row) AS g FROM n) GROUP BY reason, value, g),
r AS (SELECT *, row_number() OVER (PARTITION BY reason, value ORDER BY a) AS r, count(*) OVER (PARTITION BY reason, value) AS k FROM i)
SELECT reason, value, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (r <= 4) || CASE WHEN max(k) > 4 THEN ', ...' ELSE '' END AS rows FROM r GROUP BY reason, value
"""


def a27_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms of two models, paired by seed, for seen and new keys."""
    p = predictions(spark, sf_dir).where((F.col("pred") < 20000) & (F.col("truth") >= 20000)).groupBy("seen", "seed", "model").agg(F.count(F.lit(1)).alias("alarms"))
    pairs = evaluation.paired(p, ["seen", "seed"], "model", ("A", "N"), "alarms")
    return evaluation.alarm_cells(pairs, ["seen"], "alarms_A", "alarms_N").select("seen", F.col("alarms_A").alias("alarms_a"), F.col("alarms_N").alias("alarms_n"), "more_a", "more_b", F.round("ratio", 8).alias("ratio"))


A27_SQL = PRED + """, c AS (SELECT seen, seed, count(*) FILTER (model = 'A') AS a, count(*) FILTER (model = 'N') AS n FROM p WHERE pred < 20000 AND truth >= 20000 AND model IN ('A', 'N') GROUP BY 1, 2), z AS (SELECT seen, seed, nullif(a, 0) AS a, nullif(n, 0) AS n FROM c)
SELECT seen, CAST(sum(a) AS BIGINT) AS alarms_a, CAST(sum(n) AS BIGINT) AS alarms_n, count(*) FILTER (a > n) AS more_a, count(*) FILTER (a < n) AS more_b, round(sum(a) / nullif(sum(n), 0), 8) AS ratio FROM z GROUP BY seen"""


def a29_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member and dose nearest to a truth made from member 7 at 1.25."""
    g = models.grid(spark, sf_dir)
    truth = g.select("hour", "junction", (1.25 * F.exp(F.get("z", F.lit(7))) + 0.001 * (F.col("hour") % 3)).alias("value"))
    return posterior.oracle_member(g, truth, [0.8, 1.0, 1.25, 1.5]).select("member", "dose", F.round("rmse", 6).alias("rmse"))


A29_SQL = G_SQL + """t AS (SELECT hour, junction, 1.25 * exp(z) + 0.001 * (hour % 3) AS v FROM g WHERE member = 7), x AS (SELECT unnest([0.8, 1.0, 1.25, 1.5])::DOUBLE AS dose),
e AS (SELECT member, dose, sqrt(avg((dose * exp(z) - v) ** 2)) AS rmse FROM g JOIN t USING (hour, junction), x GROUP BY member, dose)
SELECT CAST(member AS INTEGER) AS member, dose, round(rmse, 6) AS rmse FROM e ORDER BY e.rmse, e.member, e.dose LIMIT 1"""


def a32_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as draws of each type."""
    s = evaluation.draw_summary(table(spark, sf_dir, "events"), ["event_type"], "value", 5.0)
    return s.select("event_type", *[F.round(c, 5).alias(c) for c in s.columns if c != "event_type"])


A32_SQL = "SELECT event_type, round(median(value), 5) AS median, " + ", ".join(f"round(quantile_cont(value, {0.5 + s * q / 200}), 5) AS {e}{q}" for q in (50, 80, 90, 95) for e, s in (("lo", -1), ("hi", 1))) + ", round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd, round(avg(CASE WHEN value < 5 THEN 1 ELSE 0 END), 5) AS p_below FROM events GROUP BY event_type"


def a34_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models.members(spark).withColumn("hypothesis", F.concat(F.lit("kw "), F.col("kw").cast("string")))
    h = posterior.hypothesis_weights(even_weights(spark), m, "hypothesis", "kb")
    return h.select("hypothesis", F.round("w", 8).alias("w"), F.round("mean_rate", 8).alias("mean_rate"))


A34_SQL = f"WITH {W_SQL} SELECT 'kw ' || CAST(0.05::DOUBLE * (member % 3) AS VARCHAR) AS hypothesis, round(sum(w), 8) AS w, round(sum(w * (0.1 + 0.1 * floor(member / 3))) / sum(w), 8) AS mean_rate FROM w GROUP BY 1"


def w12_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return series.month_labels(o, "month", "total").select("month", "season", F.round("change", 6).alias("change"))


W12_SQL = """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT month, CASE WHEN CAST(substr(month, 6) AS INT) IN (12, 1, 2) THEN 'winter' WHEN CAST(substr(month, 6) AS INT) <= 5 THEN 'spring' WHEN CAST(substr(month, 6) AS INT) <= 8 THEN 'summer' ELSE 'autumn' END AS season, round(total / lag(total) OVER (ORDER BY month) - 1, 6) AS change FROM o
"""


def w15_spread_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(selection.spread_hours(F.col("n_nationkey") + 1, 8, 16).cast("array<string>"), ",").alias("hours"))


W15_SQL = "SELECT n_nationkey, array_to_string([CAST(round_even(CASE WHEN n_nationkey = 0 THEN 8 ELSE 8 + i * 8.0 / greatest(n_nationkey, 1) END, 0) AS INT) FOR i IN range(n_nationkey + 1)], ',') AS hours FROM nation"


def t2_acquire_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user and hour nearest to the limit; and the user whose least value is, at the hour of the widest spread."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("junction"), F.hour("ts").alias("hour"), "value")
    hourly = e.groupBy("junction", "hour").agg(F.round(F.avg("value"), 6).alias("mu"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    minima = e.groupBy("junction").agg(F.round(F.avg("value") / 2, 6).alias("mu"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    return selection.acquire_time(hourly, minima, 10.0)


T2_SQL = """
WITH e AS (SELECT user_id % 200 AS junction, hour(ts) AS hour, value FROM events), h AS (SELECT junction, CAST(hour AS INTEGER) AS hour, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sd FROM e GROUP BY 1, 2),
m AS (SELECT junction, round(avg(value) / 2, 6) AS mu, round(stddev_pop(value), 6) AS sd FROM e GROUP BY 1), j AS (SELECT junction FROM m ORDER BY 1.96 * sd - abs(mu - 10.0) DESC, junction LIMIT 1)
SELECT 'uncertainty' AS strategy, junction, hour FROM (SELECT * FROM h ORDER BY sd DESC, hour, junction LIMIT 1) UNION ALL SELECT 'straddle', junction, hour FROM (SELECT * FROM h ORDER BY 1.96 * sd - abs(mu - 10.0) DESC, hour, junction LIMIT 1)
UNION ALL SELECT 'straddle_min', junction, hour FROM (SELECT * FROM h WHERE junction = (SELECT junction FROM j) ORDER BY sd DESC, hour LIMIT 1)
"""


def t4_demand_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("demand"))
    return selection.demand_route(d, "demand", "id", 5, 8, 16)


T4_SQL = "SELECT CAST(r AS INTEGER) AS rank, id, CAST(round_even(8 + (r - 1) * 8.0 / 4, 0) AS INTEGER) AS hour FROM (SELECT o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY 1) WHERE r <= 5"


def k8_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the mean of all, the value of the nearest sampled one in its nation, and a decay line's, fitted by sums."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("age"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + F.col("c_custkey") % 7).alias("y"))
    b = selection.baselines(c, "id", "place", "age", "y")
    return b.select("id", F.round("mean", 4).alias("mean"), F.round("line", 4).alias("line"), F.round("nearest", 4).alias("nearest"))


K8_SQL = """
WITH c AS (SELECT c_custkey AS id, c_nationkey AS place, c_acctbal AS age, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + c_custkey % 7 END AS y FROM customer),
f AS (SELECT avg(y) AS mean, regr_slope(y, age) AS b, regr_intercept(y, age) AS a FROM c WHERE y IS NOT NULL), s AS (SELECT * FROM c WHERE y IS NOT NULL),
n AS (SELECT c.id, arg_min(s.y, (abs(s.age - c.age), s.id)) AS nearest FROM c JOIN s ON c.place = s.place GROUP BY c.id)
SELECT c.id, round(mean, 4) AS mean, round(a + b * c.age, 4) AS line, round(nearest, 4) AS nearest FROM c CROSS JOIN f LEFT JOIN n ON c.id = n.id
"""


def k14_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' customers whose chance of being low is over a half while they are among the oldest quarter."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100 / 100).alias("p_below"), F.abs("c_acctbal").alias("age"))
    return selection.watch_flags(c, "p_below", "age", 18.0).select("id", "watch")


K14_SQL = "SELECT c_custkey AS id, c_custkey % 100 / 100 > 0.5 AND abs(c_acctbal) >= (SELECT quantile_cont(abs(c_acctbal), 0.75) FROM customer) AS watch FROM customer"


def k18_warming(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = network.mean_direction(flows(spark, sf_dir), ["link"]).select("link", F.col("mean").alias("flow"), (F.col("link") % 25).alias("start"), (F.col("link") % 40 + 25).alias("stop"))
    ages = spark.range(65).select(F.col("id").alias("node"), (F.col("id") % 7 * 5).cast("double").alias("age"))
    w = network.warming_temperatures(f, ages, 8.0, 16.0, 24.0)
    return w.select("link", F.round("temperature", 6).alias("temperature"), F.round("mixed", 4).alias("mixed"))


K18_SQL = f"""
WITH {FLOWS}, m AS (SELECT link, avg(flow) AS q, CASE WHEN avg(flow) < 0 THEN link % 25 ELSE link % 40 + 25 END AS down FROM fl GROUP BY link), e AS (SELECT *, exp(-(down % 7 * 5) / 24.0) AS e FROM m)
SELECT link, round(16.0 - 8.0 * e, 6) AS temperature, round(16.0 - 8.0 * (SELECT sum(abs(q) * e) / sum(abs(q)) FROM e), 4) AS mixed FROM e
"""


def sc21_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows of a plant log with faults planted in some."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.min("o_orderkey").alias("k"), F.avg("o_totalprice").alias("t"))
    month = F.when(F.col("k") % 7 == 0, F.concat(F.lit("month "), "m")).when(F.col("k") % 7 == 1, F.lit("1996-05")).otherwise(F.col("m"))
    rows = o.select(F.row_number().over(Window.orderBy("m")).alias("line"), month.alias("month"), F.when(F.col("k") % 5 == 0, "forty").otherwise((F.col("k") % 50).cast("string")).alias("temp_C"))
    return holdout.plant_problems(rows, "line", "month", "temp_C")


SC21_SQL = """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, min(o_orderkey) AS k FROM orders GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY m) AS line, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '1996-05' ELSE m END AS month, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 50 END AS t FROM o),
p AS (SELECT CAST(line AS INTEGER) AS line, 'no month' AS problem FROM r WHERE month IS NULL UNION ALL SELECT CAST(line AS INTEGER), 'month given twice' FROM r WHERE month IN (SELECT month FROM r GROUP BY month HAVING count(*) > 1)
 UNION ALL SELECT CAST(line AS INTEGER), 'no temperature' FROM r WHERE t IS NULL UNION ALL SELECT CAST(line AS INTEGER), 'temperature out of range' FROM r WHERE t > 35)
SELECT * FROM p
"""

QUERIES = {
    "r8_species": (r8_species, R8_SQL), "r12_material": (r12_material, R12_SQL), "r14_node_id": (r14_node_id, R14_SQL), "r16_coordinates": (r16_coordinates, R16_SQL), "r17_numbers": (r17_numbers, R17_SQL), "r19_cells": (r19_cells, R19_SQL),
    "r21_ratio_keys": (r21_ratio_keys, R21_SQL), "m5_equivalent_c": (m5_equivalent_c, M5_SQL), "m7_rate_scales": (m7_rate_scales, M7_SQL), "m10_hour_encoding": (m10_hour_encoding, M10_SQL), "j4_own_condition": (j4_own_condition, J4_SQL),
    "j13_prefixed": (j13_prefixed, J13_SQL), "j15_doses": (j15_doses, J15_SQL), "j20_nearest_node": (j20_nearest_node, J20_SQL), "j22_tees": (j22_tees, J22_SQL), "g4_path_sums": (g4_path_sums, G4_SQL), "g9_unfed": (g9_unfed, G9_SQL),
    "g11_cut_off": (g11_cut_off, G11_SQL), "g14_direction": (g14_direction, G14_SQL), "g15_downstream": (g15_downstream, G15_SQL), "g24_scale": (g24_scale, G24_SQL), "g26_lonlat": (g26_lonlat, G26_SQL), "a2_metrics_time": (a2_metrics_time, A2_SQL),
    "a9_learning_curve": (a9_learning_curve, A9_SQL), "a14_local_variance": (a14_local_variance, A14_SQL), "a17_posterior_age": (a17_posterior_age, A17_SQL), "a20_loss_split": (a20_loss_split, A20_SQL), "a22_dropped_lines": (a22_dropped_lines, A22_SQL),
    "a27_alarms": (a27_alarms, A27_SQL), "a29_oracle": (a29_oracle, A29_SQL), "a32_draws": (a32_draws, A32_SQL), "a34_hypotheses": (a34_hypotheses, A34_SQL), "w12_seasons": (w12_seasons, W12_SQL), "w15_spread_hours": (w15_spread_hours, W15_SQL),
    "t2_acquire_time": (t2_acquire_time, T2_SQL), "t4_demand_route": (t4_demand_route, T4_SQL), "k8_baselines": (k8_baselines, K8_SQL), "k14_watch": (k14_watch, K14_SQL), "k18_warming": (k18_warming, K18_SQL), "sc21_plant": (sc21_plant, SC21_SQL),
}

"""Sectioned model files ([JUNCTIONS], [PIPES] ...) as tables of lines, and GeoJSON as tables of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): one row per line, from 1."""
    return files.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def section_lines(lines: DataFrame, key: str) -> DataFrame:
    """Data lines with their section and tokens: comments after ; are cut, blank lines and heads go.

    Each file is one window, as a file is one row; the section is the last head above.
    """
    head = F.upper(F.regexp_extract("line", r"^\s*\[([A-Za-z]+)", 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = F.trim(F.regexp_replace("line", ";.*$", ""))
    filled = lines.withColumns({"section": F.last(F.when(head != "", head), ignorenulls=True).over(w), "body": body, "_head": head})
    return filled.where((F.col("_head") == "") & (F.col("body") != "") & F.col("section").isNotNull()).select(key, "line_no", "section", F.split("body", r"\s+").alias("tokens"))


NODES, LINKS = ["JUNCTIONS", "RESERVOIRS", "TANKS"], ["PIPES", "PUMPS", "VALVES"]


def id_report(data: DataFrame, key: str) -> DataFrame:
    """(key, group, id, n, n_spellings, too_long): ids of nodes and links that repeat, differ in case alone, or exceed 31 bytes."""
    group = F.when(F.col("section").isin(NODES), "node").when(F.col("section").isin(LINKS), "link")
    ids = data.select(key, group.alias("group"), F.col("tokens")[0].alias("id")).where("group is not null")
    g = ids.groupBy(key, "group", F.lower("id").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_spellings"), F.min("id").alias("id"))
    return g.withColumn("too_long", F.octet_length("id") > 31).where("n > 1 or too_long").select(key, "group", "id", "n", "n_spellings", "too_long")


FEATURES = "struct<features: array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>>"


def geo_features(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, kind, parts, props): GeoJSON points and lines as arrays of (x, y); other geometries keep null parts."""
    f = files.select(key, F.posexplode(F.from_json(text, FEATURES)["features"]).alias("index", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = F.when(kind == "Point", F.concat(F.lit("[["), raw, F.lit("]]"))).when(kind.isin("LineString", "MultiPoint"), F.concat(F.lit("["), raw, F.lit("]"))).when(kind.isin("MultiLineString", "Polygon"), raw)
    parts = F.transform(F.from_json(deep, "array<array<array<double>>>"), lambda p: F.transform(F.filter(p, lambda c: F.size(c) >= 2), lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    return f.select(key, "index", kind.alias("kind"), parts.alias("parts"), F.col("f.properties").alias("props"))


def line_length(part: Column) -> Column:
    """Length of one part's polyline."""
    pairs = F.zip_with(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


#: What a rule's action sets, and what its premise may read of a node.
SET_BY_RULES, READ_OF_NODES = ["LINK", "PIPE", "PUMP", "VALVE"], ["PRESSURE", "HEAD"]


def control_scan(data: DataFrame, key: str) -> DataFrame:
    """(key, kind, id), distinct: links that a file's [CONTROLS] and [RULES] set, and nodes that they read.

    data: section_lines. A control sets the link it begins with and reads each NODE it names. In a rule each line belongs to
    the last clause that was opened: IF opens the premise, THEN and ELSE the action, RULE and PRIORITY neither; AND and OR go
    on with it. Only actions set links, and a premise reads a NODE or JUNCTION by its pressure or head only. Words are in any
    case, ids keep theirs. Lines without a word after such a keyword name nothing.
    """
    first, word = F.upper(F.col("tokens")[0]), lambda i: F.upper(F.get("tokens", i))
    opened = F.when(first == "IF", "premise").when(first.isin("THEN", "ELSE"), "action").when(first.isin("RULE", "PRIORITY"), "none")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rules = data.where("section = 'RULES'").withColumn("clause", F.last(opened, ignorenulls=True).over(w)).where(first != "RULE")
    controls = data.where("section = 'CONTROLS'").withColumn("clause", F.lit("control"))
    each = controls.unionByName(rules).where("size(tokens) > 1").select(key, "clause", "tokens", F.explode(F.expr("sequence(0, size(tokens) - 2)")).alias("i"))
    here, reads = word(F.col("i")), word(F.col("i") + 2).isin(READ_OF_NODES)
    kind = (
        F.when((F.col("clause") == "control") & (F.col("i") == 0) & (here == "LINK"), "link").when((F.col("clause") == "control") & (here == "NODE"), "node")
        .when((F.col("clause") == "action") & here.isin(SET_BY_RULES), "link").when((F.col("clause") == "premise") & here.isin("NODE", "JUNCTION") & reads, "node")
    )
    return each.select(key, kind.alias("kind"), F.get("tokens", F.col("i") + 1).alias("id")).where("kind is not null").distinct()


def control_counts(data: DataFrame, key: str) -> DataFrame:
    """(key, controls, rules) of the files that have either."""
    is_rule = F.upper(F.col("tokens")[0]) == "RULE"
    some = data.where("section in ('CONTROLS', 'RULES')").groupBy(key)
    return some.agg(F.count_if(F.col("section") == "CONTROLS").alias("controls"), F.count_if((F.col("section") == "RULES") & is_rule).alias("rules"))

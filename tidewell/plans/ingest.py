"""Sources and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files, model_text, tables
from ..streaming import readings as streams
from .readings import table


def sc1_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.kind_of(F.encode("html", "UTF-8")).alias("kind"))


SC1_SQL = r"""
SELECT page_id, CASE WHEN html = '' THEN 'empty' WHEN regexp_matches(html, '^\s*<\?xml') THEN 'xml' WHEN regexp_matches(html, '^\s*<(?:!doctype html|html|head|body|div)', 'i') THEN 'html'
 WHEN regexp_matches(html, '^\s*[\{\[]') THEN 'json' WHEN regexp_matches(html, '^[^\n]*[,;\t|][^\n]*\n') THEN 'table' ELSE 'other' END AS kind FROM pages
"""


def sc2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    return d.select("doc_id", files.decode_text(raw).alias("d"), "text").select("doc_id", F.col("d.text").eqNullSafe(F.col("text")).alias("same"))


def sc7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model file per nation, written from its suppliers, then scanned by section."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws(" ", F.lit(""), F.when(F.col("s_suppkey") % 3 == 0, "Pump").otherwise("P"), F.lit(""), F.col("s_suppkey").cast("string"), F.lit("; note"))
    body = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    f = body.select(F.col("s_nationkey").alias("file"), F.concat(F.lit("[TITLE]\nmodel\n\n[PIPES]\n;ID\n"), "body", F.lit("\n[END]")).alias("text"))
    data = model_text.section_lines(model_text.lines_of(f, "file", "text"), "file")
    return data.groupBy("file", "section").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tokens")[0] == "Pump").alias("pumps"))


SC7_SQL = """
SELECT s_nationkey AS file, 'PIPES' AS section, count(*) AS n, count(*) FILTER (s_suppkey % 3 = 0) AS pumps FROM supplier GROUP BY s_nationkey
UNION ALL SELECT DISTINCT s_nationkey, 'TITLE', 1, 0 FROM supplier
"""


def sc12_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written from embeddings, read back and measured."""
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 4).cast("string")
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":[['), at(1), F.lit(","), at(2), F.lit("],["), at(3), F.lit(","), at(4), F.lit(']]},"properties":{"v":"'), F.col("vec_id"), F.lit('"}}'))
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("text"))
    g = model_text.geo_features(e, "label", "text")
    return g.select("label", F.col("props")["v"].cast("bigint").alias("vec_id"), F.round(model_text.line_length(F.col("parts")[0]), 6).alias("length"))


SC12_SQL = """
WITH e AS (SELECT label, vec_id, [round(CAST(x AS DOUBLE), 4) FOR x IN embedding[1:4]] AS c FROM embeddings) SELECT label, vec_id, round(sqrt((c[1] - c[3]) ** 2 + (c[2] - c[4]) ** 2), 6) AS length FROM e
"""


def r3_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("cell"))
    order = tables.date_order(o, "cell")
    return o.crossJoin(F.broadcast(order)).select("o_orderkey", "order", tables.date_of(F.col("cell"), F.col("order")).alias("date"))


R3_SQL = "SELECT o_orderkey, 'DMY' AS \"order\", CAST(o_orderdate AS DATE) AS date FROM orders"


def x16_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return p.select("page_id", F.md5(text.cast("binary")).alias("text_md5"), F.size(F.regexp_extract_all("html", F.lit("<([a-zA-Z0-9]+)"), 1)).alias("n_tags"))


X16_SQL = r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5, CAST(len(regexp_extract_all(html, '<([a-zA-Z0-9]+)')) AS INTEGER) AS n_tags FROM pages
"""


def j23_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


J23_SQL = "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def stream_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events as a stream, and a checkpoint folder."""
    schema = table(spark, sf_dir, "events").schema
    return streams.replay(spark, f"{sf_dir}/events.parquet*", schema), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def st1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, at = stream_of(spark, sf_dir)
    out = streams.run_once(streams.daily(stream, "event_type", "value"), at)
    return out.select(F.to_date("day").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


ST1_SQL = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def st2_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, at = stream_of(spark, sf_dir)
    out = streams.run_once(streams.bursts(stream, "user_id"), at)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.sum("n").alias("n"), F.max("n").alias("largest"))


ST2_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g), c AS (SELECT user_id, burst, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS bursts, CAST(sum(n) AS BIGINT) AS n, max(n) AS largest FROM c GROUP BY user_id
"""


def st3_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, at = stream_of(spark, sf_dir)
    keyed = stream.withColumn("site", F.col("user_id") % 5)
    return streams.run_once(streams.analyzers(keyed, "site"), at, "append").select("site")


ST3_SQL = "SELECT site FROM (SELECT user_id % 5 AS site, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2 HAVING count(*) >= 12) GROUP BY site HAVING count(*) >= 2"

QUERIES = {
    "sc1_sniff": (sc1_sniff, SC1_SQL), "sc2_decode": (sc2_decode, "SELECT doc_id, true AS same FROM documents"), "sc7_sections": (sc7_sections, SC7_SQL), "sc12_geojson": (sc12_geojson, SC12_SQL),
    "r3_dates": (r3_dates, R3_SQL), "x16_strip_tags": (x16_strip_tags, X16_SQL), "j23_json_paths": (j23_json_paths, J23_SQL), "st1_daily": (st1_daily, ST1_SQL), "st2_bursts": (st2_bursts, ST2_SQL), "st3_analyzers": (st3_analyzers, ST3_SQL),
}

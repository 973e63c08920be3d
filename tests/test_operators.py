"""Cases that the driver's tables don't have."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import parsing
from tidewell.operators import audit, evaluation, kernels, matching, network, selection, series
from tidewell.sources import files, model_text, tables


def one(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", column_of(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_readings(spark):
    got = one(spark, parsing.reading, ["0.45", "0,45 mg/L", "<0.02", ">2.2", "ND", "", None, "-1", "abc", "1.5 ppm", "N/A", "5."])
    assert [tuple(x) for x in got] == [(0.45, "used"), (0.45, "used"), (0.02, "censored_below"), (2.2, "censored_above"), (None, "censored_below"), (None, "blank"), (None, "blank"), (None, "refused"), (None, "refused"), (1.5, "used"), (None, "blank"), (None, "refused")]


def test_clock(spark):
    assert one(spark, parsing.clock_minutes, ["9:15", "09.15", "9:15 AM", "12:05 AM", "12:05 PM", "0915", "24:00", "9:75", "x", None, "9:15:59"]) == [555, 555, 555, 5, 725, 555, None, None, None, None, 555]


def test_diameters(spark):
    cells = ['8"', "200mm PVC", "DN150", '1-1/2"', "1,200 mm", "0.3 m", "30 cm", "6", "unknown", ""]
    assert one(spark, parsing.diameter_mm, cells) == pytest.approx([203.2, 200, 150, 38.1, 1200, 300, 300, None, None, None])


def test_years_and_ids(spark):
    assert one(spark, parsing.year, ["1965 8in CI", "20031231", "-631152000000", "8", "laid 2031", None]) == [1965, 2003, None, None, None, None]
    ids = one(spark, parsing.clean_id, ["a b;c", "__x__", "a" * 40, "é"])
    assert ids[:2] == ["a_b_c", "x"] and len(ids[2]) == 31 and ids[2] != "a" * 31


def test_mapping_accounts_for_every_row(spark):
    readings = spark.createDataFrame([(1, "7"), (2, "007"), (3, None), (4, "dup"), (5, "zz"), (6, "8"), (7, "A")], "i int, tap string")
    sites = spark.createDataFrame([("007", "J7"), ("dup", "J1"), ("dup", "J2"), ("08", "J8"), ("008", "J9"), ("A", "JA"), (None, "J0")], "tap_id string, junction string")
    got = {r["i"]: (r["site"], r["reason"]) for r in matching.map_readings(readings, sites, "tap", "tap_id", "junction").collect()}
    assert got == {1: ("J7", None), 2: ("J7", None), 3: (None, "no key"), 4: (None, "key names several sites"), 5: (None, "unknown key"), 6: (None, "unknown key"), 7: ("JA", None)}


def test_rank_bins_are_quantile_bins(spark):
    df = spark.range(10).select(F.col("id"), (F.col("id") * 2.0).alias("x"))
    assert [r["bin"] for r in evaluation.rank_bins(df, "x", "id", 3).orderBy("id").collect()] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert evaluation.rank_bins(df.limit(0), "x", "id", 3).count() == 0


def test_islands_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 9)], "k string, n int")
    assert sorted(tuple(r) for r in series.islands(df, "n", ["k"]).collect()) == [("a", 1, 2, 2), ("a", 5, 5, 1), ("b", 9, 9, 1)]
    assert sorted(r["id"] for r in series.unique_ids(df, "k", "n", "id").collect())[:3] == ["a", "a_2", "a_3"]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a long, b long, weight double")
    dist = {r["node"]: r["dist"] for r in network.shortest_paths(network.both_ways(e), spark.createDataFrame([(1,)], "node long")).collect()}
    assert dist == {1: 0.0, 2: 1.0, 3: 2.0}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, 20)], "node long")
    assert {r["node"]: r["part"] for r in network.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20}


def test_bridges_and_clusters(spark):
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (4, 5), (7, 8), (8, 8)])], "link int, a int, b int")
    assert {r["link"] for r in network.bridges(links).collect() if r["is_bridge"]} == {3, 6}
    points = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 5.0, 0.0), ("g", 3, 10.0, 0.0), ("g", 4, 100.0, 0.0)], "g string, id int, x double, y double")
    assert {r["id"]: r["cluster"] for r in kernels.complete_linkage(points, "g", 6.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_mds_keeps_distances(spark):
    xy = np.random.default_rng(0).normal(size=(12, 2))
    rows = [("g", i, j, float(np.hypot(*(xy[i] - xy[j])))) for i in range(12) for j in range(i)]
    got = {r["node"]: (r["c1"], r["c2"]) for r in kernels.classical_mds(spark.createDataFrame(rows, "g string, a int, b int, d double"), "g").collect()}
    for _, i, j, d in rows:
        assert np.hypot(got[i][0] - got[j][0], got[i][1] - got[j][1]) == pytest.approx(d, abs=1e-8)


def test_gaussian_process_interpolates(spark):
    x = np.linspace(0, 6, 40)
    rows = [("g", i, float(v), float(np.sin(v)) if i % 3 else None) for i, v in enumerate(x)]
    got = {r["id"]: (r["mu"], r["sd"]) for r in kernels.gaussian_process(spark.createDataFrame(rows, "g string, id int, x double, y double"), "g", ["x"], "y", noise=0.01).collect()}
    assert max(abs(got[i][0] - np.sin(v)) for i, v in enumerate(x)) < 0.1


def test_route_spreads(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.01, 0.99), (3, 9.0, 9.0, 0.5)], "id int, x double, y double, score double")
    assert [r["id"] for r in selection.diversified_route(c, 5, 1.0, 1.0).orderBy("rank").collect()] == [1, 3, 2]


def test_audit(spark):
    docs = spark.createDataFrame([(1, "rmse 0.12 and 3.5, not 7"), (2, None)], "id int, text string")
    got = audit.trace_numbers(audit.numbers_in(docs, "id", "text"), spark.createDataFrame([(0.1234,), (3.4999,)], "pool_value double"))
    assert {r["token"]: r["found"] for r in got.collect()} == {"0.12": True, "3.5": True, "7": False}


def test_numbers_of_any_length_are_traced(spark):
    """Numbers beyond bigint, with hundreds of decimals, or finer than the slack of the comparison."""
    docs = spark.createDataFrame([(1, f"99999999999999999999999 and 0.{'0' * 400}1 and {'7' * 400} and 2.50000000000000000001 and 123456789012345678901.0")], "id int, text string")
    got = audit.trace_numbers(audit.numbers_in(docs, "id", "text"), spark.createDataFrame([(2.5,), (123456789012345678901.0,)], "pool_value double"))
    assert [r["found"] for r in got.orderBy("place").collect()] == [False, False, False, True, True]


def test_decoding():
    assert files.decode_bytes("é".encode("utf-8-sig")) == ("é", "utf-8-sig")
    assert files.decode_bytes("dépôt".encode("utf-16-le"))[0] == "dépôt"
    assert files.decode_bytes("dépôt".encode("cp1252")) == ("dépôt", "windows-1252")
    assert files.decode_bytes("é".encode() + b" \x93x\x94") == ("é “x”", "utf-8 with strays")
    assert files.decode_bytes(b"") == ("", "utf-8")


def test_zip_and_kinds(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "x,y\n1,2\n")
        z.writestr("../evil", "x")
        z.writestr("bomb", "0" * 10_000_000)
    df = spark.createDataFrame([("f", bytearray(raw.getvalue())), ("g", bytearray(b"no"))], "path string, content binary")
    got = {r["member"]: (r["refused"], r["content"] and bytes(r["content"])) for r in files.zip_members(df).collect()}
    assert got == {"a.csv": (None, b"x,y\n1,2\n"), "../evil": ("unsafe path", None), "bomb": ("too dense", None), None: ("not a zip", None)}
    kinds = [raw.getvalue(), b"[TITLE]\nx\n[PIPES]\n", b"a;b\n1;2\n", b'{"type": "FeatureCollection", "features": []}', b"<?xml version='1.0'?>", b"", b"hello"]
    table = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(kinds)], "i int, content binary")
    assert [r[0] for r in table.select("i", files.kind_of(F.col("content")).alias("k")).orderBy("i").select("k").collect()] == ["zip", "model", "table", "geojson", "xml", "empty", "other"]


def test_model_sections(spark):
    text = "[JUNCTIONS]\n;ID elev\n J1 10\n j1 11 ; note\n\n[PIPES]\nP1 J1 j1 100\n" + "x" * 40 + " a b"
    lines = model_text.lines_of(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")
    data = model_text.section_lines(lines, "file")
    assert [(r["line_no"], r["section"]) for r in data.orderBy("line_no").collect()] == [(3, "JUNCTIONS"), (4, "JUNCTIONS"), (7, "PIPES"), (8, "PIPES")]
    assert sorted((r["group"], r["n"], r["n_spellings"], r["too_long"]) for r in model_text.id_report(data, "file").collect()) == [("link", 1, 1, True), ("node", 2, 2, False)]


def test_table_layout(spark):
    assert tables.layout(["Report", "date;tap;value", "1;2;3", "4;5;6"]) == (";", 1)
    assert tables.layout(["sep=;", "a;b", "1;2"]) == (";", 1)
    assert tables.guess_roles(["Sample ID", "Sample Point", "SampleDate", "Result", "Units"]) == {"date": "SampleDate", "tap": "Sample Point", "reading": "Result", "units": "Units"}
    orders = [["13/02/2026", "01/02/2026"], ["02/13/2026"], ["13/01/2026", "01/13/2026"], ["01/02/2026"], ["02/02/2026"]]
    assert [tables.date_order(spark.createDataFrame([(x,) for x in o], "d string"), "d").first()[0] for o in orders] == ["DMY", "MDY", "both", "either", "MDY"]
    lines = spark.createDataFrame([("a,\"b,c\",d",), ("x",)], "line string")
    assert [r["cells"] for r in tables.split_cells(lines, "line", ",", 3).collect()] == [["a", "b,c", "d"], ["x", None, None]]


def test_cells_are_parsed_once_a_row(spark):
    """However often a formula names a part of a cell, its plan has the part's pattern once or twice."""
    from tidewell.functions import parsing

    cells = spark.createDataFrame([(x,) for x in ('6" CI', "DN150", "8-1/2 in", "7 cm", "12x8", "", "é" * 20 + " x", "Ab;;" * 12)], "cell string")
    got = cells.select(parsing.clean_id(F.col("cell")).alias("id"), parsing.diameter_mm(F.col("cell")).alias("mm"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nps") <= 1 and plan.count("[^\\p{L}") <= 2
    rows = got.collect()
    assert [r["mm"] for r in rows[:6]] == [6 * 25.4, 150.0, 8.5 * 25.4, 70.0, None, None]
    assert rows[5]["id"] == "X" and rows[6]["id"][:11] == "é" * 11 and rows[7]["id"][:23] == "Ab_" * 7 + "A_" and len(rows[6]["id"].encode()) == 31


def test_nearest_baselines_have_no_frame_to_the_partitions_end(spark):
    from tidewell.operators import selection

    rows = spark.createDataFrame([(i, i % 2, float(i * 7 % 50), float(i) if i % 3 == 0 else None) for i in range(60)], "id long, place int, age double, y double")
    known = [(i, i % 2, float(i * 7 % 50), float(i)) for i in range(0, 60, 3)]
    got = selection.baselines(rows, "id", "place", "age", "y")
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in got.collect():
        i = r["id"]
        assert r["nearest"] == min((abs(a - float(i * 7 % 50)), k, y) for k, p, a, y in known if p == i % 2)[2]


def test_tolerance_counts_are_those_of_all_pairs(spark):
    from tidewell.operators import matching

    left = [(i, i * 0.37 % 11) for i in range(40)] + [(98, None), (99, float("nan"))]
    right = [(i, i * 0.1 % 13) for i in range(300)] + [(500, None)]
    got = matching.tolerance_counts(spark.createDataFrame(left, "k int, a double"), spark.createDataFrame(right, "c int, b double"), "k", "a", "b", "c", 1.3)
    expected = {}
    for k, a in left:
        met = [c for c, b in right if a is not None and b is not None and abs(a - b) <= 1.3]
        if met:
            expected[k] = (len(met), min(met))
    assert {r["k"]: (r["n"], r["first"]) for r in got.collect()} == expected


def test_quantiles_rank_different_values_only(spark, monkeypatch):
    from tidewell.operators import ranks

    seen = []
    plain = ranks.running_sum
    monkeypatch.setattr(ranks, "running_sum", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])
    values = [float(i % 5) for i in range(101)]
    got = ranks.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"lo": 0.05, "mid": 0.5, "hi": 0.93}).first()
    assert seen == [5] and [got["lo"], got["mid"], got["hi"]] == pytest.approx(np.quantile(values, [0.05, 0.5, 0.93]).tolist())


def test_values_are_rounded_to_the_places_asked_only(spark):
    from tidewell.operators import documents

    texts = spark.createDataFrame([(1, "2.35 and 7"), (2, "2.351")], "k int, text string")
    files = spark.createDataFrame([("f", "2.351 6.9"), ("g", "2.3514"), ("h", "1 2 3")], "file string, text string")
    cited = spark.createDataFrame([(1, "f"), (2, "g"), (2, "f")], "k int, file string")
    got = documents.trace(texts, "k", "text", cited, documents.pool(files, "file", "text"), "file")
    assert "sequence(0, 6" not in got._jdf.queryExecution().logical().toString()
    assert sorted((r["k"], r["number"], r["files"]) for r in got.collect()) == [(1, "2.35", 1), (1, "7", 1), (2, "2.351", 2)]

"""Cells whose reading is known: sizes, readings, analytes, materials, coordinates, numbers; ranks and graphs by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import forms, parsing
from tidewell.operators import evaluation, geometry, kernels, network, ranks, series


def read(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", column_of(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


SIZES = {
    '8"': (8, "in", None), "200mm PVC": (200, "mm", None), "DN150": (150, "mm", None), '1965 8" CI': (8, "in", None), "L=350' 8\"": (8, "in", None), "12x8 RED": (None, None, "reducer"), "8 & 6": (None, None, "two sizes"),
    '1-1/2"': (1.5, "in", None), "1,200 mm": (1200, "mm", None), "6": (6, None, None), "unknown": (None, None, "unreadable"), "": (None, None, "empty"), '6" (150mm)': (6, "in", None), "6x6": (6, None, None), "1/2 in": (0.5, "in", None),
    "0.3 m": (0.3, "m", None), "12 in DIP": (12, "in", None),
}


def test_pipe_sizes(spark):
    got = read(spark, parsing.pipe_size, [*SIZES, None])
    assert {k: (r["value"], r["unit"], r["flag"]) for k, r in zip(SIZES, got, strict=False)} == SIZES
    assert (got[-1]["value"], got[-1]["flag"]) == (None, "empty")
    assert read(spark, parsing.diameter_mm, ['6" (150mm)', "6", "DN150"]) == [pytest.approx(152.4), None, 150.0]


def test_readings_not_detected(spark):
    got = read(spark, parsing.reading, ["<=0.02", "non-detect", "n/d", "below detection", "<MDL", ">=2.2", "bld", "0,5 mg/L"])
    assert [r["state"] for r in got] == ["censored_below"] * 5 + ["censored_above", "refused", "used"]
    assert (got[0]["value"], got[5]["value"], got[7]["value"]) == (0.02, 2.2, 0.5)


def test_ids(spark):
    got = read(spark, parsing.clean_id, ["Élan 7", "a:b+c/d#e@f", " ;; ", "é" * 40, "x" * 31, None])
    assert got[:3] == ["Élan_7", "a:b+c/d#e@f", "X"] and got[4:] == ["x" * 31, None]
    assert len(got[3].encode()) <= 31 and got[3].startswith("é" * 11 + "_")


def test_cells(spark):
    assert read(spark, forms.coordinate, ["45.123", "45,123", "-122.4", "122.4 W", "N 45.1", "45.1°", "45°30'", "N 1 S", "", None]) == [45.123, 45.123, -122.4, -122.4, 45.1, 45.1, None, None, None, None]
    assert read(spark, lambda v: forms.coordinate(v, "xy"), ["5 W", "5"]) == [None, 5.0]
    assert read(spark, forms.number, ["1,200", "1.5", "1,5", "490 500", "1_500", "1,200.5", "x", "-3"]) == [1200.0, 1.5, 1.5, None, None, 1200.5, None, -3.0]
    assert read(spark, forms.numbers, ["1 2;3", "1,2,3", "1,5 2", "a 1", ""]) == [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.5, 2.0], None, None]
    assert read(spark, forms.cell_text, ["7.0", "7.5", " a ", None]) == ["7", "7.5", "a", ""]
    assert read(spark, forms.plant_month, ["2026-3", "2026/03", "2026-03-15", "2026-13", "March"]) == ["2026-03", "2026-03", "2026-03", None, None]


def test_ranks_in_hot_groups(spark):
    r = random.Random(3)
    rows = [(i, r.choice("aaaab") if i % 9 else None, r.randrange(40), r.randrange(1, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, v int, w int").repartition(5)
    got = {x["id"]: (x["rank"], x["rank_all"]) for x in ranks.ranked(df, ["v", "id"], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for i, h, v, _ in rows if h == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    q = {x["g"]: x["q_50"] for x in ranks.weighted_quantiles(df, "v", "w", ["g"], [0.5]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, w) for _, h, v, w in rows if h == g)
        total, at = sum(w for _, w in own), 0
        for v, w in own:
            at += w
            if at / total >= 0.5 - 1e-12:
                assert q[g] == v
                break
    m = {x["g"]: x["upper_median"] for x in ranks.upper_medians(df, "v", "id", ["g"]).collect()}
    assert m["a"] == sorted(v for _, h, v, _ in rows if h == "a")[sum(h == "a" for _, h, _, _ in rows) // 2]
    assert ranks.ranked(df.limit(0), ["v"], ["g"]).count() == 0
    runs = series.islands(spark.createDataFrame([(1,), (2,), (2,), (4,), (7,), (8,), (9,)], "n int").withColumn("k", F.lit(1)), "n", ["k"])
    assert sorted((x["first"], x["last"], x["n"]) for x in runs.collect()) == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]


def is_bridge(links, i):
    near = {}
    for j, (a, b) in enumerate(links):
        if j != i:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    a, b = links[i]
    seen, todo = {a}, [a]
    while todo:
        for x in near.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return b not in seen


def test_bridges_by_brute_force(spark):
    r = random.Random(4)
    links = [(r.randrange(14), r.randrange(14)) for _ in range(16)]
    got = {x["link"]: x["is_bridge"] for x in network.bridges(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(links)], "link int, a int, b int")).collect()}
    assert got == {i: is_bridge(links, i) for i in range(len(links))}
    assert network.bridges(spark.createDataFrame([], "link int, a int, b int")).count() == 0


def test_long_chains_end_whatever_their_length(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "a int, b int, weight double")
    source = spark.createDataFrame([(0,)], "node int")
    assert network.shortest_paths(edges, source).count() == network.reachable(edges, source).count() == 13
    assert {x["part"] for x in network.components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges).collect()} == {0}


def test_sizes_spread_along_runs(spark):
    pipes = [("p1", 1, 2, 8.0), ("p2", 2, 3, None), ("p3", 3, 4, None), ("p4", 4, 5, 6.0), ("p5", 4, 6, None), ("p6", 9, 10, None)]
    got = network.propagate_sizes(spark.createDataFrame(pipes, "link string, a int, b int, size double")).collect()
    assert {x["link"]: x["size"] for x in got} == {"p2": 8.0, "p3": 8.0}


def test_labels_hull_and_arcs(spark):
    labels = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 2.0, 3.0), (2, 50.0, 50.0, 51.0, 51.0, 1.0)], "label int, left double, bottom double, right double, top double, radius double")
    lines = spark.createDataFrame([(10, -5.0, 0.0, 5.0, 0.0), (11, -5.0, 4.0, 5.0, 4.0), (12, 90.0, 90.0, 91.0, 91.0)], "line int, ax double, ay double, bx double, by double")
    assert [tuple(x) for x in geometry.label_lines(labels, lines, 3.0).collect()] == [(1, 10, 1.0, 11, 2.0)]
    r = random.Random(5)
    points = [("g", i, r.random(), r.random()) for i in range(300)] + [("g", 1000, -1.0, -1.0), ("g", 1001, 2.0, -1.0), ("g", 1002, 0.5, 3.0), ("g", 1003, 0.5, -1.0), ("h", 1, 0.0, 0.0)]
    got = geometry.hull(spark.createDataFrame(points, "g string, id int, x double, y double"), "g").collect()
    assert sorted((x["g"], x["id"]) for x in got) == [("g", 1000), ("g", 1001), ("g", 1002), ("h", 1)]
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0)], "line int, n int, x double, y double")
    asked = spark.createDataFrame([(1, 1.5), (1, 5.0), (1, 7.0), (1, 99.0), (1, -1.0)], "line int, arc double")
    got = {x["arc"]: (x["x"], x["y"]) for x in geometry.point_at_arc(v, asked, "line", "n").collect()}
    assert got == {1.5: (1.5, 0.0), 5.0: (3.0, 2.0), 7.0: (3.0, 4.0), 99.0: (3.0, 4.0), -1.0: (0.0, 0.0)}


def test_landmarks_place_all_points(spark):
    r = random.Random(6)
    xy = [(r.random(), r.random()) for _ in range(60)]
    d = [("g", i, j, ((xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2) ** 0.5) for i in range(60) for j in range(6)]
    got = {x["node"]: (x["c1"], x["c2"]) for x in kernels.landmark_mds(spark.createDataFrame(d, "g string, node int, landmark int, d double"), "g").collect()}
    for a, b in [(0, 30), (20, 41), (7, 59)]:
        assert ((got[a][0] - got[b][0]) ** 2 + (got[a][1] - got[b][1]) ** 2) ** 0.5 == pytest.approx(((xy[a][0] - xy[b][0]) ** 2 + (xy[a][1] - xy[b][1]) ** 2) ** 0.5)


def test_clusters_in_pieces_are_those_of_the_whole(spark):
    r = random.Random(7)
    points = spark.createDataFrame([("g", i, r.random() * 8, r.random() * 8) for i in range(120)], "g string, id int, x double, y double")
    whole = {x["id"]: x["cluster"] for x in kernels.complete_linkage(points, "g", 0.5).collect()}
    assert {x["id"]: x["cluster"] for x in kernels.complete_linkage(kernels.linkage_groups(points, "g", 0.5), "piece", 0.5).collect()} == whole
    with pytest.raises(Exception, match="cut it into smaller groups"):
        kernels.complete_linkage(points, "g", 0.5, most=50).collect()


def test_recomputed_and_trees(spark):
    a = spark.createDataFrame([(1, 10.0), (2, None), (3, 5.0), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 10.05), (2, None), (3, 6.0), (5, 1.0)], "k int, v double")
    got = {x["k"]: x["status"] for x in evaluation.recomputed(a, b, "k", "v", 0.01).collect()}
    assert got == {1: "same", 2: "same", 3: "differs", 4: "stated only", 5: "computed only"}
    t = evaluation.tree(spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "g string, h int"), ["g", "h"], {"n": F.count(F.lit(1))})
    assert sorted(map(tuple, t.collect())) == [("a", "1", 1), ("a", "all", 2), ("a", "none", 1), ("all", "all", 3), ("none", "2", 1), ("none", "all", 1)]

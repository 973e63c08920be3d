"""Ends joined by steps of at most the tolerance, without their pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import building, network
from tidewell.operators.matching import nearby_points


@pytest.mark.parametrize("finest", [12, 1])
def test_clusters_are_those_of_pairs_and_no_table_grows_with_them(spark, monkeypatch, finest):
    r = np.random.default_rng(4)
    heap = lambda n, x, s: r.normal(0, s, (n, 2)) + [x, 60]
    # Scattered ends, heaps just within and just beyond the tolerance of each other, a lattice of the tolerance itself, one place twice.
    at = np.concatenate([r.uniform(-20, 20, (150, 2)), heap(300, 60, 0.05), heap(150, 61.05, 0.05), heap(100, 62.4, 0.05), np.round(r.uniform(80, 90, (60, 2))), [[-1e6, 3.3], [-1e6, 3.3]]])
    ends = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at.tolist())], "end long, x double, y double").repartition(3)
    pairs = nearby_points(ends, 1.0, "end").select("a", "b")
    want = {x["node"]: x["part"] for x in network.components(ends.select(F.col("end").alias("node")), pairs).collect()}
    made = []

    def counted(keep):
        def kept(df):
            out = keep(df)
            made.append(out.count())
            return out

        return kept

    monkeypatch.setattr(building, "cut", counted(building.cut))
    monkeypatch.setattr(network, "keep", counted(network.keep))
    found = building.clustered(ends, 1.0, finest).collect()
    assert {x["end"]: x["cluster"] for x in found} == want and len(found) == len(at) and 50 < len(set(want.values())) < 250
    if finest > 1:
        assert pairs.count() > 50 * len(at) and max(made) < 4 * len(at)


def test_parts_of_few_edges_are_joined_at_once(spark, monkeypatch):
    """Long chains, parts of many sizes and texts: the same parts by rounds and by one task, in three tables."""
    r = np.random.default_rng(5)
    at = r.permutation(3000)
    pairs = [(int(a), int(b)) for a, b in zip(at[:999], at[1:1000])] + [(int(a), int(b)) for a, b in r.choice(at[1000:], (700, 2))] + [(1, 1), (2, 4000)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    nodes = spark.range(3000).select(F.col("id").alias("node"))
    parts = lambda *how: {x["node"]: x["part"] for x in network.components(*how).collect()}
    want, made = parts(nodes, edges, 0), []
    monkeypatch.setattr(network, "keep", lambda df, keep=network.keep: made.append(1) or keep(df))
    assert parts(nodes, edges) == want == parts(nodes, edges, 900) and 1000 < len(set(want.values())) < 2000
    made.clear()
    text = lambda df: df.select(*[F.format_string("n%05d", c).alias(c) for c in df.columns])
    assert parts(text(nodes), text(edges)) == {f"n{k:05}": f"n{v:05}" for k, v in want.items()} and len(made) == 3


def test_few_open_pairs_are_compared_at_once_and_a_report_waits_until_asked_for(spark, monkeypatch):
    r = np.random.default_rng(6)
    lines = spark.createDataFrame([(i, k, float(x), float(y)) for i in range(60) for k, (x, y) in enumerate(r.uniform(0, 60, (3, 2)))], "line long, k int, x double, y double")
    asked = []
    monkeypatch.setattr(building, "components", lambda *of, all_=building.components: asked.append(1) or all_(*of))
    net = building.build_network(lines, 1.0)
    assert len(asked) <= 3  # two of the ends' cells, one of what tees join
    rows = lambda net: sorted((x["a"], x["b"], round(x["length"], 6)) for x in net.pipes.collect())
    found, seen = rows(net), len(asked)
    assert net.report.first()["pipes"] == len(found) and len(asked) == seen + 1
    monkeypatch.setattr(building, "PAIRS_AT_ONCE", 0)
    assert rows(building.build_network(lines, 1.0)) == found

"""Nearest vectors against all products."""

import math

import numpy as np
import pytest

from tidewell.llm import neighbours, queries

SF = "/root/testdata/sf0.01"


def plain(rows, k=20, every=20):
    """rows: (id, vector). All products, components added in order."""
    good = [(i, [float(x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (qi, q) in enumerate(good):
        if qi is None or qi % every:
            continue
        found = []
        for m, (i, v) in enumerate(good):
            if m != n and len(v) == len(q):
                s = 0.0
                for a, b in zip(q, v, strict=True):
                    s += a * b
                found.append((-s, i is None, i or 0, i))
        out += [(qi, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_query_finds_all_nearest(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op13_nearest_vectors(spark, SF)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert got(found) == plain(rows)


@pytest.mark.parametrize("cells", [(3, 7), (1024, 4096)])
def test_copies_ties_and_odd_vectors(spark, cells):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.standard_normal((150, 8)), 1).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0]) for i in range(60)]  # one very common vector, queries among its rows
    rows += [(7, vectors[7]), (0, vectors[0]), (0, vectors[0]), (20, vectors[3]), (None, vectors[5]), (None, vectors[0])]
    rows += [(2000 + i, [x * 1e3 for x in v]) for i, v in enumerate(vectors[:30])]  # large norms
    rows += [(3000, None), (3020, []), (3040, [0.0] * 8), (3060, [1.0, None] * 4), (3080, [math.nan] + [1.0] * 7), (3100, [math.inf] + [1.0] * 7), (3120, [1.0, 2.0, 3.0]), (3121, [-1.0, 2.0, 3.0]), (3140, [4.0]), (3160, [-0.0, 1.0, 0.0]), (3161, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    found = neighbours.nearest_vectors(df, df["vec_id"] % 20 == 0, cell_queries=cells[0], cell_vectors=cells[1])
    assert got(found) == plain(rows)
    assert neighbours.nearest_vectors(df.limit(0), df["vec_id"] % 20 == 0).count() == 0
    assert neighbours.nearest_vectors(df, df["vec_id"] < 0).count() == 0


@pytest.mark.parametrize("d", [1, 3, 64])
def test_error_bound_holds_and_prunes(d):
    rng = np.random.default_rng(d)
    vectors, asked = rng.standard_normal((3000, d)) * rng.uniform(0.1, 9, (3000, 1)), rng.standard_normal((40, d))
    bits = 4 * d
    codes = neighbours.encode(vectors, bits, 1)
    estimate, error = neighbours.estimates((asked @ neighbours.rotation(d, bits, 1).T).astype(np.float32), *codes, bits)
    off = np.abs(estimate - asked @ vectors.T) / (np.linalg.norm(asked, axis=1)[:, None] * error)
    assert codes[0].shape == (3000, -(-bits // 8)) and (d < 64 or (off <= 4).mean() > 0.9998)
    q, v, score, measured = neighbours.search_cell(asked, vectors, np.arange(3000), codes, 20, bits, 1, 4.0, block=500)
    want = np.argsort(-(asked @ vectors.T), axis=1, kind="stable")[:, :20]
    assert np.mean([np.isin(v[q == i], want[i]).mean() for i in range(40)]) >= 0.999
    assert (np.bincount(q, minlength=40) == 20).all() and (d < 64 or measured < 0.3 * 40 * 3000)

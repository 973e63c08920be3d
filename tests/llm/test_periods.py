"""Periodic runs against plain loops over all periods, and the grammar against plain comparison."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import periods, queries

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=6, times=4):
    """All maximal stretches of each period, shortest period first; a stretch counts under its smallest period."""
    w = np.asarray(w)
    found = {}
    for q in range(1, len(w) // times + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False])).astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((int(a), int(b + q)), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_on_whole_table(spark):
    names = {}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        n = len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs([names.setdefault(w, len(names)) for w in words])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want[r["doc_id"]] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs)).hexdigest())
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == want and sum(x[0] > 0 for x in got.values()) > 10


def marked(words, many):
    """The words between marks that occur once."""
    return np.concatenate(([many], words, [many + 1])).astype(np.int64)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 9)), max_size=30), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_runs_are_all_and_exact(parts, times):
    """Words of stretches and of repeated pieces."""
    words = [x for x, n in parts for _ in range(n)]
    words = words + words[:7] * times
    start, end, q = periods.runs_of(marked(words, 3), len(words))
    assert list(zip((start - 1).tolist(), (end - start).tolist(), q.tolist(), strict=True)) == plain_runs(words)


@pytest.mark.parametrize("step", [1, -1])
def test_grammar_tells_how_far_places_agree(step):
    rng = np.random.default_rng(5)
    for kind in range(4):
        words = [rng.integers(0, 3, 400), np.repeat(rng.integers(0, 4, 60), rng.integers(1, 30, 60)), np.tile(rng.integers(0, 9, 37), 20), np.zeros(500, int)][kind]
        s = marked(words, 9)
        levels = periods.grammar(s)
        assert len(np.unique(levels[-1].symbols)) == len(levels[-1].symbols)
        p, q = rng.integers(1, len(s) - 1, (2, 600))
        p, q = p[p != q], q[p != q]
        got = periods.first_difference(levels, p, q, step)
        for a, b, c in zip(p.tolist(), q.tolist(), got.tolist(), strict=True):
            n = 0
            while s[a + step * n] == s[b + step * n]:
                n += 1
            assert c == a + step * n


def test_levels_grow_as_the_logarithm():
    words = np.random.default_rng(1).integers(0, 50, 100_000)
    assert len(periods.grammar(marked(np.concatenate((words, words)), 50))) < 120
    assert len(periods.grammar(marked(np.zeros(1_000_000, int), 1))) < 40


def test_edges(spark):
    rows = [(1, "a b " * 5, "x"), (1, "a b " * 5, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n", "x"), (None, "c " * 6, "x"), (5, "c " * 5, "x"), (6, "é\u00a0f " * 6 + "end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs, tails_every=1_000_003).collect()), key=str)
    assert got == sorted([(1, [(0, 10, 2)], "a b"), (1, [(0, 10, 2)], "a b"), (2, [], ""), (3, [], ""), (4, [], ""), (None, [(0, 6, 1)], "c"), (5, [], "c c c c c"), (6, [(0, 6, 1)], "é\u00a0f end")], key=str)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_one_long_text_beside_short_ones(spark):
    long = " ".join(["w%d" % (i % 7) for i in range(60_000)] + ["tail"] * 9)
    docs = spark.createDataFrame([(i, "short one") for i in range(50)] + [(50, long)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in periods.periodic_runs(docs, slice_bytes=1000).collect()}
    assert [tuple(x) for x in got[50]["runs"]] == [(0, 60_000, 7), (60_000, 9, 1)] and got[50]["collapsed"] == "w0 w1 w2 w3 w4 w5 w6 tail"
    assert all(got[i]["collapsed"] == "short one" for i in range(50))

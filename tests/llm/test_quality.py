"""The ordinal model against plain loops, and what it keeps of rated documents it hasn't seen, for few and for more ratings."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import quality

from .test_operators import frame, texts


def plain_features(text, bits):
    """Slots as the module's docstrings say, one thing after another."""
    raw = (text or "").encode()
    low = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    words = re.findall(rb"[a-z\x80-\xff]+", low)
    slots = {xxhash.xxh32_intdigest(w) for w in words} | {xxhash.xxh32_intdigest(w[:5], 1) for w in words if len(w) > 5}
    letters, size, count = sum(len(w) for w in words) or 1, max(len(raw), 1), max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tokens = raw.split()
    shares = {
        "upper": sum(0x41 <= b <= 0x5A for b in raw) / letters, "marks": sum(b in quality.MARKS for b in raw) / size, "marked": sum(t[-1] in quality.MARKS for t in tokens) / max(len(tokens), 1),
        "distinct words": len(set(words)) / count, "distinct lines": len(set(lines)) / max(len(lines), 1), "word length": min(letters / count / 20, 1), "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / count,
    }
    for name, share in shares.items():
        for step in quality.STEPS:
            slots.add(xxhash.xxh32_intdigest(f"{name} {'over' if share > step else 'under'} {step}".encode(), 2))
    slots.add(xxhash.xxh32_intdigest(f"length {len(words).bit_length()}".encode(), 2))
    return {s & ((1 << bits) - 1) for s in slots}


def test_rates_by_brute_force(spark):
    docs = [*texts(11, 40), (900, "ALL CAPS $$$ !!!\n\nALL CAPS"), (901, "a a a a"), (902, "Ünï cödé")]
    r = np.random.default_rng(0)
    model = quality.OrdinalModel(12, r.normal(size=1 << 12).astype(np.float32) / 10, np.array([-0.5, 0.7]))
    got = {x["doc_id"]: x for x in quality.rate(frame(spark, docs), model).collect()}
    for d, t in docs:
        slots = plain_features(t, 12)
        score = sum(float(model.weights[s]) for s in slots)
        tails = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        assert got[d]["n_features"] == len(slots)
        assert (got[d]["score"], got[d]["expected_grade"], got[d]["p_tail"]) == (pytest.approx(score, abs=1e-5), pytest.approx(sum(tails), abs=1e-5), pytest.approx(tails[1], abs=1e-5))
        assert got[d]["kept"] == (tails[1] >= 1 / 3) or abs(tails[1] - 1 / 3) < 1e-5


def test_fit_raises_the_likelihood_and_orders_cuts():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        g = int(r.integers(0, 3))
        rows.append((np.unique(np.concatenate([r.integers(10, 200, 20), [1 + g] if r.random() < 0.9 else [5]])).astype(np.int32), g))
    model = quality.fit(rows, 3, 9)
    assert (np.diff(model.cuts) > 0).all()

    def likelihood(w, cuts):
        total = 0.0
        for x, g in rows:
            tails = [1.0, *(1 / (1 + math.exp(min(c - float(w[x].sum()), 40))) for c in cuts), 0.0]
            total += math.log(max(tails[g] - tails[g + 1], 1e-12))
        return total

    assert likelihood(model.weights, model.cuts) > likelihood(np.zeros(1 << 9), [-0.7, 0.7]) + 100
    assert model.weights[3] > model.weights[2] > model.weights[1]
    same = quality.fit([(np.array([3, 4], np.int32), 1)] * 5, 3, 9)
    assert np.isfinite(same.cuts).all() and np.isfinite(same.weights).all()


@pytest.mark.parametrize("sf, toxic", [("sf0.001", 0.5), ("sf0.01", 0.25)])  # with 87 and 399 ratings
def test_unseen_documents(spark, sf, toxic):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    graded = quality.grades_of(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")).where("grade is not null")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    kept = {0: [0, 0], 1: [0, 0], 2: [0, 0]}
    for k in range(5):
        model = quality.train(docs, graded.where(fold != k))
        for x in quality.rate(docs, model).join(graded.where(fold == k), "doc_id").collect():
            kept[x["grade"]][0] += x["kept"]
            kept[x["grade"]][1] += 1
    shares = {g: a / max(n, 1) for g, (a, n) in kept.items()}
    assert shares[2] > 0.9 and shares[0] < toxic

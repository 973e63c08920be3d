"""The language model against plain loops: base columns, tables, codes, and the score of each text, decision by decision."""

import zlib
from collections import Counter
from math import exp, log, log1p, log10, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import lm
from tidewell.llm.batches import raw

from .test_operators import frame, texts

M = 1 << 64


def learnt(spark, docs, bits=15):
    rows = frame(spark, docs).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return lm.learn(rows, 7, 2, 40, 16, bits, 4000)[0]


def pieces(text):
    """Closed pieces."""
    split = text.encode().split(b" ")
    return [p + b" " for p in split[:-1]] + [split[-1] + b"\xff"]


def path(code, two, byte):
    cell = int(code.context[two]) * 256 + byte
    at = int(code.start[cell])
    return [(int(x) >> 1, int(x) & 1) for x in code.flat[at : at + int(code.length[cell])]]


def decisions(code, piece, bits):
    """(place, node, bit, slots) of each decision of a closed piece."""
    inverse, out = pow(lm.ODD, -1, M), []
    for place, byte in enumerate(piece):
        before = [piece[place - i] if place >= i else 0x20 for i in range(1, 6)]
        three = sum(b << 8 * i for i, b in enumerate(before[:3]))
        five = sum(b << 8 * i for i, b in enumerate(before))
        far = sum((b + 1) * pow(inverse, j, M) for j, b in enumerate(piece[:place])) + place
        context = [(x + (i << 56)) * lm.ODD % M for i, x in enumerate((three, five, far), 1)]
        for node, bit in path(code, before[1] << 8 | before[0], byte):
            slots = [(c + node * 0xD6E8FEB86659FD93) * int(lm.MIX) % M >> 64 - b for c, b in zip(context, (bits - 2, bits - 1, bits))]
            out.append((place, node, bit, slots))
    return out


def line(piece):
    h = sum((b + 1) * pow(pow(lm.ODD, -1, M), j, M) for j, b in enumerate(piece)) % M
    h = ((h ^ h >> 32) * int(lm.MIX) | 1) % M
    return (h * int(lm.MIX) % M) >> 64 - 15


def logit(zero, one):
    return int(np.clip(np.round(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127))


def nearest(x, values):
    return min(range(len(values)), key=lambda i: (abs(values[i] - x), i))


def slow_score(model, text, rate=0.05, bits=15):
    """Nats, one decision after another."""
    t, found = model.tables, pieces(text)
    steps, tilts = sorted({a for a, _ in lm.GRID}), sorted({b for _, b in lm.GRID})
    head, place, nats = [float(x) for x in lm.HEAD], [0.0, 0.0], 0.0
    two = 0x2020
    base = int(model.code.context[two]) * 255
    for a, b in lm.rounds(len(found)):
        weights = lm.REST + steps[nearest(place[0], steps)] * lm.STRONGER + tilts[nearest(place[1], tilts)] * lm.LONGER
        pulls, n = [np.zeros(2), np.zeros(4)], [0, 0]
        for i in range(a, min(b, len(found))):
            before = line(found[i - 1]) if i else 0
            for at, node, bit, slots in decisions(model.code, found[i], bits):
                x = [t.node[node], *(table[s] for table, s in zip(t.within, slots, strict=True))] if at else [t.node[node], t.across[before * 256 + node - base]]
                x = np.array(x, float) / 16 * (2 * bit - 1)
                right = float(np.clip(x @ (weights if at else head), -20, 20))
                nats += log1p(exp(-right))
                pulls[at > 0] += x / (1 + exp(right))
                n[at > 0] += 1
        head = [w + rate * p / sqrt(n[0]) for w, p in zip(head, pulls[0], strict=True)]
        step = [rate * float(pulls[1] @ d) / sqrt(max(n[1], 1)) for d in (lm.STRONGER, lm.LONGER)]
        place = [float(np.clip(x + y, v[0], v[-1])) for x, y, v in zip(place, step, (steps, tilts), strict=True)]
    return nats


def test_base_columns_and_score(spark):
    docs = texts(5)
    docs += [(900, " Zwei\x0bDrei\x1fVier"), (901, "A " * 9), (902, " "), (903, "\n \n  x"), (0, docs[0][1])]
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    own = [(d, t, zlib.crc32(str(d).encode()) % 7 != 2) for d, t in docs]
    c = Counter(w for _, t, train in own if train for w in words(t))
    n, v = sum(c.values()), len(c)
    for frequent in (200_000, 5):
        got = lm.score_texts(frame(spark, docs), frequent=frequent, codes=16, most_bits=15, slice_bytes=4000).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in docs)
        by_id = {r["doc_id"]: r for r in got}
        for d, t, train in own:
            r = by_id[d]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train, len(words(t)), sum(w in c for w in words(t)), n)
            assert r["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in words(t)))
            assert r["n_bytes"] == len((t or "").encode()) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.5


def test_score_by_brute_force(spark):
    docs = texts(6, 40)
    model = learnt(spark, docs)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark, docs), frequent=40, codes=16, most_bits=15, slice_bytes=4000).collect()}
    for d, t in [*docs[:25], *docs[-4:-1]]:
        assert -got[d] * log(10) == pytest.approx(slow_score(model, t or ""), rel=2e-3), d


def test_tables_by_brute_force(spark):
    docs, bits = texts(7, 60), 15
    model = learnt(spark, docs, bits)
    train = Counter(p for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for p in pieces(t or ""))
    assert sum((len(p) * 3 - 3) for p in train) < 1 << bits - 1  # so that the table of the piece so far takes all
    node, within = Counter(), [Counter(), Counter(), Counter()]
    for p, n in train.items():
        for _, at, bit, slots in decisions(model.code, p, bits):
            node[at, bit] += n
            for table, s in zip(within, slots, strict=True):
                table[s, bit] += n
    for counts, table in zip([node, *within], [model.tables.node, *model.tables.within], strict=True):
        assert all(abs(int(table[s]) - logit(counts[s, 0], counts[s, 1])) <= 1 for s in {s for s, _ in counts})
        assert (table != 0).sum() <= len({s for s, _ in counts})
    base, across = int(model.code.context[0x2020]) * 255, Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            own = pieces(t or "")
            for before, p in zip([0, *map(line, own)], own, strict=False):
                for at, bit in path(model.code, 0x2020, p[0]):
                    across[before * 256 + at - base, bit] += 1
    assert all(abs(int(model.tables.across[s]) - logit(across[s, 0], across[s, 1])) <= 1 for s in {s for s, _ in across})


@pytest.mark.parametrize("times", [1, 1 << 33])
def test_tables_take_all_pieces_beyond_their_bound(spark, times):
    """More pieces than the table of the piece so far has room for, and counts beyond 32 bits: none is left out."""
    bits, random = 15, np.random.default_rng(11)
    train = Counter({bytes(random.integers(97, 123, random.integers(3, 9)).astype(np.uint8)): times * int(random.integers(1, 4)) for _ in range(3000)})
    table = spark.createDataFrame([(p.decode(), False, n) for p, n in train.items()], "piece string, last boolean, train long").repartition(2)
    code = lm.learn_code(table, 16)
    got = lm.learn_within(table, code, bits)
    far = Counter()
    for p, n in train.items():
        for _, _, bit, slots in decisions(code, p + b" ", bits):
            far[slots[2], bit] += n
    assert len({s for s, _ in far}) > 1 << bits - 1
    assert all(abs(int(got.within[2][s]) - logit(far[s, 0], far[s, 1])) <= 1 for s in {s for s, _ in far})


def toy(seed=1):
    random = np.random.default_rng(seed)
    code = lm.build_code({0x2020: random.random(256), 0x2061: random.random(256) ** 4})
    table = lambda n: random.integers(-60, 60, n).astype(np.int8)
    return lm.Memo(code, lm.Tables(table(code.nodes), [table(1 << 12), table(1 << 13), table(1 << 14)], table(lm.LINES * 256)))


def nats(memo, some):
    import pyarrow as pa

    p = lm.Pieces(*raw(pa.array(some, pa.string())))
    return lm.score_pieces(memo, p, memo.ids(p), 0.05)


def test_mixture_is_a_distribution():
    memo = toy()
    one = np.exp(-nats(memo, [chr(b) for b in range(128)]))
    two = np.exp(-nats(memo, [chr(a) + chr(b) for a in range(128) for b in range(128)]))
    assert 0 < one.sum() + two.sum() + np.exp(-nats(memo, [""])[0]) <= 1


def test_scores_dont_depend_on_neighbours_nor_on_the_memo():
    some = ["", "a b c", "word " * 300, "", "é" * 700, "a  b", " "]
    together = nats(toy(), some)
    assert together == pytest.approx([nats(toy(), [t])[0] for t in some], rel=1e-5)
    memo = toy()
    memo.most = 10
    assert [nats(memo, [t])[0] for t in some] == pytest.approx(together, rel=1e-5)


def test_index_numbers_hashes():
    index, known = lm.Index(), {}
    random = np.random.default_rng(0)
    for _ in range(30):
        h = random.integers(1, 1 << 18, 5000).astype(np.uint64) << np.uint64(46)  # many meet at one place
        new = np.unique(h[index.find(h) < 0])
        known |= {x: len(known) + i for i, x in enumerate(new.tolist())}
        index.add(new)
        assert index.find(h).tolist() == [known[x] for x in h.tolist()]


def test_a_full_memo_keeps_its_common_pieces(monkeypatch):
    memo, added, add = toy(), [], lm.Memo.add
    memo.most = 3000

    def seen(self, p, new, *more):
        added.extend(bytes(p.room[a : a + n]) for a, n in zip(p.begin[new].tolist(), p.size[new].tolist(), strict=True))
        return add(self, p, new, *more)

    monkeypatch.setattr(lm.Memo, "add", seen)
    some = [" ".join(["common", f"rare{i}", "common", f"word{i}", "often"]) for i in range(400)]
    one_by_one = [nats(memo, [t])[0] for t in some]
    assert memo.logits.n < 3200 and len(added) > 800  # it was full many times
    assert added.count(b"common ") == 1
    assert one_by_one == pytest.approx(nats(toy(), some).tolist(), rel=1e-5)


def test_words_are_found_by_their_bytes():
    numbers = {w.encode(): float(i) for i, w in enumerate(["a", "ab", "abc", "é", "x" * 64, "b"])}
    words = lm.Words(numbers)
    asked = [b"abc", b"", b"c", b"b", "é".encode(), b"x" * 63, b"x" * 64, b"a", b"zzz"]
    size = np.array([*map(len, asked)])
    begin = np.cumsum(size) - size
    room = np.frombuffer(b"".join(asked), np.uint8)
    own = lm.hashes(room, begin, size)
    assert [None if np.isnan(x) else x for x in words.find(room, begin, size, own)] == [numbers.get(w) for w in asked]
    other = np.full(len(asked), lm.hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))[0])  # all hashes those of abc
    assert [not np.isnan(x) for x in words.find(room, begin, size, other)] == [w == b"abc" for w in asked]
    assert np.isnan(lm.Words({}).find(room, begin, size, own)).all()

"""The pipeline's near stage against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from tidewell.llm import near

ROWS = "doc_id long, text string, lang string, id string"


def kept_by_brute_force(docs):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root, pairs = [grams(t) for _, t in docs], list(range(len(docs))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                pairs += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values()), pairs


def test_near_stage_finds_all_pairs_of_enough_similarity(spark):
    r = random.Random(7)
    vocabulary = ["w%d" % i for i in range(3000)]
    docs = []
    for _ in range(60):  # a text and copies with 0 to 9 words changed: similarities on both sides of 0.8
        own = [r.choice(vocabulary) for _ in range(r.choice([60, 150, 300]))]
        docs.append(own)
        for _ in range(3):
            copy = list(own)
            for at in r.sample(range(len(own)), r.randint(0, 9)):
                copy[at] = r.choice(vocabulary)
            docs.append(copy)
    docs += [["clean", *(r.choice(vocabulary) for _ in range(80))] for _ in range(40)]
    docs = [(i * 7 % 281 * 10 + i % 10, " ".join(t)) for i, t in enumerate(docs)]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "Two words"), (9004, "two  Words"), (9005, "two words more")]
    assert len({d for d, _ in docs}) == len(docs)
    want, pairs = kept_by_brute_force(docs)
    assert pairs > 100 and len(want) > 100
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], ROWS).repartition(3)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_stage(spark, table, "").collect()) == want


def test_near_edges(spark):
    table = spark.createDataFrame([(None, "a b c d e f", "x", "y"), (None, "a b c d e f", "x", "y"), (3, "other words here", "x", "y"), (3, "other words here", "x", "y")], ROWS)
    assert sorted((x["doc_id"] or 0) for x in near.drop_near_duplicates(table).collect()) == [0, 3]
    assert near.drop_near_duplicates(table.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    r = random.Random(8)
    own = [str(r.random()) for _ in range(120)]
    docs = [(i, " ".join([*own[:60], *(str(r.random()) for _ in range(1)), *own[60:]])) for i in range(1500)]
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], ROWS)
    assert [x["doc_id"] for x in near.drop_near_duplicates(table).collect()] == [0]


def test_a_group_on_both_sides_of_the_similarity_makes_no_square_of_candidates(spark, monkeypatch):
    r = random.Random(9)
    own = [str(r.random()) for _ in range(150)]
    docs = []
    for i in range(500):
        copy = list(own)
        for at in r.sample(range(len(own)), r.randint(1, 9)):
            copy[at] = str(r.random())
        docs.append((i, " ".join(copy)))
    made, keep = [], near.keep

    def counted(df, name):
        kept = keep(df, name)
        made.append((name, kept.count()))
        return kept

    monkeypatch.setattr(near, "keep", counted)
    want, pairs = kept_by_brute_force(docs)
    assert 1000 < pairs < 500 * 499 / 4 and len(want) > 10
    found = near.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in found if x["doc_id"] == x["component_id"]) == want
    members = dict(made)["near-shards"]
    assert max(n for name, n in made if name == "near-candidates") <= members  # a shard makes fewer links than it has rows


def test_sketches_rule_out_no_pair_of_enough_similarity():
    random_ = np.random.default_rng(3)
    base = random_.integers(0, 1 << 63, 900).astype(np.uint64)
    rows, sets = [], []
    for k in range(120):
        size = int(random_.integers(1, 900)) if k % 2 else 600
        own = np.unique(np.concatenate((base[: size - size // 8], random_.integers(0, 1 << 63, int(random_.integers(0, size // 4 + 1)) + 1).astype(np.uint64))))
        sets.append(own)
        rows.append((k, near.wide_fingerprint(own), k, len(own), [k + 1] if k % 10 == 0 else None, near.sketch(own)))
    i, j = np.triu_indices(len(rows), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    size = np.array([len(x) for x in sets])
    similar = common >= 0.8 * (size[i] + size[j] - common) - 1e-9
    open_ = near.may_be_similar(rows, i, j, size, 0.8)
    fits = np.minimum(size[i], size[j]) >= 0.8 * np.maximum(size[i], size[j]) - 1e-9
    assert similar.sum() > 50 and open_[similar].all() and (open_ & fits).sum() < 2 * similar.sum()
    every = {(a, b) for a, b in near.links_left(rows, rows, 0.8, False)}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(rows[a][1], rows[b][1], strict=True))
    assert every == {(a, b) for a, b, o, f in zip(i.tolist(), j.tolist(), open_, fits, strict=True) if o and f and apart(a, b) <= near.RADIUS and not (a % 10 == 0 and b == a + 1)}
    some = near.links_left(rows, rows, 0.8, True)
    parts = near.links_left(rows[:50], rows[50:], 0.8, False)
    assert {(a, b) for a, b in parts} == {(a, b) for a, b in every if a < 50 <= b}

    def roots(links):
        root = list(range(len(rows)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [y if z == x else z for z in root]
        return {frozenset(k for k in range(len(rows)) if root[k] == z) for z in root}

    assert roots(some) == roots(every) and len(some) == len(rows) - len(roots(every))


def test_later_searches_read_written_rows_of_shards_with_something_left_to_join(spark, monkeypatch):
    r = random.Random(10)
    own = [str(r.random()) for _ in range(150)]
    changed = lambda at: [str(r.random()) if i in at else w for i, w in enumerate(own)]
    a, b, c = changed({20, 70}), own, changed({40, 110})
    docs = [(i, " ".join(t)) for i, t in enumerate([a, b, c])]
    assert kept_by_brute_force(docs) == ([0], 2)  # a and c are apart
    table = spark.createDataFrame(docs, "doc_id long, text string")
    node = {x["id"]: x["node"] for x in near.signatures(table, 5, "doc_id", "text").collect()}
    asked, search = [], near.search_shards

    def fixed(links):
        def find(members, radius, rows, *more):
            asked.append(members)
            if more:
                return search(members, radius, rows, *more)
            return spark.createDataFrame([(s, node[x], node[y]) for s, x, y in links], "shard long, a long, b long")

        asked.clear()
        monkeypatch.setattr(near, "search_shards", find)
        return {x["component_id"] for x in near.near_components(table).collect()}

    assert fixed([(1, 0, 1), (1, 0, 2), (2, 1, 2)]) == {0} and len(asked) == 1  # the refused link's ends are joined by others
    assert fixed([(1, 0, 1), (1, 0, 2)]) == {0} and len(asked) == 2
    assert "Join" not in asked[1]._jdf.queryExecution().toString() and sorted(x["node"] for x in asked[1].collect()) == sorted(node.values())


def test_later_searches_take_each_text_once(spark, monkeypatch):
    r = random.Random(11)
    docs = []
    for k in range(2):  # two groups, apart from each other
        own = [str(r.random()) for _ in range(150)]
        for i in range(150):
            copy = list(own)
            for at in r.sample(range(len(own)), r.randint(1, 9)):
                copy[at] = str(r.random())
            docs.append((k * 150 + i, " ".join(copy)))
    again, keep = [], near.keep

    def seen(df, name):
        kept = keep(df, name)
        if name == "near-again":
            again.append([(x["shard"], x["node"]) for x in kept.collect()])
        return kept

    monkeypatch.setattr(near, "keep", seen)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want, _ = kept_by_brute_force(docs)
    for shard_rows in (2048, 40):
        again.clear()
        found = near.near_components(table, shard_rows=shard_rows).collect()
        assert sorted(x["doc_id"] for x in found if x["doc_id"] == x["component_id"]) == want
        assert again and all(len({node for _, node in rows}) == len(rows) <= len(docs) for rows in again)
        assert len({shard for shard, _ in again[0]}) >= 2  # what nothing links isn't searched together

"""Spelling variants against a plain search of all pairs, and the composed machine's parts."""

import itertools
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(words):
    """word: (form, root, n, n_near, form_n), from neighbours found by deleting each letter in turn."""
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out, form = {}, {}
    for w, n in words.items():
        near = {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1 :]] | {w[:i] + w[i + 1 :]} if x in words} | holes.get(w, set())
        near = {x for x in near if one_edit(w, x)}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if near and words[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_on_whole_table(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = w.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = rows(queries.op11_spelling_variants(spark, SF))
    assert got == plain(words) and sum(x[0] is not None for x in got.values()) > 100


@given(st.sets(st.text("abé", min_size=0, max_size=6), max_size=40))
@settings(max_examples=200, deadline=None)
def test_composition_accepts_each_pair_once(words):
    acceptor = spelling.Acceptor(sorted(words))
    got = spelling.one_edit_pairs(acceptor)
    assert len(got) == len(set(got))
    assert {frozenset(p) for p in got} == {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(a + b for a in ("walk", "talk", "balk") for b in ("", "s", "ed", "ing")))
    assert len(acceptor.edges) == 1 + 4 + 4  # start, one path of 'alk', then the ways of 's', 'ed' and 'ing'


@pytest.mark.parametrize("cell_words", [1, 3, 2048])
def test_cells_of_any_size_give_the_same(spark, cell_words):
    """A hot beginning, repeated letters, words of one letter, and words far longer than a recursion could read."""
    long = ["ab" * 400, "ab" * 400 + "c", "ab" * 200 + "x" + "ab" * 200, "z" * 900, "z" * 901, "z" * 902]
    words = [("hot" + "".join(p), 3 + i % 50) for i, p in enumerate(itertools.product("abc", repeat=4))]
    words += [(w, 7 * i + 1) for i, w in enumerate(["a", "b", "aa", "aaa", "aaaa", "ba", "é", "éé", *long])]
    got = rows(spelling.variant_groups(spark.createDataFrame(words, "word string, n long"), cell_words=cell_words))
    assert got == plain(dict(words))


def test_chains_of_forms_reach_their_end(spark):
    words = {"abcdefgh"[:i] * 1 + "x" * (12 - i): 3 * 2**i for i in range(9)}
    got = rows(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words) and {x[1] for x in got.values()} == {"abcdefghxxxx"}


def test_edges(spark):
    text = "one Ønë ONE one×two xāy two"
    docs = spark.createDataFrame([(1, text, "n"), (1, text, "n"), (2, None, "n"), (3, "", "n"), (None, "one", "n")], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {"one": 5, "Ønë": 2, "one×two": 2, "x": 2, "y": 2, "two": 2}
    assert rows(spelling.spelling_variants(docs.limit(0))) == {}
    assert {r["word"] for r in spelling.word_counts(docs, drop_every=1).collect()} <= {"on", "oe", "ne", "Øn", "Øë", "në", "tw", "to", "wo"} | {"one×two"[:i] + "one×two"[i + 1 :] for i in range(7)}
    assert rows(spelling.variant_groups(spark.createDataFrame([(None, 5), ("a", 3)], "word string, n long"))) == {"a": (None, "a", 3, 0, None)}

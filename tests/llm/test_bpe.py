"""Encoding against the tokenizers library: all code points, marks in any order, and the automaton against merging by hand."""

import random
import struct

import pytest
from tokenizers import Tokenizer

from tidewell.llm import bpe, queries


@pytest.fixture(scope="module")
def both():
    path = queries.tokenizer_path()
    return Tokenizer.from_file(path), bpe.Encoder(bpe.read_spec(path))


def differing(both, some):
    known, own = both
    out = []
    for t, w in zip(some, known.encode_batch(some, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        if struct.pack(f"<{len(w.ids)}I", *w.ids) != ids or own.decode(ids) != known.decode(w.ids, skip_special_tokens=False):
            out.append(t)
    return out


def test_all_code_points(both):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    blocks = ["\n".join(f"a{c}b 1{c} {c}{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    assert differing(both, blocks) == []


def test_marks_and_cases(both):
    r = random.Random(1)
    marks = [chr(i) for a, b in [*bpe.STARTERS, (0x300, 0x34F)] for i in range(a, b + 1)]
    letters = [chr(i) for a, b in [*bpe.NEWER[:40], (0x41, 0x5A), (0x3A3, 0x3C3), (0x11930, 0x11938)] for i in range(a, min(b, a + 30) + 1)] + [chr(i) for i in bpe.LOWERED]
    some = ["".join(r.choice(r.choice([marks, letters, list(" 1'!<")])) for _ in range(40)) for _ in range(2000)]
    assert differing(both, some) == []


def merged(word, ranks):
    """Tokens by applying the earliest merge first, everywhere from left to right."""
    own = list(word)
    while True:
        found = [(ranks[p], p) for p in zip(own, own[1:], strict=False) if p in ranks]
        if not found:
            return own
        pair = min(found)[1]
        out, i = [], 0
        while i < len(own):
            step = 2 if tuple(own[i : i + 2]) == pair else 1
            out.append("".join(own[i : i + step]))
            i += step
        own = out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_on_random_merges(seed):
    r = random.Random(seed)
    inner = bpe.byte_symbols()
    tokens, merges = ["a", "b", "c", "a.", "b.", "c."], []
    while len(merges) < 25:
        u, v = r.choice(tokens), r.choice(tokens)
        if u.endswith(".") or u + v in tokens:
            continue
        symbols = list((u + v).removesuffix("."))
        if (u + v).endswith("."):
            symbols[-1] += "."
        if merged(symbols, {m: i for i, m in enumerate(merges)}) != [u, v]:
            continue  # trained merges join tokens that stand side by side
        merges.append((u, v))
        tokens.append(u + v)
    names = dict.fromkeys([*inner, *(c + "." for c in inner), *tokens])
    vocab = {t: i for i, t in enumerate(names)}
    automaton = bpe.Automaton(vocab, merges, ".")
    ranks = {m: i for i, m in enumerate(merges)}
    for _ in range(200):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        want = merged([*word[:-1], word[-1] + "."], ranks)
        assert [automaton.labels[i] for i in automaton.path(word.encode())] == want

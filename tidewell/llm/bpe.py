"""BPE by automaton: merges are compiled, one gadget at a time, into a deterministic automaton over tokens.

States are "after token t". The automaton starts with one state in which every base symbol loops. The gadget of merge
(u, v) -> w takes the v arc out of the state after u, adds a w arc wherever a u arc leads to a state that had v, and lets
the state after w start as a copy of the state after v. Copies share their arcs: an arc (t, x) of the finished automaton
exists unless some gadget took it, or the arc it was built from, away, which the merges' birth dates of the right parts of
t and the left parts of x tell. A state's arcs go into the transition table when a word first asks for them.

A word, and so each beginning of it, has exactly one path through the automaton. Encoding therefore reads a word once from
left to right and keeps the one state that each beginning ends in; decoding emits the labels of the arcs that ids name.
"""

from __future__ import annotations

import gc
import json
import math
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, texts

#: Code points that Unicode assigned as letters or digits after version 16.0, which the tokenizers library follows.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Lower case that the library knows and Python 3.13 doesn't: (first, last, lower case of the first).
CASES = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Marks whose combining class is newer than the library's normaliser, which takes them for starters; the last composes in newer versions only.
STARTERS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF), (0x11930, 0x11930),
]
LOWERED = {x: low + x - first for first, last, low in CASES for x in range(first, last + 1)}


def span(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


SPANS = span(NEWER)
FAR = re.compile("[\u0558-\U0010ffff]")  # none of the above is nearer
FOREIGN = re.compile(f"[{SPANS}{span(STARTERS)}{''.join(map(chr, LOWERED))}]")
STARTER = re.compile(f"([{span(STARTERS)}])")


def foreign(text: str) -> bool:
    """Whether the library reads some character otherwise than Python does."""
    return bool(FAR.search(text) and FOREIGN.search(text))

#: How many words, and arcs, a worker keeps at most before it starts anew. No effect on results.
WORDS_KEPT, ARCS_KEPT = 300_000, 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Automaton:
    """merges: pairs of token strings in rank order. vocab: ids. suffix: marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.labels = {i: t for t, i in vocab.items()}
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + suffix] for c in byte_symbols()]
        self.gadget: dict[tuple[int, int], int] = {}  # (u, v) -> birth date of w, which is when (u, v) lost its arc
        self.left: dict[int, tuple[int, int]] = {}  # w -> (u, birth): where a w arc comes from
        self.right: dict[int, tuple[int, int]] = {}  # w -> (v, birth): which state the state after w copied
        spelt = {t: (t,) for t in (*self.inner, *self.last)}
        for birth, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.left:
                continue  # a token keeps the first merge that makes it
            self.gadget.setdefault((u, v), birth)
            self.left[w], self.right[w] = (u, birth), (v, birth)
            spelt[w] = spelt[u] + spelt[v]
        # Nested by symbol; under None a node has the token that its symbols spell.
        self.trie: dict = {}
        for token, symbols in spelt.items():
            at = self.trie
            for symbol in symbols:
                at = at.setdefault(symbol, {})
            at[None] = token
        self.table: dict[tuple[int, int], bool] = {}

    def arc(self, t: int, x: int) -> bool:
        """Whether x may follow t: no gadget joined a right part of t with a left part of x while both stood."""
        known = self.table.get((t, x))
        if known is not None:
            return known
        free, until = True, math.inf
        r: int | None = t
        while r is not None and free:
            s: int | None = x
            end = math.inf
            while s is not None:
                birth = self.gadget.get((r, s))
                if birth is not None and birth < until and birth <= end:
                    free = False
                    break
                s, end = self.left.get(s, (None, 0))
            r, until = self.right.get(r, (None, 0))
        if len(self.table) >= ARCS_KEPT:
            self.table.clear()
        self.table[t, x] = free
        return free

    def path(self, word: bytes) -> list[int]:
        """Tokens of a word that isn't empty."""
        symbols = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n, trie, known, arc = len(symbols), self.trie, self.table.get, self.arc
        state: list[int | None] = [None] * (n + 1)  # the token that the first so many symbols end in
        begin = [0] * (n + 1)  # where it begins
        for start in range(n):
            before, at = state[start], trie
            for end in range(start, n):
                at = at.get(symbols[end])
                if at is None:
                    break
                token = at.get(None)
                if token is None or state[end + 1] is not None:
                    continue
                if start:
                    free = known((before, token))
                    if free is None:
                        free = arc(before, token)
                    if not free:
                        continue
                state[end + 1], begin[end + 1] = token, start
        out, end = [], n
        while end:
            out.append(state[end])
            end = begin[end]
        return out[::-1]


class Encoder:
    """Normalises, splits and encodes a text as the tokenizer file says; special tokens' strings are cut out first."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # The library's Unicode: what was assigned later is neither letter nor digit.
        older = lambda kind: rf"[\p{{{kind}}}--[{SPANS}]]"
        pattern = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{SPANS}])+").replace(r"[\p{L}]", older("L")).replace(r"[\p{N}]", older("N"))
        self.older_words = regex.compile(pattern, regex.V1)
        self.memo: dict[str, bytes] = {}
        # The same words in a text of ASCII alone, where the standard library's matcher is twice as fast.
        self.ascii_words = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace("[[a-z]]", "[a-z]"), re.ASCII)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if foreign(text):
            text = "".join(unicodedata.normalize("NFC", part) for part in STARTER.split(text)).translate(LOWERED)
        else:
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a final sigma isn't special

    def word(self, word: str) -> bytes:
        if len(self.memo) >= WORDS_KEPT:
            self.memo.clear()
        ids = self.automaton.path(word.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self.memo[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Packed ids."""
        ids, get = [], self.memo.get
        for i, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if i % 2:
                ids.append(struct.pack("<I", self.special[part]))
                continue
            words = self.ascii_words if part.isascii() else self.older_words if foreign(part) else self.words
            ids += [get(w) or self.word(w) for w in words.findall(self.normal(part))]
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """Emits the label of each id's arc."""
        labels = self.automaton.labels
        return " ".join([labels[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    made = Encoder(spec)
    gc.freeze()  # the automaton's many small tables stay: no need to walk them again and again
    return made


def read_spec(path: str) -> str:
    """The tokenizer's JSON, read by the driver (a file of fixed size) and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Null texts are empty: no tokens, decoded empty. Texts of any length are encoded whole. Repeated rows come back repeated;
    other columns aren't read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in slices(batches, 1, slice_bytes):
            ids = [enc.encode(t.decode()) for t in texts(batch.column(1))]
            decoded = [enc.decode(x) for x in ids]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids binary, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded: from packed ids alone. Null ids decode to an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            out = [enc.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "decoded"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, decoded string")

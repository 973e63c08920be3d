"""Periodic runs of words by recompression.

A slice of documents becomes one row of symbols, a symbol a word, with marks of their own between documents. Block compression
(maximal stretches of one symbol) and pair compression (a symbol of the left kind and one of the right kind after it) alternate
until no symbol occurs twice: a run-length grammar, parsed alike wherever the surroundings are alike. How far two places agree,
forwards or backwards, is read from it level by level, first up and then down, for all questions at once.

A run of four periods or more covers four neighbouring places of its period's grid, so the candidates of a period q are every
q-th place at which three grid steps agree: n + n/2 + n/3 + ... places are looked at, and the grammar gives each one's exact
extension.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, texts


class Level(NamedTuple):
    """symbols; parent: of each, the place of its symbol one level up; first, last: of each symbol one level up, its outer places here."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    blocks: bool


def left_kind(symbols: np.ndarray, level: int) -> np.ndarray:
    """A fixed half of all symbols, another one at each level."""
    with np.errstate(over="ignore"):
        x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 0


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from the words up; in the last, of which only the symbols count, no symbol occurs twice."""
    levels: list[Level] = []
    new, none = int(symbols.max(initial=0)) + 1, np.zeros(0, np.int64)

    def lift(symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, compressed: np.ndarray, blocks: bool) -> np.ndarray:
        """The next level: its symbols begin at starts; the compressed ones are named by their keys, the others stay."""
        nonlocal new
        first = np.flatnonzero(starts)
        levels.append(Level(symbols, np.cumsum(starts) - 1, first, np.concatenate((first[1:], [len(symbols)])) - 1, blocks))
        above = symbols[first].copy()
        values, named = np.unique(keys, return_inverse=True)
        above[compressed] = new + named
        new += len(values)
        return above

    step = 0
    while len(symbols) > 1 and len(np.unique(symbols)) < len(symbols):
        starts = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if not starts.all():
            first = np.flatnonzero(starts)
            size = np.diff(np.concatenate((first, [len(symbols)])))
            long = size > 1
            kinds, kind = np.unique(symbols[first[long]], return_inverse=True)
            symbols = lift(symbols, starts, kind * (int(size.max()) + 1) + size[long], long, True)
        left = left_kind(symbols, step)
        step += 1
        head = np.concatenate((left[:-1] & ~left[1:], [False]))
        if head.any():
            starts = ~np.concatenate(([False], head[:-1]))
            a = np.flatnonzero(head)
            kinds, kind = np.unique(symbols[a + 1], return_inverse=True)
            symbols = lift(symbols, starts, symbols[a] * len(kinds) + kind, head[starts], False)
    levels.append(Level(symbols, none, none, none, False))
    return levels


def first_difference(levels: list[Level], p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """Where reading from p and from q (p != q) differs first; step 1 reads forwards, -1 backwards. Gives the place on p's side.

    Up: on each level both sides read what is left of their parents, until they differ or begin a parent together; what is
    alike on both sides is parsed alike, so that is one symbol or one block. Down: into the symbols that differ.
    """
    p, q = p.copy(), q.copy()
    at = np.zeros(len(p), np.int64)  # the level of the difference
    going = np.arange(len(p))
    for h, level in enumerate(levels):
        here, there = p[going], q[going]
        same = level.symbols[here] == level.symbols[there]
        at[going[~same]] = h
        going, here, there = going[same], here[same], there[same]
        if not going.size:
            break
        head, tail = (level.first, level.last) if step > 0 else (level.last, level.first)
        up, vp = level.parent[here], level.parent[there]
        inside = (head[up] != here) | (head[vp] != there)
        if level.blocks:
            rest, other = np.abs(tail[up] - here) + 1, np.abs(tail[vp] - there) + 1
            move = np.where(inside, np.minimum(rest, other), 0)
            ends = inside & (rest != other)
        else:
            move, ends = inside.astype(np.int64), np.zeros(len(here), bool)
        here, there = here + step * move, there + step * move
        at[going[ends]] = h
        p[going[ends]], q[going[ends]] = here[ends], there[ends]
        going, here, there = going[~ends], here[~ends], there[~ends]
        p[going], q[going] = level.parent[here], level.parent[there]
    for h in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(at >= h)
        if not down.size:
            continue
        level = levels[h - 1]
        head, tail = (level.first, level.last) if step > 0 else (level.last, level.first)
        up, vp = p[down], q[down]
        here, there = head[up], head[vp]
        same = level.symbols[here] == level.symbols[there]
        move = np.minimum(np.abs(tail[up] - here), np.abs(tail[vp] - there)) + 1 if level.blocks else 1
        move = np.where(same, move, 0)
        p[down], q[down] = here + step * move, there + step * move
    return p


def runs_of(symbols: np.ndarray, longest: int, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period), by start and period, of all maximal runs of `times` (4 or more) of their smallest period and `least` symbols or more.

    symbols: the first and the last occur once, and so do those that no run may cross; longest: a bound of a run's length.
    """
    places, periods = [], []
    for q in range(1, longest // times + 1):
        grid = symbols[::q]
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) if len(same) > 2 else same[:0]
        if len(hits):
            places.append(hits * q)
            periods.append(np.full(len(hits), q))
    if not places:
        return (np.zeros(0, np.int64),) * 3
    g, q = np.concatenate(places), np.concatenate(periods)
    levels = grammar(symbols)
    end = first_difference(levels, g, g + q, 1) + q
    start = first_difference(levels, g - 1, g - 1 + q, -1) + 1
    good = end - start >= np.maximum(least, times * q)
    # A stretch's smallest period is found with the others, which are its multiples and have the same stretch.
    found = np.unique(np.stack((start[good], end[good], q[good]), axis=1), axis=0)
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    start, end, q = found[keep].T
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def periodic_tail(name: str, n: int, every: int) -> tuple[int, int] | None:
    """(a, p): of documents whose crc32 is divisible by `every`, each word from a on becomes word a + (i - a) % p."""
    h = zlib.crc32(name.encode())
    if h % every or not n:
        return None
    g = h // every
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, tails_every: int | None = None, slice_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs, collapsed) for each row of docs.

    runs: (start, length, period) in words, by start and period: maximal stretches of a smallest period that they hold `times`
    times or more, of at least `least` words. collapsed: the words joined by one space, without those that a run holds after
    its first period. Words: runs of other than ASCII white space. tails_every: make the end of such a share of the documents
    periodic first (see periodic_tail; a null id is none of them), as a probe of the corpus.
    Null and empty texts have no words, no runs and an empty rest. Repeated rows come back repeated. Other columns aren't read.
    An empty table gives no rows. Texts are read whole; a task holds about slice_bytes, or one text if that is longer.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("name"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, slice_bytes):
            words = [t.split() for t in texts(batch.column(1))]
            if tails_every:
                for i, name in enumerate(batch.column(2).to_pylist()):
                    tail = None if name is None else periodic_tail(name, len(words[i]), tails_every)
                    if tail:
                        a, p = tail
                        own = words[i]
                        words[i] = own[:a] + (own[a : a + p] * (1 + (len(own) - a) // p))[: len(own) - a]
            size = np.fromiter(map(len, words), np.int64, len(words))
            named: dict[bytes, int] = {}
            for own in words:
                named.update(dict.fromkeys(own))
            for i, w in enumerate(named):
                named[w] = i
            # A mark in front of each document, and one behind all.
            begin = np.cumsum(size + 1) - size
            symbols = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
            marks = np.concatenate((begin - 1, [len(symbols) - 1]))
            symbols[marks] = len(named) + np.arange(len(marks))
            inside = np.ones(len(symbols), bool)
            inside[marks] = False
            symbols[inside] = np.fromiter((named[w] for own in words for w in own), np.int64, int(size.sum()))
            start, end, period = runs_of(symbols, int(size.max(initial=0)), least, times)
            gone = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            gone = np.cumsum(gone) > 0
            doc = np.searchsorted(begin, start, "right") - 1
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start - begin[doc]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"]),
            )
            touched = set(doc.tolist())
            collapsed = []
            for i, own in enumerate(words):
                if i in touched:
                    b = int(begin[i])
                    own = [own[j] for j in np.flatnonzero(~gone[b : b + len(own)]).tolist()]
                collapsed.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(collapsed, pa.binary())], names=["id", "runs", "collapsed"])

    found = rows.mapInArrow(find, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))

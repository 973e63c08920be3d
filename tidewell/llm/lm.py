"""Language-model scores: online logistic mixing of hashed-context bit predictors, beside an add-one unigram base.

A text is a row of pieces: its bytes between single spaces, each closed by that space and the last by an end. Each byte is a
few binary decisions in a prefix code of its own for the two bytes before it, so that a likely byte takes about one.
Predictors know how each decision fell in training: after the code's context, after the last three and five bytes of the
piece, and after the whole piece so far; a piece's first byte has the piece before as its further context.

Pieces are counted as Spark rows over all documents, which grow with the input; all counts within pieces are then taken from
each distinct piece once. Counts go to hashed tables summed block by block over the cluster, whose size follows the distinct
training pieces up to a stated bound. A document's score mixes the predictors' logits with weights gated by the place in the
piece. They start alike in each document and are refined by gradient from its first piece on, so that the score depends on
the document and the tables alone. Within pieces the weights stand on a grid of two directions (how strong, and how far to
the longer contexts), so that a piece's cost and gradient at a grid point are worked out once for all its occurrences.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import raw, slices
from .shared import keep

PAD, SPACE, END = 5, 0x20, 0xFF  # spaces before each piece; what closes pieces, and texts (no UTF-8 text has it)
ODD = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLOCK = 1 << 14  # counts summed together
LINES = 1 << 15  # of the table of first bytes, by hash of the piece before
HEAD = np.array([0.8, 0.3], np.float32)  # start weights for first bytes: node, piece before
REST = np.array([0.1, 0.35, 0.5, 0.25], np.float32)  # and within pieces: node, three bytes, five, piece so far
STRONGER, LONGER = REST, np.array([-0.1, -0.05, 0.0, 0.2], np.float32)  # directions of the grid
GRID = [(a, b) for a in (-0.3, -0.1, 0.1, 0.3) for b in (-1.0, 0.0, 1.0)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Code:
    """Prefix codes: context[two bytes] picks one; cell = code * 256 + byte has length[cell] decisions from flat[start[cell]] on, each node * 2 + bit."""

    context: np.ndarray
    start: np.ndarray
    length: np.ndarray
    flat: np.ndarray
    nodes: int


def huffman(weight: list[float]) -> list[list[int]]:
    """For each of 256 symbols its decisions, node * 2 + bit, nodes from 0."""
    heap = [(w, s) for s, w in enumerate(weight)]
    heapq.heapify(heap)
    children = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], 256 + len(children)))
        children.append((a[1], b[1]))
    paths: list[list[int]] = [[]] * (256 + len(children))
    for i in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[i]):
            paths[child] = [*paths[256 + i], i * 2 + bit]
    return paths[:256]


def build_code(counts: dict[int, np.ndarray]) -> Code:
    """counts[two bytes]: of each byte after them. Other contexts share the code of the sum, so each byte has a code anywhere."""
    total = sum(counts.values(), np.zeros(256)) + 0.5
    floor = total / total.sum() * 0.1
    context, start, length, flat, at = np.zeros(1 << 16, np.int32), [], [], [], 0
    for i, (two, own) in enumerate([(None, total), *sorted(counts.items())]):
        if two is not None:
            context[two] = i
        for path in huffman((own + floor).tolist()):
            start.append(at)
            length.append(len(path))
            flat += [x + i * 510 for x in path]
            at += len(path)
    return Code(context, np.array(start, np.int32), np.array(length, np.int32), np.array(flat, np.int32), 255 * (1 + len(counts)))


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1] ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """The pieces of some texts: where each begins in `room` and its size, closing byte included; its hash; how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        size = np.diff(offsets)
        self.room = np.full(int(size.sum()) + n, END, np.uint8)
        ends = np.cumsum(size + 1) - 1
        inside = np.ones(len(self.room), bool)
        inside[ends] = False
        self.room[inside] = data[int(offsets[0]) : int(offsets[-1])]
        close = np.flatnonzero((self.room == SPACE) | (self.room == END))
        self.begin = np.concatenate((np.zeros(min(len(close), 1), np.int64), close[:-1] + 1))
        self.size = close + 1 - self.begin
        self.many = np.diff(np.concatenate(([0], np.searchsorted(close, ends, "right"))))
        self.first = np.cumsum(self.many) - self.many  # of each text's pieces
        self.hash = hashes(self.room, self.begin, self.size)
        # The line of the piece before; a text's first piece has none before.
        self.line = np.zeros(len(close), np.int64)
        self.line[1:] = ((self.hash[:-1] * MIX) >> np.uint64(64 - 15)).astype(np.int64)
        self.line[self.first] = 0


@cache
def first_powers(base: int) -> np.ndarray:
    out = np.full(1 << 16, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    if n <= 1 << 16:
        return first_powers(base)[:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(room: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((room.astype(np.uint64) + np.uint64(1)) * powers(len(room), pow(ODD, -1, 1 << 64)), dtype=np.uint64)))


def hashes(room: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Polynomial over each stretch's bytes, spread; never zero."""
    with np.errstate(over="ignore"):
        sums = prefix_sums(room)
        x = (sums[begin + size] - sums[begin]) * powers(len(room) + 1, ODD)[begin]
        x ^= x >> np.uint64(32)
        return x * MIX | np.uint64(1)


class Index:
    """Numbers hashes in the order in which they come; open addressing."""

    def __init__(self) -> None:
        self.n, self.bits = 0, 16
        self.hash, self.number = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 for the new."""
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.hash.take(at)
        out = np.where(there == h, self.number.take(at), -1)
        open_ = np.flatnonzero((there != h) & (there != 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & mask
            there = self.hash.take(at[open_])
            hit = there == h[open_]
            out[open_[hit]] = self.number.take(at[open_[hit]])
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct new hashes take the next numbers."""
        if (self.n + len(h)) * 2 > len(self.hash):
            old, number = self.hash, self.number
            self.bits = max(self.bits + 1, ((self.n + len(h)) * 2).bit_length())
            self.hash, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self.place(old[old != 0], number[old != 0])
        self.place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while left.size:
            free = self.hash[at[left]] == 0
            self.hash[at[left[free]]] = h[left[free]]
            won = self.hash[at[left]] == h[left]
            self.number[at[left[won]]] = number[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & mask

    def number_all(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, places of the new ones in p, in the order of their numbers)."""
        ids = self.find(p.hash)
        new = np.flatnonzero(ids < 0)
        if new.size:
            own, first, which = np.unique(p.hash[new], return_index=True, return_inverse=True)
            ids[new] = self.n + which
            self.add(own)
            new = new[first]
        return ids, new


class Words:
    """A number for each of some words, found by hash and compared byte by byte; takes less memory than a dict."""

    def __init__(self, numbers: dict[bytes, float]):
        self.numbers = np.array([*numbers.values(), np.nan])
        self.size = np.array([*map(len, numbers), 0], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.room = np.frombuffer(b"".join(numbers), np.uint8)
        self.index = Index()
        self.index.add(hashes(self.room, self.begin[:-1], self.size[:-1]))

    def find(self, room: np.ndarray, begin: np.ndarray, size: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The stretches' numbers, nan where it has none (or where two words of it share a hash, for one of them)."""
        at = self.index.find(hash_)
        same = np.flatnonzero(self.size.take(at) == size)
        at, own, size = at.take(same), begin.take(same), size.take(same)
        other = np.flatnonzero(self.room.take(expand(self.begin.take(at), size)) != room.take(expand(own, size)))
        at[np.searchsorted(np.cumsum(size), other, "right")] = -1
        out = np.full(len(begin), np.nan)
        out[same] = self.numbers.take(at)
        return out


class Symbols:
    """Bytes of closed pieces with what stands before them. later: only decisions after a piece's first byte."""

    def __init__(self, room: np.ndarray, begin: np.ndarray, size: np.ndarray, code: Code | None = None, later: bool = False):
        own = np.cumsum(size + PAD) - size
        self.size, self.piece = size, np.repeat(np.arange(len(size)), size)
        self.place = expand(np.zeros(len(size), np.int64), size)
        spot = self.place + own.take(self.piece)
        padded = np.full(int(own[-1] + size[-1]) if len(size) else 0, SPACE, np.uint8)
        padded[spot] = room.take(self.place + begin.take(self.piece))
        # Eight bytes from five before each symbol on, turned about: the last five, nearest first, stand above the symbol's own.
        eight = np.ndarray(len(padded), "<u8", padded.tobytes() + bytes(8), 0, (1,)).take(spot - PAD).byteswap()
        self.byte = (eight >> np.uint64(16) & np.uint64(255)).view(np.int64)
        five = eight >> np.uint64(24)
        three = five & np.uint64(0xFFFFFF)
        self.two = (five & np.uint64(0xFFFF)).view(np.int64)
        with np.errstate(over="ignore"):
            sums = prefix_sums(padded)
            far = (sums.take(spot) - sums.take(own).take(self.piece)) * powers(len(padded) + 1, ODD).take(own).take(self.piece) + self.place.view(np.uint64)
            self.context = [(x + np.uint64(i << 56)) * np.uint64(ODD) for i, x in enumerate((three, five, far), 1)]
        if code:
            # Of each decision, piece by piece: its symbol, node, bit.
            self.cell = code.context.take(self.two) * 256 + self.byte
            length = code.length.take(self.cell)
            if later:
                length *= self.place > 0
            self.decisions = np.bincount(self.piece, length, len(size)).astype(np.int64)  # of each piece
            self.symbol = np.repeat(np.arange(len(length)), length)
            flat = code.flat.take(expand(code.start.take(self.cell), length))
            self.node, self.bit = flat >> 1, flat & 1
            self.spread = self.node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def slots(self, k: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self.context[k].take(self.symbol)
            x += self.spread
            x *= MIX
            x >>= np.uint64(64 - bits)
            return x.view(np.int64)


@dataclass
class Tables:
    """int8 logits of a one, in sixteenths: by node, by slot of the three contexts within a piece, and of first bytes by line and node."""

    node: np.ndarray
    within: list[np.ndarray]
    across: np.ndarray | None = None


def bits_of(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


class Store:
    """Rows that grow at the end."""

    def __init__(self, dtype: type, *width: int):
        self.rows, self.n = np.zeros((1024, *width), dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.rows):
            more = np.zeros((max(len(self.rows) * 2, self.n + len(x)), *self.rows.shape[1:]), self.rows.dtype)
            more[: self.n] = self.rows[: self.n]
            self.rows = more
        self.rows[self.n : self.n + len(x)] = x
        self.n += len(x)


@dataclass
class Memo:
    """Pieces met so far: their tokens, and for the decisions after the first byte the logits of what happened.

    logs: of one plus a frequent word's training count. Holds `most` decisions before it goes on with the pieces met most
    often, without effect on results.
    """

    code: Code
    tables: Tables
    logs: Words = field(default_factory=lambda: Words({}))
    most: int = 1 << 21

    def __post_init__(self) -> None:
        self.grid = np.array([REST + a * STRONGER + b * LONGER for a, b in GRID], np.float32)
        self.index = Index()
        self.hash, self.used = Store(np.uint64), Store(np.int64)  # used: how often met, halved each time that rare ones go
        self.at, self.size, self.logits = Store(np.int64), Store(np.int64), Store(np.int8, 4)
        self.cost = Store(np.float32, len(GRID), 3)  # nats, and the gradient by both directions, at each grid point; nan: not yet worked out
        self.tokens, self.base, self.known, self.odd = Store(np.int64), Store(np.float64), Store(np.int64), Store(np.bool_)
        self.rare: dict[int, str] = {}  # words that aren't frequent, by lines

    def forget(self) -> None:
        """Only pieces met more than once stay, the commonest, with half of the decisions at most."""
        n = self.used.n
        order = np.argsort(-self.used.rows[:n], kind="stable")
        order = order[(np.cumsum(self.size.rows[order]) <= self.most // 2) & (self.used.rows[order] > 1)]
        stay = np.sort(order)
        size = self.size.rows[stay]
        logits = self.logits.rows.view(np.int32).ravel().take(expand(self.at.rows[stay], size)).view(np.int8).reshape(-1, 4)
        self.logits.n = 0
        self.logits.add(logits)
        for store in (self.hash, self.used, self.size, self.cost, self.tokens, self.base, self.known, self.odd):
            rows, store.n = store.rows[stay], 0
            store.add(rows)
        self.at.n = 0
        self.at.add(np.cumsum(size) - size)
        self.used.rows[: len(stay)] >>= 1
        self.rare = {i: self.rare[k] for i, k in enumerate(stay.tolist()) if k in self.rare}
        self.index = Index()
        self.index.add(self.hash.rows[: len(stay)])

    def ids(self, p: Pieces) -> np.ndarray:
        if self.logits.n > self.most:
            self.forget()
        ids, new = self.index.number_all(p)
        lower = p.room.tobytes().lower() if new.size else b""
        room = np.frombuffer(lower, np.uint8)
        begin, size = p.begin[new], p.size[new] - 1
        found = self.logs.find(room, begin, size, hashes(room, begin, size))
        for i in range(0, len(new), 2_000):
            self.add(p, new[i : i + 2_000], lower, found[i : i + 2_000])
        self.used.rows[: self.used.n] += np.bincount(ids, minlength=self.used.n)
        return ids

    def add(self, p: Pieces, new: np.ndarray, lower: bytes, found: np.ndarray) -> None:
        s = Symbols(p.room, p.begin[new], p.size[new], self.code, later=True)
        n = s.decisions
        sign = (s.bit * 2 - 1).astype(np.int8)
        logits = np.empty((len(sign), 4), np.int8)
        logits[:, 0] = self.tables.node.take(s.node) * sign
        for k, table in enumerate(self.tables.within):
            logits[:, k + 1] = table.take(s.slots(k, bits_of(table))) * sign
        self.hash.add(p.hash[new])
        self.used.add(np.zeros(len(new), np.int64))
        self.at.add(np.cumsum(n) - n + self.logits.n)
        self.size.add(n)
        self.logits.add(logits)
        self.cost.add(np.full((len(new), len(GRID), 3), np.nan, np.float32))
        begin, number = p.begin[new], self.tokens.n
        rare = np.isnan(found)
        base, tokens, odd = np.where(rare, 0.0, found), np.ones(len(new), np.int64), np.flatnonzero(rare)
        known = (base > 0).astype(np.int64)
        several = []  # pieces that other white space than a space parts, or that are empty
        for i, a, b in zip(odd.tolist(), begin[odd].tolist(), (begin[odd] + p.size[new[odd]] - 1).tolist(), strict=True):
            split = lower[a:b].split()
            if len(split) == 1 and len(split[0]) == b - a:
                self.rare[number + i] = split[0].decode()
            else:
                several.append((i, split))
        logs = iter(self.logs_of([w for _, split in several for w in split]))
        for i, split in several:
            got = [next(logs) for _ in split]
            unknown = [w for w, x in zip(split, got, strict=True) if math.isnan(x)]
            got = [x for x in got if not math.isnan(x)]
            tokens[i], base[i], known[i], rare[i] = len(split), sum(got), sum(1 for x in got if x), bool(unknown)
            if unknown:
                self.rare[number + i] = b"\n".join(unknown).decode()
        for store, x in ((self.tokens, tokens), (self.base, base), (self.known, known), (self.odd, rare)):
            store.add(x)

    def logs_of(self, words: list[bytes]) -> list[float]:
        room, size = np.frombuffer(b"".join(words), np.uint8), np.array([*map(len, words)], np.int64)
        begin = np.cumsum(size) - size
        return self.logs.find(room, begin, size, hashes(room, begin, size)).tolist()

    def costs(self, ids: np.ndarray, point: np.ndarray) -> np.ndarray:
        """(nats, gradients) of each piece at its grid point."""
        cells, each = self.cost.rows.reshape(-1, 3), ids * len(GRID) + point
        out = cells.take(each, axis=0)
        new = np.isnan(out[:, 0])
        if new.any():
            pairs = np.unique(each[new])
            for a in range(0, len(pairs), 4_000):
                self.work_out(pairs[a : a + 4_000] // len(GRID), pairs[a : a + 4_000] % len(GRID))
            out[new] = cells.take(each[new], axis=0)
        return out

    def work_out(self, ids: np.ndarray, point: np.ndarray) -> None:
        size = self.size.rows[ids]
        self.cost.rows[ids, point] = 0
        ids, point, size = (x[size > 0] for x in (ids, point, size))
        if ids.size:
            x = self.logits.rows.view(np.int32).ravel().take(expand(self.at.rows[ids], size)).view(np.int8).reshape(-1, 4)
            nats, pull = mix([x[:, k] for k in range(4)], size, self.grid[point])
            self.cost.rows[ids, point] = np.stack([nats, pull @ STRONGER, pull @ LONGER], axis=1)


def rounds(size: int) -> list[tuple[int, int]]:
    """Weights are refined after 1, 2, 4, 8 ... pieces, then after each 1,024."""
    out, a = [], 0
    while a < size:
        b = a + min(max(a, 1), 1024)
        out.append((a, b))
        a = b
    return out


def mix(x: list[np.ndarray], size: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats of each stretch's decisions, of which x has the predictors' logits of what happened, and how its weights pull."""
    begin = np.cumsum(size) - size
    x = [v.astype(np.float32) for v in x]
    right = x[0] * np.repeat(weights[:, 0] / 16, size)
    for k in range(1, len(x)):
        right += x[k] * np.repeat(weights[:, k] / 16, size)
    np.clip(right, -20, 20, out=right)
    np.negative(right, out=right)
    wrong = np.exp(right, out=right)
    nats = np.add.reduceat(np.log1p(wrong), begin, dtype=np.float64)
    wrong /= 1 + wrong
    return nats, np.stack([np.add.reduceat(wrong * v, begin) for v in x], axis=1) / 16


def score_pieces(memo: Memo, p: Pieces, ids: np.ndarray, rate: float) -> np.ndarray:
    """Nats of each text."""
    code, n = memo.code, len(p.many)
    head, place = np.tile(HEAD, (n, 1)), np.zeros((n, 2), np.float32)
    steps, tilts = sorted({a for a, _ in GRID}), sorted({b for _, b in GRID})
    nearest = lambda x, values: np.searchsorted((np.array(values[1:]) + np.array(values[:-1])) / 2, x)
    nats = np.zeros(n)
    first_cell = code.context[SPACE << 8 | SPACE] * 256
    for lo, hi in rounds(int(p.many.max(initial=0))):
        doc = np.flatnonzero(p.many > lo)
        take = np.minimum(p.many[doc], hi) - lo
        at, first = expand(p.first[doc] + lo, take), np.cumsum(take) - take
        cell = first_cell + p.room[p.begin[at]].astype(np.int64)
        size = code.length.take(cell).astype(np.int64)
        flat = code.flat.take(expand(code.start.take(cell), size))
        node, sign = flat >> 1, ((flat & 1) * 2 - 1).astype(np.int8)
        x = [memo.tables.node.take(node) * sign, memo.tables.across.take(np.repeat(p.line[at] * 256, size) + (node - first_cell // 256 * 255)) * sign]
        share = np.add.reduceat(size, first)
        cost, pull = mix(x, share, head[doc])
        head[doc] += np.float32(rate) * pull / np.sqrt(share)[:, None].astype(np.float32)
        point = nearest(place[doc, 0], steps) * len(tilts) + nearest(place[doc, 1], tilts)
        own = np.add.reduceat(memo.costs(ids[at], np.repeat(point, take)), first, axis=0, dtype=np.float64)
        nats[doc] += cost + own[:, 0]
        many = np.add.reduceat(memo.size.rows[ids[at]], first)
        place[doc] += (rate * own[:, 1:] / np.sqrt(np.maximum(many, 1))[:, None]).astype(np.float32)
        np.clip(place, [steps[0], tilts[0]], [steps[-1], tilts[-1]], out=place)
    return nats


def is_training(ids: list, modulus: int, held: int) -> list[bool]:
    return [zlib.crc32(str(x).encode()) % modulus != held for x in ids]


def strings(room: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(room[expand(begin, size)].tobytes()))


COUNTS = "predictor int, block int, part int, counts binary"
COUNTED = "piece string, last boolean, train long, total long, " + COUNTS


def count_pieces(docs: DataFrame, modulus: int, held: int, slice_bytes: int, kept: int = 400_000) -> DataFrame:
    """Rows of two kinds: (piece, last, train, total), partial counts of pieces in the training documents, and in all (last: it
    ended a text); and blocks of the training documents' first bytes by line of the piece before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bytes_, size, counts = Index(), Store(np.uint8), Store(np.int64), np.zeros((2, kept * 2), np.int64)
        firsts = np.zeros(LINES * 256, np.uint32)

        def emit() -> pa.RecordBatch:
            sizes, n = size.rows[: size.n], size.n
            begin = np.cumsum(sizes) - sizes
            last = bytes_.rows[begin + sizes - 1] == END
            out = pa.RecordBatch.from_arrays(
                [strings(bytes_.rows, begin, sizes - 1), pa.array(last), pa.array(counts[0, :n].copy()), pa.array(counts[:, :n].sum(axis=0)), *(pa.nulls(n, t) for t in KINDS)],
                names=["piece", "last", "train", "total", "predictor", "block", "part", "counts"],
            )
            bytes_.n = size.n = 0
            counts[:] = 0
            return out

        for batch in slices(batches, 1, slice_bytes):
            p = Pieces(*raw(batch.column(1)))
            own = np.repeat(np.array(is_training(batch.column(0).to_pylist(), modulus, held)), p.many)
            ids, new = index.number_all(p)
            bytes_.add(p.room[expand(p.begin[new], p.size[new])])
            size.add(p.size[new])
            if size.n > counts.shape[1]:
                counts = np.concatenate((counts, np.zeros((2, size.n), np.int64)), axis=1)
            for kind, mine in enumerate((own, ~own)):
                counts[kind, : size.n] += np.bincount(ids[mine], minlength=size.n)
            np.add.at(firsts, p.line[own] * 256 + p.room[p.begin[own]], np.uint32(1))
            if size.n > kept:
                yield emit()
                index = Index()
        if size.n:
            yield emit()
        for rows in blocks([(0, firsts)]):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.string(), pa.bool_(), pa.int64(), pa.int64())), *rows.columns], names=["piece", "last", "train", "total", *rows.schema.names])

    return docs.mapInArrow(run, COUNTED)


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(room, begin, size) of closed pieces from columns piece, last."""
    data, offsets = raw(batch.column(0))
    last = np.array(batch.column(1).to_pylist(), bool)
    size = np.diff(offsets) + 1
    ends = np.cumsum(size) - 1
    room = np.zeros(int(size.sum()), np.uint8)
    inside = np.ones(len(room), bool)
    inside[ends] = False
    room[inside] = data[int(offsets[0]) : int(offsets[-1])]
    room[ends] = np.where(last, END, SPACE)
    return room, ends + 1 - size, size


def learn_code(pieces: DataFrame, codes: int) -> Code:
    """Codes of the `codes` commonest contexts of two bytes, and of a piece's first byte, from the counts of all training pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, 0, 1 << 18):
            s = Symbols(*columns_of(batch))
            key = np.concatenate((held, s.two * 256 + s.byte))
            n = np.concatenate((many, np.repeat(batch.column(2).to_numpy(), s.size)))
            held, which = np.unique(key, return_inverse=True)
            many = np.bincount(which, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held >> 8), pa.array(held & 255), pa.array(many)], names=["two", "byte", "n"])

    after = keep(pieces.select("piece", "last", "train").mapInArrow(run, "two long, byte long, n long").groupBy("two", "byte").agg(F.sum("n").alias("n")), "bytes-after")
    common = after.groupBy("two").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "two").limit(codes)
    counts: dict[int, np.ndarray] = {SPACE << 8 | SPACE: np.zeros(256)}
    for r in after.join(F.broadcast(common), "two").select("two", "byte", "n").collect():  # at most codes * 256 rows
        counts.setdefault(r["two"], np.zeros(256))[r["byte"]] = r["n"]
    return build_code(counts)


def pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4" if counts.max() < 1 << 32 else "<u8").tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    raw_ = zlib.decompress(packed)
    return np.frombuffer(raw_, "<u4" if len(raw_) == 4 * BLOCK else "<u8").astype(np.int64)


KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.binary())


def batch_of(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(KINDS)], names=["predictor", "block", "part", "counts"])


def blocks(tables: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of (predictor, counts), the blocks that aren't empty."""
    part = TaskContext.get().partitionId() % 64
    for k, counts in tables:
        yield batch_of([(k, b, part, pack(x)) for b, x in enumerate(counts.reshape(-1, BLOCK)) if x.any()])


def summed(parts: DataFrame) -> DataFrame:
    """Sums each predictor's blocks over the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, block, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, block, part) == at:
                    total = total + unpack(packed)
                    continue
                if at is not None:
                    yield batch_of([(*at, pack(total))])
                at, total = (k, block, part), unpack(packed)
        if at is not None:
            yield batch_of([(*at, pack(total))])

    # In two steps, so that no task gets a row of every task.
    for part in (F.col("part"), F.lit(0)):
        parts = parts.withColumn("part", part).repartition("predictor", "block", "part").sortWithinPartitions("predictor", "block", "part").mapInArrow(add, COUNTS)
    return parts


def logits(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.clip(np.round(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype(np.int8)


def gathered(parts: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Logits in blocks of any form, one after another; sizes: entries. The tables' size is bounded, so they may come to the driver."""
    out = {k: np.zeros(n, np.int8) for k, n in sizes.items()}
    for r in parts.collect():
        own = np.frombuffer(r["counts"], np.int8)
        out[r["predictor"]][r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
    return out


def learn_within(pieces: DataFrame, code: Code, bits: int) -> Tables:
    """Tables of what happens within pieces, each distinct training piece weighed by its count."""
    sent = pieces.sparkSession.sparkContext.broadcast(code)
    sizes = {k: -(-n * 2 // BLOCK) * BLOCK for k, n in {0: code.nodes, 1: 1 << bits - 2, 2: 1 << bits - 1, 3: 1 << bits}.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = {k: np.zeros(n, np.uint32) for k, n in sizes.items()}, 0
        for batch in slices(batches, 0, 1 << 17):
            s = Symbols(*columns_of(batch), sent.value)
            weights = np.repeat(batch.column(2).to_numpy(), s.decisions)
            total += int(weights.sum())
            if total >= 1 << 32:  # so that no count overflows
                yield from blocks(list(counts.items()))
                total = int(weights.sum())
                counts = {k: np.zeros(n, np.uint32 if total < 1 << 32 else np.int64) for k, n in sizes.items()}
            weights = weights.astype(counts[0].dtype)
            np.add.at(counts[0], s.node * 2 + s.bit, weights)
            for k, b in enumerate((bits - 2, bits - 1, bits)):
                np.add.at(counts[k + 1], s.slots(k, b) * 2 + s.bit, weights)  # in place, for less memory
        yield from blocks(list(counts.items()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(k, b, part, logits(*unpack(packed).reshape(-1, 2).T).tobytes()) for k, b, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    few = max(1, pieces.rdd.getNumPartitions() // 4)  # a task's tables are as large for few pieces as for many
    got = gathered(summed(pieces.select("piece", "last", "train").coalesce(few).mapInArrow(run, COUNTS)).mapInArrow(weigh, COUNTS), {k: n // 2 for k, n in sizes.items()})
    return Tables(got[0], [got[1], got[2], got[3]])


def learn_across(firsts: DataFrame, code: Code) -> np.ndarray:
    """By line and node, from counts of first bytes by line: a node's zeros and ones are those of the bytes below it."""
    cell = int(code.context[SPACE << 8 | SPACE])
    below = np.zeros((256, 512), np.float64)
    for byte in range(256):
        at = int(code.start[cell * 256 + byte])
        below[byte, code.flat[at : at + int(code.length[cell * 256 + byte])] - cell * 510] = 1
    sent = firsts.sparkSession.sparkContext.broadcast(below)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, b, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = (unpack(packed).reshape(-1, 256) @ sent.value).reshape(-1, 256, 2)
                rows.append((k, b, part, logits(both[:, :, 0], both[:, :, 1]).tobytes()))
            yield batch_of(rows)

    return gathered(summed(firsts).mapInArrow(weigh, COUNTS), {0: LINES * 256})[0]


def least_count(rows: DataFrame, count: str, weight: Column, most: int) -> int | None:
    """The least count (to an eighth of a power of two) from which the rows' weights add up to at most `most`; None: there is none."""
    steps = rows.groupBy(F.least(F.floor(F.log2(count) * 8), F.lit(500)).cast("int").alias("step")).agg(F.sum(weight).alias("n"), F.min(count).alias("least")).orderBy(F.desc("step")).collect()
    n, least = 0, None
    for r in steps:  # at most 501
        n += r["n"]
        if n > most:
            break
        least = r["least"]
    return least


@dataclass
class Model:
    """words: training counts of the frequent ones. tokens, distinct: of the training documents, ends included; ends: how many they have."""

    words: dict[str, int]
    code: Code
    tables: Tables
    tokens: int
    distinct: int
    ends: int


def learn(rows: DataFrame, modulus: int, held: int, frequent: int, codes: int, most_bits: int, slice_bytes: int) -> tuple[Model, DataFrame]:
    """rows: id, text. The model, and (word, train, total) of all words."""
    counted = keep(count_pieces(rows, modulus, held, slice_bytes), "partial-counts")
    pieces = keep(counted.where("piece is not null").groupBy("piece", "last").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "piece-counts")
    each = pieces.select(F.explode(F.split(F.translate("piece", UPPER, LOWER), r"[\x20\x09-\x0D]+")).alias("word"), "train", "total").where("word != ''")
    counts = keep(each.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "word-counts")
    least = least_count(counts, "total", F.lit(1), frequent)
    common = counts.where((F.col("total") >= least) & (F.octet_length("word") <= 64)).select("word", "train").collect() if least else []
    sums = counts.agg(F.sum("train").alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    learnt = pieces.where("train > 0")
    sizes = learnt.agg(F.sum(F.octet_length("piece") + 1).alias("bytes"), F.sum(F.when(F.col("last"), F.col("train"))).alias("ends")).first()
    ends = int(sizes["ends"] or 0)
    code = learn_code(learnt, codes)
    bits = min(max(15, (int(sizes["bytes"] or 0) * 2).bit_length()), max(15, most_bits))  # each table has whole blocks
    tables = learn_within(learnt, code, bits)
    tables.across = learn_across(counted.where("counts is not null").select("predictor", "block", "part", "counts"), code)
    return Model({r["word"]: r["train"] for r in common}, code, tables, int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0), ends), counts


def score_texts(
    docs: DataFrame, modulus: int = 7, held: int = 2, frequent: int = 200_000, codes: int = 512, most_bits: int = 22, rate: float = 0.05, slice_bytes: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Documents whose crc32 of the id, as text, leaves `held` by `modulus` are held out; the others are learnt from. Tokens are
    runs of other than ASCII white space, A-Z lower-cased, and an end. base_score adds log10((c + 1) / (N + V + 1)), score is
    the log10 probability of the text's bytes and its end under the mixture. Null or empty texts are an end alone. A null id
    counts as the text 'None'. Repeated rows are learnt from, and scored, each time. An empty table gives no rows.

    At most `frequent` of the commonest words go to the tasks; the others' counts are joined. Tables have two slots for each
    byte of distinct training pieces, up to 2^most_bits, so that a task's memory is bounded. Each takes all pieces; beyond the
    bound contexts that meet in a slot share its counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    model, counts = learn(rows, modulus, held, frequent, codes, most_bits, slice_bytes)
    logs = Words({w.encode(): math.log10(n + 1) for w, n in model.words.items()})
    sent = rows.sparkSession.sparkContext.broadcast((logs, model.code, model.tables))
    end_log, end_known = math.log10(model.ends + 1), int(model.ends > 0)
    n, v = model.tokens, model.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, code, tables = sent.value
        memo = Memo(code, tables, logs)
        for batch in slices(batches, 1, slice_bytes // 2):  # for less memory
            p = Pieces(*raw(batch.column(1)))
            ids = memo.ids(p)
            nats = score_pieces(memo, p, ids, rate)
            tokens, base, known = (np.add.reduceat(x.rows[ids], p.first) for x in (memo.tokens, memo.base, memo.known))
            size = np.add.reduceat(p.size, p.first) - 1
            odd = memo.odd.rows[ids]
            rare: list[Counter] = [Counter() for _ in p.many]
            for d, i in zip(np.repeat(np.arange(len(p.many)), p.many)[odd].tolist(), ids[odd].tolist(), strict=True):
                rare[d].update(memo.rare[i].split("\n"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([not x for x in is_training(batch.column(0).to_pylist(), modulus, held)]), pa.array(tokens + 1), pa.array(size), pa.array(base + end_log), pa.array(known + end_known),
                    pa.array(nats), pa.array([[{"word": w, "m": m} for w, m in r.items()] for r in rare], pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))),
                ],
                names=["id", "held_out", "n_tokens", "n_bytes", "base", "known", "nats", "rare"],
            )

    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_bytes long, base double, known long, nats double, rare array<struct<word:string,m:long>>")
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m").join(counts.select("word", "train"), "word")
    more = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("train") + 1.0)).alias("more"), F.sum(F.when(F.col("train") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    joined = scored.drop("rare").join(more, "row", "left")
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), (-F.col("nats") / math.log(10)).alias("score"),
        "n_bytes", F.when(F.col("n_bytes") > 0, F.col("nats") / F.col("n_bytes") / math.log(2)).alias("bits_per_byte"),
    )

"""Suffix-array dedup of repeated byte strings by prefix doubling over sampled suffixes.

A full suffix array would sort a row per byte at each doubling, which is several times the allowed disk. So only suffixes at
content-defined anchors are ranked: of the k-byte strings in each window of `length` bytes, the one that hashes least. Equal
windows have the same anchor at the same place, so no match is lost.

Round 1 ranks anchors by their first k bytes; those that are unique leave. Round 2 pairs that rank with the rank of the whole
stretch that the anchor's windows span; later copies of a stretch are decided. Round 3 ranks the `length`-byte strings
themselves, only where an anchor's stretches differ. Each round's aggregation has map-side minima, so a string with millions
of copies costs a row per task.

Names that decide are 128-bit BLAKE2b digests, or are compared byte by byte where they meet. Names that only bring rows
together (starts, windows before their bytes are compared) are 64-bit polynomials, doubled from single bytes inside the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import raw, slices
from .shared import keep

MULTIPLIER = 0x9E3779B97F4A7C15  # odd; any would do


def byte_names() -> np.ndarray:
    """A random 64-bit name for each byte."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), np.uint64)


NAMES = byte_names()


def name_strings(data: np.ndarray, length: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Names of all strings of a length: known lengths are doubled, and joined by the bits of the length."""
    if length in known:
        return known[length]
    if length == 1:
        known[1] = NAMES[data]
        return known[1]
    half = 1 << ((length - 1).bit_length() - 1)
    left, right = name_strings(data, half, known), name_strings(data, length - half, known)
    n = max(len(data) - length + 1, 0)
    with np.errstate(over="ignore"):
        known[length] = left[:n] * np.uint64(pow(MULTIPLIER, length - half, 1 << 64)) + right[half : half + n]
    return known[length]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a name's bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Anchors:
    """Anchors of a slice of texts: position, first and last window that has it, names of its k bytes and of its stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, k: int):
        base = int(offsets[0])
        self.offsets = offsets - base
        data = data[base : int(offsets[-1])]
        known: dict[int, np.ndarray] = {}
        short = name_strings(data, k, known)
        self.windows = name_strings(data, length, known)
        n = len(self.windows)
        empty = np.zeros(0, np.int64)
        self.row = self.at = self.first = self.last = empty
        self.data, self.length = data, length
        self.kname = empty.astype(np.uint64)
        if not n:
            return
        # The least k-byte string of each window: its hash, then its place, in one number (a slice is far under 2^26 bytes
        # unless one text is longer, whose places then only tie-break modulo 2^26, in all copies' favour or none's).
        span = length - k + 1
        order = mix(short) & ~np.uint64((1 << 26) - 1) | np.arange(len(short), dtype=np.uint64) & np.uint64((1 << 26) - 1)
        least, width = order, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        least = least[:n]
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))[:n]
        inside = np.arange(n) + length <= ends
        change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))))
        first = change
        last = np.concatenate((change[1:], [n])) - 1
        # Windows of one text border on those of the next only through windows that cross the boundary, unless the text is short.
        good = inside[first]
        self.first, self.last = first[good], last[good]
        low = least[self.first] & np.uint64((1 << 26) - 1)
        self.at = self.first + ((low.astype(np.int64) - self.first) & ((1 << 26) - 1))
        self.row = np.searchsorted(self.offsets, self.first, "right") - 1
        self.kname = short[self.at]

    def stretches(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Names of the anchors' stretches and of their own places in them, as two numbers each; zeros where not chosen."""
        index = np.arange(len(self.row)) if chosen is None else np.flatnonzero(chosen)
        found = np.zeros((len(self.row), 2), np.uint64)
        whole, length = self.data.tobytes() if index.size else b"", self.length
        reach = zip(self.first[index].tolist(), self.last[index].tolist(), self.at[index].tolist(), strict=True)
        found[index] = pairs([digest(whole[f : l + length] + (p - f).to_bytes(4, "little")) for f, l, p in reach])
        return found


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def pairs(digests: list[bytes]) -> np.ndarray:
    """16 bytes each, as two numbers."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def binary(x: np.ndarray) -> pa.Array:
    """Pairs of numbers as 16 bytes each."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def once(row: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its row with these names; entries stand in the order of their places."""
    names = [c for x in names for c in (x.T if x.ndim == 2 else (x,))]
    order = np.lexsort((np.arange(len(row)), *names[::-1], row))
    new = np.ones(len(row), bool)
    same = row[order[1:]] == row[order[:-1]]
    for x in names:
        same &= x[order[1:]] == x[order[:-1]]
    new[order[1:]] = ~same
    return new


def same_strings(data: np.ndarray, at: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """A number for each place in `at`, equal where the strings of a length there are equal; name: equal where they are."""
    order = np.argsort(name, kind="stable")
    new = np.ones(len(name), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    group = np.empty(len(name), np.int64)
    group[order] = lead
    if not len(name) or new.all():
        return group
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    met = np.flatnonzero(~new)
    for part in (met[i : i + 20_000] for i in range(0, len(met), 20_000)):
        odd = part[(strings[at[order[part]]] != strings[at[order[lead[part]]]]).any(axis=1)]
        # One name of two strings: they are told apart by their bytes.
        for i in np.unique(lead[odd]).tolist():
            members = order[lead == i]
            known: dict[bytes, int] = {}
            for m in members.tolist():
                group[m] = known.setdefault(strings[at[m]].tobytes(), i if not known else len(name) + m)
    return group


def remove_repeats(
    docs: DataFrame, length: int = 100, k: int = 20, slice_bytes: int = 1 << 20, group_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: id_col, n_bytes, n_removed, n_spans, kept (bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier, in a document of a smaller id or before in
    the same one, judged on the input. Matches never cross documents. Null texts are empty; shorter texts stay whole. Null
    ids come after all others, and between themselves none is first. Rows with the same id and text count as one document;
    of different texts with one id, none is first. Other columns aren't read. An empty table gives no rows.

    In round 3 the stretches of one start meet in one task, unless they number over group_rows: then their windows are
    aggregated one by one, with map-side minima.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("id", F.xxhash64("text").alias("content"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, slice_bytes):
            a = Anchors(*raw(batch.column(2)), length, k)
            stretch = a.stretches()
            new = once(a.row, a.kname, stretch)
            index = pa.array(a.row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), signed(a.kname[new]), binary(stretch[new])], names=["id", "content", "kname", "stretch"])

    found = keyed.mapInArrow(scan, f"id {kind}, content long, kname long, stretch binary")
    # Round 1: unique starts leave.
    shared = found.groupBy("kname").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kname")
    alive = keep(found.join(shared, "kname", "left_semi"), "anchors", free=True)
    # Round 2: the first document of each stretch.
    stretches = keep(alive.groupBy("kname", "stretch").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "stretches", free=True)
    mixed = keep(stretches.groupBy("kname").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-starts", free=True)
    later = "(id > first or (id is null and first is not null))"
    told = keep(alive.join(stretches, ["kname", "stretch"]).select("id", "content", "kname", "stretch", F.expr(f"n > 1 and {later}").alias("late")), "told", free=True)
    decided = told.where("late").select("id", "content", "stretch", F.lit(None).cast("binary").alias("mask"))
    # Round 3: where stretches of one start differ, their windows, from the first document of each.
    open_ = told.where("not late").join(mixed, "kname").groupBy("id", "content").agg(F.collect_set(F.struct("stretch", (F.col("kinds") > group_rows).alias("large"))).alias("open"))
    open_ = open_.select("id", "content", F.transform("open", lambda x: x["stretch"]).alias("open"), F.transform("open", lambda x: x["large"].cast("byte")).alias("large"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, slice_bytes):
            data, offsets = raw(batch.column(2))
            a = Anchors(data, offsets, length, k)
            data = data[int(offsets[0]) : int(offsets[-1])].tobytes()
            row, name = flat(batch.column(3))
            stretch = a.stretches()
            own, listed = numbered(stretch, name)
            large = dict(zip(zip(row.tolist(), listed.tolist(), strict=True), [x for v in batch.column(4) if v.is_valid for x in v.as_py()], strict=True))
            chosen = np.flatnonzero(among(a.row, own, row, listed) & once(a.row, a.kname, stretch))
            index = pa.array(a.row[chosen])
            first, last = a.first[chosen], a.last[chosen]
            text = [data[f : l + length] for f, l in zip(first.tolist(), last.tolist(), strict=True)]
            big = [bool(large.get(x, 0)) for x in zip(a.row[chosen].tolist(), own[chosen].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), signed(a.kname[chosen]), binary(stretch[chosen]), pa.array((a.at[chosen] - first).astype(np.int16)), pa.array(text, pa.binary()), pa.array(big)],
                names=["id", "content", "kname", "stretch", "lead", "context", "large"],
            )

    o = open_.withColumnsRenamed({"id": "f_id", "content": "f_content"})
    meets = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("content") == F.col("f_content"))
    each = keyed.join(o, meets).select("id", "content", "text", "open", "large").mapInArrow(contexts, f"id {kind}, content long, kname long, stretch binary, lead short, context binary, large boolean")
    each = keep(each, "contexts", free=True)
    together = each.where("not large").drop("large").repartition("kname").sortWithinPartitions("kname")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Complete groups of one start, some thousand rows at a time."""
        held: list[pa.RecordBatch] = []

        def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if upto is not None:
                held.extend(table.slice(upto).to_batches())
                table = table.slice(0, upto)
            for batch in table.to_batches():
                yield late_windows(batch, length)

        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                held.append(part)
                if sum(b.num_rows for b in held) >= 4000:
                    names = np.concatenate([b.column(2).to_numpy() for b in held])
                    change = np.flatnonzero(names[1:] != names[:-1])
                    if change.size:
                        yield from flush(int(change[-1]) + 1)
        if held:
            yield from flush(None)

    masks = together.mapInArrow(compare, f"id {kind}, content long, stretch binary, mask binary")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                data, at, row, place, _ = context_windows(part, length)
                index, whole = pa.array(row), data.tobytes()
                name = pa.array([digest(whole[i : i + length]) for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), part.column(3).take(index), pa.array(place.astype(np.int32)), name], names=["id", "content", "stretch", "place", "name"])

    single = each.where("large").drop("large").mapInArrow(windows, f"id {kind}, content long, stretch binary, place int, name binary")
    repeated = single.groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = single.join(repeated, "name").where(later)
    bits = F.transform(F.sequence(F.lit(0), F.lit(length - k)), lambda i: F.array_contains("places", i).cast("string"))
    spelt = F.encode(F.array_join(F.transform(bits, lambda b: F.when(b == "true", "1").otherwise("0")), ""), "US-ASCII")
    singles = late.groupBy("id", "content", "stretch").agg(F.collect_set("place").alias("places")).select("id", "content", "stretch", spelt.alias("mask"))
    marks = decided.union(masks).union(singles).groupBy("id", "content").agg(F.collect_list(F.struct("stretch", "mask")).alias("marks"))
    marks = keep(marks.select("id", "content", F.transform("marks", lambda m: m["stretch"]).alias("stretches"), F.transform("marks", lambda m: m["mask"]).alias("masks")), "marks", free=True)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, slice_bytes):
            data, offsets = raw(batch.column(1))
            a = Anchors(data, offsets, length, k)
            data, at = data[int(offsets[0]) : int(offsets[-1])], a.offsets
            # A stretch goes where the document isn't its first, or has it before; else its windows that a mask names.
            row, name = flat(batch.column(2))
            # Only starts that a text has twice can hold stretches or windows that it has twice.
            order = np.lexsort((a.kname, a.row))
            same = (a.kname[order[1:]] == a.kname[order[:-1]]) & (a.row[order[1:]] == a.row[order[:-1]])
            twice = np.zeros(len(a.row), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            stretch = a.stretches(twice | np.isin(a.row, row))
            own, listed = numbered(stretch, name)
            masks = [m for x in batch.column(3) if x.is_valid for m in x.as_py()]
            full = np.array([m is None for m in masks], bool)
            whole = among(a.row, own, row[full], listed[full]) | ~once(a.row, a.kname, stretch)
            gone = spread(a.first[whole], a.last[whole], len(a.windows))
            partly = {(r, n): m for r, n, m in zip(row.tolist(), listed.tolist(), masks, strict=True) if m is not None}
            for i in np.flatnonzero(among(a.row, own, row[~full], listed[~full]) & ~whole).tolist():
                mask = np.frombuffer(partly[int(a.row[i]), int(own[i])], np.uint8) == 0x31
                f, l = int(a.first[i]), int(a.last[i]) + 1
                gone[f:l] |= mask[: l - f]
            text, named, place = open_windows(a, twice)
            gone[place[~once(text, same_strings(data, place, named, length))]] = True
            starts = np.flatnonzero(gone)
            removed = spread(starts, starts + length - 1, len(data)) if len(data) else np.zeros(0, bool)
            out = []
            for a0, a1 in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cut = removed[a0:a1]
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                out.append((a1 - a0, int(cut.sum()), spans, data[a0:a1][~cut].tobytes()))
            n, r, s, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    m = marks.withColumnsRenamed({"id": "f_id", "content": "f_content"})
    joined = keyed.join(m, meets, "left")
    return joined.select("id", "text", "stretches", "masks").mapInArrow(strip, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def context_windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each window begins in them, its row, its place in the row, its name) of all windows in contexts.

    Columns: id, content, kname, stretch, lead, context. A name is one of the window's bytes alone; two may share it.
    """
    text = batch.column(5)
    size = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1 + text.offset)[text.offset :]).astype(np.int64)
    data = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
    names = name_strings(data, length, {})
    begin = np.cumsum(size) - size
    many = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[row] + place
    return data, at, row, place, names[at]


def late_windows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """id, content, stretch, mask (a 0 or 1 for each window) of contexts with a window that a smaller id has, too."""
    data, at, row, _, name = context_windows(batch, length)
    name = same_strings(data, at, name, length)
    ids = batch.column(0)
    rank = np.full(len(ids), len(ids), np.int64)  # null ids come last
    valid = np.flatnonzero(np.asarray(ids.is_valid()))
    rank[valid] = np.unique(ids.take(pa.array(valid)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((rank[row], name))
    group = np.cumsum(np.concatenate(([True], name[order][1:] != name[order][:-1]))) - 1
    least = rank[row][order][np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))] if len(order) else np.zeros(0, np.int64)
    late = np.zeros(len(row), bool)
    late[order] = rank[row][order] > least[group]
    has = np.unique(row[late])
    begin = np.searchsorted(row, has)
    end = np.searchsorted(row, has, "right")
    flags = (late.astype(np.uint8) + 0x30).tobytes()
    mask = [flags[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    index = pa.array(has)
    return pa.RecordBatch.from_arrays([ids.take(index), batch.column(1).take(index), batch.column(3).take(index), pa.array(mask, pa.binary())], names=["id", "content", "stretch", "mask"])


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of a column of lists of 16 bytes each."""
    size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    return np.repeat(np.arange(len(size)), size), pairs([y for x in lists if x.is_valid for y in x.as_py()])


def numbered(*names: np.ndarray) -> list[np.ndarray]:
    """A number for each name of several lists, equal where names are."""
    both = np.concatenate(names)
    order = np.lexsort(both.T)
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(np.concatenate(([False], (both[order][1:] != both[order][:-1]).any(axis=1)))[: len(both)])
    return np.split(number, np.cumsum([len(x) for x in names])[:-1])


def among(row: np.ndarray, name: np.ndarray, in_row: np.ndarray, in_name: np.ndarray) -> np.ndarray:
    """Whether each (row, number of a name) stands among others."""
    many = max(int(x.max(initial=0)) for x in (name, in_name)) + 1
    return np.isin(row * many + name, in_row * many + in_name)


def spread(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """True from each first to its last."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last + 1, -1)
    return np.cumsum(change[:-1]) > 0


def open_windows(a: Anchors, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, place) of all windows of the chosen anchors."""
    size = (a.last - a.first + 1)[chosen]
    at = np.repeat(a.first[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(a.row[chosen], size), a.windows[at], at

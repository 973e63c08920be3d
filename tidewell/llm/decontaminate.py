"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of bounded size and builds a suffix array (numpy prefix doubling) over the words of
each. Only runs of words that the benchmark knows enter it, since no match can leave such a run. Every test suffix is then
binary-searched in every shard, which gives all places of its first words and the longest verbatim match. No shuffle: the
test suffixes, in blocks of checked size, go to the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, texts
from .shared import keep

#: Maps A-Z to a-z and all other ASCII characters but a-z and 0-9 to spaces.
WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split(b" ")


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s in the order of their suffixes, by the first `depth` entries at least (ties beyond in any order)."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and len(s) and rank.max() < len(s) - 1:
        key = (rank + 1) * (len(s) + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.zeros(len(s), np.int64)
        steps[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(steps)
        k *= 2
    return order


class TestSuffixes:
    """Word ids of the benchmark's items, and each suffix that a window starts."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        ids: dict[bytes, int] = {}
        self.item, self.start, self.width, self.names, seq = [], [], [], [], []
        shortest = window
        for name, text in items:
            own = [ids.setdefault(w, len(ids) + 1) for w in words((text or "").encode()) if w]
            if own:
                width = min(window, len(own))
                shortest = min(shortest, width)
                for i in range(len(own) - width + 1):
                    self.item.append(len(self.names))
                    self.start.append(len(seq) + i)
                    self.width.append(width)
                self.names.append(name)
                seq += [*own, -1]
        self.ids, self.shortest, self.window = ids, shortest, window
        self.seq = np.array([*seq, *[-1] * window], np.int64)
        self.item, self.start, self.width = (np.array(x, np.int64) for x in (self.item, self.start, self.width))

    def bound(self, s: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
        """For each test suffix: how many of s's suffixes are less than its window, or (upper) less or begin with it."""
        lo, hi = np.zeros(len(self.start), np.int64), np.full(len(self.start), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            at, q, width = order[mid], self.start[open_], self.width[open_]
            sign = np.zeros(len(open_), np.int8)  # of (suffix - window)
            for t in range(self.window):
                rest = np.flatnonzero((sign == 0) & (t < width))
                if not rest.size:
                    break
                sign[rest] = np.sign(s[at[rest] + t] - self.seq[q[rest] + t])
            right = (sign < 0) | ((sign == 0) & upper)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo


def search_shard(docs: list[bytes], tests: TestSuffixes) -> list[tuple[int, list[int], list[int], int, int, int]]:
    """For each document: words, flat disjoint hit spans (start, end, ...), items, longest match: words, item (-1: none), place."""
    get, runs, owner, base, sizes, at = tests.ids.get, [], [], [], [], 0
    for d, text in enumerate(docs):
        own = np.array([get(w, 0) for w in words(text) if w], np.int64)
        sizes.append(len(own))
        known = np.flatnonzero(np.diff(np.concatenate(([0], own > 0, [0]))))
        for a, b in known.reshape(-1, 2).tolist():
            if b - a >= tests.shortest:
                runs += [own[a:b], np.zeros(1, np.int64)]
                owner.append((d, at, b - a))
                base.append(a)
                at += b - a + 1
    out = [(n, [], [], 0, -1, -1) for n in sizes]
    if not runs or not len(tests.start):
        return out
    s = np.concatenate([*runs, np.zeros(tests.window, np.int64)])
    order = suffix_array(s[:at], tests.window)
    lo, hi = tests.bound(s, order, False), tests.bound(s, order, True)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    if not which.size:
        return out
    place = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    starts = np.array([x[1] for x in owner])
    run = np.searchsorted(starts, place, "right") - 1
    doc = np.array([x[0] for x in owner])[run]
    item, width = tests.item[which], tests.width[which]
    # Longest matches grow from those that can't be extended to the left.
    q = tests.start[which]
    first = np.flatnonzero((place == starts[run]) | (q == 0) | (tests.seq[q - 1] != s[place - 1]))
    length = width[first].copy()
    grow = np.arange(len(first))
    while grow.size:
        f = first[grow]
        grow = grow[s[place[f] + length[grow]] == tests.seq[q[f] + length[grow]]]
        length[grow] += 1
    cover = np.zeros(at + tests.window + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + width, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0])))).reshape(-1, 2)
    edge_run = np.searchsorted(starts, edges[:, 0], "right") - 1
    shift = np.array(base) - starts
    for (a, b), r in zip(edges.tolist(), edge_run.tolist(), strict=True):
        out[owner[r][0]][1].extend((a + int(shift[r]), b + int(shift[r])))
    for pair in np.unique(doc * len(tests.names) + item).tolist():
        out[pair // len(tests.names)][2].append(pair % len(tests.names))
    for j in np.lexsort((place[first], item[first], -length)).tolist():
        d = int(doc[first[j]])
        if out[d][3] < length[j]:
            out[d] = (*out[d][:3], int(length[j]), int(item[first[j]]), int(place[first[j]] + shift[run[first[j]]]))
    return out


def find_matches(docs: DataFrame, items: list[tuple[str, str | None]], window: int, shard_bytes: int, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """One row per document: extra columns, n_words, spans, items, longest, longest_item, longest_at."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(sent.value, window)
        for batch in slices(batches, len(extra), shard_bytes):
            found = search_shard(list(texts(batch.column(len(extra)))), tests)
            n, spans, own, longest, best, at = zip(*found, strict=True)
            name = lambda i: tests.names[i] if i >= 0 else None
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(extra)], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([[name(i) for i in x] for x in own], pa.list_(pa.string())),
                    pa.array(longest, pa.int64()), pa.array([name(i) for i in best], pa.string()), pa.array(at, pa.int64()),
                ],
                names=[*extra, "n_words", "spans", "items", "longest", "longest_item", "longest_at"],
            )

    rows = docs.select(*[F.col(c) for c in extra], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in extra)
    return rows.mapInArrow(run, f"{kept}, n_words long, spans array<long>, items array<string>, longest long, longest_item string, longest_at long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, items (sorted strings), spans (flat word offsets), longest, longest_item, longest_at.

    Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. A window is `window` consecutive words of an item;
    an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit. The
    longest match is the longest verbatim run (ties: the first item by name, then the first place); null where nothing matches.
    Null or empty texts have no words; null items ids are left out of `items` but their windows hit. Repeated rows come
    back repeated; items whose ids repeat count once. Empty tables give no rows, or no hits.

    The benchmark is sent to the tasks in blocks of at most block_bytes of text (one item may exceed it); beyond one block,
    each block is searched in a pass of its own and the passes' spans are merged by row.
    """
    sizes = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(sizes) * 2 // block_bytes)) if sizes > block_bytes else 1
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    if blocks == 1:
        found = find_matches(docs, [tuple(r) for r in cut.orderBy("item", "text").collect()], window, shard_bytes, id_col, text_col, [id_col])
    else:
        numbered = keep(docs.select(id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), "numbered")
        parts = []
        for i in range(blocks):
            block = [tuple(r) for r in cut.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()]
            parts.append(keep(find_matches(numbered, block, window, shard_bytes, id_col, text_col, ["__row", id_col]), "block-matches"))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        # As in one block: the longest, then the first item by name, then the first place.
        best = F.min(F.struct((-F.col("longest")).alias("shorter"), F.when(F.col("longest") > 0, F.col("longest_item")).alias("longest_item"), "longest_at")).alias("best")
        merged = whole.groupBy("__row").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"), best)
        pairs = lambda s: F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0)), F.lit(2)), lambda k: F.struct(s[k].alias("a"), s[k + 1].alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
        joined = F.aggregate(
            F.array_sort(F.flatten(F.transform("s", pairs))), F.array().cast("array<bigint>"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.try_element_at(acc, F.lit(-1)), x["b"])))).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
        )
        found = merged.select(id_col, "n_words", joined.alias("spans"), F.flatten("i").alias("items"), (-F.col("best.shorter")).alias("longest"), "best.longest_item", "best.longest_at")
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    some = lambda c: F.when(F.col("longest") > 0, F.col(c)).alias(c)
    return found.select(id_col, "n_words", hit.alias("n_hit"), items.alias("items"), "spans", some("longest"), some("longest_item"), some("longest_at"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without those of which a word is hit; an id with several rows goes if one of its rows is hit. Null ids with a hit go, too."""
    bad = contamination(docs, benchmark, window, id_col=id_col, text_col=text_col, item_col=item_col).where("n_hit > 0").select(F.col(id_col).alias("bad_id")).distinct()
    bad = keep(bad, "contaminated")
    rows = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # columns of any name
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")

"""SimHash for near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At 0.8 each bit of two texts' fingerprints agrees with a chance of about AGREE, so one of 64 bits is too coarse: here a
fingerprint has 256 bits. Shards are keyed by a few of them; so many choices of bits are tried that a pair at 0.8 misses all
shards with a chance of MISS at most. Each shard's BK-tree is searched within RADIUS, and each link found is confirmed on the
whole sets of shingles. A search gives only as many links as join a shard's clusters, so they number at most its rows. Where
one of those isn't confirmed, and its ends aren't joined by others, what the two ends' groups are part of is searched again: all
groups that such refused links join, whose texts stand there once each and not once for each choice of bits. Each pair that a
shard left open is within one of these. Up to ROUNDS such searches give links between texts that the confirmed ones haven't
joined; they also compare sketches of the sets, which rule out no pair of enough similarity. What is refused even then is searched
for all links that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts
from .graph import connected_components
from .shared import join_heavy, keep
from .simhash import search_shards

BITS, RADIUS, AGREE, MISS, ROUNDS = 256, 72, 0.82, 0.03, 3
MIXERS = [int(x) | 1 for x in np.random.default_rng(42).integers(0, 1 << 62, BITS // 64)]


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the runs of `width` words, as op5 reads words; fewer words, or none, are one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip((end - size).tolist(), end[width - 1 :].tolist(), strict=False)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """Bit i is set where over half of the shingles have it set, each spread to 256 bits; where just half have it, the sum of the hashes decides."""
    with np.errstate(over="ignore"):
        spread = np.stack([hashes * np.uint64(m) ^ (hashes >> np.uint64(29)) * np.uint64(m) for m in MIXERS], axis=1)
        spread = (spread ^ spread >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        spread ^= spread >> np.uint64(31)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(spread), 4096):
        counts += np.unpackbits(spread[a : a + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = (counts * 2 > len(hashes)) | ((counts * 2 == len(hashes)) & (np.arange(BITS) % 2 == 0))
    return np.packbits(over, bitorder="little").tobytes()


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, size, fp): node is a digest of the set of shingles, of so many members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in texts(batch.column(1))]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(x) for x in found], pa.int32()), pa.array([wide_fingerprint(x) for x in found], pa.binary())], names=["id", "node", "size", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, node long, size int, fp binary")


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the number of members by their low bits, in eight bits or more for each: two sketches differ in no more bits than the sets in members."""
    bits = max(512, 1 << (8 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """A row for each sketch, as it would be with `size` bytes."""
    out = np.zeros((len(sketches), size // 8), np.uint64)
    for row, x in zip(out, sketches, strict=True):
        row[:] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def may_be_similar(rows: list[tuple], i: np.ndarray, j: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches (last in each row) leave it open that i and j have enough similarity."""
    bytes_ = np.array([len(x[-1]) for x in rows])
    least = np.minimum(bytes_[i], bytes_[j])
    most = (size[i] + size[j]) * (1 - similarity) / (1 + similarity) + 1e-6
    out = np.zeros(len(i), bool)
    for n in np.unique(least).tolist():
        own = np.flatnonzero(least == n)
        named, which = np.unique(np.concatenate((i[own], j[own])), return_inverse=True)
        x = folded([rows[k][-1] for k in named.tolist()], n)
        for a in range(0, len(own), max(1, (1 << 24) // n)):
            part = slice(a, a + max(1, (1 << 24) // n))
            differ = np.bitwise_count(x[which[: len(own)][part]] ^ x[which[len(own) :][part]]).sum(axis=1, dtype=np.int64)
            out[own[part]] = differ <= most[own[part]]
    return out


def links_left(tree: list[tuple], rest: list[tuple], similarity: float, spanning: bool) -> list[tuple[int, int]]:
    """Links between different groups that fingerprints, sizes and sketches leave open and that weren't tried, numbered as spanning_links does.

    Rows: node, fp, group, size, tried (nodes, or none), sketch. spanning: only so many as join the groups that all join.
    """
    both = tree if rest is tree else [*tree, *rest]
    shift = len(both) - len(rest)
    fp = np.frombuffer(b"".join(x[1] for x in both), np.uint64).reshape(-1, BITS // 64)
    group, size = (np.array([x[c] for x in both], np.int64) for c in (2, 3))
    at = {x[0]: k for k, x in enumerate(rest)}
    known = {x[0]: k for k, x in enumerate(tree)}
    tried = [(k, at[b]) for k, x in enumerate(tree) for b in x[4] or () if b in at] + [(known[b], k) for k, x in enumerate(rest) for b in x[4] or () if b in known]
    tried = np.array(sorted(tried), np.int64).reshape(-1, 2)
    links = []
    for a in range(0, len(tree), 64):
        i = np.arange(a, min(a + 64, len(tree)))
        apart = np.zeros((len(i), len(rest)), np.int16)
        for w in range(fp.shape[1]):
            apart += np.bitwise_count(fp[i, None, w] ^ fp[None, shift:, w])
        small, large = np.minimum(size[i, None], size[None, shift:]), np.maximum(size[i, None], size[None, shift:])
        near = (apart <= RADIUS) & (group[i, None] != group[None, shift:]) & (small >= similarity * large - 1e-9)
        own = tried[np.searchsorted(tried[:, 0], a) : np.searchsorted(tried[:, 0], a + 64)]
        near[own[:, 0] - a, own[:, 1]] = False
        if rest is tree:
            near &= i[:, None] < np.arange(len(rest))
        x, y = np.nonzero(near)
        x, y = x + a, y + shift
        open_ = may_be_similar(both, x, y, size, similarity)
        x, y = x[open_], y[open_]
        if not spanning:
            links += zip(x.tolist(), y.tolist(), strict=True)
            continue
        while x.size:
            # Each group's first link to a smaller one joins it to that one.
            low, high = np.minimum(group[x], group[y]), np.maximum(group[x], group[y])
            joined, first = np.unique(high, return_index=True)
            links += zip(x[first].tolist(), y[first].tolist(), strict=True)
            to = low[first]
            while True:
                spot = np.minimum(np.searchsorted(joined, to), len(joined) - 1)
                further = np.where(joined[spot] == to, to[spot], to)
                if (further == to).all():
                    break
                to = further
            spot = np.minimum(np.searchsorted(joined, group), len(joined) - 1)
            group = np.where(joined[spot] == group, to[spot], group)
            open_ = group[x] != group[y]
            x, y = x[open_], y[open_]
    return links


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """docs: text. (node, members array<long>, sketch), one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in texts(batch.column(0))]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([sketch(x) for x in found], pa.binary())], names=["node", "members", "sketch"])

    return docs.mapInArrow(run, "node long, members array<long>, sketch binary").dropDuplicates(["node"])


def key_of(id_col: str):
    """One exact key without nulls."""
    return F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.lit("none"))


def choices(n: int) -> list[list[int]]:
    """Which bits key each of the shards' choices, for n rows: so many bits that shards have some sixteen rows where bits are even."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) - 4)
    many = math.ceil(math.log(MISS) / math.log(1 - AGREE**bits))
    random = np.random.default_rng(7)
    return [sorted(random.choice(BITS, bits, replace=False).tolist()) for _ in range(many)]


def deal(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp. (shard, node, fp) for each choice of bits."""
    picked = choices(nodes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(len(picked[0]), dtype=np.uint64)
        for batch in batches:
            for part in (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000)):
                on = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
                for i, bits in enumerate(picked):
                    shard = (on[:, bits] * weight).sum(axis=1, dtype=np.uint64) * np.uint64(len(picked)) + np.uint64(i)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), part.column(0), part.column(1)], names=["shard", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "shard long, node long, fp binary")


def near_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) for each row: component_id is the least id that links of similar texts reach.

    Texts of the same set are one node, so such copies cost one row each. Fewer words than `width` are one shingle; null
    texts are empty, and empty texts equal. Null ids are never a component's id unless all are null. Repeated rows come back
    repeated. Other columns aren't read. An empty table gives no rows.
    """
    rows = keep(signatures(docs, width, id_col, text_col), "signatures")
    nodes = keep(rows.groupBy("node").agg(F.min("id").alias("least_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("rows")), "near-nodes")
    members = keep(deal(nodes), "near-shards")
    found = keep(search_shards(members, RADIUS, shard_rows), "near-candidates")

    # Sets of the texts that some link names.
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select(key_of("least_id").alias("key")).distinct()
    text = docs.select(key_of(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted, "key", "left_semi").select("text")
    sets = keep(sets_of(text, width), "shingle-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of (a, b) those of enough similarity."""
        sized = nodes.select("node", "size")
        likely = pairs.join(sized.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").join(sized.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b")
        likely = likely.where(F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b") - 1e-9).select("a", "b")
        both = likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
        common = both.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("sum"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
        return common.where(F.col("common") >= F.lit(similarity) * (F.col("sum") - F.col("common")) - 1e-9).select("a", "b")

    # What later searches need of each text that has a link; one without has none within the radius in any shard.
    met = None
    links, tried = None, None
    for left in range(ROUNDS, -1, -1):
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = confirmed(found)
        links = keep(new if links is None else links.union(new), "near-links")
        roots = connected_components(links)
        # What else joins a refused link's ends leaves nothing to find between them.
        left_out = found.join(links, ["a", "b"], "left_anti").join(roots.select(F.col("node").alias("a"), F.col("root").alias("of_a")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("of_b")), "b", "left")
        left_out = left_out.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
        refused = keep(left_out.where("of_a != of_b"), "refused")
        if left == 0 or refused.isEmpty():
            break
        tried = refused.select("a", "b") if tried is None else tried.union(refused.select("a", "b"))
        if met is None:
            met = keep(nodes.select("node", "fp", "size").join(sets.select("node", "sketch"), "node"), "near-met")
        # A search's links span what is within the radius, so what it left open lies among the groups that refused links join.
        joined = connected_components(refused, "of_a", "of_b").select(F.col("node").alias("group"), F.col("root").alias("shard"))
        again = met.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root").join(joined, "group")
        again = again.join(tried.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tried")), "node", "left")
        # Written, as a search reads its rows twice.
        again = keep(again.select("shard", "node", "fp", "group", "size", "tried", "sketch"), "near-again")
        find = partial(links_left, similarity=similarity, spanning=left > 1)
        found = keep(search_shards(again, RADIUS, shard_rows, ("group", "size", "tried", "sketch"), find), "near-candidates")
    named = keep(nodes.join(roots, "node", "left").select("node", "least_id", "rows", F.coalesce("root", "node").alias("root")), "near-rooted")
    least = keep(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "near-least")
    named = keep(join_heavy(named.select("root", "node", "rows"), least, "root", "nodes").select("node", "component_id", "rows"), "near-named")
    return join_heavy(rows.select("id", "node"), named, "node", "rows").select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its least id (one of them, if rows repeat an id), with all columns under any name."""
    # One exact key without nulls deals the rows out once, for the join and for the last step.
    key = key_of(id_col)
    found = near_components(docs, width, similarity, id_col=id_col, text_col=text_col)
    kept = keep(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(key.alias("key")).distinct(), "kept-ids")
    full = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return full.join(kept.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")

"""SimHash near-dedup: fingerprints linked by BK-tree search.

Two fingerprints of 64 bits within `radius` bits agree on `agree` of `agree + radius` blocks, so they meet in at least one
shard keyed by the bits of such a choice of blocks. Each shard builds one BK-tree (children keyed by their integer Hamming
distance to the parent) and a search follows only the edges within the radius. Trees meet their queries by co-partitioning:
a broadcast of trees over all fingerprints would grow with the data. A shard over `shard_rows` is cut into several trees,
and each is searched for each block of the shard's rows, in tasks of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts
from .graph import connected_components
from .shared import join_heavy, keep


def fingerprint(text: bytes, width: int) -> int:
    """Bit i is set where over half of the shingles' XXH64 (seed 42) have it set. Words: runs of other than ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(line, 42)]
    else:
        hashes = [digest(line[a:b], 42) for a, b in zip((end - size).tolist(), end[width - 1 :].tolist(), strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) for each row; a text without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it. take() removes what it finds."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.numbers: list[int] = []
        self.children: list[dict[int, int]] = []
        self.open: set[int] = set()

    def add(self, value: int, number: int | None = None) -> None:
        """number: the value's name; by default how many were added before."""
        new = len(self.values)
        self.values.append(value)
        self.numbers.append(new if number is None else number)
        self.children.append({})
        self.open.add(self.numbers[-1])
        at = 0
        while new:
            down = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)
            if down == new:
                return
            at = down

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.numbers[at])
            children = self.children[at]
            if children:
                stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found

    def take(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius that no earlier call has returned. Once half of the tree is taken it is built anew of the rest."""
        if not self.open:
            return []
        found = [n for n in self.near(value, radius) if n in self.open]
        self.open.difference_update(found)
        if len(self.open) * 2 < len(self.values):
            rest = [(v, n) for v, n in zip(self.values, self.numbers, strict=True) if n in self.open]
            self.values, self.numbers, self.children = [], [], []
            for v, n in rest:
                self.add(v, n)
        return found


def grown(values: list[int]) -> BKTree:
    tree = BKTree()
    for v in values:
        tree.add(v)
    return tree


def spanning_links(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join just what all links between the two lists (and inside tree_values, if they are the same) join.

    Links are pairs of numbers, those of queries after those of tree_values (or the same). Each value is returned once: a
    search from it continues its component, so links number at most the values. With two lists, a query's own component is
    found by searching both trees in turn.
    """
    values = [tree_values] if queries is tree_values else [tree_values, queries]
    trees = [grown(v) for v in values]
    shift = [0, len(tree_values) if len(values) > 1 else 0]
    links = []
    for start, value in enumerate(queries):
        if start not in trees[-1].open:
            continue
        trees[-1].open.discard(start)
        frontier = [(len(trees) - 1, start, value)]
        while frontier:
            side, i, v = frontier.pop()
            other = side if len(trees) == 1 else 1 - side
            for j in trees[other].take(v, radius):
                links.append((i + shift[side], j + shift[other]))
                frontier.append((other, j, values[other][j]))
    return links


def shard_masks(n: int, radius: int) -> list[int]:
    """Masks of the choices of blocks that two fingerprints within the radius may agree on.

    A shard should have a few of n rows where bits are even, so more blocks must agree the more rows there are, and a row
    is placed comb(agree + radius, agree) times: 15 times for two blocks of 6, 35 for three of 7, 70 for four of 8.
    """
    for agree in range(2, 64 - radius):
        blocks = agree + radius
        if agree * 64 / blocks >= math.log2(max(n, 2)) - 3 or blocks >= 9:
            break
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(pick) for pick in itertools.combinations(parts, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search_shards(members: DataFrame, radius: int, shard_rows: int, more: tuple[str, ...] = (), find: Callable | None = None) -> DataFrame:
    """members: shard long, node long, fp binary. (shard, a, b): links of nodes that meet in a shard within the radius.

    Each shard builds a BK-tree and searches it for its own rows. One over shard_rows is cut into several trees, and each is
    searched for each part of the shard's rows, in tasks of their own. The links are so many as join what all of them join.
    find(tree, rest): another search, given rows (node, fp, *more); rest is the same list where a part meets itself. It
    returns links as spanning_links does.
    """
    large = members.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    # A shard of one tree has parts = 1; of more, each part meets each: pair (i, j), i <= j, has the tree of i and the rows of j.
    placed = members.join(keep(large, "large-shards"), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("mine", mine).select(
        "shard", "node", "fp", *more, "mine", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j")))).alias("pair")
    )
    dealt = placed.select("shard", (F.col("pair.i") * 1_000_000 + F.col("pair.j")).cast("long").alias("pair"), (F.col("mine") == F.col("pair.i")).alias("tree"), "node", "fp", *more)
    dealt = dealt.repartition("shard", "pair").sortWithinPartitions("shard", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def search() -> None:
            """held: (in the tree, node, fp, *more) of one pair of parts of a shard."""
            if len(held) < 2:
                return
            tree = [x[1:] for x in held if x[0]]
            rest = tree if at[1] % 1_000_001 == 0 else [x[1:] for x in held if not x[0]]  # i == j: the same part
            if find is None:
                values = [int.from_bytes(x[1], "little") for x in tree]
                links = spanning_links(values, values if rest is tree else [int.from_bytes(x[1], "little") for x in rest], radius)
            else:
                links = find(tree, rest)
            both = tree if rest is tree else [*tree, *rest]
            out.extend((at[0], both[i][0], both[j][0]) for i, j in links)

        def emit() -> pa.RecordBatch:
            ends = np.array(out, np.int64).reshape(-1, 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, c].copy()) for c in range(3)], names=["shard", "a", "b"])

        for batch in batches:
            shard, pair = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])) + 1
            # Most shards hold one row: only those of several, and the batch's first and last, are looked at.
            bounds = np.concatenate(([0], cuts, [len(shard)]))
            several = np.flatnonzero(np.diff(bounds) > 1)
            for k in np.unique(np.concatenate((several, [0, len(bounds) - 2]))).tolist() if len(shard) else ():
                a, b = int(bounds[k]), int(bounds[k + 1])
                key = (int(shard[a]), int(pair[a]))
                if key != at:
                    if at is not None:
                        search()
                    at, held = key, []
                part = batch.slice(a, b - a)
                held += zip(*(part.column(c).to_pylist() for c in range(2, part.num_columns)), strict=True)
            if len(out) > 100_000:
                yield emit()
        if at is not None:
            search()
        yield emit()

    return dealt.mapInArrow(run, "shard long, a long, b long")


def link_fingerprints(distinct: DataFrame, radius: int = 4, shard_rows: int = 2048) -> DataFrame:
    """(a, b) longs: links between distinct fingerprints that join just what all pairs within the radius join."""
    masks = shard_masks(distinct.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    members = distinct.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.explode(keys).alias("shard"))
    return search_shards(members, radius, shard_rows).select("a", "b")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, shard_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long, component_id) for each row: component_id is the least id that links of fingerprints reach.

    Fewer words than `width` are one shingle; no words, or a null text, give fingerprint zero, which links like any other.
    Equal fingerprints are one node, so exact copies cost one row each. Null ids are never a component's id unless all are
    null. Repeated rows come back repeated. Other columns aren't read. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("rows")), "fingerprint-nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius, shard_rows))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = keep(rooted, "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("fps")), "components-named")
    named = keep(join_heavy(rooted.select("root", "fp", "rows"), least, "root", "fps").select("fp", "component_id", "rows"), "named")
    return join_heavy(rows, named, "fp", "rows").select(id_col, "fp", "component_id")

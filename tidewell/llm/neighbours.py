"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector of d components is turned by a random matrix with orthonormal columns into more components (`bits_each` for each of
its own), of which the signs are kept, packed, with two scalars: its norm, and how well the signs stand for it. They give an
estimate of its inner product with any query, and a bound of the estimate's error that holds but with the chance of `sigmas`
standard deviations. Only vectors whose bound reaches the query's k-th best product so far are measured exactly.

Equal vectors are one node, so a vector with millions of rows is searched once. The query set meets all nodes in blocks: cells
of some thousand queries and vectors, each a task's small share; a cell returns its k + 1 best for each query.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_heavy, keep


@cache
def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """bits x d, columns orthonormal."""
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng((seed, d, bits)).standard_normal((bits, d)))[0])


def encode(vectors: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norm, agreement of the signs with the turned unit vector) of each row; rows are finite and not zero."""
    largest = np.abs(vectors).max(axis=1)
    scaled = vectors / largest[:, None]
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    turned = (scaled / norm[:, None]) @ rotation(vectors.shape[1], bits, seed).T
    return np.packbits(turned > 0, axis=1), norm * largest, np.abs(turned).sum(axis=1) / math.sqrt(bits)


def estimates(turned: np.ndarray, packed: np.ndarray, norm: np.ndarray, agreement: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) from codes, and each vector's standard error for a query of norm one. turned: rotated queries, float32."""
    signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
    found = turned @ signs.T
    found *= (norm / (agreement * math.sqrt(bits))).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - agreement**2, 0) / max(bits - 1, 1)) / agreement
    return found, norm * (spread + 1e-6)  # float32 takes its share, too


def products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of left and j of right, components in order, as a plain loop would add them."""
    found = np.zeros(len(i))
    for a, b in zip(left, right, strict=True):
        found += a[i] * b[j]
    return found


def search_cell(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, codes: tuple, k: int, bits: int, seed: int, sigmas: float, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) numbers of the k best vectors of each query by score, then by least; and how many were measured."""
    packed, norm, agreement = codes
    turned = (queries @ rotation(queries.shape[1], bits, seed).T).astype(np.float32)
    size = np.sqrt((queries * queries).sum(axis=1))
    left, right = np.ascontiguousarray(queries.T), np.ascontiguousarray(vectors.T)
    best_q, best_v, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bar, measured = np.full(len(queries), -np.inf), 0
    for start in range(0, len(vectors), block):
        part = slice(start, start + block)
        estimate, error = estimates(turned, packed[part], norm[part], agreement[part], bits)
        margin = (sigmas * size[:, None]).astype(np.float32) * error.astype(np.float32)
        if estimate.shape[1] >= k:
            low = np.partition(estimate - margin, estimate.shape[1] - k, axis=1)[:, estimate.shape[1] - k]
            bar = np.maximum(bar, low)
        estimate += margin
        q, v = np.nonzero(estimate >= bar[:, None].astype(np.float32))
        v += start
        measured += len(q)
        score = np.concatenate([products(left, right, q[a : a + 100_000], v[a : a + 100_000]) for a in range(0, len(q), 100_000)] or [best_s[:0]])
        q, v, score = np.concatenate((best_q, q)), np.concatenate((best_v, v)), np.concatenate((best_s, score))
        order = np.lexsort((least[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kth = rank == k - 1
        # What is measured is true, up to the rounding of float32 that the bars are compared in.
        bar[q[kth]] = np.maximum(bar[q[kth]], score[kth] - 1e-6 * np.abs(score[kth]))
        top = rank < k
        best_q, best_v, best_s = q[top], v[top], score[top]
    return best_q, best_v, best_s, measured


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_vectors(
    vectors: DataFrame, is_query: Column, k: int = 20, bits_each: int = 4, sigmas: float = 4.0, seed: int = 20_240_521, cell_queries: int = 1024, cell_vectors: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank from 1, id_col, score double): the k rows of the largest inner product for each row where is_query holds.

    A row doesn't find itself, but may find equal ones: of rows with the same id and vector, each is a row. Ties go to the
    smaller id, null ids last. Products are sums of doubles in the order of the components. Vectors meet those of their own
    length. Vectors that are null, empty, zero or hold a null or a component that isn't finite take no part, neither do null
    ids as queries where is_query is null for them. With fewer candidates all are returned; an empty table gives no rows.
    Other columns aren't read. Ids are integers.
    sigmas: a vector is overlooked only if its estimate errs by more standard deviations (4: three in 100,000).
    """
    spark = vectors.sparkSession
    double = F.transform(vectors[vector_col], lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), double.alias("vector"), is_query.alias("asks")).where(usable(F.col("vector")))
    grouped = rows.groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"), F.sum(F.coalesce("asks", F.lit(False)).cast("long")).alias("askers"))
    dims = grouped.withColumn("d", F.size("vector"))

    def code(batches):
        for batch in batches:
            # Rows of one length together.
            size = batch.column(4).to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                packed, norm, agreement = encode(matrix(part.column(0), d), bits_each * d, seed)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(norm), pa.array(agreement)],
                    names=["vector", "least", "rows", "asks", "d", "askers", "code", "norm", "agreement"],
                )

    coded = dims.select("vector", "least", "rows", "asks", "d", "askers").mapInArrow(code, "vector array<double>, least long, rows long, asks boolean, d int, askers long, code binary, norm double, agreement double")
    nodes = keep(coded.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    total = nodes.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("q")).first()
    # The grid of cells: each node goes to its column of cells once for each row of cells, each query to its row.
    high, wide = max(1, math.ceil(total["q"] / cell_queries)), max(1, math.ceil(total["v"] / cell_vectors))
    line, column = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(high)).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.lit(wide)).cast("int")
    asked = nodes.where("asks").select("d", line.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("column"), "node", "vector")
    sought = nodes.select("d", F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("line"), column.alias("column"), "node", "vector", "least", "code", "norm", "agreement")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            left, right = left.combine_chunks(), right.combine_chunks()
            packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            least = right.column("least").fill_null(np.iinfo(np.int64).max).to_numpy()
            codes = (packed, right.column("norm").to_numpy(), right.column("agreement").to_numpy())
            q, v, score, _ = search_cell(matrix(left.column("vector"), d), matrix(right.column("vector"), d), least, codes, k + 1, bits_each * d, seed, sigmas)
            found = (left.column("node").to_numpy()[q], right.column("node").to_numpy()[v], score, least[v])
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["asker", "node", "score", "least"])

    keys = ["d", "line", "column"]
    met = asked.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(cell, "asker long, node long, score double, least long")
    order = [F.col("score").desc(), F.col("least")]
    top = met.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy(*order))).where(F.col("place") <= k + 1)
    # The least k + 1 ids of each node; of one with many rows they are sought in parts first.
    many = keep(nodes.where("rows > 1").select("vector", "node", "rows"), "vectors-of-several")
    several = join_heavy(rows.select("vector", "id"), many, "vector", "rows").select("node", "id", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part"))
    for by in (["node", "part"], ["node"]):
        several = several.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("id").asc_nulls_last()))).where(F.col("place") <= k + 1).drop("place")
    ids = several.select("node", "id").unionByName(nodes.where("rows = 1").select("node", F.col("least").alias("id")))
    items = top.select("asker", "node", "score").join(ids, "node")
    ranked = items.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("place", "node", "id", "score"))).alias("items"))
    answers = keep(nodes.where("asks").select("vector", "node", F.col("askers").alias("rows")).join(lists.withColumnRenamed("asker", "node"), "node"), "answers")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "vector")
    own = F.expr("coalesce(get(filter(items, x -> x.node = node and x.id <=> query_id), 0).place, -1)")
    told = join_heavy(asking, answers, "vector", "rows").withColumn("own", own).withColumn("items", F.expr(f"slice(filter(items, x -> x.place != own), 1, {k})"))
    return told.select("query_id", F.posexplode("items").alias("at", "item")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("item.id").alias(id_col), F.col("item.score").alias("score"))


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

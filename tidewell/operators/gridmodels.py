"""Gaussian processes over all rows on top of a grid's posterior mean: one model a group (an hour), whatever its rows number.

A kernel on inducing points makes the model as small as their number: Spark sums the products of the rows' kernel values, so a
row is seen once and a group's size doesn't matter. With all rows as inducing points it is the full process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import matern32


def inducing_points(rows: DataFrame, features: list[str], most: int = 128) -> np.ndarray:
    """At most so many distinct feature vectors of all rows, those that hash least: a fixed choice that is spread as the rows are."""
    finite = F.lit(True)
    for f in features:
        finite = finite & F.col(f).isNotNull() & ~F.isnan(f)
    few = rows.where(finite).select(*[F.col(f).cast("double").alias(f) for f in features]).distinct().orderBy(F.xxhash64(*features), *features).limit(most)
    return np.array([list(r) for r in few.collect()], float).reshape(-1, len(features))


def kernel_sums(rows: DataFrame, by: str, features: list[str], residual: str, points: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(by, i, j, v) for i <= j: sums of k(x, z_i) k(x, z_j), and with j = -1 of k(x, z_i) residual. Rows without a residual are left out.

    Each task sums its own rows of a group first, so m (m + 3) / 2 rows of a task and group are shuffled, not one a row.
    """
    kind, m = dict(rows.dtypes)[by], len(points)
    known = rows.where(F.col(residual).isNotNull() & F.col(by).isNotNull()).select(by, *[F.col(f).cast("double") for f in features], F.col(residual).cast("double").alias("r"))
    upper = np.triu_indices(m)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, own in frame.groupby(by, dropna=False):
                k = matern32(own[features].to_numpy(float), points, scale)
                gram, side = sums.get(name, (0.0, 0.0))
                sums[name] = (gram + k.T @ k, side + k.T @ own["r"].to_numpy(float))
        for name, (gram, side) in sums.items():
            i, j = np.concatenate((upper[0], np.arange(m))), np.concatenate((upper[1], np.full(m, -1)))
            v = np.concatenate((gram[upper], side))
            yield pa.RecordBatch.from_pydict({by: pa.array([name] * len(v), batch.schema.field(by).type), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(v)})

    return known.mapInArrow(add, f"`{by}` {kind}, i int, j int, v double").groupBy(by, "i", "j").agg(F.sum("v").alias("v"))


def solve(gram: np.ndarray, side: np.ndarray, inner: np.ndarray, amplitude: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, spread): the mean at x is k(x)' weights, its variance amplitude less k(x)' spread k(x). inner: the points' own kernel."""
    m = len(inner)
    prior = amplitude * inner + 1e-9 * amplitude * np.eye(m)
    whole = noise * prior + amplitude**2 * gram
    inverse = np.linalg.inv(whole + 1e-12 * np.trace(whole) / m * np.eye(m))
    return amplitude * (inverse @ (amplitude * side)), amplitude**2 * (np.linalg.inv(prior) - noise * inverse)


def grid_process(
    rows: DataFrame, by: str, features: list[str], y: str, mean: str, scale: list[float], amplitude: float = 1.0, noise: float = 0.01, points: np.ndarray | None = None, most: int = 128, model_bytes: int = 64 << 20
) -> DataFrame:
    """rows with `mu` and `sd`: the prior mean plus what the readings of the row's group tell of its residual there, and the band.

    rows: by, features (not null), y (null where there's no reading), mean (the grid's, say posterior.moments joined in). scale:
    the kernel's length along each feature; amplitude and noise are variances. A group without readings keeps the prior mean
    and its full band; so does a null group. Models of a group take points squared; they go to the tasks in packs of
    model_bytes, each a pass over its groups' rows alone. An empty table gives no rows.
    """
    scale_, at = np.asarray(scale, float), inducing_points(rows, features, most) if points is None else points
    m, inner = len(at), matern32(at, at, scale_) if len(at) else np.zeros((0, 0))
    told = rows.withColumns({"__residual": F.col(y).cast("double") - F.col(mean).cast("double")})
    if not m:
        return rows.withColumns({"mu": F.col(mean).cast("double"), "sd": F.lit(float(np.sqrt(amplitude)))})
    sums = kernel_sums(told, by, features, "__residual", at, scale_)
    kind = dict(rows.dtypes)[by]

    def fit(frame):
        import pandas as pd

        gram, side = np.zeros((m, m)), np.zeros(m)
        i, j, v = (frame[c].to_numpy() for c in "ijv")
        gram[i[j >= 0], j[j >= 0]] = v[j >= 0]
        side[i[j < 0]] = v[j < 0]
        weights, spread = solve(np.triu(gram) + np.triu(gram, 1).T, side, inner, amplitude, noise)
        return pd.DataFrame({by: frame[by].iloc[:1], "weights": [weights.tobytes()], "spread": [spread.tobytes()]})

    from ..session import keep

    models = keep(sums.where(F.col(by).isNotNull()).groupBy(by).applyInPandas(fit, f"`{by}` {kind}, weights binary, spread binary"))
    names = [r[0] for r in models.select(by).orderBy(by).collect()]  # one a group (an hour, a season)
    pack = max(1, model_bytes // (8 * m * (m + 1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", mu double, sd double"
    out = rows.where(F.col(by).isNull() | ~F.col(by).isin(names)).withColumns({"mu": F.col(mean).cast("double"), "sd": F.lit(float(np.sqrt(amplitude)))}) if names else rows.withColumns({"mu": F.col(mean).cast("double"), "sd": F.lit(float(np.sqrt(amplitude)))})
    for start in range(0, len(names), pack):
        some = names[start : start + pack]
        known = {r[by]: (np.frombuffer(r["weights"]), np.frombuffer(r["spread"]).reshape(m, m)) for r in models.where(F.col(by).isin(some)).collect()}

        def predict(batches: Iterator[pa.RecordBatch], known: dict = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
                prior = batch.column(batch.schema.get_field_index(mean)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                group = np.array(batch.column(batch.schema.get_field_index(by)).to_pylist(), object)
                mu, sd = np.zeros(len(x)), np.zeros(len(x))
                for name in set(group.tolist()):
                    own = group == name
                    weights, spread = known[name]
                    k = matern32(x[own], at, scale_)
                    mu[own] = prior[own] + k @ weights
                    sd[own] = np.sqrt(np.maximum(amplitude - ((k @ spread) * k).sum(axis=1), 0.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mu), pa.array(sd)], names=[*batch.schema.names, "mu", "sd"])

        out = out.unionByName(rows.where(F.col(by).isin(some)).mapInArrow(predict, schema))
    return out


def daily_minimum(hourly: DataFrame, site: str, hour: str, z: float = 1.645) -> DataFrame:
    """(site, hour, mu, low, high): each site's hour of the least mean (ties: the earlier), with its band."""
    least = hourly.groupBy(site).agg(F.min(F.struct("mu", hour, "sd")).alias("b"))
    return least.select(site, F.col(f"b.{hour}").alias(hour), F.col("b.mu").alias("mu"), (F.col("b.mu") - z * F.col("b.sd")).alias("low"), (F.col("b.mu") + z * F.col("b.sd")).alias("high"))

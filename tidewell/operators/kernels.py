"""Numerical kernels per group, in applyInPandas, and what cuts larger inputs into groups that bounds hold for.

A kernel works on dense matrices, so it refuses a group of more than `most` rows instead of taking what would not fit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import components


def check_size(n: int, most: int, what: str) -> None:
    if n > most:
        raise ValueError(f"{what}: a group has {n} members, more than {most}; cut it into smaller groups first")


def classical_mds(distances: DataFrame, group: str, k: int = 2, most: int = 2000) -> DataFrame:
    """(group, node, c1 .. ck): coordinates whose distances fit. distances: group, a, b, d, both ways or one.

    Each axis's largest coordinate is positive, so that the result is one of the equivalent mirror images.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([frame["a"], frame["b"]]))
        check_size(len(nodes), most, "classical_mds")
        i, j = np.searchsorted(nodes, frame["a"]), np.searchsorted(nodes, frame["b"])
        d2 = np.zeros((len(nodes), len(nodes)))
        d2[i, j] = d2[j, i] = frame["d"].to_numpy() ** 2
        centre = np.eye(len(nodes)) - 1 / len(nodes)
        values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
        out = pd.DataFrame({group: frame[group].iloc[0], "node": nodes})
        for c in range(k):
            v = vectors[:, -1 - c] * np.sqrt(max(values[-1 - c], 0)) if c < len(nodes) else np.zeros(len(nodes))
            out[f"c{c + 1}"] = v * (np.sign(v[np.argmax(np.abs(v))]) or 1)
        return out

    types = dict(distances.dtypes)
    return distances.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, node {types['a']}, " + ", ".join(f"c{c + 1} double" for c in range(k)))


def landmark_mds(distances: DataFrame, group: str, k: int = 2, most: int = 500) -> DataFrame:
    """(group, node, c1 .. ck): coordinates of any number of nodes from their distances to at most `most` landmarks a group.

    distances: group, node, landmark, d; landmarks are nodes, too, with all distances between them. The landmarks are placed
    by classical scaling, in one task a group; every other node by its distances to them, as a join and sums.
    """
    types = dict(distances.dtypes)
    axes = [f"p{c + 1}" for c in range(k)]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(frame["landmark"])
        check_size(len(names), most, "landmark_mds")
        d2 = np.zeros((len(names), len(names)))
        d2[np.searchsorted(names, frame["node"]), np.searchsorted(names, frame["landmark"])] = frame["d"].to_numpy() ** 2
        centre = np.eye(len(names)) - 1 / len(names)
        values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
        out = pd.DataFrame({group: frame[group].iloc[0], "landmark": names, "mean2": d2.mean(axis=0)})
        for c, axis in enumerate(axes):
            value = values[-1 - c] if c < len(names) else 0.0
            v = vectors[:, -1 - c] if c < len(names) else np.zeros(len(names))
            out[axis] = v * (np.sign(v[np.argmax(np.abs(v))]) or 1) / np.sqrt(value) if value > 1e-9 * max(values[-1], 1e-300) else 0.0
        return out

    marks = distances.select(group, F.col("landmark").alias("node")).distinct()
    among = distances.join(marks, [group, "node"], "left_semi")
    placed = among.groupBy(group).applyInPandas(place, f"`{group}` {types[group]}, landmark {types['landmark']}, mean2 double, " + ", ".join(f"{a} double" for a in axes))
    pull = -0.5 * (F.col("d") * F.col("d") - F.col("mean2"))
    return distances.join(placed, [group, "landmark"]).groupBy(group, "node").agg(*[F.sum(pull * F.col(a)).alias(f"c{c + 1}") for c, a in enumerate(axes)])


def linkage_groups(points: DataFrame, group: str, tol: float) -> DataFrame:
    """points with `piece`: points of a group in different pieces are over tol apart, so no cluster has both. By cells of tol and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / tol)
    placed = points.withColumn("_cell", F.concat_ws(" ", F.col(group).cast("string"), cell("x"), cell("y")))
    cells = placed.groupBy("_cell").agg(F.first(group).alias("g"), F.first(cell("x")).alias("i"), F.first(cell("y")).alias("j"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = cells.withColumn("s", steps).select(F.col("_cell").alias("a"), F.concat_ws(" ", F.col("g").cast("string"), F.col("i") + F.col("s.a"), F.col("j") + F.col("s.b")).alias("b"))
    edges = near.join(cells.select(F.col("_cell").alias("b")), "b", "left_semi").select("a", "b")
    parts = components(cells.select(F.col("_cell").alias("node")), edges)
    return placed.join(parts.select(F.col("node").alias("_cell"), F.col("part").alias("piece")), "_cell").drop("_cell")


def near_pairs(xy: np.ndarray, tol: float) -> dict[tuple[int, int], float]:
    """Distances of the pairs (i, j), i < j, at most tol apart, by cells."""
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(np.floor(xy / (tol * 1.0001 or 1.0)).tolist()):
        cells.setdefault((x, y), []).append(i)
    found = {}
    for (x, y), own in cells.items():
        others = np.array(sum((cells.get(c, []) for c in ((x, y), (x, y + 1), (x + 1, y - 1), (x + 1, y), (x + 1, y + 1))), []))
        for i in own:
            d = np.sqrt(((xy[i] - xy[others]) ** 2).sum(-1))
            for k in np.flatnonzero(d <= tol).tolist():
                if others[k] != i:
                    found[min(i, int(others[k])), max(i, int(others[k]))] = float(d[k])
    return found


def merged(xy: np.ndarray, tol: float) -> np.ndarray:
    """Labels by complete linkage at tol, each the least place of its cluster. Only pairs that may still merge are held: two clusters of which some members are over tol apart never do."""
    pairs = near_pairs(xy, tol)
    beside: list[dict[int, float]] = [{} for _ in xy]
    for (i, j), d in pairs.items():
        beside[i][j] = beside[j][i] = d
    heap = [(d, i, j) for (i, j), d in pairs.items()]
    heapq.heapify(heap)
    into = list(range(len(xy)))
    while heap:
        d, a, b = heapq.heappop(heap)
        if into[a] != a or into[b] != b or beside[a].get(b) != d:
            continue
        into[b] = a
        both = {c: max(x, beside[b][c]) for c, x in beside[a].items() if c in beside[b]}
        for old in (a, b):
            for c in beside[old]:
                beside[c].pop(old, None)
        beside[a], beside[b] = both, {}
        for c, x in both.items():
            beside[c][a] = x
            heapq.heappush(heap, (x, min(a, c), max(a, c)))
    for i in range(len(into)):
        into[i] = into[into[i]]
    return np.array(into, int)


def complete_linkage(points: DataFrame, group: str, tol: float, most: int = 1_000_000) -> DataFrame:
    """(group, id, cluster): merges the nearest clusters while their farthest points are within tol; a cluster is named by its least id.

    A task holds the pairs of its group that are within tol, not a matrix of all.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        check_size(len(frame), most, "complete_linkage")
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy()
        return pd.DataFrame({group: frame[group], "id": ids, "cluster": ids[merged(frame[["x", "y"]].to_numpy(float), tol)]})

    types = dict(points.dtypes)
    return points.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, id {types['id']}, cluster {types['id']}")


def matern32(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    r = np.sqrt(3 * (((a[:, None] - b[None]) / scale) ** 2).sum(-1))
    return (1 + r) * np.exp(-r)


def gaussian_process(rows: DataFrame, group: str, features: list[str], y: str, noise: float = 0.1, ridge: float = 1e-3, most: int = 2000) -> DataFrame:
    """(group, id, mu, sd): a ridge line in the features plus a Matern-3/2 process on what it leaves.

    Rows with y train, all are predicted. Features are scaled by the training rows' sample deviation (0 counts as 1); the
    length scale is the best of a fixed ladder by marginal likelihood. A group without y gets nulls.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        check_size(len(frame), most, "gaussian_process")
        x, t = frame[features].to_numpy(float), frame[y].to_numpy(float)
        known = ~np.isnan(t)
        out = pd.DataFrame({group: frame[group], "id": frame["id"], "mu": np.nan, "sd": np.nan})
        if not known.any():
            return out
        mean, sd = x[known].mean(0), x[known].std(0, ddof=1) if known.sum() > 1 else np.zeros(x.shape[1])
        z = (x - mean) / np.where(np.nan_to_num(sd) > 0, sd, 1)
        design = np.column_stack([np.ones(len(z)), z])
        a = design[known]
        beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ t[known])
        left = t[known] - a @ beta
        size = max(left.var(), 1e-6)
        best = None
        for scale in (0.5, 1.0, 2.0, 4.0, 8.0):
            k = size * matern32(z[known], z[known], np.full(z.shape[1], scale)) + noise**2 * np.eye(known.sum())
            low = np.linalg.cholesky(k)
            w = np.linalg.solve(low, left)
            score = -0.5 * w @ w - np.log(np.diag(low)).sum()
            if best is None or score > best[0]:
                best = (score, scale, low, w)
        _, scale, low, w = best
        cross = np.linalg.solve(low, size * matern32(z[known], z, np.full(z.shape[1], scale)))
        out["mu"], out["sd"] = design @ beta + cross.T @ w, np.sqrt(np.maximum(size - (cross**2).sum(0), 1e-12))
        return out

    types = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, id {types['id']}, mu double, sd double")

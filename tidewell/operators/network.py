"""Graph operators over link tables (a, b, weight), as frontier joins until nothing changes.

Each round's new rows are written to the shared folder; what earlier rounds found is never written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import roughness_factor
from ..session import cut, keep


def undirected(links: DataFrame, a: str, b: str, weight: str, name: str) -> DataFrame:
    """(a, b, weight, link), a < b: parallel links give the lightest (ties: least name); loops go."""
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return links.where(F.col(a) != F.col(b)).groupBy(lo.alias("a"), hi.alias("b")).agg(F.min(weight).alias("weight"), F.min_by(name, F.struct(weight, name)).alias("link"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dist) of nodes that some source reaches. Only nodes that came nearer in a round are looked at in the next.

    edges: a, b, weight (directed). Raises ValueError where a weight is null, NaN or negative: a circle of those would never end.
    """
    if not edges.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0)).isEmpty():
        raise ValueError("a weight is null, not a number, or negative")
    found = [cut(sources.select(F.col("node"), F.lit(0.0).alias("dist")).distinct())]
    while True:
        offers = found[-1].join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        known = union_all(found).groupBy("node").agg(F.min("dist").alias("dist"))
        nearer = offers.join(known, "node", "left").where("dist is null or new < dist").select("node", F.col("new").alias("dist"))
        nearer = cut(nearer)
        if nearer.isEmpty():
            return union_all(found).groupBy("node").agg(F.min("dist").alias("dist"))
        found.append(nearer)


def predecessors(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(node, before, link): of each node with dist > 0 the link that its shortest path comes by (ties: least node before).

    edges: a, b, weight, link (directed); dist: node, dist.
    """
    from_ = dist.select(F.col("node").alias("a"), F.col("dist").alias("dist_a"))
    to = dist.select(F.col("node").alias("b"), F.col("dist").alias("dist_b"))
    on = edges.join(from_, "a").join(to, "b").where((F.col("dist_b") > 0) & (F.abs(F.col("dist_a") + F.col("weight") - F.col("dist_b")) <= 1e-9 * (1 + F.col("dist_b"))) & (F.col("dist_a") < F.col("dist_b")))
    return on.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "link")).alias("best")).select("node", F.col("best.a").alias("before"), F.col("best.link").alias("link"))


def path_aggregates(before: DataFrame, pipes: DataFrame) -> DataFrame:
    """Per node on a shortest path tree: what its path's pipes add up to. Halves the paths each round.

    before: node, before, link (predecessors()). pipes: link, length, diameter, roughness; other links add nothing. Paths
    without pipes, and nodes without a predecessor that some path names, get length 1, roughness 130 and diameter 0.3.
    """
    c = F.col
    own = before.join(pipes, "link", "left").select(
        "node", "before", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce(c("length") * c("roughness"), F.lit(0.0)).alias("rough"), F.coalesce(c("length") * c("diameter"), F.lit(0.0)).alias("wide"),
        c("roughness").alias("least_rough"), c("diameter").alias("least_wide"), F.coalesce(c("length") / c("diameter"), F.lit(0.0)).alias("slim"),
        F.coalesce(c("length") / c("diameter") * roughness_factor(c("roughness"), 1.0), F.lit(0.0)).alias("wall"),
    )
    sums, leasts = ["length", "rough", "wide", "slim", "wall"], ["least_rough", "least_wide"]
    roots = before.select(c("before").alias("node")).distinct().join(before.select("node"), "node", "left_anti")
    state = cut(own.unionByName(roots, allowMissingColumns=True).fillna(0.0, sums))
    while not state.where("before is not null").isEmpty():
        up = state.select(c("node").alias("up"), c("before").alias("up_before"), *[c(x).alias(f"up_{x}") for x in sums + leasts])
        joined = state.join(up, c("before") == c("up"), "left")
        state = cut(joined.select("node", c("up_before").alias("before"), *[(c(x) + F.coalesce(f"up_{x}", F.lit(0.0))).alias(x) for x in sums], *[F.least(x, f"up_{x}").alias(x) for x in leasts]))
    some = c("length") > 0
    return state.select(
        "node", F.when(some, c("length")).otherwise(1.0).alias("length"), F.when(some, c("rough") / c("length")).otherwise(130.0).alias("mean_roughness"), F.coalesce("least_rough", F.lit(130.0)).alias("least_roughness"),
        F.when(some, c("wide") / c("length")).otherwise(0.3).alias("mean_diameter"), F.coalesce("least_wide", F.lit(0.3)).alias("least_diameter"), c("slim").alias("length_over_diameter"), c("wall").alias("wall_index"),
    )


#: Fixed value: so many edges that a contraction left are joined in one task, which takes less than a round's jobs.
EDGES_AT_ONCE = 1 << 19


def roots_at_once(edges: DataFrame) -> DataFrame:
    """(node, root): a node of each part for every node of few edges (a, b), by one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames) if (frames := list(frames)) else pd.DataFrame({"a": [], "b": []})
        code, names = pd.factorize(pd.concat([rows["a"], rows["b"]]))
        a, b = code[: len(rows)], code[len(rows) :]
        root = np.arange(len(names))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        if len(names):
            yield pd.DataFrame({"node": names, "root": names[root]})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def components(nodes: DataFrame, edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, part): the least node of each connected part, by repeated contraction; edges shrink by about half or more each round.

    Each node takes the least of itself and its neighbours in a hashed order, so that long chains halve, too, and edges are
    redrawn between those. Rounds are written as tables: a checkpoint's plan would grow with each of them on the driver. Once
    at most `at_once` edges between whole numbers or texts are left, one task ends it.
    """
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    each = nodes.select("node").distinct()
    drawn = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = drawn.join(each.select(F.col("node").alias("a")), "a", "left_semi").join(each.select(F.col("node").alias("b")), "b", "left_semi")
    left, labels = keep(known.select("a", "b")), None
    few = at_once if left.schema["a"].dataType.simpleString() in ("bigint", "int", "string") else 0
    while n := left.count():
        if n <= few:
            step = roots_at_once(left)
            labels = step if labels is None else labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = keep(labels)
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        step = keep(least.select(F.col("a").alias("node"), F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("root")))
        to = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = step if labels is None else keep(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        moved = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
        left = keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return nodes.select("node", F.col("node").alias("part"))
    named = labels.join(labels.groupBy("root").agg(F.min("node").alias("part")), "root").select("node", "part")
    return keep(nodes.select("node").join(named, "node", "left").select("node", F.coalesce("part", "node").alias("part")))


def component_sizes(parts: DataFrame) -> DataFrame:
    """(part, size, place): parts by size, the largest first, then by name; one row a part is ordered."""
    from .ranks import ranked

    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")).withColumn("_down", -F.col("size"))
    return ranked(sizes, ["_down", "part"]).select("part", "size", F.col("rank").alias("place"))


def unfed_parts(parts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(part, junctions): parts with a junction and no source. kinds: node, kind ('junction', 'source', or others)."""
    k = parts.join(kinds, "node").groupBy("part").agg(F.count_if(F.col("kind") == "junction").alias("junctions"), F.max(F.col("kind") == "source").alias("fed"))
    return k.where("junctions > 0 and not fed").select("part", "junctions")


def incident(links: DataFrame, value: str) -> DataFrame:
    """(node, degree, mean, least) of the links at each node."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), value)
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.avg(value).alias("mean"), F.min(value).alias("least"))


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, hops) of nodes that sources reach along directed edges; each round looks at the newest nodes only."""
    found = [cut(sources.select("node").distinct().withColumn("hops", F.lit(0)))]
    while True:
        step = found[-1].join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(union_all(found).select("node"), "node", "left_anti")
        newest = cut(step.withColumn("hops", F.lit(len(found))))
        if newest.isEmpty():
            return union_all(found)
        found.append(newest)


def cut_off(nodes: DataFrame, edges: DataFrame, sources: DataFrame, left_out: DataFrame) -> DataFrame:
    """(node) that no source reaches once the links in left_out (link) are gone, though some does with them. edges: a, b, link, both ways."""
    rest = edges.join(left_out.select("link"), "link", "left_anti")
    lost = nodes.select("node").join(reachable(rest, sources).select("node"), "node", "left_anti")
    return lost.join(reachable(edges, sources).select("node"), "node", "left_semi")


def boundary(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges from a node of `inside` to one that isn't."""
    kept = inside.select("node")
    return edges.join(kept, edges["a"] == kept["node"], "left_semi").join(kept, edges["b"] == kept["node"], "left_anti")


def bridges(links: DataFrame) -> DataFrame:
    """(link, is_bridge): links whose closing parts their network. links: link, a, b; of parallel ones none is a bridge, nor a loop.

    A spanning forest grows in breadth; each link outside it gets a random number of 64 bits, which is folded by XOR up the
    tree, level by level. A tree link is a bridge if nothing passes it: what comes out is zero (a link with others around it
    is taken for one with a chance of 2^-64).
    """
    real = links.where("a != b").select("link", "a", "b")
    both = real.union(real.select("link", F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.select(F.col("a").alias("node")).distinct()
    roots = components(nodes, real.select("a", "b")).where("node = part").select("node")
    levels = [cut(roots.select("node", F.lit(None).cast(dict(real.dtypes)["a"]).alias("up"), F.lit(None).cast(dict(real.dtypes)["link"]).alias("by")))]
    while True:
        step = levels[-1].select(F.col("node").alias("a")).join(both, "a").join(union_all(levels).select(F.col("node").alias("b")), "b", "left_anti")
        newest = cut(step.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "link")).alias("best")).select("node", F.col("best.a").alias("up"), F.col("best.link").alias("by")))
        if newest.isEmpty():
            break
        levels.append(newest)
    tree = union_all(levels).select(F.col("by").alias("link")).where("link is not null")
    marked = real.join(tree, "link", "left_anti").withColumn("mark", F.xxhash64(F.lit("bridge"), "link"))
    own = cut(marked.select(F.explode(F.array("a", "b")).alias("node"), "mark").groupBy("node").agg(F.bit_xor("mark").alias("mark")))
    through, below = [], None
    for level in reversed(levels[1:]):
        sums = level.join(own, "node", "left").select("up", "by", "node", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))
        if below is not None:
            sums = sums.join(below, "node", "left").select("up", "by", F.col("mark").bitwiseXOR(F.coalesce("more", F.lit(0)).cast("long")).alias("mark"))
        sums = cut(sums.select("up", "by", "mark"))
        through.append(sums)
        below = sums.groupBy(F.col("up").alias("node")).agg(F.bit_xor("mark").alias("more"))
    free = (union_all(through).where("mark = 0") if through else own.where("false").select(F.lit(None).alias("by"))).select(F.col("by").alias("link"), F.lit(True).alias("_free"))
    return links.select("link").join(free, "link", "left").select("link", F.coalesce("_free", F.lit(False)).alias("is_bridge"))


def propagate_sizes(pipes: DataFrame) -> DataFrame:
    """(link, size): sizes of pipes without one, from the nearest sized pipe along nodes that join just two pipes (ties: the least sized pipe's name).

    pipes: link, a, b, size or null. Pipes that no sized one reaches so are left out.
    """
    ends = pipes.select("link", "size", F.explode(F.array("a", "b")).alias("node"))
    two = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("node")
    near = ends.join(two, "node")
    steps = cut(near.select("node", F.col("link").alias("x")).join(near.select("node", F.col("link").alias("y")), "node").where("x != y").select("x", "y").distinct())
    found = [cut(pipes.where("size is not null").select("link", "size", F.col("link").alias("by")))]
    while True:
        offers = found[-1].join(steps, F.col("link") == F.col("x")).groupBy(F.col("y").alias("link")).agg(F.min(F.struct("by", "size")).alias("best"))
        newest = cut(offers.join(union_all(found).select("link"), "link", "left_anti").select("link", F.col("best.size").alias("size"), F.col("best.by").alias("by")))
        if newest.isEmpty():
            break
        found.append(newest)
    return union_all(found[1:]).select("link", "size") if len(found) > 1 else found[0].where("false").select("link", "size")


def mean_direction(flows: DataFrame, by: list[str], flow: str = "flow", share: float = 0.8) -> DataFrame:
    """by, mean, mean_abs, direction: 1 or -1 where the mean is over `share` of the mean size, else 0."""
    m = flows.groupBy(*by).agg(F.avg(flow).alias("mean"), F.avg(F.abs(flow)).alias("mean_abs"))
    steady = (F.col("mean_abs") > 0) & (F.abs("mean") > share * F.col("mean_abs"))
    return m.withColumn("direction", F.when(steady, F.signum("mean")).otherwise(0).cast("int"))


#: Fixed value: flow in m3/s under which water stands.
STILL = 1e-7


def downstream_ends(flows: DataFrame, pipes: DataFrame, ages: DataFrame, junctions: DataFrame) -> DataFrame:
    """(link, junction, other, codes): each pipe's downstream end by its mean flow.

    flows: link, hour, flow. pipes: link, start, stop. ages: node, age. junctions: node. codes: no_flow (the end with the
    older water, of equal ages the first), reverses (the other end, too), end_not_junction (the other end). Where no end is a
    junction both are null.
    """
    c = F.col
    m = flows.groupBy("link").agg(F.avg("flow").alias("m"), F.max(F.abs("flow")).alias("most"), F.max(F.when(c("flow") > STILL, 1).otherwise(0)).alias("on"), F.max(F.when(c("flow") < -STILL, 1).otherwise(0)).alias("back"))
    side = lambda at: ages.select(c("node").alias(at), c("age").alias(f"{at}_age"))
    is_ = lambda at: junctions.select(c("node").alias(at), F.lit(True).alias(f"{at}_is")).distinct()
    p = pipes.join(m, "link").join(side("start"), "start", "left").join(side("stop"), "stop", "left").join(is_("start"), "start", "left").join(is_("stop"), "stop", "left")
    x, y = F.coalesce("start_age", F.lit(0.0)), F.coalesce("stop_age", F.lit(0.0))
    older_is_start = F.when(x != y, x > y).otherwise(c("start") < c("stop"))
    still, swings = c("most") <= STILL, F.abs("m") <= STILL
    turns = ~still & (swings | ((c("m") > 0) & (c("back") == 1)) | ((c("m") < 0) & (c("on") == 1)))
    down_is_start = F.when(still | swings, older_is_start).otherwise(c("m") < 0)
    p = p.withColumns({"down": F.when(down_is_start, c("start")).otherwise(c("stop")), "up": F.when(down_is_start, c("stop")).otherwise(c("start")),
                       "down_is": F.coalesce(F.when(down_is_start, c("start_is")).otherwise(c("stop_is")), F.lit(False)), "up_is": F.coalesce(F.when(down_is_start, c("stop_is")).otherwise(c("start_is")), F.lit(False))})
    first, second = F.when(c("down_is"), c("down")).when(c("up_is"), c("up")), F.when(c("down_is"), c("up")).when(c("up_is"), c("down"))
    second_is = F.when(c("down_is"), c("up_is")).otherwise(c("down_is"))
    codes = F.array_compact(F.array(F.when(still, "no_flow"), F.when(turns, "reverses"), F.when(~c("down_is") & c("up_is"), "end_not_junction")))
    return p.select("link", first.alias("junction"), F.when(turns & second_is, second).alias("other"), F.array_join(codes, ",").alias("codes"))


def warming_temperatures(pipes: DataFrame, ages: DataFrame, plant: float, soil: float, tau_h: float) -> DataFrame:
    """(link, temperature, mixed): water on its way from the plant's temperature to the soil's, by the age at each pipe's downstream node;
    mixed is the mean weighed by flow. pipes: link, start, stop, flow. ages: node, age (unknown or negative ones count as 0)."""
    down = F.when(F.col("flow") < 0, F.col("start")).otherwise(F.col("stop"))
    p = pipes.withColumn("node", down).join(ages, "node", "left").withColumn("_e", F.exp(-F.greatest(F.coalesce("age", F.lit(0.0)), F.lit(0.0)) / tau_h))
    mixed = p.agg(F.coalesce(F.sum(F.abs("flow") * F.col("_e")) / F.when(F.sum(F.abs("flow")) > 0, F.sum(F.abs("flow"))), F.lit(1.0)).alias("_mix"))
    return p.crossJoin(F.broadcast(mixed)).select("link", (soil + (plant - soil) * F.col("_e")).alias("temperature"), (soil + (plant - soil) * F.col("_mix")).alias("mixed"))

"""Minimum spanning forests by several strategies, all with the same result.

The order of edges is strict (weight, src, dst), so the forest is unique. Of any part of the edges those
that are heaviest on a cycle within the part are in no forest of the whole; so tasks reduce their part
on their own, and what remains is reduced again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Stored, store
from .components import connected_components, stars
from .graph import typed
from .order import pivot, ranked

EDGE = "src long, dst long, weight double"
#: Edges that one task reduces.
TASK_EDGES = 2_000_000
#: Edges that the strategy ``local`` takes.
ONE_TASK_EDGES = 5 * TASK_EDGES
ROUNDS = 40


def local_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The forest of edges in memory: each round, every component takes its first edge in the order, and the components that meet become one."""
    edges = edges[edges["src"] != edges["dst"]].sort_values(["weight", "src", "dst"], kind="stable", ignore_index=True)
    if edges.empty:
        return edges
    ids, ends = np.unique(edges[["src", "dst"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    u, v, rank = ends[:, 0], ends[:, 1], np.arange(len(edges))
    chosen = np.zeros(len(edges), dtype=bool)
    count = len(ids)
    while len(rank):
        best = np.full(count, -1, dtype=np.int64)
        # assigned from the last edge to the first, so the first one stays
        back = slice(None, None, -1)
        both, index = np.stack([u, v], axis=1)[back].ravel(), np.repeat(np.arange(len(rank)), 2)[back]
        best[both] = index
        touched = np.flatnonzero(best >= 0)
        edge = best[touched]
        chosen[rank[edge]] = True
        up = np.arange(count)
        up[touched] = np.where(u[edge] == touched, v[edge], u[edge])
        # in a strict order only pairs choose each other; the smaller of a pair becomes the root
        mutual = (up[up] == np.arange(count)) & (np.arange(count) < up)
        up[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(following := up[up], up):
            up = following
        roots, label = np.unique(up, return_inverse=True)
        u, v, count = label[u], label[v], len(roots)
        open_ = u != v
        u, v, rank = u[open_], v[open_], rank[open_]
    return edges[chosen]


def _reduce(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a task's edges; it is taken whenever as many edges are held as a task may reduce, and twice as many as were left."""
    held, size, most = [], 0, TASK_EDGES
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= most:
            held = [local_forest(pd.concat(held))]
            size = len(held[0])
            most = max(TASK_EDGES, 2 * size)
    if held:
        yield local_forest(pd.concat(held))


def _local(edges: DataFrame) -> DataFrame:
    return edges.repartition(1).mapInPandas(_reduce, EDGE)


def _one_task(edges: DataFrame) -> DataFrame:
    """For graphs that one task can hold."""
    held = store(edges, "edges")
    if (size := held.count()) > ONE_TASK_EDGES:
        raise ValueError(f"{size} edges are too many for one task; use two_level")
    return _local(held)


def _two_level(edges: DataFrame) -> DataFrame:
    now, size = edges, edges.count()
    while size > TASK_EDGES:
        parts = -(-size // TASK_EDGES)
        following = store(now.repartition(parts).mapInPandas(_reduce, EDGE), "forests")
        left = following.count()
        now = following
        if left > 0.7 * size:  # the forest itself is too large for one task
            return _rounds(now)
        size = left
    return _local(now)


def filtered_forest(edges: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """The forest of edges in memory, taken from light to heavy: halves by weight are split down to the threshold, and edges within the components found so far are dropped before their half is looked at."""
    edges = edges[edges["src"] != edges["dst"]].reset_index(drop=True)
    if edges.empty:
        return edges
    ids, ends = np.unique(edges[["src", "dst"]].to_numpy(), return_inverse=True)
    ends, weight = ends.reshape(-1, 2), edges["weight"].to_numpy()
    src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
    label, chosen, parts = np.arange(len(ids)), [], [np.arange(len(edges))]
    while parts:
        at = parts.pop()
        u, v = label[ends[at, 0]], label[ends[at, 1]]
        apart = u != v
        at, u, v = at[apart], u[apart], v[apart]
        if len(at) > threshold:
            light = weight[at] <= np.partition(weight[at], len(at) // 2)[len(at) // 2]
            if 0 < light.sum() < len(at):
                parts += [at[~light], at[light]]
                continue
        if len(at):
            # ranks stand for weights, so the order of the original ends is kept
            order = np.lexsort((dst[at], src[at], weight[at]))
            found = local_forest(pd.DataFrame({"src": u[order], "dst": v[order], "weight": np.arange(len(at))}))
            chosen.append(at[order[found["weight"]]])
            vertex, root = stars(found["src"].to_numpy(), found["dst"].to_numpy())
            moved = np.arange(len(ids))
            moved[vertex] = root
            label = moved[label]
    return edges.iloc[np.concatenate(chosen)]


def _filtered(edges: DataFrame, share: float = 0.1, threshold: int | None = None) -> DataFrame:
    """The forest of the light edges decides which heavy ones can still be in the whole one; both parts are split again, down to the threshold (by default what one task reduces). What one task reduces is split within that task."""
    threshold = TASK_EDGES if threshold is None else threshold
    held = Stored(edges, "edges")
    size = held.df.count()
    if size <= TASK_EDGES:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if parts := list(batches):
                yield filtered_forest(pd.concat(parts), threshold)

        return held.df.repartition(1).mapInPandas(run, EDGE)
    bound = pivot(held.df, "weight", share) if size > threshold else None
    light, heavy = held.df.filter(F.col("weight") <= bound), held.df.filter(F.col("weight") > bound)
    if bound is None or light.count() == size:  # few edges, or all of one weight
        return _two_level(held.df)
    first = Stored(_filtered(light, 0.5, threshold), "light-forest")
    # what is left joins components of the light forest, so all of the light forest stays
    labels = Stored(connected_components(first.df), "labels")
    own = lambda end: F.coalesce(f"{end}_label", end)
    a, b = (labels.df.select(F.col("vertex").alias(end), F.col("component").alias(f"{end}_label")) for end in ("src", "dst"))
    between = heavy.join(a, "src", "left").join(b, "dst", "left").select(own("src").alias("x"), own("dst").alias("y"), F.struct("weight", "src", "dst").alias("e")).filter("x <> y")
    contracted = Stored(between.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("e").alias("e")), "contracted")
    held.drop()
    labels.drop()
    # ranks stand for weights, so the order of the original ends is kept
    order = ranked(contracted.df.select("u", "v", "e", "e.weight", "e.src", "e.dst"), "weight", "src", "dst")
    rest = _filtered(order.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("pos").cast("double").alias("weight")), 0.5, threshold)
    taken = rest.join(order.select("pos", "e"), rest["weight"] == F.col("pos")).select("e.src", "e.dst", "e.weight")
    contracted.drop()
    return first.df.union(taken)


def across(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between different components; vertices without a label are components of their own."""
    a = labels.select(F.col("vertex").alias("src"), F.col("component").alias("a"))
    b = labels.select(F.col("vertex").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter(F.coalesce("a", "src") != F.coalesce("b", "dst")).select("src", "dst", "weight")


def _rounds(edges: DataFrame) -> DataFrame:
    """In DataFrame operations only: each round every component takes its first edge; for forests of any size."""
    now = store(edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.struct("weight", "src", "dst").alias("e")), "contracted")
    taken: DataFrame | None = None
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        sides = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = Stored(sides.groupBy("u").agg(F.min("e").alias("e"), F.min_by("v", "e").alias("v")), "firsts").df
        own = best.select("e").distinct()
        taken = own if taken is None else taken.union(own)
        labels = connected_components(best, "u", "v")
        a = labels.select(F.col("vertex").alias("u"), F.col("component").alias("a"))
        b = labels.select(F.col("vertex").alias("v"), F.col("component").alias("b"))
        now = store(now.join(a, "u").join(b, "v").filter("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e")), "contracted")
    else:
        raise RuntimeError(f"the forest did not settle in {ROUNDS} rounds")
    if taken is None:
        return edges.limit(0)
    return taken.select("e.src", "e.dst", "e.weight")


STRATEGIES = {"local": _one_task, "two_level": _two_level, "filter": _filtered, "rounds": _rounds}


def minimum_spanning_forest(edges: DataFrame, strategy: str = "two_level", **options: float) -> DataFrame:
    """The forest (src, dst, weight). ``two_level`` needs one task for small graphs, reduces in parts above TASK_EDGES, and goes on with ``rounds`` if the forest itself is larger; ``filter`` has the options share and threshold."""
    return STRATEGIES[strategy](typed(edges), **options)


def with_edge_ids(forest: DataFrame, edges: DataFrame, name: str = "edge_id") -> DataFrame:
    """The forest with the ids of its edges in the input; of equal parallel edges the smallest id."""
    ids = typed(edges, others=(name,)).groupBy("src", "dst", "weight").agg(F.min(name).alias(name))
    return forest.join(ids, ["src", "dst", "weight"])


def classified(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """With membership: 1 in the forest, 2 closing a cycle. Edges are those of a canonical table."""
    mark = forest.select("src", "dst", F.lit(1).alias("membership"))
    return edges.join(mark, ["src", "dst"], "left").withColumn("membership", F.coalesce("membership", F.lit(2)))


def forest_totals(forest: DataFrame) -> DataFrame:
    """Number and total weight of the edges; weights are summed as decimals."""
    return forest.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum(F.col("weight").cast("decimal(28,2)")).cast("double"), F.lit(0.0)).alias("total_weight"))

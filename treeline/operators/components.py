"""Connected components of an edge table, without bringing vertices or edges to one place."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Stored

ROUNDS = 60


def find(parent: dict[int, int], v: int) -> int:
    """The root of v, which appears when it is first asked for; paths are compressed."""
    root = v
    while (up := parent.setdefault(root, root)) != root:
        root = up
    while parent[v] != root:
        parent[v], v = root, parent[v]
    return root


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for all but the smallest ones."""
    parent: dict[int, int] = {}
    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    ends = [(x, r) for x in list(parent) if (r := find(parent, x)) != x]
    out = np.array(ends, dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _local_stars(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        u, v = stars(batch["u"].to_numpy(), batch["v"].to_numpy())
        yield pd.DataFrame({"u": u, "v": v})


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around the smallest vertices: every vertex has one link at most, to a smaller one that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), (F.col("u") <= F.col("v")).cast("int").alias("bad")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(0).alias("bad"))
    )
    # a vertex that is linked to, and links, has rows of both kinds
    found = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least"), F.max("bad").alias("bad"))
    return found.filter("bad = 1 OR n > 1 OR (n = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = ROUNDS, reduced: bool = False) -> DataFrame:
    """(vertex, component), the component being its smallest vertex, for every vertex of an edge that is not a loop.

    Every task first reduces its edges to stars, unless the edges are reduced already; then large-star and small-star rounds alternate until
    all edges are stars around the smallest vertices. Each round is a partial aggregation and a join on the vertex (of which
    Spark splits hubs that are skewed), and is written to the shared folder, so that a lost executor costs one round. Edges
    with a null end are dropped.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v")
    pairs = pairs if reduced else pairs.mapInPandas(_local_stars, "u long, v long")
    now = Stored(pairs.distinct(), "stars")
    for _ in range(rounds):
        if _settled(now.df):
            break
        following = Stored(_small_star(_large_star(now.df)), "stars")
        now.drop()
        now = following
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.df.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        now.df.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def roots(parents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vertex, root and hops to it, of pointers (vertex, parent) whose roots point to themselves: the pointers are doubled until nothing moves."""
    now = Stored(parents.select("vertex", F.col("parent").alias("root"), (F.col("vertex") != F.col("parent")).cast("long").alias("hops")), "pointers")
    for _ in range(rounds):
        up = now.df.select(F.col("vertex").alias("root"), F.col("root").alias("up"), F.col("hops").alias("more"))
        following = Stored(now.df.join(up, "root").select("vertex", F.col("up").alias("root"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("up") != F.col("root")).alias("moved")), "pointers")
        now.drop()
        now = following
        if now.df.filter("moved").isEmpty():
            ends = parents.filter("vertex = parent").select(F.col("vertex").alias("root"))
            if not now.df.join(ends, "root", "left_anti").isEmpty():
                break  # a circle
            return now.df.drop("moved")
    raise RuntimeError(f"pointers do not end at roots in {rounds} rounds")

"""Breadth-first search with the heaviest edge on the path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Stored, store
from .graph import both_directions


LEVELS = "vertex long, level long, parent long, path_max double"
#: Arcs that one task searches; larger graphs are searched level by level in DataFrame operations.
TASK_ARCS = 4_000_000


def local_search(arcs: pd.DataFrame, start: int, rounds: int | None = None) -> pd.DataFrame:
    """The search over arcs (src, dst, weight) in memory, a level at a time."""
    arcs = arcs.sort_values("src", kind="stable", ignore_index=True)
    ids, ends = np.unique(np.concatenate([[start], arcs["src"], arcs["dst"]]).astype(np.int64), return_inverse=True)
    origin, (u, v), weight = ends[0], np.split(ends[1:], 2), arcs["weight"].to_numpy()
    first = np.searchsorted(u, np.arange(len(ids) + 1))
    level, parent, path_max = np.full(len(ids), -1), np.full(len(ids), -1), np.full(len(ids), -np.inf)
    level[origin], frontier = 0, np.array([origin])
    for n in count(1):
        sizes = first[frontier + 1] - first[frontier]
        at = np.repeat(first[frontier] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        at = at[level[v[at]] < 0]
        if not len(at):
            break
        if n == rounds:
            raise RuntimeError(f"vertices are left after {rounds} levels")
        most = np.maximum(path_max[u[at]], weight[at])
        order = np.lexsort((most, u[at], v[at]))
        at, most = at[order], most[order]
        new = np.concatenate([[True], v[at][1:] != v[at][:-1]])
        frontier = v[at][new]
        level[frontier], parent[frontier], path_max[frontier] = n, u[at][new], most[new]
    met = np.flatnonzero(level >= 0)
    known = parent[met] >= 0
    return pd.DataFrame({
        "vertex": ids[met], "level": level[met], "parent": pd.array(np.where(known, ids[parent[met]], 0), dtype="Int64").copy(), "path_max": path_max[met],
    }).assign(parent=lambda d: d["parent"].where(known), path_max=lambda d: d["path_max"].where(known))


def breadth_first(edges: DataFrame, start: int, rounds: int | None = None) -> DataFrame:
    """vertex, level, parent and path_max (weight of the heaviest edge on the path) of all vertices within reach.

    One task searches a small graph. In a larger one each level joins the frontier with the edges and drops vertices that were met; of several parents the
    smallest is taken. Levels are written to the shared folder and read again as one table. The search goes on until
    a level is empty; with ``rounds`` given, it raises if vertices are left after so many levels.
    """
    spark = edges.sparkSession
    around = Stored(both_directions(edges), "arcs").df
    if around.count() <= TASK_ARCS:

        def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield local_search(pd.concat([pd.DataFrame({"src": [], "dst": [], "weight": []}), *batches]), start, rounds)

        return store(around.repartition(1).mapInPandas(search, LEVELS), "levels")
    levels = [Stored(spark.createDataFrame([(start, 0, None, None)], LEVELS), "level")]
    for level in count(1):
        frontier = levels[-1].df
        # only the last two levels can meet the next one again
        met = frontier.select("vertex") if len(levels) == 1 else frontier.select("vertex").union(levels[-2].df.select("vertex"))
        reached = (
            frontier.select(F.col("vertex").alias("src"), "path_max")
            .join(around, "src")
            .groupBy(F.col("dst").alias("vertex"))
            .agg(F.min(F.struct(F.col("src").alias("parent"), F.greatest(F.coalesce("path_max", "weight"), "weight").alias("path_max"))).alias("by"))
            .join(met, "vertex", "left_anti")
            .select("vertex", F.lit(level).cast("long").alias("level"), "by.parent", "by.path_max")
        )
        following = Stored(reached, "level")
        if following.df.isEmpty():
            break
        if level == rounds:
            raise RuntimeError(f"vertices are left after {rounds} levels")
        levels.append(following)
    return spark.read.schema(levels[0].df.schema).parquet(*(part.path for part in levels))

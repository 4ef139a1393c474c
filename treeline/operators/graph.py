"""Edge tables: canonical form, adjacency, profile.

An edge table has src, dst (long) and weight (double). All orders of edges are the strict one by
(weight, src, dst), so results do not depend on ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import ranked

ORDER = ("weight", "src", "dst")


def typed(edges: DataFrame, default_weight: float = 0.0, others: tuple[str, ...] = ()) -> DataFrame:
    """Long ends and double weights, and other columns as they are; a missing weight is the default. Edges without an end are dropped."""
    return edges.select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"),
        F.coalesce(F.col("weight").cast("double"), F.lit(default_weight)).alias("weight"), *others,
    ).filter("src IS NOT NULL AND dst IS NOT NULL")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected form: the smaller end first, no loops, of parallel edges the lightest."""
    return without_loops(typed(edges)).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))


def lightest_parallel(edges: DataFrame) -> DataFrame:
    """Of directed parallel edges the lightest."""
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def rebased(edges: DataFrame, by: int = -1) -> DataFrame:
    """Vertex ids shifted, from 1-based to 0-based by default."""
    return edges.withColumns({"src": F.col("src") + by, "dst": F.col("dst") + by})


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def with_id(edges: DataFrame) -> DataFrame:
    """With edge_id, the position in the strict order, from 0."""
    return ranked(edges, *ORDER, name="edge_id")


def vertices(edges: DataFrame) -> DataFrame:
    """Vertices that have an edge."""
    return edges.select(F.col("src").alias("vertex")).union(edges.select(F.col("dst").alias("vertex"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """vertex and its outgoing (dst, weight), by dst; the lists grow with the degree, so keep edges flat where you can."""
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def from_adjacency(lists: DataFrame, undirected: bool = False) -> DataFrame:
    """Edges of adjacency lists; of an undirected graph's, those with src < dst."""
    edges = lists.select(F.col("vertex").alias("src"), F.inline("neighbours"))
    return edges.filter("src < dst") if undirected else edges


def out_degrees(edges: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """vertex and degree; with a universe of vertices, also those of degree 0."""
    found = edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))
    if universe is None:
        return found
    return universe.select("vertex").join(found, "vertex", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def running_degree(degrees: DataFrame) -> DataFrame:
    """One row: the mean so far and each next degree, halved, in the order of vertices.

    A vertex counts half of the one behind it, so beyond the last 64 nothing is left in a double.
    """
    last = degrees.orderBy(F.desc("vertex")).limit(64)
    behind = F.row_number().over(Window.orderBy(F.desc("vertex")))
    return last.withColumn("n", behind).agg(F.round(F.sum(F.col("degree") * F.pow(F.lit(0.5), "n")), 6).alias("running_degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, loops, parallel edges, vertices with edges, largest and mean degree, largest weight."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("weight").alias("w"))
    sums = pairs.agg(
        F.sum("n").alias("n_edges"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("n_loops"),
        F.sum(F.col("n") - 1).alias("n_parallel"), F.max("w").alias("max_weight"),
    )
    degrees = out_degrees(edges, vertices(edges)).agg(F.count("*").alias("n_vertices"), F.max("degree").alias("max_degree"), F.round(F.sum("degree") / F.count("*"), 6).alias("mean_degree"))
    return sums.crossJoin(degrees)  # two tables of one row


def degree_histogram(edges: DataFrame, last: int = 9) -> DataFrame:
    """Vertices of each out-degree; the last bin is open."""
    return out_degrees(edges, vertices(edges)).groupBy(F.least("degree", F.lit(last)).cast("long").alias("degree_bin")).agg(F.count("*").alias("n_vertices"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side they are on."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)).withColumn("side", F.lit("left")).union(b.select(*columns).exceptAll(a).withColumn("side", F.lit("right")))

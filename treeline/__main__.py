"""Command line: python -m treeline COMMAND GRAPH ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, forest, graph, order, traversal
from .plans.shared import owned, store
from .sources import edges as files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="treeline", description="Weighted graphs around the minimum spanning forest.")
    commands = top.add_subparsers(dest="command", required=True)
    made = {
        "forest": "the minimum spanning forest: edges, weight and seconds of each run",
        "profile": "edges, loops, vertices, degrees and weights",
        "search": "breadth-first search over the forest, with the heaviest edge on each path",
        "convert": "writes the edges as text, dumps or Parquet, by the suffix of the target",
    }
    for name, text in made.items():
        command = commands.add_parser(name, help=text, description=text)
        command.add_argument("graph", help="text, .dump or .parquet")
        command.add_argument("--zero-based", action="store_true", help="vertices of a text count from 0")
        if name == "forest":
            command.add_argument("--strategy", choices=sorted(forest.STRATEGIES), default="two_level")
            command.add_argument("--iterations", type=int, default=1)
            command.add_argument("--print", action="store_true", help="the forest's edges")
            command.add_argument("--stats", type=int, metavar="POINTS", help="shares of forest and cycle edges over the order, and lengths of runs")
            command.add_argument("--oracle", action="store_true", help="replays without the cycle edges, and counts jumps")
        elif name == "search":
            command.add_argument("--start", type=int, default=0)
        elif name == "convert":
            command.add_argument("target")
    return top


def show(df: DataFrame, *by: str) -> None:
    """Prints rows as they come from the partitions, in order if columns are given."""
    for row in (df.orderBy(*by) if by else df).toLocalIterator():
        print(" ".join(f"{k}:{v}" for k, v in row.asDict().items()))


def read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    text = not args.graph.rstrip("/").endswith((".dump", ".parquet"))
    return files.read_edges(spark, args.graph, **({"one_based": not args.zero_based} if text else {}))


def run_forest(spark: SparkSession, args: argparse.Namespace) -> None:
    edges = store(graph.canonical(read(spark, args)), "edges")
    for n in range(args.iterations):
        began = time.perf_counter()
        found = store(forest.minimum_spanning_forest(edges, args.strategy), "forest")
        totals = forest.forest_totals(found).first()
        print(f"batch#{n} strategy:{args.strategy} msf_edges:{totals.n_edges} weight:{totals.total_weight} seconds:{time.perf_counter() - began:.3f}")
    if args.print:
        show(files.edge_report(order.ranked(found, *graph.ORDER)).select("value"))
    if args.stats or args.oracle:
        rows = store(forest.classified(order.ranked(edges, *graph.ORDER), found), "classified")
        if args.stats:
            show(analytics.percentile_progress(rows, args.stats), "point")
            show(analytics.gap_histogram(rows, powers=True), "gap")
        if args.oracle:
            show(analytics.replay_without_cycles(edges, rows))
            show(analytics.jump_summary(rows))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("treeline").getOrCreate()
    with owned(spark):
        if args.command == "forest":
            run_forest(spark, args)
        elif args.command == "profile":
            edges = store(read(spark, args), "edges")
            show(graph.graph_stats(edges))
            show(graph.degree_histogram(edges), "degree_bin")
        elif args.command == "search":
            found = forest.minimum_spanning_forest(graph.canonical(read(spark, args)))
            show(traversal.breadth_first(found, args.start).select("vertex", "level", "parent", F.col("path_max")), "level", "vertex")
        else:
            files.write_edges(read(spark, args), args.target)


if __name__ == "__main__":
    main()

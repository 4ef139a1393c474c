"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import analytics, forest, graph, order, traversal
from .operators.components import connected_components, roots
from .plans import graphs
from .plans.graphs import table
from .plans.shared import scratch
from .sources import edges as edge_files
from .sources import run_logs
from .streaming.incremental import latest_forest, maintain_forest

Query = Callable[[SparkSession, str], DataFrame]
Graph = Callable[[SparkSession, str], DataFrame]


def classified(make: Graph) -> Query:
    """pos, src, dst, weight and membership of every edge."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = order.ranked(make(spark, sf_dir), *graph.ORDER)
        return forest.classified(edges, forest.minimum_spanning_forest(edges))

    return run


trade, hops = classified(graphs.nation_trade), classified(graphs.user_hops)


def directed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed multigraph: a line item's part and supplier, both modulo 500, with parallel edges and loops."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("src"), (F.col("l_suppkey") % 500).alias("dst"), F.col("l_extendedprice").alias("weight"))


DIRECTED_SQL = "SELECT (l_partkey % 500)::BIGINT AS src, (l_suppkey % 500)::BIGINT AS dst, l_extendedprice AS weight FROM lineitem"


def edges_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_id(graphs.part_supplier(spark, sf_dir))


def adjacency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = graph.adjacency(graphs.nation_trade(spark, sf_dir))
    return lists.select("vertex", F.array_join(F.transform("neighbours", lambda n: n["dst"].cast("string")), ",").alias("neighbours"))


def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = graph.both_directions(graphs.nation_trade(spark, sf_dir))
    return graph.from_adjacency(graph.adjacency(both), undirected=True)


def light_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order.ranked(graphs.part_supplier(spark, sf_dir), *graph.ORDER)
    return edges.filter(F.col("pos") < edges.count() // 10).select("src", "dst", "weight")


def pivot_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.partitioned(graphs.part_supplier(spark, sf_dir), "weight", 20_000.0).groupBy("is_left").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most"))


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order.ranked(graphs.user_hops(spark, sf_dir), *graph.ORDER)
    return edges.groupBy(order.chunk(F.col("pos"), edges.count(), 7).alias("chunk")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.user_hops(spark, sf_dir)
    runs = [edges.filter(F.col("src") % 3 == n).sortWithinPartitions(*graph.ORDER) for n in range(3)]
    return order.merged(runs, *graph.ORDER)


def components_of(make: Graph) -> Query:
    return lambda spark, d: connected_components(make(spark, d))


def msf_of(make: Graph, strategy: str = "two_level") -> Query:
    return lambda spark, d: forest.minimum_spanning_forest(make(spark, d), strategy)


def msf_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order.store(graphs.nation_trade(spark, sf_dir), "trade")
    parts = [forest.forest_totals(forest.minimum_spanning_forest(edges, s)).withColumn("strategy", F.lit(s)) for s in forest.STRATEGIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def heavy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy edges that are left once the forest of the lightest thirtieth has been taken."""
    edges = order.ranked(graphs.user_hops(spark, sf_dir), *graph.ORDER)
    light = edges.count() // 30
    found = forest.minimum_spanning_forest(edges.filter(F.col("pos") < light))
    return forest.across(edges.filter(F.col("pos") >= light).select("src", "dst", "weight"), connected_components(found))


def percentile_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.percentile_progress(hops(spark, sf_dir), 100)


def prefix_detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.store(hops(spark, sf_dir), "classified")
    return analytics.prefix_detectability(rows, rows.filter("membership = 1"), 100)


def closing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.store(trade(spark, sf_dir), "classified")
    return analytics.closing_time(rows, rows.filter("membership = 1"))


def over_hops(ask: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: ask(order.store(hops(spark, d), "classified"))


def oracle_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.store(hops(spark, sf_dir), "classified")
    return analytics.replay_without_cycles(rows.select("src", "dst", "weight"), rows)


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From vertex 1 over the forest, where paths are unique."""
    return traversal.breadth_first(forest.minimum_spanning_forest(graphs.user_hops(spark, sf_dir)), 1)


def parse_edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("c a comment")).when(
        F.col("o_orderkey") % 5 == 0, F.format_string("%d %d", F.col("o_custkey"), F.col("o_orderkey"))
    ).otherwise(F.format_string("a %d %d %d", F.col("o_custkey"), F.col("o_orderkey"), F.floor("o_totalprice")))
    return edge_files.parse_edge_lines(table(spark, sf_dir, "orders").select(text.alias("value")))


def parse_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("run nthreads:%d seconds:%s batch#%d cycles_main:%d cycles_helper:%d cycles_ht#0:%d cycles_ht#1:%d cycles_skipped:0",
                           F.col("o_custkey") % 8 + 1, F.format_string("%d.5", F.col("o_orderkey") % 100), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") * 3, F.col("o_custkey"), F.col("o_custkey") * 2)
    runs = run_logs.parse_runs(table(spark, sf_dir, "orders").select(line.alias("value")))
    return runs.select("nthreads", "seconds", "batch", "cycles_main", "cycles_helper", "cycles_skipped", F.aggregate("cycles_by_helper", F.lit(0).cast("long"), lambda a, n: a + n).alias("helper_total"))


def parse_cpu_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    text = F.format_string("%d-%d,%d %d", F.col("n_nationkey"), F.col("n_nationkey") + 3, F.col("n_nationkey") + 10, F.col("n_nationkey") + 11)
    return nations.select(F.col("n_nationkey").cast("long").alias("nation"), F.explode(scalars.number_list(text)).alias("cpu"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("n"))
    return rows.select(
        "n", scalars.next_power_of_two(F.col("n")).alias("power"), scalars.digits(F.col("n")).cast("long").alias("digits"),
        scalars.percent_cells(F.col("n") % 100 / 100.0).alias("cells"), scalars.without(F.col("n").cast("string"), "1").alias("no_ones"), F.bit_count("n").cast("long").alias("bits"),
        scalars.pairs_total(F.concat_ws(" ", F.concat(F.lit("0:"), "n"), F.concat(F.lit("1:"), "n"))).alias("twice"),
    )


def progress_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle edges so far at each of 50 points, those of the first half of the order and of the second."""
    rows = order.store(hops(spark, sf_dir), "classified")
    n = rows.count()
    cycle, first = F.col("membership") == 2, F.col("pos") < n // 2
    per = rows.groupBy(order.chunk(F.col("pos"), n, 50).alias("point")).agg(F.count_if(cycle & first).alias("a"), F.count_if(cycle & ~first).alias("b"))
    up_to = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("point", F.sum("a").over(up_to).alias("cycles_first"), F.sum("b").over(up_to).alias("cycles_second"))


def streaming_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest kept over a stream that brings the edges in several batches."""
    path = scratch(spark, "stream")
    graphs.nation_trade(spark, sf_dir).repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(forest.EDGE).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    maintain_forest(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return latest_forest(spark, f"{path}/out")


def msf_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order.store(graph.with_id(graphs.user_hops(spark, sf_dir)), "edges")
    return forest.with_edge_ids(forest.minimum_spanning_forest(edges), edges)


def mirrored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with ends modulo 2 and 3, so that many mirror the line before or are loops, over borders of blocks too."""
    lines = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("line"), (F.col("o_custkey") % 2).cast("long").alias("src"), (F.floor("o_totalprice") % 3).cast("long").alias("dst")
    )
    return edge_files.collapse_mirrored(lines, block=700)


def position_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked weights of edges from even vertices against those from odd ones."""
    edges = graphs.user_hops(spark, sf_dir)
    return order.differences(edges.filter("src % 2 = 0"), edges.filter("src % 2 = 1"), "weight")


def kth_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order.store(graphs.part_supplier(spark, sf_dir), "edges")
    return order.kth(edges, edges.count() // 3, *graph.ORDER)


def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of ends, the edges that are lighter than the one before."""
    return order.unsorted(order.ranked(graphs.part_supplier(spark, sf_dir), "src", "dst"), "pos", "weight", "src", "dst", block=4000)


def find_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers from each vertex to the smallest one around it."""
    both = graph.both_directions(graphs.part_supplier(spark, sf_dir))
    return roots(both.groupBy(F.col("src").alias("vertex")).agg(F.least(F.min("dst"), F.first("src")).alias("parent")))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light edges against those of even vertices."""
    edges = graphs.nation_trade(spark, sf_dir)
    return graph.difference(edges.filter("weight < 2000"), edges.filter("src % 2 = 0"))


QUERIES: dict[str, Query] = {
    "edges_canonical": graphs.nation_trade,
    "edges_part_supplier": graphs.part_supplier,
    "edges_user_hops": graphs.user_hops,
    "edges_order_forest": graphs.order_forest,
    "edges_reversed_union": lambda s, d: graph.both_directions(graphs.nation_trade(s, d)),
    "edges_lightest_parallel": lambda s, d: graph.lightest_parallel(directed_lines(s, d)),
    "edges_rebased": lambda s, d: graph.rebased(graph.without_loops(graph.typed(directed_lines(s, d)))).groupBy("src", "dst").agg(F.count("*").alias("n")),
    "edges_with_id": edges_with_id,
    "adjacency_list": adjacency_list,
    "adjacency_edges": adjacency_edges,
    "graph_stats": lambda s, d: graph.graph_stats(directed_lines(s, d)),
    "degree_histogram": lambda s, d: graph.degree_histogram(graphs.nation_trade(s, d)),
    "out_degrees": lambda s, d: graph.out_degrees(directed_lines(s, d), graph.vertices(directed_lines(s, d))),
    "running_degree": lambda s, d: graph.running_degree(graph.out_degrees(directed_lines(s, d), graph.vertices(directed_lines(s, d)))),
    "distinct_vertices": lambda s, d: graph.vertices(graphs.part_supplier(s, d)).agg(F.count("*").alias("n_vertices")),
    "edge_rank": lambda s, d: order.ranked(graphs.user_hops(s, d), *graph.ORDER, name="rank", start=1),
    "light_edges_k": light_edges,
    "lightest_top": lambda s, d: order.lightest(graphs.part_supplier(s, d), 100, *graph.ORDER),
    "pivot_partition": pivot_partition,
    "chunk_bounds": chunk_bounds,
    "kway_merge": kway_merge,
    "weight_threshold_filter": lambda s, d: graphs.part_supplier(s, d).filter("weight <= 2000.0"),
    "set_difference": set_difference,
    "components_nation": components_of(graphs.nation_trade),
    "components_order_forest": components_of(graphs.order_forest),
    "msf_nation_trade": msf_of(graphs.nation_trade),
    "msf_user_hops": msf_of(graphs.user_hops),
    "msf_by_strategy": msf_by_strategy,
    "msf_totals": lambda s, d: forest.forest_totals(forest.minimum_spanning_forest(graphs.user_hops(s, d))),
    "msf_order_forest": msf_of(graphs.order_forest),
    "msf_part_supplier": msf_of(graphs.part_supplier),
    "msf_filtered": lambda s, d: forest.forest_totals(forest.minimum_spanning_forest(graphs.part_supplier(s, d), "filter", threshold=10_000)),
    "msf_prefix": lambda s, d: forest.minimum_spanning_forest(order.ranked(graphs.nation_trade(s, d), *graph.ORDER).filter("pos < 100")),
    "msf_streaming": streaming_forest,
    "edge_membership": lambda s, d: hops(s, d).select("pos", "membership"),
    "edge_classes": over_hops(analytics.class_counts),
    "heavy_filter": heavy_filter,
    "percentile_progress": percentile_progress,
    "progress_snapshots": progress_snapshots,
    "prefix_detectability": prefix_detectability,
    "closing_times": closing_times,
    "gap_histogram": over_hops(analytics.gap_histogram),
    "gap_histogram_pow2": over_hops(lambda rows: analytics.gap_histogram(rows, powers=True)),
    "jump_lengths": over_hops(analytics.jump_lengths),
    "jump_lengths_capped": over_hops(lambda rows: analytics.jump_lengths(rows, 8)),
    "jump_summary": over_hops(analytics.jump_summary),
    "oracle_skip": oracle_skip,
    "compacted_order": over_hops(analytics.compacted),
    "compacted_chunks": over_hops(lambda rows: analytics.compacted(rows, 4)),
    "compacted_jumps": over_hops(lambda rows: analytics.compacted_jumps(rows, 4)),
    "oracle_prepared": over_hops(lambda rows: analytics.prepared(rows).select("pos", "membership")),
    "progress_cells": over_hops(lambda rows: analytics.progress_cells(rows, 20)),
    "stat_matrix": over_hops(lambda rows: analytics.stat_matrix(rows, 5)),
    "msf_with_ids": msf_with_ids,
    "mirrored_lines": mirrored_lines,
    "position_differences": position_differences,
    "kth_edge": kth_edge,
    "order_breaks": order_breaks,
    "find_hops": find_hops,
    "cycles_by_chunk": over_hops(lambda rows: analytics.cycles_by_chunk(rows, 6)),
    "bfs_levels": bfs_levels,
    "parse_edge_text": parse_edge_text,
    "parse_run_log": parse_run_log,
    "parse_cpu_list": parse_cpu_list,
    "scalar_functions": scalar_functions,
}

TRADE, HOPS, PARTS, STARS = (graphs.SQL[n] for n in ("nation_trade", "user_hops", "part_supplier", "order_forest"))


def steps(edges: str) -> str:
    """CTEs g (edges with pos from 1), m (with membership and the labels after each edge): one edge a step, in order."""
    return f"""g0 AS ({edges}), vs AS (SELECT list(x ORDER BY x) AS v FROM (SELECT src AS x FROM g0 UNION SELECT dst FROM g0)),
g AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS pos, list_position(v, src) AS ps, list_position(v, dst) AS pd FROM g0, vs),
w(pos, lab, membership) AS (SELECT 0::BIGINT, v, 0 FROM vs UNION ALL
 SELECT g.pos, CASE WHEN lab[ps] = lab[pd] THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = greatest(lab[ps], lab[pd]) THEN least(lab[ps], lab[pd]) ELSE x END) END,
  CASE WHEN lab[ps] = lab[pd] THEN 2 ELSE 1 END FROM w JOIN g ON g.pos = w.pos + 1),
m AS (SELECT g.src, g.dst, g.weight, g.pos - 1 AS pos, w.membership, w.lab, g.ps, g.pd FROM g JOIN w USING (pos)),
n AS (SELECT count(*)::BIGINT AS e FROM g0)"""


def over(edges: str, select: str) -> str:
    return f"WITH RECURSIVE {steps(edges)} {select}"


def ranked_sql(edges: str, name: str, start: int) -> str:
    return f"SELECT src, dst, weight, (row_number() OVER (ORDER BY weight, src, dst) - 1 + {start})::BIGINT AS {name} FROM ({edges})"


TOTALS = "count(*)::BIGINT AS n_edges, sum(weight::DECIMAL(28,2))::DOUBLE AS total_weight"
RUNS = "r AS (SELECT min(pos) AS run_start, count(*)::BIGINT AS run_length FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS k FROM m WHERE membership = 2) GROUP BY k)"
POWER = "CASE WHEN {n} <= 1 THEN 1 ELSE (1::BIGINT << length(bin({n} - 1))::INT) END::BIGINT"


def gaps(key: str) -> str:
    return over(HOPS, f""", {RUNS}, h AS (SELECT {key} AS gap, count(*)::BIGINT AS n FROM r GROUP BY 1)
SELECT gap, n, round(100.0::DOUBLE * sum(n) OVER (ORDER BY gap) / sum(n) OVER (), 4) AS cum_share FROM h""")


def boruvka(edges: str, select: str, rounds: int = 16) -> str:
    """CTE f (the forest): every component takes its first edge; chains of choices end at the smaller of a pair that chose each other."""
    ctes = [f"e0 AS MATERIALIZED (SELECT src AS a, dst AS b, weight, src, dst FROM ({edges}))"]
    for n in range(rounds):
        ctes.append(f"""b{n} AS MATERIALIZED (SELECT a, arg_min(b, (weight, src, dst)) AS o, min((weight, src, dst)) AS e FROM (SELECT * FROM e{n} UNION ALL SELECT b, a, weight, src, dst FROM e{n}) GROUP BY a),
p{n} AS MATERIALIZED (SELECT x.a, CASE WHEN y.o = x.a AND x.a < x.o THEN x.a ELSE x.o END AS up FROM b{n} x JOIN b{n} y ON y.a = x.o),
j{n} AS (SELECT a, up FROM p{n} UNION ALL SELECT j{n}.a, p{n}.up FROM j{n} JOIN p{n} ON p{n}.a = j{n}.up AND p{n}.up <> p{n}.a),
r{n} AS MATERIALIZED (SELECT j{n}.a, j{n}.up AS r FROM j{n} JOIN p{n} ON p{n}.a = j{n}.up AND p{n}.up = p{n}.a),
e{n + 1} AS MATERIALIZED (SELECT x.r AS a, y.r AS b, weight, src, dst FROM e{n} JOIN r{n} x ON x.a = e{n}.a JOIN r{n} y ON y.a = e{n}.b WHERE x.r <> y.r)""")
    picks = " UNION ".join(f"SELECT e FROM b{n}" for n in range(rounds))
    return f"WITH RECURSIVE {', '.join(ctes)}, f AS (SELECT e[2] AS src, e[3] AS dst, e[1] AS weight FROM ({picks})) {select}"


def components_sql(edges: str) -> str:
    return f"""WITH RECURSIVE g AS MATERIALIZED ({edges}), b AS (SELECT src AS x, dst AS y FROM g UNION ALL SELECT dst, src FROM g),
r AS (SELECT DISTINCT x AS vertex, x AS c FROM b UNION SELECT r.vertex, b.y FROM r JOIN b ON b.x = r.c)
SELECT vertex, min(c) AS component FROM r GROUP BY vertex"""


ORACLES: dict[str, str] = {
    "edges_canonical": TRADE,
    "edges_part_supplier": PARTS,
    "edges_user_hops": HOPS,
    "edges_order_forest": STARS,
    "edges_reversed_union": f"WITH g AS ({TRADE}) SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g",
    "edges_lightest_parallel": f"SELECT src, dst, min(weight) AS weight FROM ({DIRECTED_SQL}) GROUP BY 1, 2",
    "edges_rebased": f"SELECT src - 1 AS src, dst - 1 AS dst, count(*)::BIGINT AS n FROM ({DIRECTED_SQL}) WHERE src <> dst GROUP BY 1, 2",
    "edges_with_id": ranked_sql(PARTS, "edge_id", 0),
    "adjacency_list": f"SELECT src AS vertex, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM ({TRADE}) GROUP BY src",
    "adjacency_edges": TRADE,
    "graph_stats": f"""WITH g AS ({DIRECTED_SQL}), p AS (SELECT src, dst, count(*) AS n FROM g GROUP BY 1, 2), v AS (SELECT src AS x FROM g UNION SELECT dst FROM g),
deg AS (SELECT x, count(g.src) AS k FROM v LEFT JOIN g ON g.src = x GROUP BY x)
SELECT (SELECT count(*) FROM g)::BIGINT AS n_edges, (SELECT count(*) FROM g WHERE src = dst)::BIGINT AS n_loops, (SELECT sum(n - 1) FROM p)::BIGINT AS n_parallel, (SELECT max(weight) FROM g) AS max_weight,
 (SELECT count(*) FROM v)::BIGINT AS n_vertices, max(k)::BIGINT AS max_degree, round(sum(k)::DOUBLE / count(*), 6) AS mean_degree FROM deg""",
    "degree_histogram": f"""WITH g AS ({TRADE}), v AS (SELECT src AS x FROM g UNION SELECT dst FROM g), deg AS (SELECT x, count(g.src) AS k FROM v LEFT JOIN g ON g.src = x GROUP BY x)
SELECT least(k, 9)::BIGINT AS degree_bin, count(*)::BIGINT AS n_vertices FROM deg GROUP BY 1""",
    "out_degrees": f"WITH g AS ({DIRECTED_SQL}), v AS (SELECT src AS x FROM g UNION SELECT dst FROM g) SELECT x AS vertex, count(g.src)::BIGINT AS degree FROM v LEFT JOIN g ON g.src = x GROUP BY x",
    "running_degree": f"""WITH g AS ({DIRECTED_SQL}), v AS (SELECT src AS x FROM g UNION SELECT dst FROM g), deg AS (SELECT x, count(g.src) AS k FROM v LEFT JOIN g ON g.src = x GROUP BY x)
SELECT round(sum(k * pow(0.5::DOUBLE, n)), 6) AS running_degree FROM (SELECT k, row_number() OVER (ORDER BY x DESC) AS n FROM deg)""",
    "distinct_vertices": f"SELECT count(*)::BIGINT AS n_vertices FROM (SELECT src FROM ({PARTS}) UNION SELECT dst FROM ({PARTS}))",
    "edge_rank": ranked_sql(HOPS, "rank", 1),
    "light_edges_k": f"SELECT src, dst, weight FROM ({ranked_sql(PARTS, 'pos', 0)}) WHERE pos < (SELECT count(*) FROM ({PARTS})) // 10",
    "lightest_top": f"SELECT * FROM ({PARTS}) ORDER BY weight, src, dst LIMIT 100",
    "pivot_partition": f"SELECT weight < 20000.0 AS is_left, count(*)::BIGINT AS n, min(weight) AS least, max(weight) AS most FROM ({PARTS}) GROUP BY 1",
    "chunk_bounds": f"SELECT chunk::BIGINT AS chunk, min(pos)::BIGINT AS first_pos, count(*)::BIGINT AS n FROM (SELECT row_number() OVER (ORDER BY weight, src, dst) - 1 AS pos, ntile(7) OVER (ORDER BY weight, src, dst) AS chunk FROM ({HOPS})) GROUP BY chunk",
    "kway_merge": ranked_sql(HOPS, "pos", 0),
    "weight_threshold_filter": f"SELECT * FROM ({PARTS}) WHERE weight <= 2000.0",
    "set_difference": f"""WITH g AS ({TRADE}), a AS (SELECT * FROM g WHERE weight < 2000), b AS (SELECT * FROM g WHERE src % 2 = 0)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "components_nation": components_sql(TRADE),
    "components_order_forest": components_sql(STARS),
    "msf_nation_trade": over(TRADE, "SELECT src, dst, weight FROM m WHERE membership = 1"),
    "msf_user_hops": over(HOPS, "SELECT src, dst, weight FROM m WHERE membership = 1"),
    "msf_by_strategy": over(TRADE, f"SELECT s AS strategy, {TOTALS} FROM m, (VALUES ('local'), ('two_level'), ('filter'), ('rounds')) t(s) WHERE membership = 1 GROUP BY s"),
    "msf_totals": over(HOPS, f"SELECT {TOTALS} FROM m WHERE membership = 1"),
    "msf_order_forest": STARS,
    "msf_part_supplier": boruvka(PARTS, "SELECT src, dst, weight FROM f"),
    "msf_filtered": boruvka(PARTS, f"SELECT {TOTALS} FROM f"),
    "msf_with_ids": over(HOPS, "SELECT src, dst, weight, pos AS edge_id FROM m WHERE membership = 1"),
    "mirrored_lines": """WITH l AS (SELECT o_orderkey::BIGINT AS line, (o_custkey % 2)::BIGINT AS src, (floor(o_totalprice) % 3)::BIGINT AS dst FROM orders),
p AS (SELECT *, lag(least(src, dst)) OVER o IS DISTINCT FROM least(src, dst) OR lag(greatest(src, dst)) OVER o IS DISTINCT FROM greatest(src, dst) AS first FROM l WINDOW o AS (ORDER BY line)),
r AS (SELECT *, sum(first::INT) OVER (ORDER BY line) AS run FROM p), s AS (SELECT *, first_value(src) OVER (PARTITION BY run ORDER BY line) AS led FROM r)
SELECT line, src, dst FROM s WHERE first OR (src <> dst AND src = led)""",
    "position_differences": f"""WITH a AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS pos FROM ({HOPS}) WHERE src % 2 = 0), b AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS pos FROM ({HOPS}) WHERE src % 2 = 1)
SELECT coalesce(a.pos, b.pos)::BIGINT AS pos, a.weight AS left, b.weight AS right FROM a FULL JOIN b ON a.pos = b.pos WHERE a.weight IS DISTINCT FROM b.weight""",
    "kth_edge": f"SELECT src, dst, weight FROM ({ranked_sql(PARTS, 'pos', 0)}) WHERE pos = (SELECT count(*) FROM ({PARTS})) // 3",
    "order_breaks": f"""SELECT src, dst, weight, pos FROM (SELECT *, (row_number() OVER o - 1)::BIGINT AS pos, lag(weight) OVER o AS w, lag(src) OVER o AS s, lag(dst) OVER o AS d FROM ({PARTS}) WINDOW o AS (ORDER BY src, dst)) WHERE w IS NOT NULL AND (weight, src, dst) < (w, s, d)""",
    "find_hops": f"""WITH RECURSIVE g AS MATERIALIZED ({PARTS}), p AS MATERIALIZED (SELECT a AS vertex, least(a, min(b)) AS parent FROM (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g) GROUP BY a),
h AS (SELECT vertex, vertex AS x, 0::BIGINT AS hops FROM p UNION ALL SELECT h.vertex, p.parent, h.hops + 1 FROM h JOIN p ON p.vertex = h.x AND p.parent <> p.vertex)
SELECT vertex, arg_max(x, hops) AS root, max(hops) AS hops FROM h GROUP BY vertex""",
    "compacted_jumps": over(HOPS, """, t AS (SELECT *, ntile(4) OVER (ORDER BY pos) AS chunk FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY membership, pos) - 1 AS slot, count(*) OVER (PARTITION BY chunk) AS k FROM t)
SELECT chunk, slot::BIGINT AS slot, CASE WHEN membership = 1 THEN 0 ELSE -((k - slot) % 128) END::BIGINT AS jump FROM c"""),
    "oracle_prepared": over(HOPS, "SELECT pos, CASE WHEN membership = 2 THEN 2 ELSE 0 END AS membership FROM m"),
    "progress_cells": over(HOPS, """, t AS (SELECT *, ntile(20) OVER (ORDER BY pos) AS point FROM m), c AS (SELECT point, count(*) FILTER (membership = 1) AS a, count(*) FILTER (membership = 2) AS b FROM t GROUP BY 1)
SELECT point::BIGINT AS point, round(point::DOUBLE / 20 * 60)::BIGINT AS edges, round(round(100.0::DOUBLE * sum(a) OVER o / sum(a) OVER (), 4) / 100 * 60)::BIGINT AS msf, round(round(100.0::DOUBLE * sum(b) OVER o / sum(b) OVER (), 4) / 100 * 60)::BIGINT AS cycle FROM c WINDOW o AS (ORDER BY point)"""),
    "stat_matrix": over(HOPS, ", t AS (SELECT *, ntile(5) OVER (ORDER BY pos) AS point FROM m) SELECT membership, " + ", ".join(f"count(*) FILTER (point <= {n})::BIGINT AS p{n}" for n in range(1, 6)) + " FROM t GROUP BY membership"),
    "msf_prefix": over(TRADE, "SELECT src, dst, weight FROM m WHERE membership = 1 AND pos < 100"),
    "msf_streaming": over(TRADE, "SELECT src, dst, weight FROM m WHERE membership = 1"),
    "edge_membership": over(HOPS, "SELECT pos, membership FROM m"),
    "edge_classes": over(HOPS, "SELECT membership, count(*)::BIGINT AS n_edges FROM m GROUP BY membership"),
    "heavy_filter": over(HOPS, "SELECT src, dst, weight FROM m, (SELECT lab AS l FROM w, n WHERE w.pos = e // 30) WHERE m.pos >= (SELECT e // 30 FROM n) AND l[ps] <> l[pd]"),
    "percentile_progress": over(HOPS, """, t AS (SELECT *, ntile(100) OVER (ORDER BY pos) AS point FROM m),
c AS (SELECT point::BIGINT AS point, count(*)::BIGINT AS n, count(*) FILTER (membership = 1)::BIGINT AS n_msf, count(*) FILTER (membership = 2)::BIGINT AS n_cycle FROM t GROUP BY 1)
SELECT point, n, n_msf, n_cycle, (sum(n_msf) OVER o)::BIGINT AS cum_msf, (sum(n_cycle) OVER o)::BIGINT AS cum_cycle, round(100.0::DOUBLE * sum(n_msf) OVER o / sum(n_msf) OVER (), 4) AS msf_share,
 round(100.0::DOUBLE * sum(n_cycle) OVER o / sum(n_cycle) OVER (), 4) AS cycle_share FROM c WINDOW o AS (ORDER BY point)"""),
    "progress_snapshots": over(HOPS, """, t AS (SELECT *, ntile(50) OVER (ORDER BY pos) AS point FROM m),
c AS (SELECT point::BIGINT AS point, count(*) FILTER (membership = 2 AND pos < e // 2) AS a, count(*) FILTER (membership = 2 AND pos >= e // 2) AS b FROM t, n GROUP BY 1)
SELECT point, (sum(a) OVER (ORDER BY point))::BIGINT AS cycles_first, (sum(b) OVER (ORDER BY point))::BIGINT AS cycles_second FROM c"""),
    "prefix_detectability": over(HOPS, """, p AS (SELECT i AS point, e * i // 100 AS upto FROM range(1, 101) t(i), n), k AS (SELECT point, upto, lab AS l FROM p JOIN w ON w.pos = p.upto),
c AS (SELECT point, upto, count(*) FILTER (m.pos >= upto AND l[ps] = l[pd])::BIGINT AS detectable, count(*) FILTER (m.membership = 2 AND m.pos >= upto) AS later_cycles, count(*) FILTER (m.membership = 2) AS cycles, count(*) FILTER (m.pos >= upto) AS later FROM k, m GROUP BY 1, 2)
SELECT point, upto::BIGINT AS upto, detectable, round(100.0::DOUBLE * detectable / cycles, 4) AS of_all_cycles, CASE WHEN later_cycles > 0 THEN round(100.0::DOUBLE * detectable / later_cycles, 4) ELSE 0.0::DOUBLE END AS of_later_cycles,
 CASE WHEN later > 0 THEN round(100.0::DOUBLE * detectable / later, 4) ELSE 0.0::DOUBLE END AS of_later_edges FROM c"""),
    "closing_times": over(TRADE, "SELECT m.src, m.dst, m.pos, min(w.pos) - 1 AS closed_at FROM m JOIN w ON w.lab[m.ps] = w.lab[m.pd] WHERE m.membership = 2 GROUP BY ALL"),
    "gap_histogram": gaps("run_length"),
    "gap_histogram_pow2": gaps(POWER.format(n="run_length")),
    "jump_lengths": over(HOPS, f", {RUNS} SELECT m.pos, CASE WHEN membership = 1 THEN 0 ELSE m.pos - run_start - run_length END::BIGINT AS jump FROM m LEFT JOIN r ON m.pos >= run_start AND m.pos < run_start + run_length"),
    "jump_lengths_capped": over(HOPS, f", {RUNS} SELECT m.pos, CASE WHEN membership = 1 THEN 0 ELSE -((run_start + run_length - m.pos - 1) % 8 + 1) END::BIGINT AS jump FROM m LEFT JOIN r ON m.pos >= run_start AND m.pos < run_start + run_length"),
    "jump_summary": over(HOPS, f", {RUNS} SELECT sum(run_length)::BIGINT AS skipped, count(*)::BIGINT AS jumps, (any_value(e) - sum(run_length) + count(*))::BIGINT AS visited, any_value(e) AS visited_serial FROM r, n"),
    "oracle_skip": over(HOPS, "SELECT count(*) FILTER (membership = 1)::BIGINT AS n_msf, sum(weight::DECIMAL(28,2)) FILTER (membership = 1)::DOUBLE AS total_weight, count(*) FILTER (membership = 2)::BIGINT AS skipped FROM m"),
    "compacted_order": over(HOPS, "SELECT pos, 1::BIGINT AS chunk, (row_number() OVER (ORDER BY membership, pos) - 1)::BIGINT AS slot, membership FROM m"),
    "compacted_chunks": over(HOPS, ", t AS (SELECT *, ntile(4) OVER (ORDER BY pos) AS chunk FROM m) SELECT pos, chunk, (row_number() OVER (PARTITION BY chunk ORDER BY membership, pos) - 1)::BIGINT AS slot, membership FROM t"),
    "cycles_by_chunk": over(HOPS, ", t AS (SELECT *, ntile(6) OVER (ORDER BY pos) AS chunk FROM m) SELECT chunk, count(*) FILTER (membership = 2)::BIGINT AS n_cycle, count(*) FILTER (membership = 1)::BIGINT AS n_msf FROM t GROUP BY chunk"),
    "bfs_levels": over(HOPS, """, f AS (SELECT src AS x, dst AS y, weight FROM m WHERE membership = 1 UNION ALL SELECT dst, src, weight FROM m WHERE membership = 1),
q(vertex, level, parent, path_max) AS (SELECT 1::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE UNION ALL SELECT f.y, q.level + 1, q.vertex, greatest(coalesce(q.path_max, f.weight), f.weight) FROM q JOIN f ON f.x = q.vertex WHERE q.parent IS NULL OR f.y <> q.parent)
SELECT * FROM q"""),
    "parse_edge_text": """SELECT (o_custkey - 1)::BIGINT AS src, (o_orderkey - 1)::BIGINT AS dst, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE floor(o_totalprice) END::DOUBLE AS weight FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey <> o_orderkey""",
    "parse_run_log": """SELECT (o_custkey % 8 + 1)::BIGINT AS nthreads, (o_orderkey % 100 + 0.5)::DOUBLE AS seconds, o_orderkey::BIGINT AS batch, o_custkey::BIGINT AS cycles_main, (o_custkey * 3)::BIGINT AS cycles_helper, 0::BIGINT AS cycles_skipped, (o_custkey * 3)::BIGINT AS helper_total FROM orders""",
    "parse_cpu_list": "SELECT n_nationkey::BIGINT AS nation, unnest([n_nationkey, n_nationkey + 1, n_nationkey + 2, n_nationkey + 3, n_nationkey + 10, n_nationkey + 11])::BIGINT AS cpu FROM nation",
    "scalar_functions": f"""SELECT o_orderkey::BIGINT AS n, {POWER.format(n="o_orderkey")} AS power, length(o_orderkey::VARCHAR)::BIGINT AS digits, round((o_orderkey % 100)::DOUBLE / 100.0 * 60)::BIGINT AS cells,
 replace(o_orderkey::VARCHAR, '1', '') AS no_ones, bit_count(o_orderkey)::BIGINT AS bits, (2 * o_orderkey)::BIGINT AS twice FROM orders""",
}

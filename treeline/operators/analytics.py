"""Questions about classified edges: shares by rank, early recognition of cycles, runs, jumps, compaction.

``rows`` hold pos (from 0, the strict order) and membership (1 forest, 2 cycle).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import next_power_of_two
from ..plans.shared import store
from .components import connected_components
from .forest import minimum_spanning_forest
from .order import BLOCK, chunk, filled, ranked

#: Vertices of a forest whose merge times may go to every task: 16 bytes each.
TASK_VERTICES = 2_000_000


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("membership").agg(F.count("*").alias("n_edges"))


def percentile_progress(rows: DataFrame, points: int = 100) -> DataFrame:
    """For equal chunks of the order: edges, forest and cycle edges, cumulative counts and shares."""
    total = rows.count()
    per = rows.groupBy(chunk(F.col("pos"), max(1, total), points).alias("point")).agg(
        F.count("*").alias("n"), F.count_if(F.col("membership") == 1).alias("n_msf"), F.count_if(F.col("membership") == 2).alias("n_cycle")
    )
    # one row for each point
    up_to = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select(
        "point", "n", "n_msf", "n_cycle", F.sum("n_msf").over(up_to).alias("cum_msf"), F.sum("n_cycle").over(up_to).alias("cum_cycle"),
        F.round(100.0 * F.sum("n_msf").over(up_to) / F.greatest(F.sum("n_msf").over(every), F.lit(1)), 4).alias("msf_share"),
        F.round(100.0 * F.sum("n_cycle").over(up_to) / F.greatest(F.sum("n_cycle").over(every), F.lit(1)), 4).alias("cycle_share"),
    )


def progress_cells(rows: DataFrame, points: int = 100, cells: int = 60) -> DataFrame:
    """For each point of the order, how many of the cells of a progress bar the order, the forest and the cycle edges fill."""
    at = percentile_progress(rows, points)
    return at.select("point", F.round(F.col("point") / points * cells).cast("long").alias("edges"), *(F.round(F.col(f"{n}_share") / 100 * cells).cast("long").alias(n) for n in ("msf", "cycle")))


def stat_matrix(rows: DataFrame, points: int = 100) -> DataFrame:
    """One row for each class of edges, one column for each point: the edges of the class up to there."""
    total = rows.count()
    counted = rows.groupBy("membership", chunk(F.col("pos"), max(1, total), points).alias("point")).agg(F.count("*").alias("n"))
    wide = counted.groupBy("membership").pivot("point", list(range(1, points + 1))).agg(F.first("n"))
    so_far = [F.coalesce(F.col(f"`{p}`"), F.lit(0)) for p in range(1, points + 1)]
    for n in range(1, points):
        so_far[n] = so_far[n - 1] + so_far[n]
    return wide.select("membership", *(c.cast("long").alias(f"p{n}") for n, c in enumerate(so_far, 1)))


def prepared(rows: DataFrame) -> DataFrame:
    """Membership as it is before a replay: 2 for known cycle edges, 0 for edges that are still to be decided."""
    return rows.withColumn("membership", F.when(F.col("membership") == 2, 2).otherwise(0))


def merge_times(forest: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, the parent (position) each got in the union-find forest, and the pos at which it got it; -1 for roots."""
    forest = forest.sort_values("pos")
    ids, ends = np.unique(forest[["src", "dst"]].to_numpy(), return_inverse=True)
    parent, time, size = np.arange(len(ids)), np.full(len(ids), np.iinfo(np.int64).max), np.ones(len(ids), dtype=np.int64)
    for (a, b), pos in zip(ends.reshape(-1, 2).tolist(), forest["pos"].tolist()):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if size[a] < size[b]:
            a, b = b, a
        parent[b], time[b] = a, pos
        size[a] += size[b]
    return ids, parent, time


def closing_time(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Cycle edges with closed_at: the pos of the forest edge that connected their ends, the heaviest on their path.

    The merge times of up to TASK_VERTICES vertices go to every task, where each edge climbs a tree of logarithmic height.
    """
    spark = rows.sparkSession
    in_order = rows.filter("membership = 1").select("src", "dst", "pos")
    if in_order.count() > TASK_VERTICES:
        return _closing_by_contraction(store(rows.filter("membership = 2"), "cycles"), store(in_order, "forest"))
    shared = spark.sparkContext.broadcast(merge_times(in_order.toPandas()))

    def climb(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parent, time = shared.value
        for batch in batches:
            a, b = np.searchsorted(ids, batch["src"]), np.searchsorted(ids, batch["dst"])
            last = np.zeros(len(batch), dtype=np.int64)
            while (apart := a != b).any():
                left = apart & (time[a] <= time[b])
                right = apart & ~left
                last = np.where(left, time[a], np.where(right, time[b], last))
                a, b = np.where(left, parent[a], a), np.where(right, parent[b], b)
            yield batch.assign(closed_at=last)

    return rows.filter("membership = 2").select("src", "dst", "pos").mapInPandas(climb, "src long, dst long, pos long, closed_at long")


def _closing_by_contraction(cycles: DataFrame, forest: DataFrame) -> DataFrame:
    """For forests of any size, in rounds as many as the logarithm of the vertices.

    Every component takes its first edge in the order, and those that meet become one. The last edge on the path
    between two vertices is the last of the edges that their components took before they became one.
    """
    now = forest.select(F.col("src").alias("u"), F.col("dst").alias("v"), "pos")
    open_ = cycles.select("src", "dst", "pos", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(-1).cast("long").alias("closed_at"))
    done: list[DataFrame] = []
    while not open_.isEmpty():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "pos"))
        firsts = store(both.groupBy("u").agg(F.min("pos").alias("at"), F.min_by("v", "pos").alias("v")), "firsts")
        labels = connected_components(firsts, "u", "v")
        up = store(firsts.join(labels, F.col("u") == F.col("vertex")).select(F.col("u").alias("node"), "at", F.col("component").alias("up")), "up")
        left, right = (up.select(*(F.col(c).alias(f"{c}_{side}") for c in up.columns)) for side in "ab")
        climbed = open_.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))
        climbed = store(climbed.select("src", "dst", "pos", F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.greatest("closed_at", "at_a", "at_b").alias("closed_at")), "climbed")
        done.append(climbed.filter("a = b").select("src", "dst", "pos", "closed_at"))
        open_ = climbed.filter("a <> b")
        moved = now.join(left, F.col("u") == F.col("node_a")).join(right, F.col("v") == F.col("node_b")).filter("up_a <> up_b")
        now = store(moved.select(F.col("up_a").alias("u"), F.col("up_b").alias("v"), "pos"), "contracted")
    out = cycles.select("src", "dst", "pos", F.lit(0).cast("long").alias("closed_at")).limit(0)
    for part in done:
        out = out.union(part)
    return out


def prefix_detectability(rows: DataFrame, forest: DataFrame, points: int = 100) -> DataFrame:
    """For prefixes of the order: later edges that the prefix's forest already closes, and their shares of all cycles, later cycles and later edges."""
    spark = rows.sparkSession
    total = rows.count()
    cycles = closing_time(rows, forest)
    n_cycles = rows.filter("membership = 2").count()
    bounds = spark.createDataFrame([(p, total * p // points) for p in range(1, points + 1)], "point int, upto long")
    # an edge counts for the prefixes after closed_at and up to its own pos: +1 at the first and -1 behind the last
    steps = cycles.select(F.explode(F.array(
        F.struct((F.col("closed_at") + 1).alias("upto"), F.lit(1).alias("step")), F.struct((F.col("pos") + 1).alias("upto"), F.lit(-1).alias("step")),
    )).alias("s")).select("s.*")
    before = cycles.select(F.col("pos").alias("at"))
    places = [r.upto for r in bounds.orderBy("upto").collect()]
    bucket = lambda c: sum((c > p).cast("int") for p in places)  # noqa: E731  points before which the step does not hold
    counted = steps.groupBy(bucket(F.col("upto")).alias("after")).agg(F.sum("step").alias("step"))
    later = before.groupBy(bucket(F.col("at") + 1).alias("after")).agg(F.count("*").alias("n"))
    order = Window.orderBy("after").rowsBetween(Window.unboundedPreceding, 0)
    index = spark.createDataFrame([(n, u) for n, u in enumerate(places)], "after int, upto long")
    table = index.join(counted, "after", "left").join(later, "after", "left").select(
        "after", "upto", F.sum(F.coalesce("step", F.lit(0))).over(order).alias("detectable"), F.sum(F.coalesce("n", F.lit(0))).over(order).alias("cycles_so_far")
    )
    rest = F.lit(n_cycles) - F.col("cycles_so_far")
    share = lambda n, d: F.when(d > 0, F.round(100.0 * n / d, 4)).otherwise(F.lit(0.0))
    return table.select(
        (F.col("after") + 1).cast("long").alias("point"), "upto", "detectable", share(F.col("detectable"), F.lit(n_cycles)).alias("of_all_cycles"),
        share(F.col("detectable"), rest).alias("of_later_cycles"), share(F.col("detectable"), F.lit(total) - F.col("upto")).alias("of_later_edges"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """Maximal runs of cycle edges: run_start, run_length. Between two forest edges there is one run at most, so runs come from the gaps of their positions."""
    total = rows.count()
    spark = rows.sparkSession
    ends = rows.filter("membership = 1").select("pos").union(spark.createDataFrame([(-1,), (total,)], "pos long"))
    order = ranked(ends, "pos", name="n")
    following = order.select((F.col("n") - 1).alias("n"), F.col("pos").alias("next"))
    return order.join(following, "n").filter("next - pos > 1").select((F.col("pos") + 1).alias("run_start"), (F.col("next") - F.col("pos") - 1).alias("run_length"))


def gap_histogram(rows: DataFrame, powers: bool = False) -> DataFrame:
    """Runs of each length, or of each next power of two, with the cumulative share."""
    length = next_power_of_two(F.col("run_length")) if powers else F.col("run_length")
    found = runs(rows).groupBy(length.cast("long").alias("gap")).agg(F.count("*").alias("n"))
    up_to = Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.select("gap", "n", F.round(100.0 * F.sum("n").over(up_to) / F.sum("n").over(every), 4).alias("cum_share"))


def jump_lengths(rows: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """pos and jump: for cycle edges minus what is left of their run, for others 0; a cap bounds single jumps."""
    marked = filled(rows.select("pos", "membership"), "pos", F.when(F.col("membership") == 1, F.col("pos")), "next", block, forward=False)
    left = F.coalesce("next", F.lit(rows.count())) - F.col("pos")
    left = left if cap is None else F.when(left > 0, F.pmod(left - 1, F.lit(cap)) + 1).otherwise(left)
    return marked.select("pos", (-left).cast("long").alias("jump"))


def jump_summary(rows: DataFrame) -> DataFrame:
    """One row: edges skipped by jumps, jumps, slots visited with jumps and without."""
    n = rows.count()
    found = runs(rows).agg(F.coalesce(F.sum("run_length"), F.lit(0)).alias("skipped"), F.count("*").alias("jumps"))
    return found.select("skipped", "jumps", (n - F.col("skipped") + F.col("jumps")).alias("visited"), F.lit(n).cast("long").alias("visited_serial"))


def replay_without_cycles(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """The forest of the edges that are no known cycle edges, with the number skipped."""
    cycles = rows.filter("membership = 2").select("src", "dst")
    forest = minimum_spanning_forest(edges.join(cycles, ["src", "dst"], "left_anti"))
    skipped = cycles.count()
    return forest.agg(F.count("*").alias("n_msf"), F.coalesce(F.sum(F.col("weight").cast("decimal(28,2)")).cast("double"), F.lit(0.0)).alias("total_weight")).withColumn("skipped", F.lit(skipped).cast("long"))


def compacted(rows: DataFrame, chunks: int = 1) -> DataFrame:
    """pos, chunk and slot: within each chunk of the order forest edges come first, then cycle edges, both in order."""
    total = max(1, rows.count())
    if chunks == 1:
        forest = ranked(rows.filter("membership = 1"), "pos", name="slot")
        cycles = ranked(rows.filter("membership = 2"), "pos", name="slot", start=forest.count())
        return forest.union(cycles).select("pos", F.lit(1).cast("long").alias("chunk"), "slot", "membership")
    placed = rows.withColumn("chunk", chunk(F.col("pos"), total, chunks))
    # one row for each chunk: what stands before it in each class, and where its cycle edges begin
    counts = placed.groupBy("chunk").agg(F.count_if(F.col("membership") == 1).alias("n_msf"), F.count_if(F.col("membership") == 2).alias("n_cycle"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", "n_msf", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n_msf", "n_cycle")))
    forest, cycles = (ranked(placed.filter(F.col("membership") == m).select("pos", "chunk", "membership"), "pos", name="rank") for m in (1, 2))
    forest = forest.join(starts, "chunk").withColumn("slot", F.col("rank") - F.col("before_n_msf"))
    cycles = cycles.join(starts, "chunk").withColumn("slot", F.col("n_msf") + F.col("rank") - F.col("before_n_cycle"))
    return forest.union(cycles).select("pos", "chunk", "slot", "membership")


def compacted_jumps(rows: DataFrame, chunks: int, limit: int = 128) -> DataFrame:
    """chunk, slot and jump after the compaction of each chunk: 0 for forest edges, then one run of jumps over the chunk's tail, modulo the limit (so 0 where the rest is a multiple of it)."""
    slots = compacted(rows, chunks)
    sizes = slots.groupBy("chunk").agg(F.count("*").alias("n"))
    return slots.join(sizes, "chunk").select("chunk", "slot", F.when(F.col("membership") == 1, 0).otherwise(-((F.col("n") - F.col("slot")) % limit)).cast("long").alias("jump"))


def cycles_by_chunk(rows: DataFrame, chunks: int) -> DataFrame:
    """Cycle edges of each chunk of the order."""
    total = max(1, rows.count())
    return rows.groupBy(chunk(F.col("pos"), total, chunks).alias("chunk")).agg(F.count_if(F.col("membership") == 2).alias("n_cycle"), F.count_if(F.col("membership") == 1).alias("n_msf"))

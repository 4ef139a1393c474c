"""Order and selection without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import store

#: Positions that one window goes over.
BLOCK = 1 << 20


def ranked(df: DataFrame, *order: str, name: str = "pos", start: int = 0) -> DataFrame:
    """With the position of each row in the order. Rows are range-partitioned and sorted; ids of rows within partitions are moved by the sizes of the partitions before."""
    columns = df.columns
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__id", 33).cast("int"))
    # one row for each partition
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    before, rows = start, []
    for part, size in sizes:
        rows.append((part, before))
        before += size
    starts = F.broadcast(spark.createDataFrame(rows, "__part int, __start long"))
    position = F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, "__part").withColumn(name, position).select(*columns, name)


def with_previous(df: DataFrame, position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """With the value of the row before in the order of a position (long, distinct); null for the first row.

    Windows go over blocks of positions; the last row of a block is handed to the next block that has any.
    """
    rows = df.withColumn("__block", F.floor(F.col(position) / block)).withColumn("__own", F.struct(value.alias("v")))
    last = rows.groupBy("__block").agg(F.max_by("__own", position).alias("__last"))
    # one row for each block
    handed = last.select("__block", F.lag("__last").over(Window.orderBy("__block")).alias("__handed"))
    before = F.lag("__own").over(Window.partitionBy("__block").orderBy(position))
    return rows.withColumn("__before", before).join(handed, "__block").withColumn(name, F.coalesce("__before", "__handed")["v"]).drop("__block", "__own", "__before", "__handed")


def filled(df: DataFrame, position: str, value: Column, name: str, block: int = BLOCK, forward: bool = True) -> DataFrame:
    """With the last value that is not null at a row or before it in the order of a position (or, not forward, the next one at it or behind it); in blocks as ``with_previous``."""
    rows = df.withColumn("__block", F.floor(F.col(position) / block)).withColumn("__own", value)
    pick = F.max_by if forward else F.min_by
    ends = rows.filter("__own IS NOT NULL").groupBy("__block").agg(pick("__own", position).alias("__end"))
    blocks = rows.select("__block").distinct().join(ends, "__block", "left")
    # one row for each block
    order = Window.orderBy(F.col("__block") if forward else F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select("__block", F.last("__end", ignorenulls=True).over(order).alias("__handed"))
    w = Window.partitionBy("__block").orderBy(F.col(position) if forward else F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    within = F.last("__own", ignorenulls=True).over(w)
    return rows.withColumn("__within", within).join(handed, "__block").withColumn(name, F.coalesce("__within", "__handed")).drop("__block", "__own", "__within", "__handed")


def kth(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The row at position k (from 0) of the order, exactly."""
    return ranked(df, *order, name="__pos").filter(F.col("__pos") == k).drop("__pos")


def unsorted(df: DataFrame, position: str, *order: str, block: int = BLOCK) -> DataFrame:
    """Rows that are less than the row before them by position, in the order of the columns; none if the table is sorted."""
    now = F.struct(*order)
    return with_previous(df, position, now, "__before", block).filter(now < F.col("__before")).drop("__before")


def differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """pos, left and right for the positions at which two tables, each ranked by the column, differ; null where one has ended."""
    left = ranked(a.select(F.col(column).alias("left")), "left")
    right = ranked(b.select(F.col(column).alias("right")), "right")
    return left.join(right, "pos", "full").filter(~F.col("left").eqNullSafe(F.col("right"))).select("pos", "left", "right")


def lightest(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows of the order, themselves in no order: top rows of each task for a small k, ranks for a large one."""
    if k <= 10_000:
        return df.orderBy(*order).limit(k)
    return ranked(df, *order).filter(F.col("pos") < k).drop("pos")


def pivot(df: DataFrame, column: str, share: float, accuracy: int = 10_000) -> float | None:
    """A value that about this share of the rows do not exceed, in one pass."""
    return df.agg(F.percentile_approx(column, share, accuracy)).first()[0]


def partitioned(df: DataFrame, column: str, value: float) -> DataFrame:
    """With is_left: whether the value of the column is below the pivot."""
    return df.withColumn("is_left", F.col(column) < value)


def chunk(position: Column, rows: int, chunks: int) -> Column:
    """Chunk from 1 of a position from 0: equal sizes, the remainder to the first chunks."""
    size, rest = divmod(rows, chunks)
    if size == 0:
        return (position + 1).cast("long")
    return F.when(position < rest * (size + 1), F.floor(position / (size + 1))).otherwise(rest + F.floor((position - rest * (size + 1)) / size)).cast("long") + 1


def merged(runs: list[DataFrame], *order: str, name: str = "pos") -> DataFrame:
    """Several tables as one, with positions in the order: one range partitioning of all, in which each task sorts its range once."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return ranked(out, *order, name=name)


def is_partitioned(left: DataFrame, right: DataFrame, column: str) -> bool:
    """Whether no value on the left exceeds one on the right."""
    most, least = left.agg(F.max(column)).first()[0], right.agg(F.min(column)).first()[0]
    return most is None or least is None or most <= least

"""Sharding by K-d tree partitioning over the metadata of documents.

Nodes are split at the distributed weighted median along their widest dimension (doc_id, source, language
and size, each relative to its extent over all documents) until every leaf has its target bytes; a leaf
is a shard. A number of shards that is no power of two splits in proportion. The items of the tree are groups of
equal texts, so copies share a shard; a group of more than half a shard is cut into pieces of a 64th of a
shard by doc_id, so no group, however large, unbalances the shards. Groups that weigh much come first in a
node's order, so that medians fall between light ones. Equal coordinates are ordered by a hash.

Nodes with few items are split down to their shards in one task each. The driver gets extents and histograms of the
others, some 2 * ``LOCAL_NODES`` at most whatever the number of shards, and one row for each shard.

Defined cases: a null text has size 1 and the checksum of no bytes; texts of any length are measured whole; null metadata
come before all others; rows that repeat are placed each, with slots of their own, rows with equal doc_ids in any order
among themselves; an empty table gives no row; with fewer items than shards, some shards are empty. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import Stored, store
from .cuts import KEY_BITS, weighted_cuts

DIMENSIONS = ("at_id", "at_source", "at_lang", "at_size")
GROUP = ("text_key", "text_crc32", "size")
#: Rows of a shard that are numbered in one task, about.
SLOT_ROWS = 50_000
#: Items of a node that one task splits down to its shards: so many, or so large a part of all.
LOCAL_ITEMS, LOCAL_NODES = 20_000, 8192


def ordinal(text: Column) -> Column:
    """A number in the order of the first seven bytes of a text; -1 for null."""
    digits = F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1))


def measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("at_id"), ordinal(F.col("source")).alias("at_source"), ordinal(F.col("lang")).alias("at_lang"), size.alias("at_size"),
    )


def number_rows(rows: DataFrame, by: str, order: str, name: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 for the rows of each value of ``by``: rows are numbered in buckets, whose starts are added up."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    starts = rows.groupBy(by, "bucket").count().withColumn(
        "start", F.sum("count").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select(by, "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(order)) - 1
    return rows.withColumn(name, own.cast("long")).join(starts, [by, "bucket"]).withColumn(name, F.col(name) + F.col("start")).drop("bucket", "start")


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, for a number of shards or for their bytes."""
    spark = docs.sparkSession
    rows = store(measure(docs), "measured")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, math.ceil(total / target_bytes))
    target = max(1, total // shards)

    weights = rows.groupBy(*GROUP).agg(F.sum("size").alias("weight"))
    # groups of over half a shard: fewer than twice the shards
    large = weights.filter(F.col("weight") > target / 2).select(*GROUP, F.ceil(64 * F.col("weight") / target).alias("pieces"))
    large = spark.createDataFrame(large.collect(), large.schema)
    rows = rows.join(F.broadcast(large), list(GROUP), "left").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    items = Stored(
        rows.groupBy(*GROUP, "piece").agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in DIMENSIONS)).withColumn("node", F.lit(0).cast("long")),
        "items",
    )
    whole = list(_extents(items.df)[0][3:]) if count else []
    leaves = {0: (0, shards)}
    number = items.df.count()
    local = max(LOCAL_ITEMS, number // LOCAL_NODES)
    while count:
        extents = {n: e for n, *e in _extents(items.df)}
        # a node without items has nothing to split: its shards stay empty
        leaves = {n: r for n, r in leaves.items() if n in extents}
        open_ = {n for n, (a, b) in leaves.items() if b - a > 1 and extents[n][0] > local}
        if not open_:
            break
        plan, targets = [], {}
        for n in sorted(open_):
            (a, b), (_, weight, *spans) = leaves[n], extents[n]
            dimension = _widest(spans, whole)
            plan.append((n, dimension, *map(float, spans[dimension])))
            targets[n] = weight * ((b - a) // 2) // (b - a)
        spans = F.broadcast(spark.createDataFrame(plan, "node long, dimension int, least double, most double"))
        place = F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1)
        # in doubles a large extent swallows the one that is added, so the greatest place is held below the range's end
        scaled = F.least(F.floor((place - F.col("least")) / (F.col("most") - F.col("least") + 1) * (1 << 29)).cast("long"), F.lit((1 << 29) - 1))
        light = (F.col("weight") <= target / 64).cast("long")
        key = F.shiftleft(light, KEY_BITS - 1).bitwiseOR(F.shiftleft(scaled, 30)).bitwiseOR(F.pmod(F.xxhash64(*GROUP, "piece"), F.lit(1 << 30)))
        keyed = Stored(items.df.join(spans, "node", "left").withColumn("key", F.coalesce(key, F.lit(0))).drop("dimension", "least", "most"), "items")
        cuts = weighted_cuts(keyed.df.select("node", "key", "weight"), targets, target // 1000)
        table = F.broadcast(spark.createDataFrame(list(cuts.items()), "node long, cut long"))
        moved = keyed.df.join(table, "node", "left").withColumn("node", 2 * F.col("node") + F.coalesce((F.col("key") >= F.col("cut")).cast("long"), F.lit(0))).drop("key", "cut")
        following = Stored(moved, "items")
        items.drop()
        keyed.drop()
        items = following
        halves = {n: (a, b, a + (b - a) // 2 if n in cuts else b) for n, (a, b) in leaves.items()}
        leaves = {2 * n: (a, m) for n, (a, b, m) in halves.items()} | {2 * n + 1: (m, b) for n, (a, b, m) in halves.items() if m < b}
    names = F.broadcast(spark.createDataFrame([(n, a, b) for n, (a, b) in leaves.items()], "node long, first int, last int"))
    placed = items.df.join(names, "node")
    tie = F.pmod(F.xxhash64(*GROUP, "piece"), F.lit(1 << 30))
    rest = placed.filter("last - first > 1").withColumn("tie", tie).groupBy("node").applyInPandas(
        lambda rows: _split(rows, whole, target), "text_key long, text_crc32 long, size long, piece long, shard int"
    )
    shard_of = placed.filter("last - first = 1").select(*GROUP, "piece", F.col("first").alias("shard")).union(rest)
    found = rows.join(shard_of, [*GROUP, "piece"]).select("doc_id", "size", "text_crc32", "shard")
    return number_rows(found, "shard", "doc_id", "slot", max(1, -(-count // SLOT_ROWS)))


def _widest(spans: list[tuple[int, int]], whole: list[tuple[int, int]]) -> int:
    """The dimension that is widest relative to its extent over all items."""
    return max(range(len(DIMENSIONS)), key=lambda d: ((spans[d][1] - spans[d][0]) / max(1, whole[d][1] - whole[d][0]), -d))


def _split(rows: pd.DataFrame, whole: list[tuple[int, int]], target: int) -> pd.DataFrame:
    """Splits a node that one task holds down to its shards, by the same rule."""
    rows = rows.sort_values(["tie", *GROUP, "piece"], ignore_index=True)
    places, weight = [rows[d].to_numpy() for d in DIMENSIONS], rows["weight"].to_numpy()
    heavy, shard = weight > target / 64, np.zeros(len(rows), dtype=np.int32)
    open_ = [(np.arange(len(rows)), int(rows["first"].iloc[0]), int(rows["last"].iloc[0]))]
    while open_:
        at, a, b = open_.pop()
        if b - a == 1 or not len(at):
            shard[at] = a
            continue
        half = (b - a) // 2
        goal = int(weight[at].sum()) * half // (b - a)
        place = places[_widest([(int(p[at].min()), int(p[at].max())) for p in places], whole)][at]
        # heavy items come first; rows are in the order of their ties
        order = at[np.lexsort((place, ~heavy[at]))]
        sums = np.cumsum(weight[order])
        cut = int(np.searchsorted(sums, goal, side="right"))
        if cut < len(order) and sums[cut] - goal < goal - (sums[cut - 1] if cut else 0):
            cut += 1
        open_ += [(np.sort(order[:cut]), a, a + half), (np.sort(order[cut:]), a + half, b)]
    return rows[[*GROUP, "piece"]].assign(shard=shard)


def _extents(items: DataFrame) -> list[tuple]:
    """node, items, weight and, for each dimension, its least and largest value."""
    found = items.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), *(F.struct(F.min(d), F.max(d)).alias(d) for d in DIMENSIONS)).collect()
    return [(r.node, r.n, r.weight, *(tuple(r[d]) for d in DIMENSIONS)) for r in found]


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """Writes the documents with all their columns into a folder for each shard."""
    # equal rows share a shard, so id, size and checksum lead to one
    keys = ("__id", "__size", "__crc")
    placed = assign_shards(docs, shards).select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "size", "text_crc32"), keys)), F.col("shard").alias("__shard")).dropDuplicates(keys)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.octet_length(text) + 1 == F.col("__size")) & (F.crc32(F.encode(text, "utf-8")) == F.col("__crc"))
    docs.join(placed, same).drop(*keys).withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, shards=8).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})

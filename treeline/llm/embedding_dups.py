"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are one throughout, with their number. The others get, after a random rotation, a code of
the signs of their coordinates and a correction factor, the inner product of the unit vector with its
code. Pairs to look at share a bucket: the signs of further rotations, ``signs`` of them for each table. The number
of signs grows with the logarithm of the number of vectors, so buckets keep their size; the number of
tables is the one with which a pair exactly at the threshold shares a bucket with probability ``RECALL``,
and closer pairs with a larger one. A pair that shares several buckets counts in the first table.

1. Only codes go to the buckets. Two codes differ in a share of their signs that is the angle over pi on
   average; pairs that differ in more signs than the threshold's angle allows, by ``EPSILON`` standard
   deviations, are dropped by counting bits. What is left names the vectors that a bucket has to see.
2. Vectors, codes and factors of these go to their buckets. The inner product of a code with another rotated
   unit vector, divided by the factor f, is an unbiased estimate of the cosine; its error is within ``EPSILON`` *
   sqrt(1 - f^2) / (f * sqrt(dimension - 1)) but for a vanishing share of pairs. Pairs whose upper bound is below the
   threshold are dropped; all others are computed anew in double precision, so no pair below it is linked.

Large buckets are cut into slices and each pair of slices is one task, so a bucket of any size is compared
whole. Tasks give numbers of links and a spanning forest, not pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors
with a null vec_id; vectors of each length are compared among themselves; rows that repeat count as vectors of their own
with one vec_id; a cosine equal to the threshold links; an empty table gives no row. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, stars
from ..plans.shared import Stored, store
from .ngram_join import groups_of

THRESHOLD, RECALL, EPSILON, SEED = 0.95, 0.9995, 5.0, 5
#: Vectors of a bucket, about; vectors compared at once, about.
BUCKET, TILE = 256, 1536


def rotations(dimension: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random directions, in blocks of orthogonal ones; the first ``dimension`` are the code's."""
    rng, blocks = np.random.default_rng(seed), []
    while sum(map(len, blocks)) < count:
        q, r = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        blocks.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(blocks)[:count]


def shape_of_tables(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs of each table, and tables."""
    signs = max(4, math.ceil(math.log2(max(2, vectors / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log1p(-together))


def identify(vectors: DataFrame) -> DataFrame:
    """vec_id, same (16 bytes that stand for the vector; null if it links with nothing), dimension and vector (bytes) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are no numbers here
            starts = np.cumsum(sizes) - sizes
            same, raw = [None] * batch.num_rows, [None] * batch.num_rows
            usable = (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[usable]).tolist():
                at = np.flatnonzero(usable & (sizes == size))
                rows = flat[starts[at][:, None] + np.arange(size)] + 0.0  # no negative zeros
                good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
                for n, row in zip(at[good].tolist(), rows[good].astype("<f4" if rows.dtype == np.float32 else "<f8")):
                    raw[n] = row.tobytes()
                    same[n] = xxhash.xxh3_128_digest(raw[n])
            yield pa.RecordBatch.from_arrays([ids, pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "same", "dimension", "vector"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, same binary, dimension long, vector binary")


def unit_vectors(raw: Iterable[bytes], dimension: int) -> np.ndarray:
    data = b"".join(raw)
    rows = len(data) and np.frombuffer(data, dtype="<f4" if _width(raw, dimension) == 4 else "<f8").astype(np.float64).reshape(-1, dimension)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _width(raw: Iterable[bytes], dimension: int) -> int:
    return len(next(iter(raw))) // dimension


CODED = "vec_id long, copies long, vector binary, code binary, factor double, keys array<long>"
#: Bits of a bucket's number that hold its key.
KEY_BITS = 48


def words_of(dimension: int) -> int:
    """64-bit words of a code."""
    return -(-dimension // 64)


def encode(reps: DataFrame, dimension: int, signs: int, tables: int, seed: int = SEED) -> DataFrame:
    """With code (signs of the rotated vector in 64-bit words, then those of the tables), factor and the bucket in each table."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions = rotations(dimension, dimension + signs * tables, seed)
        powers, width = 1 << np.arange(signs, dtype=np.int64), 8 * words_of(dimension)
        for batch in batches:
            if not len(batch):
                continue
            turned = unit_vectors(batch["vector"].tolist(), dimension) @ directions.T
            own = turned[:, :dimension]
            code, bits = np.zeros((len(batch), width), dtype=np.uint8), turned[:, dimension:] > 0
            packed = np.packbits(own > 0, axis=1)
            code[:, : packed.shape[1]] = packed
            keys = (bits.reshape(len(batch), tables, signs) * powers).sum(axis=2)
            yield batch.assign(
                code=[c.tobytes() for c in np.concatenate([code, np.packbits(bits, axis=1)], axis=1)],
                factor=np.abs(own).sum(axis=1) / math.sqrt(dimension),
                keys=list(keys + (np.arange(tables, dtype=np.int64) << KEY_BITS)),
            )

    return reps.mapInPandas(run, CODED)


class Tile:
    """The codes of a bucket, or of two slices of one."""

    def __init__(self, rows: pd.DataFrame, dimension: int, signs: int, threshold: float):
        data = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
        width = 8 * words_of(dimension)
        self.codes, self.signs = np.ascontiguousarray(data[:, :width]).view(np.uint64), data[:, width:]
        self.table = int(rows["bucket"].iloc[0]) >> KEY_BITS
        bits = np.unpackbits(self.signs, axis=1)[:, : self.table * signs].reshape(len(rows), self.table, signs)
        #: Buckets in the tables before this one.
        self.before = (bits * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2)
        place = rows["place"].to_numpy()
        crossed = place[0] >> 32 != place[0] >> 1 & 0x7FFFFFFF
        self.side = place & 1 if crossed else None
        share = math.acos(threshold) / math.pi
        self.most = dimension * share + EPSILON * math.sqrt(dimension * share * (1 - share))

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs whose codes differ in few signs and that share no bucket of an earlier table."""
        for start in range(0, len(self.codes), 256):
            part = self.codes[start : start + 256]
            differ = sum(np.bitwise_count(part[:, None, w] ^ self.codes[None, start:, w]).astype(np.int32) for w in range(self.codes.shape[1]))
            i, j = np.nonzero(differ <= self.most)
            i, j = i + start, j + start
            keep = i < j
            if self.side is not None:
                keep &= self.side[i] != self.side[j]
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 50_000):
                a, b = i[at : at + 50_000], j[at : at + 50_000]
                first = ~(self.before[a] == self.before[b]).any(axis=1)
                yield a[first], b[first]


def tiles_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in groups_of((b.assign(pair=b["place"] // 2) for b in batches), "bucket", "pair"):
        if len(batch[1]) > 1:
            yield batch[1]


def candidates(placed: DataFrame, dimension: int, signs: int, threshold: float, partitions: int) -> DataFrame:
    """Step 1: vec_id, bucket and place of the vectors of pairs near by their codes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in tiles_of(batches):
            some = np.zeros(len(rows), dtype=bool)
            for i, j in Tile(rows, dimension, signs, threshold).near():
                some[i] = some[j] = True
            if some.any():
                yield rows.loc[some, ["vec_id", "bucket", "place"]]

    return dealt(placed, partitions).mapInPandas(run, "vec_id long, bucket long, place long")


def dealt(placed: DataFrame, partitions: int) -> DataFrame:
    return placed.repartition(partitions, "bucket", F.shiftright("place", 1)).sortWithinPartitions("bucket", "place")


def linked(rows: pd.DataFrame, tile: Tile, dimension: int, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tile's pairs at or above the threshold: by estimates first, then in double precision."""
    units = unit_vectors(rows["vector"].tolist(), dimension)
    turned = units @ rotation.T
    signs = np.unpackbits(tile.codes.view(np.uint8), axis=1)[:, :dimension] * 2.0 - 1
    factor = rows["factor"].to_numpy()
    margin = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(max(1, dimension - 1))) + 1e-9
    # what the estimate must reach for the upper bound to reach the threshold, in units of the raw inner product
    need = (threshold - margin) * factor * math.sqrt(dimension)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, j in tile.near():
        may = np.einsum("ij,ij->i", signs[i], turned[j]) >= need[i]
        i, j = i[may], j[may]
        close = (units[i] * units[j]).sum(axis=1) >= threshold
        left.append(i[close])
        right.append(j[close])
    return np.concatenate(left), np.concatenate(right)


def search_tiles(placed: DataFrame, dimension: int, signs: int, threshold: float, seed: int, partitions: int) -> DataFrame:
    """Step 2: for vectors with links in a tile, vec_id and their number; and a spanning forest as (vec_id, other)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation, out, held = rotations(dimension, dimension, seed), [], 0
        for rows in tiles_of(batches):
            i, j = linked(rows, Tile(rows, dimension, signs, threshold), dimension, rotation, threshold)
            if not len(i):
                continue
            ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
            links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
            some = np.flatnonzero(links)
            u, v = stars(ids[i], ids[j])
            out.append(pd.DataFrame({"vec_id": np.concatenate([ids[some], u]), "other": pd.array([*[None] * len(some), *v.tolist()], dtype="Int64"), "n": np.concatenate([links[some].astype(np.int64), np.zeros(len(u), dtype=np.int64)])}))
            held += len(out[-1])
            if held > 50_000:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return dealt(placed, partitions).mapInPandas(run, "vec_id long, other long, n long")


def links_of(reps: DataFrame, dimension: int, number: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """What ``search_tiles`` gives for the vectors of one length."""
    partitions = 2 * int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signs, tables = shape_of_tables(number, threshold, recall)
    coded = store(encode(reps.filter(F.col("dimension") == dimension).select("vec_id", "copies", "vector"), dimension, signs, tables, seed), "codes")
    spots = coded.select("vec_id", "code", F.explode("keys").alias("bucket"))
    large = spots.groupBy("bucket").count().filter(F.col("count") > TILE).select("bucket", F.ceil(2 * F.col("count") / TILE).cast("long").alias("s"))
    slices = F.coalesce("s", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("vec_id"), slices)
    # place: the two slices that meet (twice the same one: a slice by itself), and which of them is the row's
    tile = F.struct(F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b"))
    placed = (
        spots.join(large, "bucket", "left")
        .select("vec_id", "code", "bucket", own.alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("other"))
        .select("vec_id", "code", "bucket", F.shiftleft(tile.a, 32).bitwiseOR(F.shiftleft(tile.b, 1)).bitwiseOR((F.col("slice") > F.col("other")).cast("long")).alias("place"))
    )
    near = store(candidates(placed, dimension, signs, threshold, partitions), "near")
    return Stored(search_tiles(near.join(coded.drop("keys"), "vec_id"), dimension, signs, threshold, seed, partitions), "links").df


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    known = store(identify(vectors), "vectors")
    reps = known.filter("same IS NOT NULL").groupBy("dimension", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = store(reps, "distinct-vectors")
    found = vectors.sparkSession.createDataFrame([], "vec_id long, other long, n long")
    # one row for each length
    for dimension, number in reps.groupBy("dimension").count().filter("count > 1").collect():
        found = found.union(links_of(reps, dimension, number, threshold, recall, seed))
    links = found.filter("other IS NULL").groupBy("vec_id").agg(F.sum("n").alias("links"))
    classes = connected_components(found.filter("other IS NOT NULL"), "vec_id", "other", reduced=True)

    joined = (
        reps.select("dimension", "same", F.col("vec_id").alias("rep"), "copies")
        .join(links, F.col("rep") == F.col("vec_id"), "left").drop("vec_id")
        .join(classes, F.col("rep") == F.col("vertex"), "left")
        .select("dimension", "same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return known.select("vec_id", "dimension", "same").join(joined, ["dimension", "same"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.r = links.x),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.x = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c
"""

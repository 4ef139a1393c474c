"""Readers and writers of edge files."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import adjacency, rebased, without_loops
from ..operators.order import BLOCK, filled, ranked, with_previous
from ..plans.byte_files import AtomicFile, RangeReader
from ..plans.shared import file_heads

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
EDGE_LINE = rf"^\s*(?:a\s+)?(\d+)\s+(\d+)(?:\s+({NUMBER}))?\s*$"
HEADER_LINE = r"^\s*(?:p\s+)?#?sp\s+(\d+)\s+(\d+)\s*$"
#: A header that states the vertices only.
SHORT_HEADER = r"^\s*(\d+)\s*$"
#: Fixed values of the dump format. Its header: vertices, edges, an address, a flag, padding; then rows.
DUMP_HEADER = "<IIQii"
#: Edges of a dump that are read at once.
DUMP_ROWS = 1 << 18
DUMP_EDGE = np.dtype([("src", "<u4"), ("dst", "<u4"), ("weight", "<f4")])


def edge_columns(lines: DataFrame, text: Column, *others: str) -> DataFrame:
    """src, dst and weight of the lines that are edges, as they stand there."""
    return lines.filter(text.rlike(EDGE_LINE)).select(
        *others, F.regexp_extract(text, EDGE_LINE, 1).cast("long").alias("src"), F.regexp_extract(text, EDGE_LINE, 2).cast("long").alias("dst"),
        F.coalesce(F.nullif(F.regexp_extract(text, EDGE_LINE, 3), F.lit("")).cast("double"), F.lit(0.0)).alias("weight"),
    )


def parse_edge_lines(lines: DataFrame, line: str | Column = "value", one_based: bool = True, undirected: bool = False) -> DataFrame:
    """Edges of text lines ``a s t w`` or ``s t [w]``; other lines are skipped, a missing weight is 0, loops are dropped.

    undirected: files hold both directions; the pair counts once, with its smaller end first and the lightest weight.
    """
    found = edge_columns(lines, F.col(line) if isinstance(line, str) else line)
    edges = without_loops(rebased(found) if one_based else found)
    if undirected:
        return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    return edges


def parse_header(lines: DataFrame, line: str = "value") -> tuple[int, int | None] | None:
    """(vertices, edges) that the first header line states; the number of edges need not be right, and is None in files that state vertices only."""
    text = F.col(line)
    number = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("long")
    found = lines.filter(text.rlike(HEADER_LINE) | text.rlike(SHORT_HEADER)).select(F.coalesce(number(HEADER_LINE, 1), number(SHORT_HEADER, 1)), number(HEADER_LINE, 2)).first()
    return (found[0], found[1]) if found else None


def read_text(spark: SparkSession, path: str, one_based: bool = True, undirected: bool = False) -> DataFrame:
    return parse_edge_lines(spark.read.text(path), "value", one_based, undirected)


def with_line_number(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and position from 0 over all files."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return ranked(lines, "file", "block", "at", name="line").select("value", "file", "line")


def read_text_with_id(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """Edges with edge_id, their position among the edges of the file; loops and other lines have none."""
    parsed = edge_columns(with_line_number(spark, path), F.col("value"), "line")
    return ranked(without_loops(rebased(parsed) if one_based else parsed), "line", name="edge_id").drop("line")


def collapse_mirrored(edges: DataFrame, order: str = "line", block: int = BLOCK) -> DataFrame:
    """Drops each line that mirrors the last line kept before it.

    Lines of one pair of ends that follow each other are a run. Its first line is kept, and of the others those in the
    direction of the first; of a loop the first only. Runs go on over the borders of blocks.
    """
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    begun = with_previous(edges, order, pair, "__pair", block).withColumn("__first", F.col("__pair").isNull() | (F.col("__pair") != pair))
    led = filled(begun, order, F.when(F.col("__first"), F.col("src")), "__src", block)
    return led.filter(F.col("__first") | (F.col("src") != F.col("dst")) & (F.col("src") == F.col("__src"))).select(*edges.columns)


def read_dump(spark: SparkSession, path: str, rows: int = DUMP_ROWS) -> DataFrame:
    """Edges of binary dumps, with weights in the file's 32 bits. Files are read in byte ranges of ``rows`` edges, so one of any size is many tasks."""
    size = struct.calcsize(DUMP_HEADER)
    counts = [(uri, struct.unpack(DUMP_HEADER, head)[1]) for uri, head in file_heads(spark, path, size)]
    spans = [(uri, start, min(rows, count - start)) for uri, count in counts for start in range(0, count, rows)]
    schema = "src long, dst long, weight float"
    if not spans:
        return spark.createDataFrame([], schema)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start, count in batch.itertuples(index=False):
                reader = RangeReader(uri)
                part = np.frombuffer(reader.read(size + start * DUMP_EDGE.itemsize, count * DUMP_EDGE.itemsize), dtype=DUMP_EDGE)
                reader.close()
                yield pd.DataFrame({"src": part["src"].astype(np.int64), "dst": part["dst"].astype(np.int64), "weight": part["weight"]})

    return spark.createDataFrame(spans, "uri string, start long, count long").repartition(min(len(spans), 10_000), "uri", "start").mapInPandas(parse, schema)


def dump_bytes(edges: pd.DataFrame, vertices: int, undirected: bool = False) -> bytes:
    """A binary dump of a graph in memory."""
    rows = np.empty(len(edges), dtype=DUMP_EDGE)
    for name in ("src", "dst", "weight"):
        rows[name] = edges[name]
    return struct.pack(DUMP_HEADER, vertices, len(edges), 0, int(undirected), 0) + rows.tobytes()


def write_dumps(edges: DataFrame, path: str, vertices: int, undirected: bool = False) -> int:
    """A folder of dumps, one for each partition, which ``read_dump`` reads as one graph; returns the number of edges."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = [b for b in batches if len(b)]
        if rows:
            table = pd.concat(rows)
            file = AtomicFile(f"{path}/part-{TaskContext.get().partitionId():06d}.dump")
            file.write(dump_bytes(table, vertices, undirected))
            file.close()
            yield pd.DataFrame({"n": [len(table)]})

    return edges.select("src", "dst", "weight").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_edges(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """By the suffix: dump, parquet or text; options are those of ``read_text``, and the other kinds have none."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind in ("dump", "parquet") and options:
        raise ValueError(f"{kind} files have no options: {', '.join(options)}")
    if kind == "dump":
        return read_dump(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path).select("src", "dst", "weight")
    return read_text(spark, path, **options)


def read_adjacency(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """Adjacency lists (vertex, neighbours) of a text file with 1-based ends; loops count, and undirected files give both directions."""
    lines = spark.read.text(path)
    found = rebased(edge_columns(lines, F.col("value")))
    return adjacency(found.union(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if undirected else found)


def edge_text(edges: DataFrame) -> DataFrame:
    """One line for each edge, as the text reader takes it."""
    return edges.select(F.format_string("a %d %d %s", F.col("src") + 1, F.col("dst") + 1, F.col("weight").cast("string")).alias("value"))


def edge_report(edges: DataFrame, position: str = "pos") -> DataFrame:
    return edges.select(F.format_string("Edge %d: (%d,%d) [%.2f]", position, "src", "dst", "weight").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Text for a path that ends with .gr or .txt, a folder of dumps for .dump, else Parquet."""
    if path.endswith((".gr", ".txt")):
        edge_text(edges).write.text(path)
    elif path.endswith(".dump"):
        write_dumps(edges, path, vertices=(edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1)
    else:
        edges.write.parquet(path)

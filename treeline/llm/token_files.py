"""Token-id files of independent zstandard frames.

A file holds frames of whole documents, each frame a zstandard frame of its own; then a skippable
frame with the document index; then, last, the seek table of the public zstandard seekable format: a
skippable frame with the compressed size, the size and the low 32 bits of the XXH64 of each frame.
A reader finds the table from the end of the file, looks documents up in the index and decompresses
only the frames that hold them; each frame's checksum is verified.

A frame's content is its documents' ids as little-endian unsigned integers, 16 bits wide if the
vocabulary allows, else 32. The index holds doc_id, ids and frame of every document, in file order.

Documents are dealt to files by ranges of doc_id, so the files in order hold ascending doc_ids. Files
are written under a name of their own and moved into place: a task that runs twice leaves one file.

Defined cases: a null text is encoded as an empty one (the end id alone remains); rows with a null
doc_id come first; rows that repeat a doc_id are all written, in the order of their texts (equal rows
change nothing by their order); a text of any length is one document of one frame; an empty
table gives no file and no row. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.byte_files import AtomicFile, RangeReader
from ..plans.shared import scratch
from .batches import give_back, parts_of
from .fragments import byte_encoder

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = 0x184D2A50
#: Bytes of ids after which a frame ends with its document.
FRAME_BYTES = 1 << 18
#: Bytes of text for each file, until there are ``MOST_FILES`` of them; then files grow, so manifests stay small.
FILE_BYTES, MOST_FILES = 16 << 20, 200_000
NO_ID = -(2**63)


class TokenFileWriter:
    def __init__(self, uri: str, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.file, self.width, self.frame_bytes = AtomicFile(uri), width, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray, end: bytes = b"") -> None:
        """end: bytes of ids that stand behind the document's own."""
        data = ids.astype(f"<u{self.width}").tobytes() + end
        self.documents.append((NO_ID if doc_id is None else doc_id, len(data) // self.width, len(self.frames)))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            content = b"".join(self.held)
            packed = self.compressor.compress(content)
            self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.file.write(packed)
            self.held, self.held_bytes = [], 0

    def close(self) -> int:
        """Returns the number of ids in the file."""
        self.end_frame()
        index = self.compressor.compress(struct.pack("<B", self.width) + np.array(self.documents, dtype="<i8").reshape(-1, 3).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack("<II", INDEX, len(index)) + index)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()
        return sum(n for _, n, _ in self.documents)


class TokenFileReader:
    def __init__(self, uri: str):
        self.file = RangeReader(uri)
        count, flags, magic = struct.unpack("<IBI", self.file.read(self.file.size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums at its end")
        table = self.file.read(self.file.size - 9 - 12 * count, 12 * count)
        self.frames = np.frombuffer(table, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        magic, size = struct.unpack("<II", self.file.read(int(self.starts[-1]), 8))
        if magic != INDEX:
            raise ValueError(f"{uri}: no document index")
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.starts[-1]) + 8, size))
        self.width = raw[0]
        documents = np.frombuffer(raw[1:], dtype="<i8").reshape(-1, 3)
        self.doc_ids, self.counts, self.frame_of = documents[:, 0], documents[:, 1], documents[:, 2]
        before = np.concatenate([[0], np.cumsum(self.counts)])
        self.starts_in_file = before[:-1]
        first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        self.in_frame = self.starts_in_file - before[first][self.frame_of] if len(documents) else before[:0]

    def frame(self, n: int) -> bytes:
        packed, size, checksum = map(int, self.frames[n])
        content = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.starts[n]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {n} of {self.file.path} is damaged")
        return content

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, position of its first id in the file, and ids: of all documents, or only of these, reading their frames alone."""
        wanted = np.arange(len(self.doc_ids)) if doc_ids is None else np.flatnonzero(np.isin(self.doc_ids, list(doc_ids)))
        at, content = -1, b""
        for n in wanted.tolist():
            if self.frame_of[n] != at:
                at = int(self.frame_of[n])
                content = self.frame(at)
            ids = np.frombuffer(content, dtype=f"<u{self.width}", count=int(self.counts[n]), offset=int(self.in_frame[n]) * self.width)
            yield int(self.doc_ids[n]), int(self.starts_in_file[n]), ids

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, path: str, encode: Callable[[pa.Array], list[np.ndarray]], end_id: int | None = None, width: int = 2, files: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the files and returns their manifest: file, documents, ids and start (ids in the files before it); encode: the ids of each text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // max(FILE_BYTES, size // MOST_FILES)))
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.ids.zst"
        writer, documents = None, 0
        for batch in batches:
            writer = writer or TokenFileWriter(f"{path}/{name}", width, frame_bytes)
            for part in parts_of(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    writer.add(doc_id, ids, end)
            documents += batch.num_rows
        if writer:
            yield pa.RecordBatch.from_pydict({"file": [name], "documents": [documents], "ids": [writer.close()]})
        give_back()

    sorted_rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = sorted_rows.mapInArrow(write, "file string, documents long, ids long").toPandas().sort_values("file")
    manifest["start"] = manifest["ids"].cumsum() - manifest["ids"]
    return spark.createDataFrame(manifest, "file string, documents long, ids long, start long") if len(manifest) else spark.createDataFrame([], "file string, documents long, ids long, start long")


def read_token_files(manifest: DataFrame, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (32-bit little-endian bytes) of all documents, or of those given, from the files."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, before in zip(files["file"], files["start"]):
                reader, held = TokenFileReader(f"{path}/{name}"), []
                for doc_id, at, ids in reader.documents(doc_ids):
                    held.append((None if doc_id == NO_ID else doc_id, before + at, len(ids), ids.astype("<u4").tobytes()))
                    if len(held) >= 2000:
                        yield pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                        held = []
                reader.close()
                yield pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    count = max(1, manifest.count())
    return manifest.repartitionByRange(count, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def encode_byte_level(tokenizer: str) -> Callable[[pa.Array], list[np.ndarray]]:
    return lambda texts: byte_encoder(tokenizer).batch(texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, path, encode_byte_level(public_tokenizers.path("byte_bpe_50k.json")), end_id=2)
    return read_token_files(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""WARC archives with revisit records and a two-level capture index.

Archives hold one gzip member for each record. The index has two levels: capture lines, sorted by
reversed-host url key (com,example)/path), in gzip blocks of a fixed number of lines; and, at the end of
each index file, a sparse directory of its blocks (first key, offset, length). Where the files' own keys begin
is one row for each file, of which there are at most ``MOST_FILES`` (beyond that, files grow).

A look-up of one url or of many searches the files' first keys, the directory of a file, read by range, and the
lines of a block, read by range; then it reads records by range. Many urls are sorted by key and dealt to
the files, so each directory and block is read once.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a
response and the others revisit it; smaller payloads are always responses.

Defined cases: null html is an empty payload; a null url is an empty one; a row with a null page_id is
a response and never the target of a revisit; rows that repeat the largest page_id of a payload are
all responses; an empty table gives no archive and no row; a url of any length is one line, and html of any length one
record; captures with equal keys lie in the order of page_id, file and offset, over as many blocks and files as they
take. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.byte_files import AtomicFile, RangeReader
from ..plans.shared import Stored, scratch

LEAST = 1000
BLOCK_LINES = 512
#: Blocks of an index file, about, until there are ``MOST_FILES`` of them.
FILE_BLOCKS, MOST_FILES = 64, 65_536
#: Characters of a file's first key that every task holds.
KEY_CHARS = 200
DATE = "2024-01-01T00:00:00Z"
UNSAFE = re.compile("[\x00-\x20\x7f]")


def pack(data: bytes) -> bytes:
    """One gzip member without a time, so the same record always gives the same bytes."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def unpack(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def surt(url: str) -> str:
    """com,example)/path?query for http://example.com/path?query."""
    rest = url.partition("://")[2] if "://" in url else url
    host = re.match("[^/?#]*", rest)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{base32}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(refers_to, digest)
        fields["X-Refers-To-Page-Id"] = str(refers_to)
    fields["Content-Length"] = str(len(body))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of an unpacked record, with http (header) and payload (empty for a revisit) in bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields | {"http": http.decode(), "payload": payload}


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    # partial maxima are taken before the shuffle, and only payloads that repeat are left to join
    groups = (
        rows.filter(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "target")
    )
    # the join by digest carries no payload; the one by page_id, which has no hot key, carries each once
    revisits = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
        .filter(F.col("size") >= least)
        .join(groups, "digest")
        .filter(F.col("page_id") < F.col("target"))
        .select("page_id", "digest", F.col("target").alias("refers_to"))
        .distinct()
    )
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


CAPTURES = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Writes the archives; the captures: key, page_id, file, offset and length of each record."""
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, file = f"captures-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            file = file or AtomicFile(f"{path}/{name}")
            out = {"key": [], "page_id": [], "offset": [], "length": []}
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in range(5))):
                page_id, url = page_id.as_py(), url.as_py() or ""
                packed = pack(record(page_id, url, html.as_py(), digest.as_py(), refers_to.as_py()))
                out["key"].append(surt(url))
                out["page_id"].append(page_id)
                out["offset"].append(file.write(packed))
                out["length"].append(len(packed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.string()), pa.array(out["page_id"], pa.int64()), pa.array([name] * batch.num_rows, pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if file:
            file.close()

    # dealt and sorted by content, not by arrival: a task that runs again writes the same archive
    return mark_revisits(pages, least).sortWithinPartitions("page_id", "digest", "url").mapInArrow(write, CAPTURES)


FILES = "first_key string, index_file string, lines long"


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES, files: int = 8) -> DataFrame:
    """Writes the sorted capture lines in compressed blocks, behind them their directory; one row for each file."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, file, held, blocks, lines = f"index-{TaskContext.get().partitionId():06d}.gz", None, [], [], 0

        def end_block() -> None:
            nonlocal held
            packed = pack("\n".join(held).encode())
            blocks.append((json.loads(held[0])[0], file.write(packed), len(packed)))
            held = []

        for batch in batches:
            file = file or AtomicFile(f"{path}/{name}")
            for capture in batch.astype(object).itertuples(index=False):
                key, page_id, *rest = capture
                held.append(json.dumps([key, None if pd.isna(page_id) else int(page_id), *rest]))
                if len(held) == block_lines:
                    end_block()
            lines += len(batch)
        if file:
            if held:
                end_block()
            directory = pack(json.dumps(blocks).encode())
            file.write(directory + struct.pack("<Q", len(directory)))
            file.close()
            yield pd.DataFrame([(blocks[0][0][:KEY_CHARS], name, lines)], columns=["first_key", "index_file", "lines"])

    ordered = captures.repartitionByRange(files, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return ordered.mapInPandas(write, FILES)


class IndexFile:
    """One file of the index: its directory, and the last block read."""

    def __init__(self, uri: str):
        self.reader = RangeReader(uri)
        size = struct.unpack("<Q", self.reader.read(self.reader.size - 8, 8))[0]
        self.directory = json.loads(unpack(self.reader.read(self.reader.size - 8 - size, size)))
        self.at, self.lines = -1, []

    def captures(self, key: str) -> list[list]:
        """The captures of a key, by binary search."""
        found = []
        for n in range(max(0, bisect.bisect_left(self.directory, key, key=lambda b: b[0]) - 1), len(self.directory)):
            first, offset, length = self.directory[n]
            if first > key:
                break
            if n != self.at:
                self.at, self.lines = n, [json.loads(line) for line in unpack(self.reader.read(offset, length)).decode().split("\n")]
            found.extend(self.lines[bisect.bisect_left(self.lines, key, key=lambda c: c[0]) : bisect.bisect_right(self.lines, key, key=lambda c: c[0])])
        return found


class CaptureIndex:
    """The files of an index, of which it holds the first keys."""

    def __init__(self, files: DataFrame, path: str):
        rows = sorted((r.first_key, r.index_file) for r in files.collect())
        self.keys, self.names, self.path = [k for k, _ in rows], [n for _, n in rows], path

    def files_of(self, key: str) -> list[str]:
        """The files that may hold a key: the last that begins before it, and those that begin like it."""
        key = key[:KEY_CHARS]
        return self.names[max(0, bisect.bisect_left(self.keys, key) - 1) : bisect.bisect_right(self.keys, key)]

    def captures(self, url: str) -> list[list]:
        key = surt(url)
        return [c for name in self.files_of(key) for c in IndexFile(f"{self.path}/{name}").captures(key)]

    def records(self, url: str) -> list[dict]:
        return [parse(unpack(RangeReader(f"{self.path}/{f}").read(o, n))) for _, _, f, o, n in self.captures(url)]


def look_up(urls: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The captures of the urls of a table (null: the empty one), each once."""
    index = urls.sparkSession.sparkContext.broadcast(CaptureIndex(files, path))

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = sorted({surt(u or "") for u in batch["url"]})
            rows = [(name, key) for key in keys for name in index.value.files_of(key)]
            yield pd.DataFrame(rows, columns=["index_file", "key"])

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, file = None, None
        for batch in batches:
            for name, rows in batch.groupby("index_file", sort=False):
                if name != at:
                    at, file = name, IndexFile(f"{index.value.path}/{name}")
                found = [c for key in rows["key"] for c in file.captures(key)]
                yield pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    # a key that many rows share is looked up once; each file is one task's
    dealt = urls.select("url").distinct().mapInPandas(deal, "index_file string, key string").distinct()
    count = max(1, len(index.value.names))
    return dealt.repartition(count, "index_file").sortWithinPartitions("index_file", "key").mapInPandas(search, CAPTURES)


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_records(captures: DataFrame, path: str, files: int, payloads: bool = True) -> DataFrame:
    """The records of the captures, read by range: of a revisit, the length and digest of the payload it stands for."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length"))):
                if name != at:
                    if reader:
                        reader.close()
                    at, reader = name, RangeReader(f"{path}/{name}")
                r = parse(unpack(reader.read(offset, length)))
                revisit = r["WARC-Type"] == "revisit"
                stated = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if not revisit and hashlib.sha1(r["payload"]).hexdigest() != stated:
                    raise ValueError(f"{name} at {offset}: the payload is damaged")
                full = int(re.search(r"Content-Length: (\d+)", r["http"])[1])
                page, target = r.get("X-Page-Id"), r.get("X-Refers-To-Page-Id")
                rows.append((None if page is None else int(page), r["WARC-Target-URI"], r["WARC-Type"], r["payload"] if payloads else None, full, stated, None if target is None else int(target)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
        if reader:
            reader.close()

    return captures.repartition(files, "file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def build(pages: DataFrame, path: str, least: int = LEAST, lines_of_block: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """Writes archives and index; the captures and the index's files."""
    captures = Stored(write_archives(pages, path, least), "captures").df
    lines = captures.count()
    files = max(1, min(MOST_FILES, -(-lines // (FILE_BLOCKS * lines_of_block))))
    return captures, Stored(write_index(captures, path, block_lines=lines_of_block, files=files), "index-files").df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures, index_files = build(pages, path)
    files = max(1, captures.select("file").distinct().count())
    records = read_records(look_up(pages, index_files, path), path, files, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH a AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM a)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> target THEN target END AS refers_to FROM b
"""

"""BPE encoding and decoding of whole documents by forced-boundary splitting (see ``fragments``).

Defined cases: a null text is encoded as an empty one, to no ids and an empty decoded text; rows that
repeat stay repeated; an empty table gives no row; a null doc_id stays null; a text of any length is encoded whole. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import PART_BYTES, give_back, parts_of
from .fragments import encoder

TOKENIZER = "word_bpe_49k.json"


def map_rows(rows: DataFrame, value: str, work: Callable[[pa.Array], list], kinds: dict[str, tuple[str, pa.DataType]], at_once: int = PART_BYTES) -> DataFrame:
    """doc_id and the columns that ``work`` makes of arrays of values, a bounded number of bytes or one row at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, at_once):
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(work(part.column(1)), kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *kinds])
        give_back()

    schema = ", ".join(["doc_id long", *(f"{k} {sql}" for k, (sql, _) in kinds.items())])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(value)).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids, as little-endian unsigned 32-bit integers."""

    def work(texts: pa.Array) -> list:
        ids, bounds = encoder(tokenizer).batch(texts)
        data = ids.astype("<u4").tobytes()
        return [[data[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]]

    return map_rows(docs, "text", work, {"ids": ("binary", pa.binary())})


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and decoded text of rows with ids."""

    def work(ids: pa.Array) -> list:
        own = ids.to_pylist()
        all_ids = np.frombuffer(b"".join(i or b"" for i in own), dtype="<u4")
        bounds = np.cumsum([0, *(len(i or b"") // 4 for i in own)])
        return [encoder(tokenizer).decoded(all_ids, bounds).cast(pa.string())]

    return map_rows(encoded, "ids", work, {"decoded": ("string", pa.string())})


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digests of what ``encode_documents`` and ``decode_documents`` give, in one pass."""

    def work(texts: pa.Array) -> list:
        e = encoder(tokenizer)
        ids, bounds = e.batch(texts)
        digests = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in spelled(ids, bounds)] for spelled in (e.numbered, e.decoded)]
        return [np.diff(bounds), *digests]

    kinds = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return map_rows(docs, "text", work, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))

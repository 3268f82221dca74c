"""Texts packed into rows of bounded size, and questions that packs ask bucket by bucket.

A pack holds about PACK_BYTES of text. Operators that need corpus-wide facts about what a text holds let
each pack ask once for each distinct item; items are dealt to buckets by their hash, a bucket answers each
pack, and the answers are joined to the packs. No row or task grows with how often an item occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packs, text_bytes

PACK_BYTES = 4 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 8 << 20
#: Stands for a null doc_id, which is later than all others.
NO_ID = np.iinfo(np.int64).max


def zipped(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unzipped(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, b in enumerate(packs(batches, limit=PACK_BYTES)):
        data, offsets = text_bytes(b.column("text"))
        known = b.column("doc_id")
        ids = known.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        is_null = np.asarray(known.is_null().to_numpy(zero_copy_only=False), dtype=np.uint8)
        head = np.array([len(ids)], dtype=np.int64).tobytes() + ids.astype(np.int64).tobytes() + is_null.tobytes() + offsets.astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([zipped(head + data.tobytes())], pa.binary()), pa.array([len(data)], pa.int64())], ["pack", "texts", "size"])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, which of them are null, offsets and bytes."""
    raw = unzipped(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    at = 8 + 8 * n
    ids = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    is_null = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at)
    at += n
    offsets = np.frombuffer(raw, dtype=np.uint8, count=8 * (n + 1), offset=at).view(np.uint8).tobytes()
    return ids, is_null, np.frombuffer(offsets, dtype=np.int64), np.frombuffer(raw, dtype=np.uint8, offset=at + 8 * (n + 1))


def edges(short: np.ndarray, buckets: int, bits: int = 47) -> np.ndarray:
    """Where each bucket's share of sorted values of so many bits begins and ends."""
    limits = (np.arange(buckets + 1, dtype=np.float64) * (float(1 << bits) / buckets)).astype(np.uint64)
    limits[-1] = np.uint64(1 << bits)
    return np.searchsorted(short, limits)


def by_bucket(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The rows of each bucket, which follow one another."""
    bucket, held, blobs = None, [], []
    for b in batches:
        for k, p, x in zip(b.column("bucket").to_pylist(), b.column("pack").to_pylist(), b.column(column)):
            if k != bucket and held:
                yield bucket, held, blobs
                held, blobs = [], []
            bucket = k
            held.append(p)
            blobs.append(x.as_py())
    if held:
        yield bucket, held, blobs


def packed(docs: DataFrame) -> DataFrame:
    """Rows (pack, texts, size), size in bytes of text, checkpointed in the shared folder, so that Spark cleans them up as it does other checkpoints."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, "pack long, texts binary, size long"))


def bucket_count(table: DataFrame) -> int:
    """A bucket for each BUCKET_BYTES of text, and no fewer than shuffle partitions."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() * PACK_BYTES // BUCKET_BYTES)


def text_buckets(table: DataFrame, least: int = 8) -> int:
    """A bucket for each BUCKET_BYTES of text, into however many partitions and packs it is cut.

    For exchanges in which each bucket sends a row to each other one.
    """
    return max(least, -(-int(table.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))


def dealt(asked: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's rows together, in order of pack."""
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "pack")

"""Shared pieces: checkpoint folder, bounded text blocks, vectorised words and hashes, components."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spread

#: Characters that separate words, as in the pattern [^\x20\x09-\x0D]+
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 2 << 20
#: Bytes that span_hash sums up at once, unless a span is longer: its sums take 24 bytes for each and stay in the cache.
HASH_BYTES = 1 << 17

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the folder in spark.checkpoint.dir; where that is unset, a local master gets a local one and a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the driver notice which shuffles and checkpoints nothing refers to any more, so that Spark's cleaner takes their files.

    Else they stay until the driver's heap happens to be collected.
    """
    for _ in range(3):  # what Python lets go of reaches the JVM some moments later, and the cleaner works beside it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where its files have fewer splits than that."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits are usable."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _M, dtype=np.uint64), np.full(n, _M_INV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for sorted, possibly empty spans, in blocks of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        size = int(ends[j - 1] - base)
        # Powers for longer spans are not kept, as they would stay in a worker for all that it runs later.
        up, down = _powers(HASH_BYTES) if size <= HASH_BYTES else _powers.__wrapped__(size)
        prefix = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_byte_table(seed)[data[base : base + size]] * up[:size], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of every word of the concatenated texts; words never cross texts."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts joined, and n + 1 offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = text_bytes(batch.column(column))[1][1:]
        i = 0
        while i < batch.num_rows:
            done = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def packs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to about limit bytes of text each."""
    held, size = [], 0
    for b in blocks(batches, column, limit):
        n = len(text_bytes(b.column(column))[0])
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for every span, joined."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


#: An edge takes a hundredth of the bytes of a text, so edges are kept in fewer partitions.
TEXTS_PER_EDGE_PARTITION = 16


def _few(df: DataFrame) -> DataFrame:
    return df.coalesce(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // TEXTS_PER_EDGE_PARTITION))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) for every end of the edges (a, b): component is the least id that is reachable.

    Alternating large-star and small-star rounds; each ends in a checkpoint, so lineage stays short and
    no link reaches the driver. Minima are aggregated before the shuffle, and a hub's links meet its minimum
    in a join of two plain tables, which Spark can split.
    """
    known = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    # What makes the edges may be heavy and keeps its partitions; the checkpoint is read in few.
    spark_edges = _few(cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")))
    before = known(spark_edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # Large star: each node links its larger neighbours to the least of its neighbours and itself.
        both = spark_edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _few(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # Small star: each node links itself and its smaller neighbours to the least of them.
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u")
        linked = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = cut(_few(_few(linked.where("a <> b")).distinct()))
        spark_edges, last, before = after, before, known(after)
        if last == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = spark_edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return spark_edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)

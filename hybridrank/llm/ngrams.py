"""Character n-grams over small alphabets, and their counts per key, summed without one hot task; n-grams of code points as they are."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

CHUNKS = 16
SALTS = 8
MOST_HELD = 8


#: Code points with an entry of their own; there are no letters from the last one on.
POINTS = 0x33000


@lru_cache(maxsize=2)
def letter_scripts() -> tuple[np.ndarray, list[str]]:
    """For each code point the number of its letter's script, 0 for what is no letter, and the scripts' names, the first empty."""
    names = {"": 0}
    out = np.zeros(POINTS, dtype=np.uint16)
    for c in range(POINTS):
        x = chr(c)
        if x.isalpha():
            out[c] = names.setdefault(unicodedata.name(x, "").split(" ")[0], len(names))
    return out, list(names)


@lru_cache(maxsize=2)
def letter_alphabet() -> np.ndarray:
    """Symbols below 63: 0 anything but letters, 1-26 a-z, 27-62 other lower-case letters by code point. 63 parts texts."""
    out = np.zeros(POINTS, dtype=np.uint8)
    for c in range(POINTS):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    out[0] = 63
    return out


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of 0 as one, a parting symbol before each text; and each symbol's text number."""
    part = table[0]
    joined = "\0" + "\0".join(x.replace("\0", " ") for x in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = table[np.minimum(points, POINTS - 1)] if points.max(initial=0) >= POINTS else table[points]
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    out = out[keep]
    return out, np.cumsum(out == part) - 1


def codes(seq: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each symbol but the parting one, and where they end; what is before a text counts as 0."""
    part = (1 << bits) - 1
    at = np.flatnonzero(seq != part)
    out = seq[at].astype(np.int32)
    open_ = np.ones(len(at), dtype=bool)
    for k in range(1, order):
        back = at - k
        before = seq[np.maximum(back, 0)]
        open_ &= (before != part) & (back >= 0)
        out |= np.where(open_, before, 0).astype(np.int32) << (bits * k)
    return out, at


#: Stands before a text; all code points are below it. Symbols take POINT_BITS bits.
BEFORE = 0x110000
POINT_BITS = 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hash(grams: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, whose symbols are given place by place."""
    out = np.full(len(grams[0]) if grams else 0, len(grams), dtype=np.uint64)
    for x in grams:
        out = (out + x.astype(np.uint64) + np.uint64(1)) * _STEP
    return mix(out)


def text_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts joined, as they are, and each text's number of them."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def point_grams(points: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """The symbols of the n-gram that ends at each code point, place by place; what is before a text counts as BEFORE."""
    starts = np.cumsum(lengths) - lengths
    out = [points]
    for k in range(1, order):
        back = np.full(len(points), BEFORE, dtype=np.uint32)
        back[k:] = points[: len(points) - k]
        for j in range(k):
            back[(starts + j)[lengths > j]] = BEFORE
        out.insert(0, back)
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of each of them in hashes, and for each hash the number of its distinct one."""
    coded = pa.array(hashes).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    first = np.empty(len(coded.dictionary), dtype=np.int64)
    first[number[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return coded.dictionary.to_numpy(zero_copy_only=False), first, number


def _emit(held: dict[str, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    for key, counts in held.items():
        step = max(1, len(counts) // CHUNKS)
        rows = []
        for c in range(CHUNKS):
            own = counts[c * step : (c + 1) * step]
            index = np.flatnonzero(own)
            if len(index):
                rows.append((c, (index + c * step).astype(np.int32).tobytes(), own[index].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["key", "chunk", "salt", "grams", "counts"],
            )


_SCHEMA = "key string, chunk int, salt int, grams binary, counts binary"


def _merge(table: pa.Table) -> pa.Table:
    index = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in table["grams"].to_pylist()])
    counts = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["counts"].to_pylist()])
    unique, where = np.unique(index, return_inverse=True)
    total = np.zeros(len(unique), dtype=np.int64)
    np.add.at(total, where, counts)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.table({"key": pa.array([first["key"]]), "chunk": pa.array([first["chunk"]], pa.int32()), "salt": pa.array([first["salt"]], pa.int32()), "grams": pa.array([unique.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})


def count_grams(docs: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, np.ndarray]]]) -> DataFrame:
    """(key, chunk, grams, counts): count yields a key and n-gram codes below size for each block of rows.

    Each task adds its blocks up, then tasks are added up in two steps, the first salted; a row holds a
    sixteenth of the codes of one key, so no row or group grows with the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, np.ndarray] = {}
        for key, grams in count(batches):
            if key not in held and len(held) >= MOST_HELD:
                yield from _emit(held, salt)
                held = {}
            own = np.bincount(grams, minlength=size)
            held[key] = held[key] + own if key in held else own
        yield from _emit(held, salt)

    parts = docs.mapInArrow(run, _SCHEMA)
    once = parts.groupBy("key", "chunk", "salt").applyInArrow(_merge, _SCHEMA)
    return once.withColumn("salt", F.lit(0)).groupBy("key", "chunk").applyInArrow(_merge, _SCHEMA).drop("salt")


def gathered(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Codes and counts per key on the driver: at most size entries a key, however many documents there are."""
    out: dict[str, list] = {}
    for row in counts.select("key", "chunk", "grams", "counts").toLocalIterator():
        out.setdefault(row["key"], []).append((row["chunk"], np.frombuffer(bytes(row["grams"]), dtype=np.int32), np.frombuffer(bytes(row["counts"]), dtype=np.int64)))
    return {k: (np.concatenate([x[1] for x in sorted(v, key=lambda x: x[0])]), np.concatenate([x[2] for x in sorted(v, key=lambda x: x[0])])) for k, v in sorted(out.items())}

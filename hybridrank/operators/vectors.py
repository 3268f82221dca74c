"""Products of a stated set of query vectors with all vectors, block by block.

Vectors and queries are packed into rows that hold a matrix each; a pack of vectors meets each pack of
queries in one matrix product. Query packs are broadcast in groups whose size is bounded before they are made, so
any number of queries takes bounded memory, and one more pass over the vectors for each group. A pair of packs
gives at most k rows for each of its queries; Spark's ranked window merges them, first within each task.

Null vectors and those with a null or non-finite component take no part, and vectors meet only queries of their
own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a pack's matrix, of the query packs broadcast at once, and of the scores held at once.
PACK_BYTES, QUERY_BYTES, SCORE_BYTES = 1 << 20, 32 << 20, 16 << 20
DIGITS = 9


def _packer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(dim: int, ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        key, matrix = pa.concat_arrays(ids), np.concatenate(rows)
        order = pc.sort_indices(key)  # equal scores go to the smaller id, so ids ascend
        matrix = np.ascontiguousarray(matrix[order.to_numpy()])
        listed = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key.take(order))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), listed, pa.array([matrix.tobytes()], pa.binary())], ["dim", "ids", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[pa.Array], list[np.ndarray]]] = {}
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column("vector")), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                own = b.filter(pa.array(lengths == dim))
                values = own.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                fine = np.isfinite(values).all(axis=1)
                most = max(1, size // (8 * dim))
                ids, values = own.column("id").filter(pa.array(fine)), values[fine]
                at = 0
                while at < len(ids):
                    group = held.setdefault(dim, ([], []))
                    take = min(len(ids) - at, most - sum(map(len, group[0])))
                    group[0].append(ids[at : at + take])
                    group[1].append(values[at : at + take])
                    at += take
                    if sum(map(len, group[0])) >= most:
                        yield pack(dim, *held.pop(dim))
        for dim, group in held.items():
            yield pack(dim, *group)

    return run


def packs(rows: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """(dim, ids, matrix) of rows (id, vector); at most size bytes to a matrix, or one row."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_packer(size), f"dim int, ids array<{kind}>, matrix binary")


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each row after rounding; of equal ones those of the least columns."""
    m, n = scores.shape
    if k >= n:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    rounded = np.round(scores, DIGITS)
    bar = np.partition(rounded, n - k, axis=1)[:, n - k, None]
    above = rounded > bar
    ties = rounded == bar
    left = k - above.sum(axis=1)
    row, column = np.nonzero(ties)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    keep = number < left[row]
    above[row[keep], column[keep]] = True
    return np.nonzero(above)


def _multiplier(k: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                ids, asked = b.column("ids")[r].values, b.column("asked")[r].values
                vectors = np.frombuffer(b.column("matrix")[r].as_buffer(), dtype=np.float64).reshape(-1, dim)
                queries = np.frombuffer(b.column("queries")[r].as_buffer(), dtype=np.float64).reshape(-1, dim)
                step = max(1, SCORE_BYTES // (8 * len(vectors)))
                for at in range(0, len(queries), step):
                    scores = queries[at : at + step] @ vectors.T
                    row, column = best_columns(scores, k or len(vectors))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(row + at)), ids.take(pa.array(column)), pa.array(scores[row, column])], ["query_id", "doc_id", "score"])

    return run


def products(queries: DataFrame, vectors: DataFrame, k: int | None = None, pack_bytes: int = PACK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, doc_id, score): dot products of queries (query_id, vector) and vectors (doc_id, vector).

    With k at least the k best of each query, ties by doc_id, and few others; without k all of them.
    """
    asked = queries.select(F.col("query_id").alias("id"), "vector")
    facts = asked.agg(F.sum(F.coalesce(F.size("vector"), F.lit(0)) * 8 + 64).alias("bytes")).first()
    groups = max(1, -(-int(facts["bytes"] or 0) // query_bytes))
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()]
    held = packs(vectors.select(F.col("doc_id").alias("id"), "vector"), pack_bytes)
    out = None
    for g in range(groups):
        own = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        sides = packs(own.coalesce(1) if groups == 1 else own, pack_bytes).select("dim", F.col("ids").alias("asked"), F.col("matrix").alias("queries"))
        part = held.join(F.broadcast(sides), "dim").mapInArrow(_multiplier(k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
        out = part if out is None else out.unionAll(part)
    return out

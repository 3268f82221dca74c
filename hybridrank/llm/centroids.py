"""Centroid clustering by sort-means over whole-number vectors.

Each component x becomes floor(SCALE * x). In every round each centroid has the others in order of their
distance from it; a vector scans them from its previous centroid on, and stops at the first one strictly
beyond twice its distance from that centroid, as none from there on can be nearer or as near. All distances
are squares of whole numbers, so the bound and every tie are exact; of centroids as near, the one of smaller
number wins. Vectors and their clusters stay in a checkpointed table, tasks keep the sums of their own
vectors, and only those sums, CLUSTERS rows of them, reach the driver.

Vectors that are null, of another length or with a null or non-finite component are left out. Components
beyond +-2**26 count as that. Sums beyond 64 bits count as the largest such number. Repeated rows count once each; a null vec_id is hashed as an empty one and
comes last among equal hashes; equal hashes go by vec_id, then vector. With fewer vectors than clusters there are
as many clusters as vectors; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Twice this, squared and summed up over 64 components, still fits into four times itself.
MOST = 1 << 26
_WIDTHS = (np.int8, np.int16, np.int32)


def packed(values: np.ndarray) -> pa.Array:
    """Each row of whole numbers as bytes, in the narrowest type that holds all of them."""
    kind = next(t for t in _WIDTHS if not values.size or (values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max))
    raw = np.ascontiguousarray(values.astype(kind))
    width = raw.itemsize * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The rows as 64-bit numbers; rows of one batch may come in different types."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // dim
    out = np.empty((len(column), dim), dtype=np.int64)
    for kind in _WIDTHS:
        at = np.flatnonzero(sizes == np.dtype(kind).itemsize)
        if len(at):
            own = column if len(at) == len(column) else column.take(pa.array(at))
            own = pa.concat_arrays([own])
            offsets = np.frombuffer(own.buffers()[1], dtype=np.int32)[own.offset : own.offset + len(own) + 1]
            out[at] = np.frombuffer(own.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(at), dim)
    return out


def _quantize(dim: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
            b = b.filter(right)
            flat = b.column("vector").flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes NaN
            fine = np.isfinite(values).all(axis=1)
            whole = np.clip(np.floor(np.clip(values[fine], -MOST, MOST) * scale), -MOST, MOST).astype(np.int64)
            ids = b.column("vec_id").filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, packed(whole), pa.array(np.zeros(len(whole), dtype=np.int32)), pa.array(np.zeros(len(whole), dtype=np.int64))], ["vec_id", "vector", "cluster", "distance"])

    return run


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def sort_means(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many distances were computed."""
    near = np.stack([squared(centroids, c) for c in centroids])
    order = np.argsort(near, axis=1, kind="stable")
    cluster = previous.copy()
    distance = squared(x, centroids[previous])
    done = len(x)
    for c in np.unique(previous):
        own = np.flatnonzero(previous == c)
        own = own[np.argsort(-distance[own], kind="stable")]
        reach = -4 * distance[own]  # ascending; a centroid at near is within reach of the first rows
        for other in order[c]:
            live = own[: np.searchsorted(reach, -near[c, other], side="right")]
            if not len(live):
                break
            if other == c:
                continue
            d = squared(x[live], centroids[other])
            done += len(live)
            better = (d < distance[live]) | ((d == distance[live]) & (other < cluster[live]))
            distance[live[better]], cluster[live[better]] = d[better], other
    return cluster, distance, done


def _assign(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column("vector"), centroids.shape[1])
            cluster, distance, _ = sort_means(x, b.column("cluster").to_numpy(zero_copy_only=False), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "vector", "cluster", "distance"])

    return run


def _sums(clusters: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((clusters, dim), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for b in batches:
            cluster = b.column("cluster").to_numpy(zero_copy_only=False)
            x = unpacked(b.column("vector"), dim)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += x[own].sum(axis=0)
                count[c] += own.sum()
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def first_centroids(vectors: DataFrame, clusters: int, dim: int, seed: int) -> np.ndarray:
    """The vectors whose `seed:vec_id` has the smallest hashes; clusters rows, whatever the table holds."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vec_id", "vector").orderBy("key", F.col("vec_id").asc_nulls_last(), "vector").limit(clusters).collect()
    return unpacked(pa.array([bytes(r.vector) for r in rows], pa.binary()), dim) if rows else np.empty((0, dim), dtype=np.int64)


def moved(centroids: np.ndarray, assigned: DataFrame) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k, dim = centroids.shape
    partial = assigned.select("vector", "cluster").mapInArrow(_sums(k, dim), "cluster int, n long, total array<bigint>")
    rows = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]).collect()  # k rows at most
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of vectors (vec_id, vector), checkpointed, and the last centroids as whole numbers."""
    if dim > DIMENSIONS:
        raise ValueError(f"distances of more than {DIMENSIONS} components may not fit into 64 bits")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, vector binary, cluster int, distance long"
    state = cut(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_quantize(dim, scale), schema))
    centroids = first_centroids(state, clusters, dim, seed)
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance"), centroids
    for _ in range(rounds):
        state = cut(state.mapInArrow(_assign(centroids), schema))
        centroids = moved(centroids, state)
    return cut(state.mapInArrow(_assign(centroids), schema)).select("vec_id", "cluster", "distance"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256. Facts of clusters are as few as those and are broadcast."""
    most = (1 << 63) - 1
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(i, min(most, sums.get(i, 0)), digest(c.tolist())) for i, c in enumerate(centroids)]
    known = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(min(most, sum(sums.values()))).cast("long")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))))


def _sql() -> str:
    """All rounds as one statement: c<r> are the centroids before round r, a<r> their nearest vectors."""
    assign = "a{r} AS MATERIALIZED (SELECT id, cluster, d FROM (SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, row_number() OVER (PARTITION BY v.id ORDER BY d, c.cluster) AS rk FROM v, c{r} c) WHERE rk = 1)"
    move = """c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT cluster, list(q ORDER BY i) AS c FROM (
    SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM (SELECT cluster, unnest(v.v) AS x, unnest(range(64)) AS i FROM a{r} a JOIN v USING (id)) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
    steps = [f"{assign}, {move}".format(r=r, n=r + 1) for r in range(ROUNDS)] + [assign.format(r=ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), vec_id) - 1 AS cluster, v AS c FROM v QUALIFY cluster < {CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (id) JOIN c{ROUNDS} c USING (cluster)
"""


OP12_SQL = _sql()

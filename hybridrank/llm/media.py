"""Cropped or edited copies of images, by local descriptors.

Corners are found at two scales, each gets the orientation of its intensity centroid and TESTS binary
intensity tests on positions turned by it. Descriptors are joined through Hamming tables: cut into BANDS
parts, two descriptors are compared where a part is equal, and match within MOST_BITS different bits. Two
images are copies if at least LEAST_INLIERS matches agree on one rotation, scale and shift.

Images are binary PGM (P5). Identical images are one class and are compared once. Queries are searched in
blocks of at most QUERY_BLOCK classes, whose descriptors alone are broadcast, against all classes.

Defined edge cases: a null, empty or unreadable image has no corners and matches nothing; images smaller than
a patch have none either; repeated rows share their class; an empty table gives an empty result; no corner,
match or candidate is dropped for number; columns other than media_id and image are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, expand, table

RADIUS, TESTS, BANDS, MOST_BITS, LEAST_INLIERS = 7, 256, 8, 32, 6
LEAST_RESPONSE = 0.01
QUERY_BLOCK = 2000
CROP, GAIN, LIFT = (9, 4, 6, 3), 0.8, 20.0
_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", TESTS // 8)])
_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def read_pgm(raw: bytes | None) -> np.ndarray | None:
    m = _HEAD.match(raw) if raw else None
    if not m or int(m[3]) != 255 or len(raw) - m.end() < int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(raw, dtype=np.uint8, count=int(m[1]) * int(m[2]), offset=m.end()).reshape(int(m[2]), int(m[1]))


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def drawn(vector: np.ndarray, size: int = 64) -> np.ndarray:
    """A grainy picture of overlapping rectangles that a vector decides: stands in for a media column."""
    rng = np.random.default_rng(np.frombuffer(hashlib.sha256(np.asarray(vector, dtype="<f4").tobytes()).digest(), dtype=np.uint32))
    image = np.full((size, size), 128.0)
    for x, y, w, h, c in rng.integers((0, 0, 6, 6, 0), (size, size, 26, 26, 256), size=(24, 5)):
        image[y : y + h, x : x + w] = c
    return np.clip(image + rng.normal(0, 12, size=image.shape), 0, 255).astype(np.uint8)


def edited(image: np.ndarray) -> np.ndarray:
    """A cropped copy of less contrast."""
    top, left, bottom, right = CROP
    return np.clip(image[top : image.shape[0] - bottom, left : image.shape[1] - right] * GAIN + LIFT, 0, 255).astype(np.uint8)


@lru_cache(maxsize=1)
def _tests() -> np.ndarray:
    return np.clip(np.random.default_rng(5).normal(0, RADIUS / 2.2, size=(TESTS, 2, 2)), -RADIUS / 1.42, RADIUS / 1.42)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]


def describe(image: np.ndarray | None) -> np.ndarray:
    """Points with descriptors of an image at scales 1 and 2."""
    found = []
    for scale in (1, 2):
        if image is None or min(image.shape) // scale < 2 * RADIUS + 3:
            break
        a = image.astype(np.float64)
        if scale > 1:
            h, w = (n // scale * scale for n in a.shape)
            a = a[:h, :w].reshape(h // scale, scale, w // scale, scale).mean(axis=(1, 3))
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 1), _box(gy * gy, 1), _box(gx * gy, 1)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = np.pad(response, 2, constant_values=-np.inf)
        peak = np.max([top[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5)], axis=0)
        good = (response == peak) & (response > LEAST_RESPONSE * max(response.max(), 1e-9))
        good[:RADIUS], good[-RADIUS:], good[:, :RADIUS], good[:, -RADIUS:] = False, False, False, False
        y, x = np.nonzero(good)
        if not len(x):
            continue
        smooth = _box(a, 1)
        dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
        disc = dx * dx + dy * dy <= RADIUS * RADIUS
        dx, dy = dx[disc], dy[disc]
        patch = a[y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        t = _tests()
        tx = np.rint(x[:, None, None] + c * t[..., 0] - s * t[..., 1]).astype(int)
        ty = np.rint(y[:, None, None] + s * t[..., 0] + c * t[..., 1]).astype(int)
        v = smooth[ty, tx]
        out = np.empty(len(x), dtype=_POINT)
        out["x"], out["y"], out["scale"], out["angle"] = x * scale, y * scale, scale, angle
        out["bits"] = np.packbits(v[..., 0] < v[..., 1], axis=1)
        found.append(out)
    return np.concatenate(found) if found else np.empty(0, dtype=_POINT)


def descriptors(media: DataFrame) -> DataFrame:
    """(media_id, digest, points) of (media_id, image); an unreadable image has a null digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                images = [read_pgm(x.as_py()) for x in part.column("image")]
                digests = [None if m is None else hashlib.sha256(repr(m.shape).encode() + m.tobytes()).digest() for m in images]
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(digests, pa.binary()), pa.array([describe(m).tobytes() for m in images], pa.binary())], ["media_id", "digest", "points"])

    return media.select(F.col("media_id").cast("long").alias("media_id"), "image").mapInArrow(run, "media_id long, digest binary, points binary")


class Tables:
    """Hamming tables of the descriptors of a block of queries."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        points = [np.frombuffer(p, dtype=_POINT) for _, p in rows]
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(p) for p in points])
        self.points = np.concatenate(points) if points else np.empty(0, dtype=_POINT)
        self.parts = _parts(self.points)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.parts, self.order, axis=0)

    def search(self, points: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, owner, inliers) of the images that agree with a query."""
        if not len(points) or not len(self.points):
            return []
        parts, pairs = _parts(points), []
        for k in range(parts.shape[1]):
            lo = np.searchsorted(self.sorted[:, k], parts[:, k], side="left")
            n = np.searchsorted(self.sorted[:, k], parts[:, k], side="right") - lo
            pairs.append(np.repeat(np.arange(len(points)), n) * len(self.points) + self.order[expand(lo, n), k])
        j, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.points))
        near = np.bitwise_count(points["bits"][j] ^ self.points["bits"][i]).sum(axis=1) <= MOST_BITS
        j, i = j[near], i[near]
        a, b = self.points[i], points[j]
        turn = np.mod(b["angle"] - a["angle"] + np.pi, 2 * np.pi) - np.pi
        size = b["scale"] / a["scale"]
        c, s = np.cos(turn) * size, np.sin(turn) * size
        votes = np.stack([self.owner[i], owner[j], np.rint(turn / (np.pi / 8)).astype(int) % 16, np.rint(np.log2(size)).astype(int)], axis=1)
        sx, sy = b["x"] - (c * a["x"] - s * a["y"]), b["y"] - (s * a["x"] + c * a["y"])
        best: dict[tuple[int, int], int] = {}
        for fx in (0.0, 0.5):  # bins of shift that overlap, so that no agreeing group is split by an edge
            for fy in (0.0, 0.5):
                key = np.concatenate([votes, np.floor(sx / 8 + fx).astype(int)[:, None], np.floor(sy / 8 + fy).astype(int)[:, None]], axis=1)
                found, count = np.unique(key, axis=0, return_counts=True)
                for row, n in zip(found[count >= LEAST_INLIERS].tolist(), count[count >= LEAST_INLIERS].tolist()):
                    best[row[0], row[1]] = max(n, best.get((row[0], row[1]), 0))
        return [(int(self.ids[q]), o, n) for (q, o), n in best.items()]


def _parts(points: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(points["bits"]).view(np.uint32).reshape(len(points), TESTS // 32)[:, :BANDS]


def _classes(described: DataFrame) -> DataFrame:
    return described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("media_id").alias("class_id"))


def copies(media: DataFrame, queries: DataFrame) -> DataFrame:
    """For each row of media: media_id, class_id, and the classes of queries it is a copy of, with inliers.

    queries are (media_id, image) too; a class of queries goes by its least media_id.
    """
    spark = media.sparkSession
    own, asked = cut(descriptors(media)), cut(descriptors(queries))
    classes = cut(_classes(own))
    index = own.join(classes.withColumnRenamed("class_id", "media_id"), ["digest", "media_id"]).select("media_id", "points")
    query_classes = cut(asked.join(_classes(asked).withColumnRenamed("class_id", "media_id"), ["digest", "media_id"]).select("media_id", "points").dropDuplicates(["media_id"]))
    blocks = max(1, -(-query_classes.count() // QUERY_BLOCK))
    found = None
    for k in range(blocks):
        rows = [(r["media_id"], bytes(r["points"])) for r in query_classes.where(F.pmod(F.xxhash64("media_id"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(Tables(rows))
        hits = index.mapInArrow(_search(shared), "class_id long, query_id long, inliers long")
        found = hits if found is None else found.unionAll(hits)
    matched = found.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("query_id", "inliers"))).alias("copy_of"))
    rows = own.join(classes, "digest", "left").select("media_id", F.coalesce("class_id", "media_id").alias("class_id"))
    return rows.join(matched, "class_id", "left").select("media_id", "class_id", "copy_of")


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = part.column("media_id").to_pylist()
                points = [np.frombuffer(x.as_py(), dtype=_POINT) for x in part.column("points")]
                owner = np.repeat(np.arange(len(ids)), [len(p) for p in points])
                hits = shared.value.search(np.concatenate(points), owner)
                yield pa.RecordBatch.from_arrays([pa.array([ids[o] for _, o, _ in hits], pa.int64()), pa.array([q for q, _, _ in hits], pa.int64()), pa.array([n for _, _, n in hits], pa.int64())], ["class_id", "query_id", "inliers"])

    return run


def as_media(vectors: DataFrame, edit: bool = False) -> DataFrame:
    """(media_id, image) drawn from (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                images = [None if v is None else drawn(v) for v in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([None if m is None else write_pgm(edited(m) if edit else m) for m in images], pa.binary())], ["media_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"media_id {vectors.schema['vec_id'].dataType.simpleString()}, image binary")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings, drawn, against edited copies of those whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return copies(as_media(vectors), as_media(vectors.where(F.col("vec_id") % 50 == 0), edit=True))

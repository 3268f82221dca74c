"""An index as versioned Parquet tables: builds, keyed upserts, deletions, compaction and removal of old versions.

Every change writes a folder of its own with the rows of the documents that it changes. A manifest, written last,
names the folders that count; until then readers keep the manifest before. A row counts as long as no later
folder has its document, so a changed document replaces all of its rows, in every table, at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..operators import chunking, retrieval

if TYPE_CHECKING:
    from . import Config, Engine

Embed = Callable[[DataFrame], DataFrame]
TABLES = ("documents", "chunks", "postings", "vectors")
CHUNK_KEY = r"^(.*)::\d+$"


class Busy(RuntimeError):
    """Another change of the index is going on, or one ended without taking its lock back."""


class Snapshot:
    """The index of a configuration below root, in a folder of the configuration's fingerprint.

    Documents are (doc_id, text, ...) with unique ids; the id as text is their key. embed, if given, maps
    (doc_id, text) to (doc_id, vector): chunks then get vectors in the same version, and semantic chunks are
    made of texts. All vectors of an index have one length; another fails the write.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config, embed: Embed | None = None) -> None:
        self.spark, self.config, self.embed = spark, config, embed
        self.path = f"{root.rstrip('/')}/index-{config.index_fingerprint()}"

    # -- files --------------------------------------------------------------------------------------------------
    def _at(self, *parts: str) -> Any:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        system, path = self._at(*parts)
        return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []

    def _read(self, *parts: str) -> str:
        system, path = self._at(*parts)
        stream = system.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        """A small file that appears whole, under a name that is free."""
        system, path = self._at(*parts)
        half = path.suffix(".part")
        stream = system.create(half, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.rename(half, path):
            raise Busy(f"{path} exists")

    @contextmanager
    def _changing(self, break_lock: bool) -> Iterator[None]:
        system, lock = self._at("lock")
        system.mkdirs(lock.getParent())
        if break_lock:
            system.delete(lock, False)
        if not system.createNewFile(lock):
            raise Busy(f"{lock} is held; break_lock=True takes it over from a change that did not end")
        try:
            yield
        finally:
            system.delete(lock, False)

    # -- manifests ----------------------------------------------------------------------------------------------
    def manifests(self) -> list[dict[str, Any]]:
        """All manifests that are there, oldest first."""
        return [json.loads(self._read("manifests", name)) for name in self._names("manifests") if name.endswith(".json")]

    def manifest(self) -> dict[str, Any] | None:
        found = [name for name in self._names("manifests") if name.endswith(".json")]
        return json.loads(self._read("manifests", found[-1])) if found else None

    def needs_rebuild(self) -> bool:
        found = self.manifest()
        return not found or found["fingerprint"] != self.config.index_fingerprint() or not found["n_chunks"]

    def _next(self) -> str:
        """A version name beyond all that were ever begun."""
        names = [*self._names(), *[n.partition(".")[0] for n in self._names("manifests")]]
        last = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
        return f"v{last + 1:08d}"

    def _commit(self, version: str, parts: list[str], dim: int | None) -> dict[str, Any]:
        facts = self._view("chunks", parts).agg(F.count("*").alias("n_chunks"), F.countDistinct("key").alias("n_documents"), F.avg("n_tokens").alias("avgdl")).first() if parts else None
        told = {"version": version, "parts": parts, "fingerprint": self.config.index_fingerprint(), "config": self.config.to_json(), "dim": dim, "n_chunks": facts.n_chunks if facts else 0, "n_documents": facts.n_documents if facts else 0, "avgdl": float(facts.avgdl or 0) if facts else 0.0}
        self._write(json.dumps(told, sort_keys=True), "manifests", f"{version}.json")
        return told

    # -- tables -------------------------------------------------------------------------------------------------
    def _part(self, version: str, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{version}/{name}") if name in self._names(version) else None

    def _view(self, name: str, parts: list[str]) -> DataFrame:
        """The rows of a table that count: those of documents that no later part has. Of repeated vectors the last ones count."""
        out = later = seen = None
        for version in reversed(parts):
            rows = self._part(version, name)
            if rows is not None:
                own = rows.join(later, "key", "left_anti") if later is not None else rows
                if name == "vectors" and seen is not None:
                    own = own.join(seen, "doc_id", "left_anti")
                out = own if out is None else out.unionByName(own, allowMissingColumns=True)
                if name == "vectors":
                    ids = rows.select("doc_id")
                    seen = ids if seen is None else seen.unionAll(ids)
            keys = self._part(version, "keys")
            if keys is not None:
                keys = keys.select("key")
                later = keys if later is None else later.unionAll(keys)
        if out is None:
            raise ValueError(f"no {name} in {self.path}")
        return out

    def table(self, name: str) -> DataFrame:
        found = self.manifest()
        if not found or not found["parts"]:
            raise ValueError(f"no index at {self.path}")
        return self._view(name, found["parts"])

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.table("chunks").where(F.col("chunk_id") == chunk_id)

    def chunk_ids(self) -> DataFrame:
        return self.table("chunks").orderBy("doc_id", "ordinal").select("chunk_id")

    def vectors(self, ids: DataFrame) -> DataFrame:
        return self.table("vectors").join(ids.select("doc_id"), "doc_id", "left_semi")

    # -- changes ------------------------------------------------------------------------------------------------
    def _chunks(self, docs: DataFrame) -> DataFrame:
        c = self.config.chunk
        if c.get("strategy") == "semantic" and "vector" not in docs.columns:
            return chunking.chunk(docs.select("doc_id", "text"), **c, embed=self.embed)
        return chunking.chunk(docs.select(*[x for x in ("doc_id", "ordinal", "text", "vector") if x in docs.columns]), **c)

    def _checked(self, vectors: DataFrame, dim: int) -> DataFrame:
        return vectors.where(F.assert_true(F.size("vector") == dim, F.lit(f"a vector must have {dim} values")).isNull())

    def _write_documents(self, version: str, docs: DataFrame, dim: int | None) -> int | None:
        """All tables of docs below the version, and the length of their vectors."""
        c = self.config
        at = lambda name: f"{self.path}/{version}/{name}"
        key = F.col("doc_id").cast("string").alias("key")
        docs.select("*", key).write.mode("overwrite").parquet(at("documents"))
        known = self.spark.read.parquet(at("documents"))
        # Rows of the semantic strategy are sentences, several to a document.
        if "ordinal" not in known.columns and known.groupBy("key").count().where("count > 1 OR key IS NULL").take(1):
            raise ValueError("documents need ids, each of its own")
        known.select("key", F.lit(False).alias("gone")).distinct().write.mode("overwrite").parquet(at("keys"))
        chunks = self._chunks(known).select(F.concat_ws("::", F.col("doc_id").cast("string"), "ordinal").alias("chunk_id"), key, "*", F.size(lexical_tokens(F.col("text"), False)).alias("n_tokens"))
        chunks.write.mode("overwrite").parquet(at("chunks"))
        passages = self.spark.read.parquet(at("chunks")).select(F.col("chunk_id").alias("doc_id"), "text")
        # Ranges of (term, passage) split a frequent term's list over files.
        lists = retrieval.postings(passages, c.stemmed, c.truncate).withColumn("key", F.regexp_extract("doc_id", CHUNK_KEY, 1))
        lists.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(at("postings"))
        if not self.embed:
            return dim
        made = self.embed(passages).select("doc_id", "vector", F.regexp_extract("doc_id", CHUNK_KEY, 1).alias("key"))
        if dim is None:
            first = made.first()
            dim = len(first.vector) if first else None
        (self._checked(made, dim) if dim is not None else made).write.mode("overwrite").parquet(at("vectors"))
        return dim

    def build(self, docs: DataFrame, force: bool = False, break_lock: bool = False) -> dict[str, Any]:
        """The whole index of docs; an equal one is used again unless forced."""
        if not force and not self.needs_rebuild():
            return self.manifest() or {}
        with self._changing(break_lock):
            version = self._next()
            dim = self._write_documents(version, docs, None)
            return self._commit(version, [version], dim)

    def upsert(self, docs: DataFrame, break_lock: bool = False) -> dict[str, Any]:
        """docs added, or in place of those with their ids; everything else stays."""
        with self._changing(break_lock):
            before = self.manifest() or {"parts": [], "dim": None}
            version = self._next()
            dim = self._write_documents(version, docs, before["dim"])
            return self._commit(version, [*before["parts"], version], dim)

    def delete(self, ids: DataFrame, break_lock: bool = False) -> dict[str, Any]:
        """The index without the documents of ids (doc_id)."""
        with self._changing(break_lock):
            before = self.manifest()
            if not before or not before["parts"]:
                raise ValueError(f"no index at {self.path}")
            version = self._next()
            ids.select(F.col("doc_id").cast("string").alias("key"), F.lit(True).alias("gone")).distinct().write.mode("overwrite").parquet(f"{self.path}/{version}/keys")
            return self._commit(version, [*before["parts"], version], before["dim"])

    def add_vectors(self, vectors: DataFrame, dim: int, break_lock: bool = False) -> dict[str, Any]:
        """A version with (doc_id, vector) of chunks; a vector of another length fails the write, and readers keep what they had."""
        with self._changing(break_lock):
            before = self.manifest()
            if not before or not before["parts"]:
                raise ValueError(f"no index at {self.path}")
            if before["dim"] not in (None, dim):
                raise ValueError(f"vectors of this index have {before['dim']} values")
            version = self._next()
            rows = vectors.select("doc_id", "vector", F.regexp_extract("doc_id", CHUNK_KEY, 1).alias("key"))
            self._checked(rows, dim).write.mode("overwrite").parquet(f"{self.path}/{version}/vectors")
            return self._commit(version, [*before["parts"], version], dim)

    def compact(self, break_lock: bool = False) -> dict[str, Any]:
        """The same index in one part."""
        with self._changing(break_lock):
            before = self.manifest()
            if not before or not before["parts"]:
                raise ValueError(f"no index at {self.path}")
            version = self._next()
            for name in TABLES:
                if any(name in self._names(p) for p in before["parts"]):
                    rows = self._view(name, before["parts"])
                    rows = rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id") if name == "postings" else rows
                    rows.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
            self._view("documents", before["parts"]).select("key", F.lit(False).alias("gone")).distinct().write.mode("overwrite").parquet(f"{self.path}/{version}/keys")
            return self._commit(version, [version], before["dim"])

    def reset(self, break_lock: bool = False) -> dict[str, Any]:
        """An empty index; what it had stays until vacuum takes it away."""
        with self._changing(break_lock):
            return self._commit(self._next(), [], None)

    def vacuum(self, keep: int = 1, break_lock: bool = False) -> list[str]:
        """Takes away all folders that the last keep manifests do not name, and older manifests; readers of those must be done."""
        with self._changing(break_lock):
            names = [n for n in self._names("manifests") if n.endswith(".json")]
            live = {p for n in names[len(names) - keep :] for p in json.loads(self._read("manifests", n))["parts"]}
            gone = [n for n in self._names() if n[:1] == "v" and n[1:].isdigit() and n not in live]
            for name in names[: len(names) - keep]:
                system, path = self._at("manifests", name)
                system.delete(path, False)
            for name in gone:
                system, path = self._at(name)
                system.delete(path, True)
            return gone

    def engine(self, reorder: Callable[[DataFrame], DataFrame] | None = None, with_vectors: bool = False) -> Engine:
        """An engine that reads the postings instead of the texts."""
        from . import Engine

        facts = self.manifest()
        if not facts or not facts["parts"]:
            raise ValueError(f"no index at {self.path}")
        view = lambda name: self._view(name, facts["parts"])
        passages = view("chunks").select(F.col("chunk_id").alias("doc_id"), "text", F.col("doc_id").cast("string").alias("source"), "window_text")
        if with_vectors:
            passages = passages.join(view("vectors").select("doc_id", "vector"), "doc_id", "left")
        size = self.spark.createDataFrame([(facts["n_chunks"], float(facts["avgdl"]))], "n long, avgdl double")
        return Engine(passages, self.config, reorder, (view("postings").drop("key"), size), self.embed)


def describe(manifest: dict[str, Any]) -> str:
    """A build in a line."""
    return f"{manifest['version']}: {manifest['n_documents']} documents, {manifest['n_chunks']} chunks in {len(manifest['parts'])} parts, vectors of {manifest['dim'] or 'no'} values, {manifest['avgdl']:.1f} tokens a chunk"


def statistics(snapshot: Snapshot) -> DataFrame:
    """One row: documents, chunks, vectors, postings and tokens that count."""
    rows: Column = F.count("*")
    out = snapshot.table("chunks").agg(F.countDistinct("key").alias("documents"), rows.alias("chunks"), F.sum("n_tokens").alias("tokens"))
    out = out.crossJoin(F.broadcast(snapshot.table("postings").agg(rows.alias("postings"))))
    found = snapshot.manifest() or {}
    return out.crossJoin(F.broadcast(snapshot.table("vectors").agg(rows.alias("vectors")))) if found.get("dim") else out.withColumn("vectors", F.lit(0).cast("long"))

"""Versions of an index: upserts, deletions, compaction, interrupted changes, vectors, and embedding models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.operators import chunking as C
from hybridrank.operators import retrieval as R
from hybridrank.plans import Config, Snapshot
from hybridrank.plans.snapshot import Busy, describe, statistics

CONFIG = Config(fusion="lexical_only", chunk={"strategy": "fixed", "size": 60, "overlap": 10, "least": 5}, threshold=0.0)


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id string, text string, chunk_id string")


def state(snap):
    """What counts: the texts of chunks, the postings and the vectors, by document."""
    chunks = sorted((r.key, r.ordinal, r.text) for r in snap.table("chunks").collect())
    postings = sorted((r.term, r.doc_id, r.tf, r.len) for r in snap.table("postings").collect())
    vectors = sorted((r.doc_id, tuple(np.round(r.vector, 9))) for r in snap.table("vectors").collect()) if (snap.manifest() or {}).get("dim") else []
    return chunks, postings, vectors


OLD = [(f"d{i}", f"passage {i} tells of topic{i} and of other things, at some length, so that it has parts. " * 2) for i in range(5)]
NEW = [("d1", "an entirely other text about zebras"), ("d7::1", "a document with an odd id about quaggas " * 4)]


@pytest.mark.parametrize("embed", [None, R.hashed_vectors])
def test_upsert_replaces_whole_documents(spark, tmp_path, embed):
    snap = Snapshot(spark, str(tmp_path / "a"), CONFIG, embed)
    first = snap.build(docs(spark, OLD))
    assert first["n_documents"] == 5 and snap.build(docs(spark, NEW)) == first
    snap.upsert(docs(spark, NEW))
    snap.delete(spark.createDataFrame([("d0",), ("unknown",)], "doc_id string"))
    fresh = Snapshot(spark, str(tmp_path / "b"), CONFIG, embed)
    fresh.build(docs(spark, [r for r in OLD if r[0] not in ("d0", "d1")] + NEW))
    assert state(snap) == state(fresh)
    own, other = snap.manifest(), fresh.manifest()
    assert (own["n_documents"], own["n_chunks"]) == (other["n_documents"], other["n_chunks"]) and abs(own["avgdl"] - other["avgdl"]) < 1e-9
    asked = spark.createDataFrame([("q", "zebras"), ("r", "topic1"), ("s", "topic3 passage")], "query_id string, text string")
    hits = lambda s: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in s.engine().retrieve(asked).collect())
    assert hits(snap) == hits(fresh) and not any(q == "r" for q, *_ in hits(snap))
    assert len(own["parts"]) == 3 and describe(own).startswith(own["version"])
    before = state(snap)
    assert len(snap.compact()["parts"]) == 1 and state(snap) == before
    counts = statistics(snap).first()
    assert (counts.documents, counts.chunks, counts.postings, counts.vectors) == (5, len(before[0]), len(before[1]), len(before[2]))
    assert len(snap.vacuum()) == 3 and state(snap) == before and len(snap.manifests()) == 1
    assert snap.reset()["n_chunks"] == 0 and snap.needs_rebuild()
    with pytest.raises(ValueError):
        snap.table("chunks")
    snap.upsert(docs(spark, OLD[:1]))
    assert snap.manifest()["n_documents"] == 1


def test_interrupted_changes_leave_the_old_state(spark, tmp_path):
    def fails(texts):
        raise RuntimeError("no model")

    snap = Snapshot(spark, str(tmp_path / "a"), CONFIG, R.hashed_vectors)
    snap.build(docs(spark, OLD))
    before, manifest = state(snap), snap.manifest()
    broken = Snapshot(spark, str(tmp_path / "a"), CONFIG, fails)
    for change in (lambda: broken.upsert(docs(spark, NEW)), lambda: broken.build(docs(spark, NEW), force=True), lambda: snap.upsert(docs(spark, [NEW[0], NEW[0]])), lambda: snap.upsert(docs(spark, [(None, "x" * 30)]))):
        with pytest.raises(Exception):
            change()
        assert state(snap) == before and snap.manifest() == manifest
    other = Snapshot(spark, str(tmp_path / "a"), CONFIG, lambda t: R.hashed_vectors(t, 8))
    with pytest.raises(Exception, match="must have 64"):
        other.upsert(docs(spark, NEW))
    assert state(snap) == before
    snap.upsert(docs(spark, NEW))  # what was half written is in nobody's way
    assert state(snap) != before
    assert len(snap.vacuum(keep=2)) >= 3 and snap.manifest()["n_documents"] == 6


def test_one_change_at_a_time(spark, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "a"), CONFIG)
    snap.build(docs(spark, OLD[:1]))
    with snap._changing(False):
        with pytest.raises(Busy):
            Snapshot(spark, str(tmp_path / "a"), CONFIG).upsert(docs(spark, NEW))
    system, lock = snap._at("lock")
    assert system.createNewFile(lock)  # a change that died
    with pytest.raises(Busy):
        snap.reset()
    assert snap.upsert(docs(spark, NEW), break_lock=True)["n_documents"] == 3


def test_vectors_of_an_index(spark, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "a"), CONFIG)
    snap.build(docs(spark, OLD[:2]))
    ids = [r.chunk_id for r in snap.chunk_ids().collect()]
    rows = lambda v: spark.createDataFrame([(i, [v, 0.0]) for i in ids], "doc_id string, vector array<double>")
    snap.add_vectors(rows(1.0), 2)
    with pytest.raises(Exception, match="must have 2"):
        snap.add_vectors(spark.createDataFrame([(ids[0], [1.0])], "doc_id string, vector array<double>"), 2)
    with pytest.raises(ValueError):
        snap.add_vectors(rows(1.0), 3)
    snap.add_vectors(rows(2.0).where(F.col("doc_id") == ids[0]), 2)
    assert {r.doc_id: r.vector[0] for r in snap.table("vectors").collect()} == {i: 2.0 if i == ids[0] else 1.0 for i in ids}
    snap.upsert(docs(spark, [("d0", "short and new")]))
    assert not any(r.key == "d0" for r in snap.table("vectors").collect())
    assert snap.vectors(spark.createDataFrame([(ids[-1],)], "doc_id string")).count() == 1
    assert snap.engine(with_vectors=True).passages.where("vector IS NULL").count() == 1


def test_semantic_index_of_texts(spark, tmp_path):
    text = "Cats purr and cats sleep. Cats eat and cats play. Cats purr and cats eat. Stars burn far away. Stars shine far away. Stars burn and stars shine."
    config = Config(fusion="lexical_only", chunk={"strategy": "semantic", "percentile": 80.0})
    snap = Snapshot(spark, str(tmp_path / "a"), config, R.hashed_vectors)
    snap.build(docs(spark, [("x", text), ("y", "One. Two."), ("z", None)]))
    got = [(r.key, r.text) for r in snap.table("chunks").orderBy("key", "ordinal").collect()]
    assert [t for k, t in got if k == "x"] == ["Cats purr and cats sleep. Cats eat and cats play. Cats purr and cats eat.", "Stars burn far away. Stars shine far away. Stars burn and stars shine."]
    assert [t for k, t in got if k == "y"] == ["One. Two."] and not any(k == "z" for k, _ in got)
    with pytest.raises(ValueError):
        C.chunk(docs(spark, [("x", text)]), "semantic")


def test_embedder_asks_in_batches(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(37)], "doc_id long, text string").coalesce(1)

    def model(own):
        assert 0 < len(own) <= 16
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(own)))]

    got = {r.doc_id: r.vector for r in R.embedder(model)(texts).collect()}
    assert len(got) == 37
    assert all(np.allclose(v, np.array([0 if i == 3 else len(f"t{i}"), 1.0]) / np.hypot(0 if i == 3 else len(f"t{i}"), 1)) for i, v in got.items())
    assert all(r.vector == [0.0, 0.0] for r in R.embedder(lambda own: [[0.0, 0.0]] * len(own))(texts).collect())

    def flaky(own, calls=[]):  # noqa: B006
        calls.append(1)
        if len(calls) == 1:
            raise OSError("busy")
        return [[1.0]] * len(own)

    assert R.embedder(flaky, wait=0.0)(texts).count() == 37
    with pytest.raises(Exception, match="got 1 vectors"):
        R.embedder(lambda own: [[1.0]])(texts).count()

"""What a query makes per task, so that it grows no faster than its input."""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridrank import sources as S
from hybridrank.functions.text import turkish_lower
from hybridrank.operators import postings as P
from hybridrank.operators import retrieval as R


def test_words_are_counted_before_they_are_exchanged(spark):
    rows = [r for b in S._words(iter([pa.RecordBatch.from_pydict({"text": ["Kapı kapı a Kapı", None, "", "kapı Iİ"] * 100})])) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in rows} == {"Kapı": 200, "kapı": 200, "Iİ": 100} and len(rows) == 3
    docs = spark.createDataFrame([("Kapı kapı KAPI kapI a Iİ ıi Ka ka",), (None,)], "text string")
    assert {r.term: r.n for r in S.vocabulary(docs).collect()} == {"kapı": 4, "ıi": 2, "ka": 2}


def test_letters_are_all_that_lower_case_makes_a_letter_of(spark):
    letters = lambda batches: (pa.RecordBatch.from_pydict({"c": [chr(i) for i in b.column("id").to_pylist()]}) for b in batches)
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").mapInArrow(letters, "c string")
    assert points.where(turkish_lower(F.col("c")).rlike("[a-zçğıöşü]") != F.col("c").rlike(f"^[{S.LETTERS}]$")).count() == 0


def test_pairs_with_a_known_tail_go_before_any_exchange(spark):
    texts = ["house of wor ds, wor ds", "Wor DS kapı lar", None, "no pair"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(w,) for w in ("the", "of", "words", "kapılar", "lar")], "term string")
    found = S._breaks(docs, known)
    assert [(r.doc_id, r.place, r.head, r.tail, r.term) for r in found.orderBy("doc_id", "place").collect()] == [(0, 1, "wor", "ds", "words"), (0, 2, "wor", "ds", "words"), (1, 0, "Wor", "DS", "words")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.text, r.repairs) for r in S.repair_word_breaks(docs, known).collect()}
    assert got == {0: ("house of words, words", 2), 1: ("WorDS kapı lar", 1), 2: (None, 0), 3: ("no pair", 0)}


@pytest.mark.parametrize("passages, postings, questions", [(4, 8, 3), (1, 1, 1), (1000, 1000, 1000), (7, 1000, 2)])
def test_scores_of_a_partition_in_bounded_packs(monkeypatch, passages, postings, questions):
    draw = random.Random(passages)
    rows = [{"doc_id": d, "term": f"t{t}", "w": draw.random()} for d in range(50) for t in draw.sample(range(12), draw.randint(1, 6))]
    asked = [{"query_id": q, "term": f"t{t}", "weight": draw.random() + 0.1} for q in range(7) for t in draw.sample(range(9), 3)]
    want: dict = defaultdict(float)
    for a in asked:
        for r in rows:
            if r["term"] == a["term"]:
                want[a["query_id"], r["doc_id"]] += a["weight"] * r["w"]
    monkeypatch.setattr(P, "PASSAGES", passages)
    monkeypatch.setattr(P, "POSTINGS", postings)
    monkeypatch.setattr(P, "QUESTIONS", questions)
    held = []
    monkeypatch.setattr(P, "_scored", lambda groups, k, ids, parts, f=P._scored: held.append((sum(map(len, ids)), sum(len(x[0]) for x in parts))) or f(groups, k, ids, parts))
    (sealed,) = P._sealed(iter([pa.RecordBatch.from_pylist(asked)]))
    sent = pa.array([sealed.column("asked")[0].as_py()] + [None] * (len(rows) - 1), pa.binary())
    whole = pa.RecordBatch.from_arrays([sent, *pa.RecordBatch.from_pylist(rows).columns], ["asked", "doc_id", "term", "w"])
    found = [r for b in P._scorer(50)(whole.slice(i, 5) for i in range(0, len(rows), 5)) for r in b.to_pylist()]
    assert {(r["query_id"], r["doc_id"]): pytest.approx(r["score"]) for r in found} == want and len(found) == len(want)
    assert all(n <= passages and p <= max(postings + 6, 12) for n, p in held)
    assert not list(P._scorer(5)(iter([whole.slice(1, 5)])))


def test_postings_pass_through_one_python_step(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i}") for i in range(100)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word3 text"), (2, "common 5")], "query_id long, text string")
    plan = R.bm25(asked, docs, 3)._jdf.queryExecution().executedPlan().toString()
    # The postings' own step once for scores and once for frequencies; one that seals the questions, one that scores.
    assert plan.count("MapInArrow _scorer") + plan.count("MapInArrow run") == 3 and plan.count("MapInArrow") == 4
    assert R.bm25(asked.limit(0), docs, 3).count() == 0

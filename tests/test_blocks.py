"""Blocked vector products, posting lists in blocks, resampled vectors and running sums against plain computation."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridrank.functions.text import lexical_tokens
from hybridrank.operators import evaluation as E
from hybridrank.operators import postings as P
from hybridrank.operators import retrieval as R
from hybridrank.operators import vectors as V


def vector_rows(spark, rows, name):
    return spark.createDataFrame([(k, None if v is None else [float(x) if x is not None else None for x in v]) for k, v in rows], f"{name} string, vector array<double>").repartition(3)


@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_in_blocks(spark, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[40:80] = x[0]  # a third of the vectors are equal
    docs = [(f"d{i:03}", v) for i, v in enumerate(x)] + [("null", None), ("nan", [math.nan, 0, 0]), ("hole", [1, None, 0]), ("short", [1, 2]), ("none", [])]
    asked = [(f"q{i}", v) for i, v in enumerate(np.round(rng.normal(size=(30, 3)), 1))] + [("zero", [0, 0, 0]), ("two", [1, 1]), ("null", None)]
    full = {q: sorted(((round(float(np.dot(v, w)), 9), d) for d, w in docs if w is not None and len(w) == len(v) and all(y is not None and math.isfinite(y) for y in w)), key=lambda p: (-p[0], p[1]))[:k] for q, v in asked if v is not None}
    want = {(q, d, i + 1) for q, hits in full.items() for i, (_, d) in enumerate(hits)}
    sides = vector_rows(spark, asked, "query_id"), vector_rows(spark, docs, "doc_id")
    for bounds in ({"pack_bytes": 24 * 7, "query_bytes": 600}, {}):
        got = R.ranked(V.products(*sides, k, **bounds), k)
        assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want
    assert R.dense(sides[0].limit(0), sides[1], k).count() == 0 and R.dense(sides[0], sides[1].limit(0), k).count() == 0


def test_products_emit_few_rows(spark):
    """Equal vectors do not make a block give more than k rows for a query."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).coalesce(1)
    asked = spark.range(3).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    assert V.products(asked, docs, 5).count() == 15
    assert {r.doc_id for r in R.dense(asked, docs, 5).collect()} == {0, 1, 2, 3, 4}


ODD = ["", None, "İstanbul'un IŞIKLARI  ve kitaplarından gelenler", "ﬁne K Å ª ½ ① ñandú", "a" * 5000, "kitaplar kitaplardan kitapların 漢字 x1y2", "the THE The", "İ" * 30]


@pytest.mark.parametrize("stemmed, truncate", [(True, None), (False, None), (True, 6), (False, 3)])
def test_postings_are_those_of_the_tokens(spark, stemmed, truncate):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", lexical_tokens(F.col("text"), stemmed, truncate).alias("t")).collect()}
    want = {(t, i, c, len(ts)) for i, ts in tokens.items() for t, c in Counter(ts).items()}
    assert {tuple(r) for r in P.postings(docs, stemmed, truncate).collect()} == want
    assert R.corpus_size(docs).first().n == len(ODD)
    assert abs(R.corpus_size(docs).first().avgdl - sum(map(len, tokens.values())) / len(ODD)) < 1e-9


def corpus(spark, n=400):
    """Passages over words of very different frequency, one of which nearly all have; ties and copies among them."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(["common"] * int(rng.integers(1, 4)) + [words[min(299, int(x))] for x in rng.exponential(30, rng.integers(3, 30))]) for _ in range(n)]
    texts[5:60] = [texts[5]] * 55
    texts += ["", "only here rare1 rare2"]
    asked = [" ".join(["common"] + [words[min(299, int(x))] for x in rng.exponential(60, rng.integers(1, 9))]) for _ in range(25)] + ["common common", "rare1", "unknown", ""]
    return list(enumerate(texts)), list(enumerate(asked))


def brute_bm25(docs, asked, k):
    tokens = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = set()
    for q, text in asked:
        scores = {}
        for w in text.split():
            for i, t in tokens.items():
                if w in t:
                    tf = t.count(w)
                    scores[i] = scores.get(i, 0) + max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        for r, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1):
            out.add((q, i, r))
    return out


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bm25_full_and_in_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(P, "PASSAGES", 37)
    docs, asked = corpus(spark)
    want = brute_bm25(docs, asked, k)
    passages, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")
    ranks = lambda df: {(r.query_id, r.doc_id, r["rank"]) for r in df.collect()}
    assert ranks(R.bm25(queries, passages, k)) == want
    monkeypatch.setattr(P, "QUESTIONS", 7)
    monkeypatch.setattr(P, "TERM_BYTES", 1000)
    assert ranks(R.bm25(queries, passages, k)) == want
    size = R.corpus_size(passages)
    blocks = P.blocked(P.postings(passages), size, 40).cache()
    assert ranks(R.blocked_bm25(queries, blocks, size, k)) == want
    reads = P.block_reads(queries, blocks, size, k).agg(F.sum("postings").alias("all"), F.sum(F.col("main") + F.col("last")).alias("read"), F.sum("main").alias("main")).first()
    assert reads["main"] <= reads["read"] <= reads["all"] * {1: 0.6, 5: 0.9, 1000: 1}[k], reads
    assert R.bm25(queries.limit(0), passages).count() == 0 and R.bm25(queries, passages.limit(0)).count() == 0


def test_blocks_are_exchanged_once_and_scores_never(spark):
    docs, asked = corpus(spark, 200)
    passages, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")
    size = R.corpus_size(passages)
    blocks = R.kept(P.blocked(P.postings(passages), size, 40))
    plan = P.bm25_scores(queries, blocks, size, 5)._jdf.queryExecution().executedPlan().toString()
    dealt = [sorted(set(re.findall(r"(\w+)#", x))) for x in re.findall(r"Exchange hashpartitioning\((.*)\)", plan)]
    assert ["span"] in dealt and not [x for x in dealt if "span" in x and x != ["span"]], dealt


@pytest.mark.parametrize("questions", [1, 3, 256])
def test_a_span_is_scored_as_a_matrix(monkeypatch, questions):
    monkeypatch.setattr(P, "QUESTIONS", questions)
    ask = lambda q, main=True, bar=float("-inf"), rest=0.0: {"query_id": q, "weight": 1.0 + q, "bar": bar, "rest": rest, "main": main}
    rows = [
        {"rows": [{"doc_id": "b", "w": 1.0}, {"doc_id": "a", "w": 1.0}, {"doc_id": "c", "w": 3.0}], "asks": [ask(0), ask(1, bar=5.0, rest=1.0)]},
        {"rows": [{"doc_id": "d", "w": 9.0}], "asks": [ask(3, False, 5.0, 9.0)]},  # without a main list there is nothing to complete
        {"rows": [{"doc_id": "a", "w": 0.5}, {"doc_id": "c", "w": 0.25}], "asks": [ask(1, False, 5.0, 1.0), ask(2)]},
    ]
    table = pa.concat_tables([pa.Table.from_pylist(rows[:1]), pa.Table.from_pylist(rows[1:])])
    got = sorted((r["query_id"], r["doc_id"], r["score"]) for r in P._span_scorer(2)(table).to_pylist())
    assert got == [(0, "a", 1.0), (0, "c", 3.0), (1, "c", 6.5), (2, "a", 1.5), (2, "c", 0.75)]


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, (E.SEED, *parts))).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("block, chunk", [(4, 7), (E.BLOCK, E.CHUNK)])
def test_resampling_in_blocks(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    groups = {"x": rng.random(23), "y": np.zeros(9), "z": np.array([0.25])}
    rows = spark.createDataFrame([(g, i, float(v), float(v * (i % 3))) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, i long, a double, b double")
    got = {r.g: r for r in E.bootstrap_ci(rows.withColumnRenamed("a", "value"), 60, by=["g"]).collect()}
    for g, vs in groups.items():
        means = [round(float(np.mean([vs[draw(b, j) % len(vs)] for j in range(len(vs))])), 12) for b in range(60)]
        assert np.allclose([got[g].estimate, got[g].lower, got[g].upper, got[g].n], [vs.mean(), *np.percentile(means, [2.5, 97.5]), len(vs)])
    tests = {r.g: r for r in E.permutation_test(rows, 60, by=["g"]).collect()}
    for g, vs in groups.items():
        d = np.array([v - v * (i % 3) for i, v in enumerate(vs)])
        extreme = sum(round(abs(float(np.mean([x * (1 - 2 * (draw(b, i) % 2)) for i, x in enumerate(d)]))), 12) >= round(abs(float(d.mean())), 12) for b in range(60))
        p = 1.0 if abs(d).max() <= 1e-8 else (extreme + 1) / 61
        effect = d.mean() / d.std(ddof=1) if len(d) > 1 and d.std(ddof=1) > 0 else 0.0
        assert np.allclose([tests[g].p, tests[g].d, tests[g]["diff"], tests[g].n], [p, effect, d.mean(), len(d)])
    assert E.bootstrap_ci(rows.limit(0).withColumnRenamed("a", "value"), 5).count() == 0 and E.permutation_test(rows.limit(0), 5).count() == 0


def test_resamples_leave_a_task_added_up(spark):
    """One row for each block and resample is exchanged, not one for each draw."""
    values = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("value")).repartition(3)
    df = E.bootstrap_ci(values, 300)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_sums_over_many_scores(spark):
    """10**6 distinct scores, and as many rows that share one."""
    n = 1_000_000
    scored = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("label"))
    tied = spark.range(n).select(F.lit(float(1 << 29)).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    both = scored.unionAll(tied)
    pdf = both.toPandas()
    s, y = pdf.score.to_numpy(), pdf.label.to_numpy()
    values, at, counts = np.unique(s, return_inverse=True, return_counts=True)
    pos = np.bincount(at, weights=y)
    neg = counts - pos
    below = np.concatenate([[0], np.cumsum(neg)[:-1]])
    want = float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum()))
    got = E.auc(both, range_rows=50_000).first()
    assert abs(got.auc - want) < 1e-9 and got.n_pos == y.sum()
    order = np.argsort(-values)
    recall = np.cumsum(pos[order]) / pos.sum()
    assert E.safety_threshold(both, range_rows=50_000).first().threshold == values[order][recall >= 0.9].max()
    sweep = E.threshold_sweep(both, range_rows=50_000).agg(F.count("*").alias("n"), F.countDistinct("threshold").alias("d"), F.min("tp").alias("lo"), F.max("tp").alias("hi"), F.sum("fn").alias("fn")).first()
    assert (sweep.n, sweep.d, sweep.lo, sweep.hi) == (len(values) + 1, len(values) + 1, 0, y.sum())
    assert sweep.fn == int(np.cumsum(pos).sum())


def test_running_order_and_nulls(spark):
    rows = spark.createDataFrame([(None, "z", 1), (3.0, "b", 2), (1.0, "a", 4), (3.0, "a", 8), (float("-inf"), "a", 16), (2.0, "a", 32)], "k double, t string, v long").repartition(3)
    for size in (1, 100):
        got = [(r.k, r.t, r.s_before, r.s_all) for r in E.running(rows, "k", {"s": F.col("v")}, ("t",), size).orderBy("s_before").collect()]
        assert got == [(None, "z", 0, 63), (float("-inf"), "a", 1, 63), (1.0, "a", 17, 63), (2.0, "a", 21, 63), (3.0, "a", 53, 63), (3.0, "b", 61, 63)]
    assert sorted(r.i for r in E.numbered(rows, "k", ("t",), 2).collect()) == list(range(6))
    assert E.auc(rows.limit(0).select(F.col("k").alias("score"), F.col("v").alias("label"))).first().auc is None


def test_holm_in_families(spark):
    rows = [("f", "a", 0.001), ("f", "b", 0.02), ("f", "c", 0.03), ("g", "a", 0.04), ("g", "b", 0.01)]
    tests = spark.createDataFrame(rows, "family string, name string, p double")
    assert {(r.family, r.name) for r in E.holm(tests, by=["family"]).where("reject").collect()} == {("f", "a"), ("f", "b"), ("f", "c"), ("g", "a"), ("g", "b")}
    assert {r.name for r in E.holm(tests.where("family = 'f'").withColumn("p", F.col("p") * 2), 0.05).where("reject").collect()} == {"a"}


def test_hashed_vectors_row_by_row(spark):
    """Against plain computation, and without an exchange, so that the work grows with the texts alone."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", lexical_tokens(F.col("text"), False).alias("t")).collect()}
    for dim in (64, 10):
        out = R.hashed_vectors(docs, dim)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        for r in out.collect():
            want = [0.0] * dim
            for t in tokens[r.doc_id]:
                h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                want[h % dim] += 1 - 2 * (h // dim % 2)
            norm = max(math.sqrt(sum(x * x for x in want)), 1e-12)
            assert r.vector == [x / norm for x in want]


def test_slices_hold_bounded_text():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["x" * 1000] * 200 + [None, "", "y" * 9000] + ["é"] * 197)], ["doc_id", "text"])
    parts = list(P.slices([b, b.slice(7, 0)], limit=4000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and len(parts) > 60
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) + 64 for t in p.column("text").to_pylist()) <= 4000 for p in parts)

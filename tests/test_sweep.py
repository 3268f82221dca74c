"""Sweeps of configurations and end-to-end evaluation against single runs of the engine and hand-worked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridrank.functions.text import lexical_tokens
from hybridrank.operators import evaluation as E
from hybridrank.operators import reports as X
from hybridrank.operators import retrieval as R
from hybridrank.plans import Config, Engine, sweep_configs
from hybridrank.plans.end_to_end import evaluate, summarize, summary_text
from hybridrank.plans.sweep import Sweep, overlap_order


@pytest.fixture(scope="module")
def world(spark):
    """80 passages of a few dozen words each, and 12 items in two wordings, one of which has no gold."""
    rng = np.random.default_rng(11)
    words = [f"kelime{i}" for i in range(60)] + ["kitaplardan", "kitaplar", "evlerden", "evler"]
    texts = [" ".join(rng.choice(words, 25)) for _ in range(80)]
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=6))
    vectors = [unit() if i % 9 else None for i in range(80)]
    rows, gold = [], []
    for i in range(12):
        own = texts[i * 3].split()
        for w, variant in enumerate(("generated", "paraphrased")):
            rows.append((i * 2 + w, " ".join(own[: 12 - 7 * w]), variant, i, i != 7, (np.array(vectors[i * 3] or unit()) + 0.1).tolist()))
            if i != 7:
                gold += [(i * 2 + w, i * 3), (i * 2 + w, i * 3 + 1)]
    questions = spark.createDataFrame(rows, "query_id long, text string, variant string, position long, answerable boolean, vector array<double>").cache()
    passages = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, vectors))], "doc_id long, text string, vector array<double>").cache()
    return questions, spark.createDataFrame(gold, "query_id long, doc_id long").cache(), passages


def reorder(heads):
    return overlap_order(heads, lexical_tokens)


def test_sweep_is_the_engine_run_by_run(spark, world, monkeypatch):
    questions, gold, passages = world
    searched = []
    bm25, dense = R.bm25, R.dense
    monkeypatch.setattr(R, "bm25", lambda *a, **k: searched.append("lexical") or bm25(*a, **k))
    monkeypatch.setattr(R, "dense", lambda *a, **k: searched.append("dense") or dense(*a, **k))
    sweep = Sweep(questions, gold, passages, reorder=reorder, resamples=50)
    got = {}
    for r in sweep.hits.collect():
        got.setdefault(r.config, set()).add((r.query_id, r.doc_id, r["rank"]))
    assert sorted(searched) == ["dense", "lexical", "lexical", "lexical"]  # an arm each, whatever the number of configurations
    assert len(got) == 12
    asked = questions.where("answerable")
    for c in sweep_configs():
        if c.name in ("baseline-dense", "lexical-nostem", "rrf-k20", "weighted-0.7", "rrf-truncate6", "rrf-mmr", "weighted-rerank"):
            want = {(r.query_id, r.doc_id, r["rank"]) for r in Engine(passages, c, reorder if c.rerank else None).retrieve(asked).collect()}
            assert got[c.name] == want, c.name
    metrics = E.retrieval_metrics(asked, Engine(passages, Config(fusion="rrf")).retrieve(asked), gold)
    own = sweep.metrics.where("config = 'rrf'").select(*metrics.columns)
    key = lambda r: tuple(None if x is None else round(x, 9) for x in r)
    assert sorted(map(key, own.collect()), key=str) == sorted(map(key, metrics.collect()), key=str)


def test_sweep_exchanges_neither_texts_nor_postings_of_other_terms(spark, world):
    questions, gold, passages = world
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        vectors = passages.where("vector IS NOT NULL").select("doc_id", "vector")
        sweep = Sweep(questions, gold, passages.select("doc_id", "text"), reorder=reorder, resamples=50, vectors=vectors)
        found = lambda df, key: [f"BroadcastHashJoin [{key}" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in x]
        lexical = found(R.bm25(sweep.questions.select("query_id", "text"), sweep.passages), "term")
        assert lexical and all(lexical)
        own, whole = sweep.hits, Sweep(questions, gold, passages, reorder=reorder, resamples=50).hits
        rows = lambda df: {tuple(r) for r in df.collect()}
        assert rows(own) == rows(whole)
        joined = found(own, "doc_id")
        assert joined and all(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sweep_tables(world):
    questions, gold, passages = world
    sweep = Sweep(questions, gold, passages, resamples=50)
    assert "weighted-rerank" not in {c.name for c in sweep.configs} and len(sweep.configs) == 11
    rows = {(r.variant, r.config): r for r in sweep.summary().collect()}
    assert len(rows) == 22 and all(r.n == 11 and r.ndcg_lower - 1e-9 <= r.ndcg <= r.ndcg_upper + 1e-9 for r in rows.values())
    tests = {(r.variant, r.config): r for r in sweep.comparisons().collect()}
    assert len(tests) == 20
    for (v, c), r in tests.items():
        assert math.isclose(r["diff"], rows[v, c].ndcg - rows[v, "baseline-dense"].ndcg, abs_tol=1e-9) and math.isclose(r.baseline, rows[v, "baseline-dense"].ndcg)
        assert r.verdict == ("significant" if r.reject else "lost to the correction" if r.p < 0.05 else "not significant")
    gaps = {r.config: r for r in sweep.wording_gap().collect()}
    assert len(gaps) == 11 and math.isclose(gaps["rrf"]["diff"], rows["paraphrased", "rrf"].ndcg - rows["generated", "rrf"].ndcg, abs_tol=1e-9)
    planned = {(r.variant, r.config, r.other) for r in sweep.planned().collect()}
    assert planned == {(v, a, b) for v in ("generated", "paraphrased") for a, b in (("lexical-only", "lexical-nostem"), ("rrf", "baseline-dense"))}
    assert {(r.effect, r.needed, r.sufficient) for r in sweep.power().collect()} == {("small", 197, False), ("medium", 32, False), ("large", 13, False)}


def test_sweep_refuses(world):
    questions, gold, passages = world
    with pytest.raises(ValueError):
        Sweep(questions, gold, passages, [Config(name="a"), Config(name="b", top_k=3)])
    with pytest.raises(ValueError):
        Sweep(questions, gold, passages, [Config(name="a"), Config(name="a", alpha=0.1)])
    other = gold.where("NOT (query_id = 3 AND doc_id = 3)")
    sweep = Sweep(questions, other, passages, [Config(name="a", fusion="lexical_only"), Config(name="b", fusion="lexical_only", stemmed=False)], resamples=20)
    with pytest.raises(ValueError, match="same gold"):
        sweep.wording_gap()
    assert sweep.comparisons().count() == 2


def test_query_template_reaches_the_dense_arm_only(world):
    questions, gold, passages = world
    embedded = []

    def embed(texts):
        embedded.append({r.text for r in texts.collect()})
        return R.hashed_vectors(texts, 6)

    Sweep(questions.drop("vector"), gold, passages, [Config(name="a", fusion="rrf"), Config(name="b", fusion="rrf", instruct=True), Config(name="c", alpha=0.2)], embed=embed).hits.count()
    assert len(embedded) == 2
    plain, told = sorted(embedded, key=lambda x: any("Instruct" in t for t in x))
    assert all("Instruct" in t for t in told) and not any("Instruct" in t for t in plain)


def test_end_to_end(spark, world):
    questions, gold, passages = world
    asked = questions.where("variant = 'generated'")
    seen = []

    def generate(prompts):
        seen.append({r.query_id for r in prompts.collect()})
        reply = F.when(F.col("query_id") % 3 == 0, "It says so [1] [9].").when(F.col("query_id") % 3 == 1, "This is not present here.").otherwise("So [2].")
        return prompts.select("query_id", reply.alias("answer"), (F.col("query_id") + 1.0).alias("generation_ms"))

    engine = Engine(passages, Config(fusion="lexical_only", threshold=8.0))
    hits = engine.retrieve(asked)
    best = {r.query_id: r.s for r in hits.groupBy("query_id").agg(F.max("lexical_score").alias("s")).collect()}
    records = evaluate(engine, asked, gold, generate)
    rows = {r.query_id: r for r in records.collect()}
    assert len(rows) == 12 and set(rows) == {r.query_id for r in asked.collect()}
    assert seen[0] == {q for q, s in best.items() if s >= 8.0}
    golds = {i * 2: {i * 3, i * 3 + 1} for i in range(12) if i != 7}
    for q, r in rows.items():
        refused = q % 3 == 1
        assert r.abstained == (best[q] < 8.0 or refused)
        assert r.answerable == (q != 14) and r.abstention_correct == (r.abstained != r.answerable)
        if best[q] >= 8.0:
            want = {0: ([1], [9]), 1: ([], []), 2: ([2], [])}[q % 3]
            assert (r.citations, r.invalid) == want and r.generation_ms == q + 1
            cited = [r.retrieved[i - 1] for i in r.citations]
            assert r.citation_precision == (sum(c in golds.get(q, ()) for c in cited) / len(cited) if cited else 0)
        else:
            assert r.answer is None and r.citations == [] and r.generation_ms == 0
        assert (r.recall is None) == (q == 14)
    s = summarize(records, 50).first()
    known = [r for r in rows.values() if r.answerable]
    assert (s.n, s.n_answerable) == (12, 11) and math.isclose(s.ndcg, sum(r.ndcg for r in known) / 11)
    assert math.isclose(s.abstention_accuracy, sum(r.abstention_correct for r in rows.values()) / 12) and s.ndcg_lower - 1e-9 <= s.ndcg <= s.ndcg_upper + 1e-9
    text = summarize(records, 50).select(summary_text("run", "abc").alias("t")).first().t
    assert text.startswith("run (abc)\n  recall: ") and "generation: p50" in text


def test_end_to_end_without_hits_or_gold(spark, world):
    _, gold, passages = world
    asked = spark.createDataFrame([(1, "zzz", True), (2, " ", False)], "query_id long, text string, answerable boolean")
    rows = {r.query_id: r for r in evaluate(Engine(passages, Config(fusion="lexical_only")), asked, gold.limit(0)).collect()}
    assert all(r.abstained and r.retrieved == [] and r.citations == [] for r in rows.values()) and rows[1].recall == 0 and rows[2].recall is None


def test_words_for_tests(spark):
    df = spark.createDataFrame([(0.1, 0.01, 0.6, 20), (-0.1, 0.2, 0.1, 20)], "diff double, p double, d double, n long")
    got = [r.t for r in df.select(E.interpretation(*map(F.col, df.columns)).alias("t")).collect()]
    assert got == ["better (diff=+0.1000, p=0.0100, d=0.60 medium, n=20)", "no significant difference (diff=-0.1000, p=0.2000, n=20)"]
    row = spark.range(1).select(E.half_width(F.lit(1.0), F.lit(3.0)).alias("h"), E.intervals_overlap(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(3.0)).alias("a"), E.intervals_overlap(F.lit(1.0), F.lit(2.0), F.lit(2.1), F.lit(3.0)).alias("b")).first()
    assert (row.h, row.a, row.b) == (1.0, True, False)


def test_sources_of_an_answer(spark):
    passages = spark.createDataFrame([("a", "zebra one. more", "S1"), ("b", "zebra zebra two [[page:7]]", None)], "doc_id string, text string, source string")
    asked = spark.createDataFrame([("q", "zebra"), ("r", "nothing here")], "query_id string, text string")
    say = lambda rows: rows.select("query_id", F.lit("So [2] and [1] and [9].").alias("answer"))
    rows = {r.query_id: r for r in Engine(passages, Config(fusion="lexical_only", threshold=-1.0)).ask(asked, say).collect()}
    assert rows["q"].sources == ["S1", "b · s.7"] and rows["q"].cited == [2, 1] and rows["q"].invalid == [9] and rows["r"].sources is None


def test_configurations_as_files(tmp_path):
    own = Config(name="x", fusion="rrf", chunk={"strategy": "fixed", "size": 100}, truncate=6)
    for name in ("a.json", "a.yaml"):
        own.save(str(tmp_path / name))
        assert Config.load(str(tmp_path / name)) == own
    (tmp_path / "b.yml").write_text("fusion: rrf\n")
    assert Config.load(str(tmp_path / "b.yml")) == Config(fusion="rrf")
    (tmp_path / "c.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "c.json"))


def test_reports_and_eval_sets_as_files(spark, world, tmp_path):
    questions, gold, passages = world
    rows = questions.drop("vector").withColumn("gold_chunk_ids", F.array(F.col("position").cast("string")))
    X.save_report(rows, str(tmp_path / "set"))
    back = X.load_report(spark, str(tmp_path / "set"), "query_id long, text string, variant string, position long, answerable boolean, gold_chunk_ids array<string>")
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.select(*rows.columns).collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        X.save_report(rows, str(tmp_path / "set"))
    X.save_report(Sweep(questions, gold, passages, [Config(name="a", fusion="lexical_only"), Config(name="b", fusion="lexical_only", truncate=3)], resamples=10).summary(), str(tmp_path / "report"))
    assert {r.config for r in X.load_report(spark, str(tmp_path / "report"), "config string, variant string, ndcg double").collect()} == {"a", "b"}


@pytest.mark.parametrize("name", ["sweep_comparisons", "wording_gap"])
def test_configurations_are_tested_by_ten_thousand_flips(spark, monkeypatch, name):
    from hybridrank.plans import queries as Q
    from hybridrank.plans import sweep

    class Asked(Exception):
        pass

    def asked(*args, resamples=None, **more):
        raise Asked(resamples)

    monkeypatch.setattr(sweep, "Sweep", asked)
    with pytest.raises(Asked, match="^10000$"):
        Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "range(10000) x(r)" in Q.ORACLES[name] and "/ 10001e0" in Q.ORACLES[name] and "range(200)" not in Q.ORACLES[name]


def test_gold_meets_few_documents(spark, tmp_path):
    """Items are found by contains, as before, and are tried on documents that have their longest inner word only."""
    from hybridrank.plans import queries as Q

    items = [(1, "alpha betagamma delta"), (2, "ab"), (3, "a b"), (4, "x  y"), (5, ""), (6, "x   y"), (7, "é ñandú é")]
    docs = [(1, "xalpha betagamma deltax"), (2, "alpha betagamma"), (3, "cab a b"), (4, "x  y"), (5, None), (6, ""), (7, "x   y"), (8, "é ñandú é ñandú é"), (9, "betagamma alpha betagamma delta alpha betagamma delta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q._gold(spark, str(tmp_path))
    want = sorted((i, d) for i, p in items for d, t in docs if t is not None and p in t)
    assert sorted((r.query_id, r.doc_id) for r in out.collect()) == want
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()

"""Hand-worked values of the retrieval and evaluation operators, and every query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from hybridrank import sources as S
from hybridrank.functions import text as T
from hybridrank.operators import chunking as C
from hybridrank.operators import evaluation as E
from hybridrank.operators import reports as X
from hybridrank.operators import retrieval as R
from hybridrank.plans import Config, Engine, Snapshot, sweep_configs
from hybridrank.plans import queries as Q
from hybridrank.streaming import append_postings

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def hits(spark, *rows):
    return spark.createDataFrame([("q", d, r, float(s)) for d, r, s in rows], "query_id string, doc_id string, rank long, score double")


def one(df, column="x"):
    return [r[column] for r in df.collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_rrf(spark):
    out = {r.doc_id: r for r in R.rrf(hits(spark, ("b", 1, 0.4), ("a", 2, 0.3)), hits(spark, ("c", 1, 900), ("a", 2, 800))).collect()}
    assert out["a"].rank == 1 and math.isclose(out["a"].score, 2 / 62)
    assert math.isclose(out["b"].score, 1 / 61) and math.isclose(out["c"].score, 1 / 61) and out["b"].rank == 2


def test_weighted(spark):
    flat = {r.doc_id: r.score for r in R.min_max(hits(spark, ("a", 1, 0.5), ("b", 2, 0.5))).collect()}
    assert flat == {"a": 1.0, "b": 1.0}
    out = {r.doc_id: r.score for r in R.weighted(hits(spark, ("a", 1, 0.9)), hits(spark, ("b", 1, 7.0)), 0.7).collect()}
    assert math.isclose(out["a"], 0.7) and math.isclose(out["b"], 0.3)
    with pytest.raises(ValueError):
        R.fuse(hits(spark, ("a", 1, 1)), hits(spark, ("a", 1, 1)), "magic")
    assert one(R.fuse(hits(spark, ("a", 1, 1)), hits(spark, ("b", 1, 1)), "lexical_only"), "doc_id") == ["b"]


def test_metrics(spark):
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    gold = spark.createDataFrame([("q", "a"), ("none", "z")], "query_id string, doc_id string")
    found = hits(spark, ("x", 1, 5), ("y", 2, 4), ("a", 3, 3), ("v", 4, 2), ("w", 5, 1))
    out = {r.query_id: r for r in E.retrieval_metrics(q, found, gold, 5).collect()}
    assert (out["q"].recall, out["q"].precision, out["q"].first_rank) == (1.0, 0.2, 3)
    assert math.isclose(out["q"].rr, 1 / 3) and math.isclose(out["q"].ndcg, 0.5)
    assert (out["none"].recall, out["none"].precision, out["none"].rr, out["none"].ndcg, out["none"].first_rank) == (0, 0, 0, 0, None)


def test_text(spark):
    words = texts(spark, "kayıtların dondurulması", "kayıt dondurma", "IŞIK İSTANBUL", None, "şa")
    assert [list(x) for x in one(words.select(T.lexical_tokens(F.col("text")).alias("x")))] == [["kayit", "dondurulm"], ["kayit", "dondurm"], ["isik", "istanbul"], [], ["sa"]]
    assert [list(x) for x in one(words.select(T.lexical_tokens(F.col("text"), True, 6).alias("x")))][:2] == [["kayit", "dondur"], ["kayit", "dondur"]]
    assert one(words.select(T.turkish_lower(F.col("text")).alias("x")))[2] == "ışık istanbul"
    langs = texts(spark, "bu bir yasa ve için", "this is the one for that", "", "zzz")
    assert one(langs.select(T.detect_language(F.col("text")).alias("x"))) == ["tr", "en", "unknown", "unknown"]


def test_sentences(spark):
    docs = texts(spark, "MADDE 7 - Başvuru Öğr. Gör. Dr. Ayşe Yılmaz'a yapılır. Bu süre 2. yarıyıl sonuna kadardır.", "", "A. B.")
    assert one(docs.select(C.sentences(F.col("text")).alias("x")))[0] == ["MADDE 7 - Başvuru Öğr. Gör. Dr. Ayşe Yılmaz'a yapılır.", "Bu süre 2. yarıyıl sonuna kadardır."]


@pytest.mark.parametrize("size", [899, 900, 901, 1650, 1651])
def test_fixed_chunks_cover(spark, size):
    text = "x" * size
    rows = C.fixed_chunks(texts(spark, text)).orderBy("ordinal").collect()
    assert rows[0].char_start == 0 and rows[-1].char_end == size
    assert all(b.char_start - a.char_start == 750 and a.char_end >= b.char_start for a, b in zip(rows, rows[1:]))


def test_recursive_chunks():
    assert C.recursive_pieces("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert C.recursive_pieces("one two\n\nthree four\n\nfive", 12) == ["one two", "three four", "five"]
    assert C.recursive_pieces("  ", 10) == [] and C.recursive_spans("") == []
    assert C.recursive_pieces("x\nMADDE 1 aaaa\nMADDE 2 bbbb", 14) == ["x\nMADDE 1 aaaa"[:1] + "\nMADDE 1 aaaa", "MADDE 2 bbbb"]
    assert C.merge_short([("ab", 0, 2), ("cdef", 2, 6), ("g", 6, 7)], 3) == [("ab\ncdef\ng", 0, 7)]


def test_statistics(spark):
    tests = spark.createDataFrame([(str(p), p) for p in (0.001, 0.02, 0.03, 0.04, 0.2)], "name string, p double")
    assert [r.name for r in E.holm(tests).where("reject").collect()] == ["0.001"]
    assert [E.required_sample_size(d) for d in (0.2, 0.5, 0.8, 0)] == [197, 32, 13, 0]
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(4)], "i long, a double, b double")
    assert E.permutation_test(same, 50).first().p == 1.0
    scored = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1), (2.0, 0)], "score double, label int")
    assert math.isclose(E.auc(scored).first().auc, (1 + 0.5 + 3) / 6)
    assert E.auc(scored.where("label = 1")).first().auc is None
    best = E.best_threshold(scored).first()
    assert (best.threshold, best.tp, best.fp) == (1.5, 2, 2)
    edge = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.1, 0)], "confidence double, outcome int")
    assert {r.bin: r.n for r in E.calibration_bins(edge).collect()} == {0: 1, 9: 1}


def test_mmr_ties_and_orphans(spark):
    rows = [("q", "a", 1, 0.9, [1.0, 0.0]), ("q", "b", 2, 0.9, [1.0, 0.0]), ("q", "c", 3, 0.5, [0.0, 1.0]), ("q", "d", 4, 0.8, None)]
    pool = spark.createDataFrame(rows, "query_id string, doc_id string, rank long, relevance double, vector array<double>")
    assert [r.doc_id for r in R.mmr(pool, 0.5, 4).orderBy("step").collect()] == ["a", "c", "b", "d"]
    assert [r.doc_id for r in R.mmr(pool, 1.0, 2).orderBy("step").collect()] == ["a", "b"]


def test_pages_and_repair(spark):
    pages = spark.createDataFrame([("d", i, f"Head line\nbody {i}\nfoot") for i in range(4)] + [("e", 0, "Head line\nx")], "doc_id string, page long, text string")
    assert {r.line for r in S.repeated_lines(pages).collect()} == {"Head line", "foot"}
    assert S.join_pages(S.strip_repeated_lines(pages)).where("doc_id = 'd'").first().text.startswith("[[page:0]]\nbody 0\n\n[[page:1]]")
    docs = texts(spark, "yönetmeliği yönetmeliği yönetmeli ği olarak de de olarak", "x")
    fixed = S.repair_word_breaks(docs, S.vocabulary(docs)).where("doc_id = 0").first().text
    assert fixed == "yönetmeliği yönetmeliği yönetmeliği olarak de de olarak"


def test_files_snapshot_and_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Title\n\nalpha beta gamma delta words for the document that is long enough.")
    (tmp_path / "in/b.html").write_text("<title>Page</title><nav>menu</nav><p>omega sigma tau and this is a long enough paragraph for it</p>")
    (tmp_path / "in/c.pdf").write_text("no")
    docs = S.read_files(spark, str(tmp_path / "in"))
    assert {(r.doc_id, r.source) for r in docs.collect()} == {("a", "Title"), ("b", "Page")}
    snap = Snapshot(spark, str(tmp_path / "index"), Config())
    assert snap.needs_rebuild() and snap.build(docs)["n_documents"] == 2 and not snap.needs_rebuild()
    assert Snapshot(spark, str(tmp_path / "index"), Config(alpha=0.9)).path == snap.path
    assert Snapshot(spark, str(tmp_path / "index"), Config(chunk={"strategy": "fixed"})).path != snap.path
    passages = snap.table("chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    questions = spark.createDataFrame([("1", "alpha gamma?"), ("2", " "), ("3", "zzzz")], "query_id string, text string")
    engine = Engine(passages, Config(fusion="lexical_only", threshold=-1.0))
    assert [(r.query_id, r.doc_id) for r in engine.retrieve(questions).collect()] == [("1", "a::0")]
    assert {r.query_id: r.abstained for r in engine.ask(questions).collect()} == {"1": False, "2": True, "3": True}
    assert len({c.fingerprint() for c in sweep_configs()}) == len(sweep_configs()) == 12


def test_engine_diversifies_and_reranks(spark):
    vectors = {"a": [1.0, 0.0], "b": [1.0, 0.0], "c": [0.8, 0.6], "d": [0.6, 0.8]}
    passages = spark.createDataFrame([(k, f"word {k}", v) for k, v in vectors.items()], "doc_id string, text string, vector array<double>")
    asked = spark.createDataFrame([("q", "word", [1.0, 0.0])], "query_id string, text string, vector array<double>")
    order = lambda e: [r.doc_id for r in e.retrieve(asked).orderBy("rank").collect()]
    config = Config(fusion="dense_only", top_k=2)
    assert order(Engine(passages, config)) == ["a", "b"]
    # After a, at 0.3: b is worth 0.3 - 0.7 = -0.4, c 0.24 - 0.56 = -0.32, d 0.18 - 0.42 = -0.24.
    assert order(Engine(passages, Config(fusion="dense_only", top_k=2, use_mmr=True, mmr_trade=0.3))) == ["a", "d"]
    last_first = lambda head: head.groupBy("query_id").agg(F.count("*").alias("n")).selectExpr("query_id", "transform(sequence(1, cast(n as int)), i -> cast(n as int) - i) AS ordering")
    assert order(Engine(passages, config, last_first)) == ["d", "c"]
    assert order(Engine(passages, Config(fusion="dense_only", top_k=3, rerank_head=2), last_first)) == ["b", "a", "c"]
    assert order(Engine(passages, Config(fusion="dense_only", top_k=4, use_mmr=True), last_first)) == ["d", "c", "b", "a"]


def test_streaming(spark, tmp_path):
    texts(spark, "alpha beta " * 50, "gamma").write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
    append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/postings")).select("term").distinct().count() == 3


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, duck, name):
    ours, theirs = Q.QUERIES[name](spark, SF), duck.execute(Q.ORACLES[name])
    names = sorted(ours.columns)
    at = [[c[0] for c in theirs.description].index(c) for c in names]
    assert sorted(c[0] for c in theirs.description) == names
    rows = [tuple(r[i] for i in at) for r in theirs.fetchall()]
    key = lambda r: tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, (tuple(r) for r in ours.select(*names).collect()))) == sorted(map(key, rows))


def test_recursive_repacks_to_one_piece():
    text = "a" * 450 + "\n\n" + "b" * 449
    assert [len(x) for x in C.recursive_pieces(text, 900)] == [900]


def test_every_chunker_with_default_knobs(spark):
    docs = spark.createDataFrame([(1, "One sentence here.  Another  one follows. " * 40), (2, None), (3, "")], "doc_id long, text string")
    for strategy in ("fixed", "recursive", "sentence_window"):
        out = C.chunk(docs, strategy)
        assert out.columns == C.CHUNK_COLUMNS and {r.doc_id for r in out.collect()} == {1}
    rows = spark.createDataFrame([(1, i, f"s{i}", [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)], "doc_id long, ordinal long, text string, vector array<double>")
    assert [r.text for r in C.chunk(rows, "semantic").orderBy("ordinal").collect()] == ["s0 s1 s2 s3", "s4 s5 s6 s7"]


def test_semantic_chunks_exchange_sentences_once(spark):
    """One exchange by document carries texts and vectors; a sentence's vector needs no join."""
    docs = texts(spark, "One two three. Four five six. One two three. Nine ten. Nine ten.", "Alone.", "", None)
    out = C.chunk(docs, "semantic", embed=R.hashed_vectors)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    rows = {(r.doc_id, r.ordinal): r.text for r in out.collect()}
    assert {d for d, _ in rows} == {0, 1} and rows[(1, 0)] == "Alone."
    assert " ".join(t for (d, _), t in sorted(rows.items()) if d == 0) == "One two three. Four five six. One two three. Nine ten. Nine ten."


def test_engine_by_default_abstains_on_raw_scores(spark):
    passages = spark.createDataFrame([(f"p{i}", f"filler{i} words of passage {i} that say nothing", [1.0, 0.0]) for i in range(30)] + [("x", "zebra quagga okapi. More text.", [0.0, 1.0])], "doc_id string, text string, vector array<double>")
    asked = spark.createDataFrame([("q", "zebra quagga okapi", [0.0, 1.0]), ("r", "unknown thing", [0.0, 1.0])], "query_id string, text string, vector array<double>")
    got = {r.query_id: r for r in Engine(passages, Config()).ask(asked).collect()}
    assert not got["q"].abstained and got["q"].grounded and got["q"].cited == [1]
    top = Engine(passages, Config()).retrieve(asked).where("query_id = 'q' AND rank = 1").first()
    assert top.doc_id == "x" and top.lexical_score > 6.9 and top.score <= 1.0
    assert R.strategies(*[R.bm25(asked, passages, 5)] * 2, 2).groupBy("strategy").count().count() == 4
    assert top.asDict().keys() >= {"dense_score", "lexical_score"}
    assert Engine(passages, Config()).retrieve(asked).select(R.explain().alias("e")).where("e LIKE '%bm25 #1 (%'").count() == 1


def test_engine_reads_its_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"passage {i} tells of topic{i} and more. " * 6) for i in range(6)], "doc_id string, text string")
    snap = Snapshot(spark, str(tmp_path / "ix"), Config(fusion="lexical_only", threshold=0.0))
    first = snap.build(docs)["version"]
    engine = snap.engine()
    asked = spark.createDataFrame([("q", "topic4")], "query_id string, text string")
    assert [r.doc_id for r in engine.retrieve(asked).collect()] == ["d4::0"]
    plain = Engine(snap.table("chunks").select(F.col("chunk_id").alias("doc_id"), "text"), snap.config).retrieve(asked).first()
    assert abs(plain.lexical_score - engine.retrieve(asked).first().lexical_score) < 1e-9
    assert snap.build(docs, force=True)["version"] > first and snap.chunk_ids().count() == 6
    with pytest.raises(Exception, match="must have 3"):
        snap.add_vectors(spark.createDataFrame([("d0::0", [1.0])], "doc_id string, vector array<double>"), 3)
    with pytest.raises(ValueError):
        Config.from_dict({"nonsense": 1})


def test_files_with_odd_paths_and_bytes(spark, tmp_path):
    (tmp_path / "in (1)+ x").mkdir()
    (tmp_path / "in (1)+ x/y.txt").write_bytes(b"bad \xff byte in a text that is long enough to be taken as one document")
    (row,) = S.load_corpus(spark, str(tmp_path / "in (1)+ x")).collect()
    assert row.doc_id == "y" and "�" in row.text and row.repairs == 0
    with pytest.raises(FileNotFoundError):
        S.read_files(spark, str(tmp_path / "none"))


def test_run_comparisons_check_their_pairs(spark):
    run = lambda rows: spark.createDataFrame(rows, "position long, question string, answerable boolean, gold array<long>, value double")
    a, b = run([(0, "x", True, [1], 1.0), (1, "y", True, [2], 0.5)]), run([(0, "y", True, [1], 1.0), (1, "x", True, [2], 0.0)])
    with pytest.raises(ValueError):
        X.compare(a, b)
    assert abs(X.compare_by_gold(a, b, 50).first()["diff"] - 0.25) < 1e-9
    with pytest.raises(ValueError):
        X.compare_by_gold(a, run([(0, "y", True, [], 1.0), (1, "x", True, [2], 0.0)]))
    with pytest.raises(ValueError):
        X.compare_by_gold(a, run([(0, "y", True, [1], 1.0)]))


def test_paraphrases(spark):
    items = spark.createDataFrame([(1, "What does the old garden rule say?", "garden rule"), (2, "When is the library open today?", "library"), (3, "Who signs the form in spring?", "form")], "item_id long, question string, gold_text string")
    tries = spark.createDataFrame(
        [(1, 0, "What does the old garden rule say?"), (1, 1, "1. How must one treat plants outside?"), (2, 0, "When is the library open today?\nnoise"), (3, 0, "short?")], "item_id long, attempt int, raw string"
    )
    got = {r.item_id: r for r in X.paraphrases(items, tries).collect()}
    assert got[1].question == "How must one treat plants outside?" and not got[1].echo
    assert got[2].question == "When is the library open today?" and got[2].echo
    assert got[3].question == "Who signs the form in spring?" and got[3].echo and got[3].gold_overlap > 0
    assert X.unanswerable(spark, ["a?", "b?"], 1).count() == 1
    assert [r[0] for r in spark.createDataFrame([("z",), ("paraphrased",), ("generated",)], "v string").orderBy(X.variant_order(F.col("v"))).collect()] == ["generated", "paraphrased", "z"]


def test_question_texts(spark):
    raw = spark.createDataFrame([('2) "Soru: Bu kural kime uygulanır?"\nek',), ("yukarıda ne yazıyor acaba?",), ("kısa?",)], "t string")
    got = [(r.c, r.u) for r in raw.select(T.clean_question(F.col("t")).alias("c"), T.is_usable_question(T.clean_question(F.col("t")), X.REFERENTIAL).alias("u")).collect()]
    assert got[0][1] and not got[1][1] and not got[2][1]
    assert T.with_instruction(F.lit("x"), "Query: {query}!") is not None

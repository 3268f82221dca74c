"""End-to-end evaluation: retrieval, abstention, answers and citations of a set of questions, judged in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import reports as X
from ..operators import retrieval as R
from . import Engine

RETRIEVAL = ("recall", "precision", "rr", "ndcg")
#: Characters of an answer that a record keeps.
ANSWER_CHARACTERS = 500


def evaluate(engine: Engine, questions: DataFrame, gold: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One record for each question (query_id, text, answerable[, vector]) with gold (query_id, doc_id).

    Questions are searched once. Those that the engine abstains from never reach generate, and both branches are
    joined again by question. Retrieval is judged for answerable questions only and null for the others. A column
    generation_ms of generate's is kept; abstained questions have 0 there.
    """
    gold = R.kept(gold.select("query_id", "doc_id").distinct())
    hits = R.kept(engine.retrieve(questions))
    ranked = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score")))
    found = hits.groupBy("query_id").agg(ranked.alias("found"))
    golds = gold.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("gold"))
    answers = engine.ask(questions, generate, hits)
    kind = hits.schema["doc_id"].dataType.simpleString()
    none = lambda t: F.expr(f"cast(array() AS array<{t}>)")
    asked = questions.select("query_id", F.col("text").alias("question"), "answerable").join(answers, "query_id", "left").join(found, "query_id", "left").join(golds, "query_id", "left")
    own = asked.select(
        "query_id", "question", "answerable", F.coalesce("abstained", F.lit(True)).alias("abstained"), (~F.col("answerable")).alias("should_abstain"), F.substring("answer", 1, ANSWER_CHARACTERS).alias("answer"),
        F.coalesce("cited", none("bigint")).alias("citations"), F.coalesce("invalid", none("bigint")).alias("invalid"), F.coalesce(F.transform("found", lambda x: x["doc_id"]), none(kind)).alias("retrieved"),
        F.coalesce("gold", none(kind)).alias("gold"), F.get("found", F.lit(0))["score"].alias("top_score"), F.coalesce("grounded", F.lit(False)).alias("grounded"), (F.coalesce("generation_ms", F.lit(0.0)) if "generation_ms" in asked.columns else F.lit(None)).cast("double").alias("generation_ms"),
    )
    judged = X.answer_metrics(own).drop("abstained", "should_abstain")
    retrieval = E.retrieval_metrics(questions.where("answerable").select("query_id"), hits, gold, engine.config.top_k)
    return own.drop("should_abstain").join(judged, "query_id").join(retrieval, "query_id", "left")


def summarize(records: DataFrame, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """One row: n, rates of answers, means of retrieval over answerable questions with intervals of recall, rr and ndcg, and generation times."""
    records = R.kept(records)
    answers = X.answer_summary(records.withColumn("should_abstain", ~F.col("answerable")))
    asked = records.where("answerable")
    means = asked.agg(F.count("*").alias("n_answerable"), *[F.avg(c).alias(c) for c in RETRIEVAL], F.avg((F.col("recall") > 0).cast("double")).alias("hit_rate"))
    long = E.numbered_groups(asked.select("query_id", F.explode(F.create_map(*[x for c in ("recall", "rr", "ndcg") for x in (F.lit(c), F.col(c))])).alias("metric", "value")), ["metric"], ["query_id"])
    ends = E.bootstrap_ci(long, resamples, confidence, by=["metric"]).agg(*[F.max(F.when(F.col("metric") == c, F.col(e))).alias(f"{c}_{e}") for c in ("recall", "rr", "ndcg") for e in ("lower", "upper")])
    times = E.run_latency(records.where("generation_ms > 0").select(F.lit(0).alias("all"), F.col("generation_ms").alias("value")), "all").agg(F.max("p50").alias("p50_ms"), F.max("p95").alias("p95_ms"), F.max("most").alias("max_ms"), F.max("mean").alias("mean_ms"))
    return answers.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(times))


def summary_text(name: str, fingerprint: str) -> Column:
    """A row of summarize in lines for a reader."""
    lines = [F.lit(f"{name} ({fingerprint})")]
    lines += [F.concat(F.lit(f"  {c}: "), X.interval_text(F.col(c), F.col(f"{c}_lower"), F.col(f"{c}_upper"))) for c in ("recall", "rr", "ndcg")]
    lines += [F.format_string(f"  {c}: %.4f", F.coalesce(F.col(c), F.lit(0.0))) for c in ("abstention_accuracy", "citation_rate", "invalid_rate", "refusal_recall", "answer_rate", "citation_precision")]
    return F.concat_ws("\n", *lines, F.when(F.col("p50_ms").isNotNull(), F.format_string("  generation: p50 %.0f ms, p95 %.0f ms", "p50_ms", "p95_ms")))

"""Runs compared, answers judged, eval sets built and described.

A run is (position, question, answerable, gold, value): one row for each question, gold an array of passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_question, is_refusal, is_usable_question, jaccard, leaked, lexical_tokens, overlap, repetition, strip_page_markers
from . import evaluation as E
from . import retrieval as R

VARIANTS = ("generated", "paraphrased")
ECHO = 0.8
# Phrases that point at a text which the reader of a question does not have.
REFERENTIAL = ["bu maddede", "bu bölümde", "yukarıda", "aşağıda", "metinde"]
#: More of them, for questions in other wordings or in English.
MORE_REFERENTIAL = [*REFERENTIAL, "bu metin", "bu pasaj", "metne göre", "pasaja göre", "the text", "the passage"]
SEED = 20260801


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Each answer (query_id, abstained, should_abstain, citations, invalid, retrieved, gold) judged.

    Citations count from 1; those outside of retrieved are not counted; without any the precision is 0.
    """
    cited = F.transform(F.filter("citations", lambda c: (c >= 1) & (c <= F.size("retrieved"))), lambda c: F.element_at("retrieved", c.cast("int")))
    right = F.filter(cited, lambda x: F.array_contains("gold", x))
    precision = F.when(F.size(cited) > 0, F.size(right) / F.size(cited)).otherwise(F.lit(0.0))
    return answers.select("query_id", "abstained", "should_abstain", (F.size("citations") > 0).alias("has_citations"), (F.size("invalid") > 0).alias("has_invalid"), precision.alias("citation_precision"), (F.col("abstained") == F.col("should_abstain")).alias("abstention_correct"))


def answer_summary(metrics: DataFrame) -> DataFrame:
    """Rates over all answers; refusal_recall over those that should abstain, answer_rate and citation_precision over the others."""
    share = lambda c: F.avg(c.cast("double"))
    should = F.col("should_abstain")
    return metrics.agg(
        F.count("*").alias("n"), share(F.col("abstention_correct")).alias("abstention_accuracy"), share(F.col("has_citations")).alias("citation_rate"), share(F.col("has_invalid")).alias("invalid_rate"),
        share(F.when(should, F.col("abstained"))).alias("refusal_recall"), share(F.when(~should, ~F.col("abstained"))).alias("answer_rate"), F.avg(F.when(~should, F.col("citation_precision"))).alias("citation_precision"),
    )


def _paired(a: DataFrame, b: DataFrame, key: str, message: str) -> DataFrame:
    """(i, a, b) of the answerable questions of two runs, whose keys must agree at every position."""
    own = lambda x, name: x.where("answerable").select("position", F.col(key).alias(f"key_{name}"), F.coalesce("value", F.lit(0.0)).alias(name))
    both = own(a, "a").join(own(b, "b"), "position", "full")
    if both.where("NOT (key_a <=> key_b)").take(1):
        raise ValueError(message)
    return both.select(F.col("position").alias("i"), "a", "b")


def compare(a: DataFrame, b: DataFrame, resamples: int = 1000) -> DataFrame:
    """The paired test of two runs of the same questions at the same positions; anything else raises."""
    return E.permutation_test(_paired(a, b, "question", "a paired comparison needs the same questions in the same order"), resamples)


def compare_by_gold(a: DataFrame, b: DataFrame, resamples: int = 1000) -> DataFrame:
    """The paired test of two wordings of the same items: each position has the same gold passages, and has some."""
    asked = a.where("answerable")
    if not asked.take(1) or asked.where("gold IS NULL OR size(gold) = 0").take(1):
        raise ValueError("every question needs gold passages")
    return E.permutation_test(_paired(a, b, "gold", "both runs must have the same gold passages at each position"), resamples)


def compare_many(runs: dict[str, DataFrame], baseline: DataFrame, alpha: float = 0.05, resamples: int = 1000) -> DataFrame:
    """Each run against the baseline (name, mean_a, mean_b, diff, p, d, n) with Holm's correction over all of them as reject."""
    pairs = None
    for name, run in runs.items():
        own = _paired(baseline, run, "question", "a paired comparison needs the same questions in the same order").withColumn("name", F.lit(name))
        pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is None:
        raise ValueError("no run to compare")
    tests = E.permutation_test(pairs, resamples, by=["name"])
    return E.holm(tests, alpha)


def interval_text(estimate: Column, lower: Column, upper: Column) -> Column:
    return F.format_string("%.4f [%.4f, %.4f]", estimate, lower, upper)


def paraphrases(items: DataFrame, attempts: DataFrame, echo: float = ECHO, referential: list[str] | None = None) -> DataFrame:
    """(item_id, question, original, echo, gold_overlap): one row for each item (item_id, question, gold_text).

    attempts (item_id, attempt, raw): the first usable one that shares at most echo of its tokens with the
    original, else the last usable one, else the original; the last two are marked as echoes.
    """
    text = attempts.select("item_id", "attempt", clean_question(F.col("raw")).alias("text"))
    usable = text.where(is_usable_question(F.col("text"), REFERENTIAL if referential is None else referential))
    joined = usable.join(items.select("item_id", "question"), "item_id")
    tokens = lambda c: F.array_distinct(lexical_tokens(F.col(c)))
    both_empty = (F.size(tokens("text")) == 0) & (F.size(tokens("question")) == 0)
    similarity = F.when(both_empty, F.lit(1.0)).otherwise(jaccard(tokens("text"), tokens("question")))
    best = joined.withColumn("new", similarity <= echo).groupBy("item_id").agg(F.min(F.when(F.col("new"), F.struct("attempt", "text")))["text"].alias("first"), F.max(F.struct("attempt", "text"))["text"].alias("last"))
    out = items.join(best, "item_id", "left")
    chosen = F.coalesce("first", "last", "question")
    return out.select("item_id", chosen.alias("text"), F.col("question").alias("original"), F.col("first").isNull().alias("echo"), overlap(lexical_tokens(chosen), lexical_tokens(F.col("gold_text"))).alias("gold_overlap")).withColumnRenamed("text", "question")


def drawn(passages: DataFrame, n: int, least: int = 300, seed: int = SEED, factor: float = 2.5) -> DataFrame:
    """(doc_id, source, text, attempt) of the passages (doc_id, text[, source]) that may be tried: the first min(pool, factor * n) in the order of a seeded hash, from 1.

    The order does not depend on which attempts succeed. It is a top-k, so no task holds the pool.
    """
    most = int(n * factor)
    source = F.col("source") if "source" in passages.columns else F.col("doc_id").cast("string")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    pool = passages.where(F.length("text") >= least).select(draw.alias("draw"), "doc_id", source.alias("source"), "text").orderBy("draw", "doc_id").limit(most)
    # At most factor * n rows are left.
    return pool.withColumn("attempt", F.row_number().over(Window.orderBy("draw", "doc_id")).cast("long")).drop("draw")


def generated_questions(passages: DataFrame, generate: Callable[[DataFrame], DataFrame], n: int = 40, least: int = 300, seed: int = SEED, factor: float = 2.5, referential: list[str] | None = None, passage_chars: int = 1500, answer_chars: int = 400) -> DataFrame:
    """n questions of drawn passages, or as many as min(pool, factor * n) attempts give: (position, attempt, question, gold, source_doc, gold_answer, gold_overlap, variant, answerable).

    generate maps (doc_id, attempt, passage) to (doc_id, raw), at most one row each; a missing or null reply is a failed attempt. A
    reply counts when it is usable and no earlier attempt had the same tokens. Attempts run in rounds of n, and the
    draw stops after the round that reaches n; the last question is the n-th usable one in draw order, whatever ran beyond it.
    """
    pool = R.kept(drawn(passages, n, least, seed, factor))
    tried, found = 0, None
    most = pool.count()
    while tried < most and n > 0:
        part = pool.where((F.col("attempt") > tried) & (F.col("attempt") <= tried + n)).withColumn("passage", F.substring(F.trim(strip_page_markers(F.col("text"))), 1, passage_chars))
        replies = generate(part.select("doc_id", "attempt", "passage")).select("doc_id", clean_question(F.col("raw")).alias("question"))
        usable = R.kept(part.drop("text").join(replies, "doc_id").where(is_usable_question(F.col("question"), REFERENTIAL if referential is None else referential)))
        found = usable if found is None else found.unionByName(usable)
        tried += n
        if found.select(_question_key()).distinct().count() >= n:
            break
    if found is None:
        raise ValueError("no passage is long enough for a question")
    first = found.groupBy(_question_key()).agg(F.min_by(F.struct(*found.columns), "attempt").alias("x")).select("x.*")
    position = F.row_number().over(Window.orderBy("attempt")) - 1  # of at most factor * n rows
    rows = first.withColumn("position", position.cast("long")).where(F.col("position") < n)
    share = F.round(overlap(lexical_tokens(F.col("question")), lexical_tokens(F.col("passage"))), 4)
    return rows.select("position", "attempt", "question", F.array("doc_id").alias("gold"), F.col("source").alias("source_doc"), F.substring("passage", 1, answer_chars).alias("gold_answer"), share.alias("gold_overlap"), F.lit(VARIANTS[0]).alias("variant"), F.lit(True).alias("answerable"))


def _question_key() -> Column:
    return F.array_join(lexical_tokens(F.col("question")), " ").alias("key")


def unanswerable(spark: SparkSession, questions: list[str], n: int | None = None) -> DataFrame:
    """Eval rows of questions that no passage answers, the first n of the list."""
    rows = [(i, q, False, "unanswerable") for i, q in enumerate(questions if n is None else questions[:n])]
    return spark.createDataFrame(rows, "position long, question string, answerable boolean, variant string")


def variant_order(variant: Column) -> Column:
    """Sort key of variants: the known ones first, then the others by name."""
    known = F.coalesce(*[F.when(variant == v, F.lit(str(i))) for i, v in enumerate(VARIANTS)])
    return F.coalesce(known, F.concat(F.lit("~"), variant))


def evalset_stats(questions: DataFrame) -> DataFrame:
    """Per variant of (variant, answerable, source_doc, question, gold_overlap, echo): counts, documents, overlap, echoes, length."""
    return questions.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if(F.col("answerable")).alias("n_answerable"), F.countDistinct(F.nullif("source_doc", F.lit(""))).alias("documents"),
        F.round(F.avg("gold_overlap"), 4).alias("gold_overlap"), F.count_if((F.col("variant") == "paraphrased") & F.col("echo")).alias("echoes"), F.round(F.avg(F.length("question")), 1).alias("mean_chars"),
    )


def fidelity(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """mean, median, least, p10 and the number below threshold of pairs (id, cosine)."""
    return pairs.agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.percentile("cosine", F.lit(0.5)).alias("median"), F.min("cosine").alias("least"), F.percentile("cosine", F.lit(0.1)).alias("p10"), F.count_if(F.col("cosine") < threshold).alias("suspect"))


def model_comparison(replies: DataFrame) -> DataFrame:
    """Per model of (model, case_id, answer, latency, must_contain, expect_refusal): latency, repetition, groundings, refusals."""
    found = F.exists("must_contain", lambda k: F.contains(F.lower("answer"), F.lower(k)))
    return replies.groupBy("model").agg(
        F.count("*").alias("n"), F.avg("latency").alias("mean_latency"), F.avg(repetition(F.col("answer"))).alias("mean_repetition"), F.count_if(~F.col("expect_refusal") & F.coalesce(found, F.lit(False))).alias("grounded"),
        F.count_if(F.col("expect_refusal") & is_refusal(F.col("answer"))).alias("refused"),
    )


def prompt_ablation(replies: DataFrame) -> DataFrame:
    """Per (language, budget) of (language, budget, answerable, answer, citations, latency): right refusals, leaks, answers, repetition."""
    refused, cites = is_refusal(F.col("answer")), F.size("citations") > 0
    return replies.groupBy("language", "budget").agg(
        F.count_if(~F.col("answerable") & refused & ~cites).alias("refused"), F.count_if(leaked(F.col("answer"))).alias("leaks"), F.count_if(F.col("answerable") & ~refused & cites).alias("answered"),
        F.avg(repetition(F.col("answer"))).alias("mean_repetition"), F.avg("latency").alias("mean_latency"),
    )


def save_report(rows: DataFrame, path: str) -> None:
    """A report or an eval set as JSON lines; an earlier one at the path must be moved or named otherwise first."""
    rows.write.mode("errorifexists").json(path)


def load_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)



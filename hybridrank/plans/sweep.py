"""A sweep of configurations over questions as one plan, and the comparisons that are made of it.

Configurations are rows of a table. Each distinct arm (side, stems, truncation, query template) is searched once for all
questions of all wordings, and its hits are kept; every configuration fuses, reorders and is judged in one plan
grouped by (config, question).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, with_instruction
from ..operators import evaluation as E
from ..operators import reports as X
from ..operators import retrieval as R
from . import INSTRUCTION, Config, sweep_configs

METRICS = ("recall", "precision", "rr", "ndcg")
#: Hypotheses stated before a sweep, each with what it is held against; they are outside of any correction.
PLANNED = (("lexical-only", "lexical-nostem"), ("rrf", "baseline-dense"), ("weighted-rerank", "weighted-0.5"))


def _arm(c: Config, side: str, embedded: bool) -> tuple:
    """What tells one side's search of a configuration from another's."""
    return (side, c.stemmed, c.truncate) if side == "lexical" else (side, c.instruct and embedded)


def _sides(c: Config) -> tuple[str, ...]:
    return {"dense_only": ("dense",), "lexical_only": ("lexical",)}.get(c.fusion, ("dense", "lexical"))


def arms(configs: list[Config], questions: DataFrame, passages: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(arm, query_id, doc_id, score, rank): each arm that a configuration uses once, as deep as the deepest of them needs. vectors (doc_id, vector) are those of passages, if not there."""
    vectors = passages if vectors is None else vectors
    depth: dict[tuple, int] = {}
    for c in configs:
        for side in _sides(c):
            key = _arm(c, side, embed is not None)
            depth[key] = max(depth.get(key, 0), c.dense_k if side == "dense" else c.lexical_k)
    out = None
    for key, k in depth.items():
        if key[0] == "lexical":
            hits = R.bm25(questions.select("query_id", "text"), passages.select("doc_id", "text"), k, key[1], key[2])
        else:
            asked = questions
            if embed:
                texts = questions.select(F.col("query_id").alias("doc_id"), with_instruction(F.col("text"), INSTRUCTION, key[1]).alias("text"))
                asked = embed(texts).select(F.col("doc_id").alias("query_id"), "vector")
            hits = R.dense(asked.select("query_id", "vector"), vectors.select("doc_id", "vector"), k)
        own = hits.select(F.lit(repr(key)).alias("arm"), "query_id", "doc_id", "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def _table(configs: list[Config], questions: DataFrame, embedded: bool) -> DataFrame:
    """One row for each configuration and side: a few dozen, which every task may hold."""
    weight = {"dense_only": 1.0, "lexical_only": 0.0}
    rows = [(c.name, side, repr(_arm(c, side, embedded)), c.dense_k if side == "dense" else c.lexical_k, c.fusion == "rrf", c.rrf_k, float(weight.get(c.fusion, c.alpha)), c.top_k, c.use_mmr, c.mmr_trade, c.rerank, c.rerank_head) for c in configs for side in _sides(c)]
    return questions.sparkSession.createDataFrame(rows, "config string, side string, arm string, depth int, rrf boolean, rrf_k int, alpha double, top_k int, use_mmr boolean, mmr_trade double, rerank boolean, rerank_head int")


def fused(hits: DataFrame, table: DataFrame) -> DataFrame:
    """(run, config, query_id, doc_id, score, rank, ...settings) for all configurations: run is their struct with the question."""
    settings = ["rrf", "rrf_k", "alpha", "top_k", "use_mmr", "mmr_trade", "rerank", "rerank_head"]
    own = hits.join(F.broadcast(table), "arm").where(F.col("rank") <= F.col("depth"))
    arm = Window.partitionBy("config", "side", "query_id")
    low, high = F.min("score").over(arm), F.max("score").over(arm)
    scaled = F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sides = [of(side, c).alias(f"{side}_{c}") for side in ("dense", "lexical") for c in ("rank", "score", "scaled")]
    both = own.withColumn("scaled", scaled).groupBy("config", "query_id", "doc_id", *settings).agg(*sides)
    part = lambda side: F.coalesce(F.lit(1.0) / (F.col("rrf_k") + F.col(f"{side}_rank")), F.lit(0.0))
    share = lambda side: F.coalesce(f"{side}_scaled", F.lit(0.0))
    score = F.when(F.col("rrf"), part("dense") + part("lexical")).otherwise(F.col("alpha") * share("dense") + (1 - F.col("alpha")) * share("lexical"))
    order = Window.partitionBy("config", "query_id").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "doc_id")
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("config", "query_id")))
    return ranked.withColumn("run", F.struct("config", "query_id")).drop("dense_scaled", "lexical_scaled")


#: Ids that are broadcast to find their passages, at most.
FEW = 1 << 20


class Sweep:
    """Configurations over questions (query_id, text, variant, position[, vector]) with gold (query_id, doc_id) and passages (doc_id, text[, vector]).

    variant names a wording, position an item that every wording asks for. Questions without gold are not asked.
    The first configuration is the baseline. reorder is that of Engine, with (config, query_id) as the query_id; configurations that
    need one are left out where there is none. All configurations are judged at one top_k. Vectors of passages may come as a table
    of their own, vectors (doc_id, vector), with ids of passages only, so that no join carries the texts.
    """

    def __init__(self, questions: DataFrame, gold: DataFrame, passages: DataFrame, configs: list[Config] | None = None, reorder: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, resamples: int = 1000, vectors: DataFrame | None = None) -> None:
        chosen = [c for c in (configs or sweep_configs()) if reorder or not c.rerank]
        if len({c.top_k for c in chosen}) != 1 or len({c.name for c in chosen}) != len(chosen):
            raise ValueError("a sweep needs configurations of different names and one top_k")
        self.configs, self.resamples, self.reorder, self.passages = chosen, resamples, reorder, passages
        # Every arm, every metric and every comparison asks for these again, so they are made once.
        self.gold = R.kept(gold.select("query_id", "doc_id").distinct())
        self.questions = R.kept(questions.join(self.gold.select("query_id").distinct(), "query_id", "left_semi"))
        self.embed, self.vectors = embed, passages if vectors is None else vectors

    @cached_property
    def arms(self) -> DataFrame:
        """Every arm's hits, made once."""
        return R.kept(arms(self.configs, self.questions, self.passages, self.embed, self.vectors))

    @cached_property
    def hits(self) -> DataFrame:
        """(config, query_id, doc_id, rank) of every configuration."""
        return self._hits(fused(self.arms, _table(self.configs, self.questions, self.embed is not None)))

    @cached_property
    def metrics(self) -> DataFrame:
        """(config, query_id, variant, position, recall, precision, rr, ndcg, first_rank), a row for every configuration and question, made once."""
        return R.kept(self._metrics())

    def _hits(self, rows: DataFrame) -> DataFrame:
        """The final hits (config, query_id, doc_id, rank): heads reordered and pools diversified where a configuration says so."""
        plain = ["config", "query_id", "run", "doc_id", "rank", "n", "top_k", "use_mmr"]
        out = rows.where("NOT rerank").select(*plain)
        if any(c.rerank for c in self.configs):
            out = out.unionByName(self._reordered(rows.where("rerank"), plain))
        last = out.where("NOT use_mmr")
        for c in self.configs:
            if c.use_mmr:
                last = last.unionByName(self._diverse(out.where(F.col("config") == c.name), c, plain))
        return last.where(F.col("rank") <= F.col("top_k")).select("config", "query_id", "doc_id", "rank")

    def _told(self, rows: DataFrame, table: DataFrame, depth: int) -> DataFrame:
        """rows with what table has of their doc_id, at most depth rows for each question; few rows are broadcast, so that the table stays where it is."""
        few = depth * self.questions.count() <= FEW
        return rows.join(table.join(F.broadcast(rows.select("doc_id").distinct()), "doc_id", "left_semi") if few else table, "doc_id", "left")

    def _reordered(self, own: DataFrame, plain: list[str]) -> DataFrame:
        head = own.where("n > 1 AND rank <= rerank_head").select("run", "query_id", "rank", "doc_id")
        depth = sum(c.rerank_head for c in self.configs if c.rerank)
        head = self._told(head, self.passages.select("doc_id", "text"), depth).join(self.questions.select("query_id", F.col("text").alias("question")), "query_id")
        order = self.reorder(head.select(F.col("run").alias("query_id"), "question", "rank", "doc_id", "text"))
        places = order.select(F.col("query_id").alias("run"), F.posexplode("ordering").alias("place", "old")).select("run", (F.col("old") + 1).cast("long").alias("rank"), (F.col("place") + 1).cast("long").alias("new"))
        # A reordered head stays before the tail.
        place = F.when(F.col("rank") <= F.col("rerank_head"), F.coalesce("new", "rank")).otherwise(F.col("rank"))
        new = F.row_number().over(Window.partitionBy("run").orderBy(place, "rank")).cast("long")
        return own.join(places, ["run", "rank"], "left").withColumn("new", new).select(*[F.col("new").alias("rank") if c == "rank" else c for c in plain])

    def _diverse(self, own: DataFrame, c: Config, plain: list[str]) -> DataFrame:
        pool = own.where((F.col("n") > c.top_k) & (F.col("rank") <= max(c.rerank_head, 3 * c.top_k))).select("run", "query_id", "doc_id", "rank")
        pool = self._told(pool, self.vectors.select("doc_id", "vector"), max(c.rerank_head, 3 * c.top_k)).join(self.questions.select("query_id", F.col("vector").alias("asked")), "query_id")
        picked = R.mmr(pool.select(F.col("run").alias("query_id"), "doc_id", "rank", "vector", dot(F.col("asked"), F.col("vector")).alias("relevance")), c.mmr_trade, c.top_k).withColumnRenamed("query_id", "run")
        kept = own.join(picked, ["run", "doc_id"], "left").where((F.col("n") <= c.top_k) | F.col("step").isNotNull())
        return kept.select(*[F.coalesce("step", "rank").alias("rank") if x == "rank" else x for x in plain])

    def _metrics(self) -> DataFrame:
        names = F.array(*[F.lit(c.name) for c in self.configs])
        run = F.struct("config", "query_id").alias("query_id")
        every = self.questions.select("query_id", F.explode(names).alias("config"))
        judged = E.retrieval_metrics(every.select(run), self.hits.select(run, "doc_id", "rank"), self.gold.select("query_id", "doc_id", F.explode(names).alias("config")).select(run, "doc_id"), self.configs[0].top_k)
        rows = judged.select("query_id.config", "query_id.query_id", *METRICS, "first_rank")
        return rows.join(self.questions.select("query_id", "variant", "position"), "query_id")

    def summary(self, confidence: float = 0.95) -> DataFrame:
        """(variant, config, n, <metric>..., hit_rate, <metric>_lower, <metric>_upper for recall, rr and ndcg)."""
        means = self.metrics.groupBy("variant", "config").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in METRICS], F.avg((F.col("recall") > 0).cast("double")).alias("hit_rate"))
        long = self.metrics.select("variant", "config", "position", F.explode(F.create_map(*[x for c in ("recall", "rr", "ndcg") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
        by = ["variant", "config", "metric"]
        # A wording may lack items, so places are counted anew.
        ends = E.bootstrap_ci(E.numbered_groups(long, by, ["position"]), self.resamples, confidence, by=by)
        wide = ends.groupBy("variant", "config").agg(*[F.max(F.when(F.col("metric") == c, F.col(e))).alias(f"{c}_{e}") for c in ("recall", "rr", "ndcg") for e in ("lower", "upper")])
        return means.join(wide, ["variant", "config"])

    def _against(self, pairs: list[tuple[str, str]], metric: str) -> DataFrame:
        """(variant, config, other, mean, other_mean, diff, p, d, n) of the named pairs; a positive difference is for the first."""
        told = self.metrics.sparkSession.createDataFrame(pairs, "config string, other string")
        own = self.metrics.select("variant", "position", "config", F.col(metric).alias("a"))
        other = own.withColumnsRenamed({"config": "other", "a": "b"})
        both = own.join(F.broadcast(told), "config").join(other, ["variant", "position", "other"]).withColumnRenamed("position", "i")
        return E.permutation_test(both, self.resamples, by=["variant", "config", "other"]).withColumnsRenamed({"mean_a": "mean", "mean_b": "other_mean"})

    def comparisons(self, metric: str = "ndcg", alpha: float = 0.05) -> DataFrame:
        """Each configuration against the baseline, within each wording a family of tests, with reject and a verdict."""
        base = self.configs[0].name
        tests = self._against([(c.name, base) for c in self.configs[1:]], metric)
        return E.holm(tests.withColumn("name", F.col("config")), alpha, by=["variant"]).drop("name", "other").withColumnRenamed("other_mean", "baseline").withColumn("verdict", E.verdict(F.col("p"), F.col("reject"), alpha=alpha))

    def planned(self, metric: str = "ndcg", pairs: tuple[tuple[str, str], ...] = PLANNED) -> DataFrame:
        """The hypotheses whose configurations were run, uncorrected."""
        names = {c.name for c in self.configs}
        return self._against([p for p in pairs if set(p) <= names], metric)

    def wording_gap(self, first: str = X.VARIANTS[0], second: str = X.VARIANTS[1], metric: str = "ndcg", alpha: float = 0.05) -> DataFrame:
        """What each configuration loses from one wording to the other: (config, mean_first, mean_second, diff, p, d, n, reject, verdict), one family.

        Items are paired by position; where both wordings do not have the same gold passages at every
        position there is nothing to compare, and the call raises.
        """
        golds = self.gold.join(self.questions.select("query_id", "variant", "position"), "query_id").groupBy("variant", "position").agg(F.sort_array(F.collect_set("doc_id")).alias("gold"))
        side = lambda name, g: golds.where(F.col("variant") == name).select("position", F.col("gold").alias(g))
        if side(first, "a").join(side(second, "b"), "position", "full").where("NOT (a <=> b)").take(1):
            raise ValueError("both wordings must have the same gold passages at each position")
        own = lambda name, c: self.metrics.where(F.col("variant") == name).select("config", F.col("position").alias("i"), F.col(metric).alias(c))
        tests = E.permutation_test(own(second, "a").join(own(first, "b"), ["config", "i"]), self.resamples, by=["config"])
        out = E.holm(tests.withColumn("name", F.col("config")).withColumn("family", F.lit(0)), alpha, by=["family"]).drop("name", "family")
        return out.withColumnsRenamed({"mean_a": "mean_second", "mean_b": "mean_first"}).withColumn("verdict", E.verdict(F.col("p"), F.col("reject"), F.when(F.col("diff") < 0, "significant drop").otherwise("significant gain"), alpha))

    def power(self) -> DataFrame:
        """(variant, n, effect, d, needed, sufficient) for small, medium and large effects."""
        sizes = [("small", 0.2, E.required_sample_size(0.2)), ("medium", 0.5, E.required_sample_size(0.5)), ("large", 0.8, E.required_sample_size(0.8))]
        needed = F.array(*[F.struct(F.lit(e).alias("effect"), F.lit(d).alias("d"), F.lit(n).cast("long").alias("needed")) for e, d, n in sizes])
        counts = self.questions.groupBy("variant").agg(F.count("*").alias("n"))
        return counts.select("variant", "n", F.explode(needed).alias("x")).select("variant", "n", "x.*").withColumn("sufficient", F.col("n") >= F.col("needed"))


def overlap_order(heads: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """An offline reorder: heads by the share of the question's tokens that a passage has, then as they were."""
    from ..functions.text import overlap

    share = F.round(overlap(tokens(F.col("question")), tokens(F.col("text"))), 9)
    rows = heads.select("query_id", F.struct((-share).alias("s"), "rank").alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("query_id", F.transform("xs", lambda x: (x["rank"] - 1).cast("int")).alias("ordering"))

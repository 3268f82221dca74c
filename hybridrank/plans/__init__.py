"""Index snapshots, configurations, and the batch engine over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFUSAL_TEXT, citation_label, citations, dot, is_refusal, prompt_language, read_text, strip_page_markers, with_instruction
from ..operators import retrieval


@dataclass(frozen=True)
class Config:
    """All knobs with their defaults; the chunk and embedding knobs alone decide whether an index is rebuilt."""

    name: str = "default"
    chunk: dict[str, Any] = field(default_factory=lambda: {"strategy": "recursive", "size": 900, "overlap": 150, "least": 120})
    embedding: str = "precomputed"
    fusion: str = "weighted"
    rrf_k: int = 60
    alpha: float = 0.5
    dense_k: int = 30
    lexical_k: int = 30
    top_k: int = 5
    stemmed: bool = True
    truncate: int | None = None
    use_mmr: bool = False
    mmr_trade: float = 0.7
    rerank_head: int = 12
    budget: int = 1600
    threshold: float = 6.865533
    abstain: bool = True
    signal: str = "lexical_raw"
    language: str = "auto"
    instruct: bool = False
    rerank: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Config:
        """A configuration from a mapping, such as a parsed YAML or JSON file; unknown names raise."""
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str) -> Config:
        """A configuration of a YAML or JSON file on the driver; what it does not name has its default."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text or "{}"))

    def save(self, path: str) -> None:
        """All settings as YAML or JSON, by the file's suffix."""
        with open(path, "w", encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                yaml.safe_dump(asdict(self), f, allow_unicode=True, sort_keys=False)
            else:
                json.dump(asdict(self), f, ensure_ascii=False, indent=2)

    def fingerprint(self) -> str:
        return _digest({k: v for k, v in asdict(self).items() if k != "name"})

    def index_fingerprint(self) -> str:
        return _digest({"chunk": self.chunk, "embedding": self.embedding, "stemmed": self.stemmed, "truncate": self.truncate})


def _digest(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:12]


def sweep_configs() -> list[Config]:
    """The compared configurations; the first is the baseline."""
    base = Config()
    return [
        replace(base, name="baseline-dense", fusion="dense_only", stemmed=False),
        replace(base, name="lexical-only", fusion="lexical_only"),
        replace(base, name="lexical-nostem", fusion="lexical_only", stemmed=False),
        replace(base, name="rrf", fusion="rrf"),
        replace(base, name="rrf-k20", fusion="rrf", rrf_k=20),
        replace(base, name="rrf-k120", fusion="rrf", rrf_k=120),
        replace(base, name="weighted-0.5", alpha=0.5),
        replace(base, name="weighted-0.7", alpha=0.7),
        replace(base, name="rrf-truncate6", fusion="rrf", truncate=6),
        replace(base, name="rrf-instruct", fusion="rrf", instruct=True),
        replace(base, name="rrf-mmr", fusion="rrf", use_mmr=True),
        replace(base, name="weighted-rerank", rerank=True),
    ]


PROMPTS = {
    "tr": "Soruyu yalnızca aşağıdaki pasajlara dayanarak, kısa ve tahmin etmeden yanıtla. Her bilginin ardından pasajın numarasını [1] biçiminde yaz. Pasajlar yetmiyorsa yalnızca şunu yaz: {refusal}\n\nPasajlar:\n",
    "en": "Answer the question from the passages below alone, briefly and without guessing. Put the number of the passage after each statement, as in [1]. If they do not suffice, write only: {refusal}\n\nPassages:\n",
}
INSTRUCTION = "Instruct: find passages that answer the question\nQuery: {query}"


class Engine:
    """Whole batches of questions (query_id, text[, vector]) against passages (doc_id, text[, vector]).

    reorder, if given, maps the heads of all rankings (query_id, question, rank, doc_id, text) to
    (query_id, ordering): an array of places from 0; a query without a row keeps its order. embed, if given,
    maps (doc_id, text) to (doc_id, vector) for questions that come without vectors.
    """

    def __init__(self, passages: DataFrame, config: Config | None = None, reorder: Callable[[DataFrame], DataFrame] | None = None, index: tuple[DataFrame, DataFrame] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.passages, self.config, self.reorder, self.index, self.embed = passages, config or Config(), reorder, index, embed
        if self.config.rerank and not reorder:
            raise ValueError("a configuration with rerank needs a reorder function")

    def describe(self) -> str:
        c = self.config
        return f"{c.name}: {c.fusion}, dense {c.dense_k}, lexical {c.lexical_k}, top {c.top_k}, mmr {c.use_mmr}, rerank {bool(self.reorder)}, threshold {c.threshold} on {c.signal}"

    def _embedded(self, asked: DataFrame) -> DataFrame:
        """Questions with a vector each, of their text inside the query template where the configuration says so."""
        texts = asked.select(F.col("query_id").alias("doc_id"), with_instruction(F.col("text"), INSTRUCTION, self.config.instruct).alias("text"))
        return asked.join(self.embed(texts).withColumnRenamed("doc_id", "query_id"), "query_id")

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """The first top_k hits of each question with both arms' own scores and ranks."""
        c = self.config
        asked = questions.where(F.trim("text") != "")
        if self.embed and c.fusion != "lexical_only" and "vector" not in asked.columns:
            asked = self._embedded(asked)
        kind = self.passages.schema["doc_id"].dataType
        empty = asked.select("query_id", F.lit(None).cast(kind).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
        lexical = retrieval.bm25(asked, self.passages, c.lexical_k, c.stemmed, c.truncate, self.index) if c.fusion != "dense_only" else empty
        dense = retrieval.dense(asked, self.passages, c.dense_k) if c.fusion != "lexical_only" else empty
        diverse = c.use_mmr and "vector" in self.passages.columns and "vector" in asked.columns
        if not self.reorder and not diverse:
            return retrieval.fuse(dense, lexical, c.fusion, c.rrf_k, c.alpha, c.top_k)
        hits = retrieval.fuse(dense, lexical, c.fusion, c.rrf_k, c.alpha)
        if self.reorder:
            hits = self._reranked(hits, asked)
        if diverse:
            hits = self._diversified(hits, asked)
        return hits.where(F.col("rank") <= c.top_k)

    def _reranked(self, hits: DataFrame, asked: DataFrame) -> DataFrame:
        """The head of each ranking of more than one hit in the order that reorder gives."""
        c = self.config
        several = hits.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where((F.col("n") > 1) & (F.col("rank") <= c.rerank_head))
        head = several.select("query_id", "rank", "doc_id").join(self.passages.select("doc_id", "text"), "doc_id").join(asked.select("query_id", F.col("text").alias("question")), "query_id")
        ordered = retrieval.rerank(hits, self.reorder(head.select("query_id", "question", "rank", "doc_id", "text")), c.rerank_head)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("new_rank", "rank")).cast("long")
        return ordered.select(*[place.alias("rank") if x == "rank" else x for x in hits.columns])

    def _diversified(self, hits: DataFrame, asked: DataFrame) -> DataFrame:
        """MMR over the first hits of each ranking that has more than top_k."""
        c = self.config
        counted = hits.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
        pool = counted.where((F.col("n") > c.top_k) & (F.col("rank") <= max(c.rerank_head, 3 * c.top_k))).select("query_id", "doc_id", "rank")
        pool = pool.join(self.passages.select("doc_id", "vector"), "doc_id").join(asked.select("query_id", F.col("vector").alias("query_vector")), "query_id")
        picked = retrieval.mmr(pool.withColumn("relevance", dot(F.col("query_vector"), F.col("vector"))), c.mmr_trade, c.top_k)
        kept = counted.join(picked, ["query_id", "doc_id"], "left").where((F.col("n") <= c.top_k) | F.col("step").isNotNull())
        return kept.select(*[F.coalesce("step", "rank").alias("rank") if x == "rank" else x for x in hits.columns])

    def ask(self, questions: DataFrame, generate=None, hits: DataFrame | None = None) -> DataFrame:
        """(query_id, abstained, answer, cited, invalid, grounded, language, sources) and what else generate tells of an answer.

        sources are the labels of the cited passages.

        generate maps (query_id, prompt, question, context) to (query_id, answer, ...); abstained rows never reach it.
        hits are those of retrieve, where they are at hand.
        """
        c = self.config
        told = [x for x in ("doc_id", "text", "source", "window_text") if x in self.passages.columns]
        hits = (self.retrieve(questions) if hits is None else hits).join(self.passages.select(*told), "doc_id")
        decided = retrieval.abstention(questions, hits, c.threshold, c.abstain, c.signal)
        optional = lambda name: F.col(name) if name in told else F.lit(None).cast("string")
        label = citation_label(optional("source"), F.col("doc_id"), F.col("text"))
        shown = strip_page_markers(read_text(optional("window_text"), F.col("text")))
        blocks = hits.withColumn("block", F.format_string("[%d] (%s)\n%s", F.col("rank"), label, shown))
        held = retrieval.context(blocks, c.budget).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
        labels = F.transform(F.sort_array(F.collect_list(F.struct("rank", label.alias("label")))), lambda x: x["label"])
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), labels.alias("labels"))
        prompts = decided.where("NOT abstains").join(held, "query_id").join(counts, "query_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        prompts = prompts.withColumn("language", prompt_language(F.col("question"), c.language))
        head = F.when(F.col("language") == "en", PROMPTS["en"].format(refusal=REFUSAL_TEXT["en"])).otherwise(PROMPTS["tr"].format(refusal=REFUSAL_TEXT["tr"]))
        prompts = prompts.select("query_id", "n_hits", "labels", "question", "context", "language", F.concat(head, "context", F.lit("\n\n"), "question").alias("prompt"))
        # Without a model the answer is the first sentence of the first passage, or all of it.
        passage = F.regexp_extract("context", r"(?s)^\[1\][^\n]*\n(.*?)(?:\n\n\[2\] \(|$)", 1)
        sentence = F.regexp_extract(passage, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
        replies = generate(prompts.select("query_id", "prompt", "question", "context")) if generate else prompts.select("query_id", F.concat(F.when(sentence == "", passage).otherwise(sentence), F.lit(" [1]")).alias("answer"))
        marks = citations(F.col("answer"))
        within = lambda x: (x >= 1) & (x <= F.col("n_hits"))
        cited = replies.join(prompts.select("query_id", "n_hits", "labels", "language"), "query_id").withColumn("cited", F.filter(marks, within)).withColumn("invalid", F.filter(marks, lambda x: ~within(x)))
        out = decided.select("query_id", "abstains").join(cited, "query_id", "left")
        refused = is_refusal(F.col("answer")) & (F.size("cited") == 0)
        grounded = F.coalesce((F.size("cited") > 0) & (F.size("invalid") == 0), F.lit(False))
        more = [x for x in replies.columns if x not in ("query_id", "answer", "abstained", "cited", "invalid", "grounded", "language", "sources", "labels", "n_hits")]
        sources = F.transform("cited", lambda i: F.element_at("labels", i.cast("int")))
        return out.select("query_id", (F.col("abstains") | F.coalesce(refused, F.lit(True))).alias("abstained"), "answer", "cited", "invalid", grounded.alias("grounded"), "language", sources.alias("sources"), *more)


from .snapshot import Snapshot  # noqa: E402, F401

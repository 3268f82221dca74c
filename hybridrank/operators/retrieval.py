"""Lexical and dense arms, fusion, diversification, context and abstention.

Queries come as (query_id, ...), results as (query_id, doc_id, score, rank). Every ranking ends with the id,
so that equal scores have one order.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .postings import MEMO, TERM_BYTES, _folded, blocked, bm25_scores, idf, list_scores, postings, slices, span_count, terms_of, weight  # noqa: F401
from .vectors import products

def kept(df: DataFrame) -> DataFrame:
    """df, made once: in the shared checkpoint folder where there is one, else held by the executors."""
    sc = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return df.checkpoint() if sc._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def corpus_size(passages: DataFrame) -> DataFrame:
    """One row: n and avgdl in tokens, passages without tokens included. Stemming leaves their number as it is."""
    size = F.regexp_count(fold(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"))
    return passages.select(size.alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def bm25(queries: DataFrame, passages: DataFrame, k: int = 30, stemmed: bool = True, truncate: int | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best passages of each query (query_id, text). A repeated query term counts each time.

    index: postings (term, doc_id, tf, len) and one row (n, avgdl); without it they are made from passages.
    Posting lists are cut to the terms that queries have, a stated set that is counted first, before anything is
    exchanged. Document frequencies and scores read one exchange. For an index in blocks see blocked_bm25.
    """
    wanted = terms_of(queries, stemmed, truncate)
    every, size = index or (postings(passages, stemmed, truncate), corpus_size(passages))
    n, asked = wanted.count(), wanted.select("term").distinct()
    # Where the plan does not know how few terms there are, as after a checkpoint, it would exchange every posting to find theirs.
    few = F.broadcast(asked) if n * 64 <= TERM_BYTES else asked
    lists = every.join(few, "term", "left_semi").repartition("doc_id")
    # The same columns as below, so that it is the same exchange.
    df = lists.groupBy("term").agg(F.count(F.when((F.col("tf") > 0) & (F.col("len") > 0) & F.col("doc_id").isNotNull(), 1)).alias("df"))
    weights = wanted.join(df, "term").crossJoin(F.broadcast(size.select("n"))).select("query_id", "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"))
    weighed = lists.crossJoin(F.broadcast(size.select("avgdl"))).select("doc_id", "term", weight(F.col("tf"), F.col("len"), F.col("avgdl")).alias("w"))
    scores = list_scores(weighed.sortWithinPartitions("doc_id"), weights, k, n)
    return ranked(scores, k).select("query_id", "doc_id", "score", "rank")


def blocked_bm25(queries: DataFrame, blocks: DataFrame, size: DataFrame, k: int = 30, stemmed: bool = True, truncate: int | None = None) -> DataFrame:
    """bm25 over an index in blocks (postings.blocked) and its one row (n, avgdl): equal hits, without reading the spans that have none."""
    return ranked(bm25_scores(queries, blocks, size, k, stemmed, truncate), k).select("query_id", "doc_id", "score", "rank")


def dense(queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """Exact k nearest by cosine of unit vectors: queries (query_id, vector), vectors (doc_id, vector), in blocks."""
    return ranked(products(queries, vectors, k), k)


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both arms with their own scores and ranks, and what else an arm has under its name."""
    arm = lambda x, name: x.select("query_id", "doc_id", *[F.col(c).alias(f"{name}_{c}") for c in x.columns if c not in ("query_id", "doc_id")])
    return arm(left, "dense").join(arm(right, "lexical"), ["query_id", "doc_id"], "full")


def _fused(rows: DataFrame, score: Column, k: int | None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "doc_id")
    out = rows.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def rrf(left: DataFrame, right: DataFrame, rrf_k: int = 60, weights: tuple[float, float] = (1.0, 1.0), k: int | None = None) -> DataFrame:
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return _fused(_both(left, right), part("dense_rank", weights[0]) + part("lexical_rank", weights[1]), k)


def min_max_score() -> Column:
    """A query's scores brought to 0..1; equal scores become 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))


def min_max(arm: DataFrame) -> DataFrame:
    return arm.withColumn("score", min_max_score())


def weighted(left: DataFrame, right: DataFrame, alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """Weighted sum of both arms' min-max scores; dense_score and lexical_score stay what the arms gave."""
    scaled = lambda x: x.select("*", min_max_score().alias("scaled"))
    score = F.lit(alpha) * F.coalesce("dense_scaled", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("lexical_scaled", F.lit(0.0))
    return _fused(_both(scaled(left), scaled(right)), score, k).drop("dense_scaled", "lexical_scaled")


def fuse(left: DataFrame, right: DataFrame, strategy: str = "weighted", rrf_k: int = 60, alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """A single-arm strategy never plans the other arm."""
    if strategy == "rrf":
        return rrf(left, right, rrf_k, k=k)
    if strategy == "weighted":
        return weighted(left, right, alpha, k)
    if strategy == "dense_only":
        return weighted(left, right.limit(0), 1.0, k)
    if strategy == "lexical_only":
        return weighted(left.limit(0), right, 0.0, k)
    raise ValueError(f"unknown fusion strategy: {strategy}")


def mmr(pool: DataFrame, trade: float = 0.7, k: int = 5) -> DataFrame:
    """Greedy picks of each query's pool (query_id, doc_id, rank, relevance, vector): (query_id, doc_id, step).

    A pool is at most a few dozen rows, so it is folded as one array; equal values go to the better rank, and
    candidates without a vector come last.
    """
    item = F.struct(F.col("rank").alias("rk"), "doc_id", "relevance", "vector")
    rows = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("vector").isNotNull(), item))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("vector").isNull(), item))).alias("o"))
    step = f"""
      aggregate(sequence(1, {k}), cast(array() AS array<int>), (picked, s) ->
        IF(size(picked) >= size(c), picked, concat(picked, array(
          array_min(transform(filter(sequence(0, size(c) - 1), i -> NOT array_contains(picked, i)), i -> named_struct(
            'v', -round({trade}D * c[i].relevance - (1 - {trade}D) * coalesce(array_max(transform(picked, p ->
                   aggregate(zip_with(c[i].vector, c[p].vector, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (a, x) -> a + x))), 0D), 9),
            'i', i))).i))))"""
    picked = rows.withColumn("picked", F.expr(step))
    order = F.expr(f"slice(concat(transform(picked, i -> c[i].doc_id), transform(o, x -> x.doc_id)), 1, {k})")
    return picked.select("query_id", F.posexplode(order).alias("step", "doc_id")).select("query_id", "doc_id", (F.col("step") + 1).cast("long").alias("step"))


def rerank(hits: DataFrame, orderings: DataFrame, head: int = 12) -> DataFrame:
    """New ranks from (query_id, ordering): the head in the named order, the tail as it was."""
    places = orderings.select("query_id", F.posexplode("ordering").alias("place", "old")).select("query_id", (F.col("old") + 1).alias("rank"), (F.col("place") + 1).alias("new_rank"))
    joined = hits.join(places, ["query_id", "rank"], "left")
    return joined.withColumn("new_rank", F.when(F.col("rank") <= head, F.coalesce("new_rank", "rank")).otherwise(F.col("rank")).cast("long"))


def context(hits: DataFrame, budget: int = 1600) -> DataFrame:
    """The blocks (query_id, rank, block) that fit the budget in order of rank; the first always does."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = hits.withColumn("used", F.sum(F.length("block")).over(upto).cast("long"))
    return out.where((F.col("rank") == 1) | (F.col("used") <= budget))


def abstention(queries: DataFrame, hits: DataFrame, threshold: float, enabled: bool = True, signal: str = "lexical_raw") -> DataFrame:
    """(query_id, signal, abstains): the best raw score of an arm among a query's final hits against the threshold.

    signal: lexical_raw, dense_raw or fused; a query whose hits the arm does not have goes by its first hit's score.
    """
    columns = {"lexical_raw": "lexical_score", "dense_raw": "dense_score", "fused": None}
    if signal not in columns:
        raise ValueError(f"unknown abstention signal: {signal}")
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    best = hits.groupBy("query_id").agg((F.coalesce(F.max(columns[signal]), first) if columns[signal] else first).alias("signal"))
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.withColumn("abstains", F.lit(enabled) & (F.col("signal").isNull() | (F.col("signal") < threshold)))


def explain() -> Column:
    """One line of a fused hit: its rank and score in each arm that has it."""
    arm = lambda label, name: F.when(F.col(f"{name}_rank").isNotNull(), F.format_string(f"{label} #%d (%.3f)", f"{name}_rank", f"{name}_score"))
    text = F.concat_ws(" | ", arm("dense", "dense"), arm("bm25", "lexical"))
    return F.when(text == "", "no arm").otherwise(text)


def cosine_matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, cosine) of a stated set of vectors (id, vector) against another, in blocks."""
    rows = products(left.select(F.col("id").alias("query_id"), "vector"), right.select(F.col("id").alias("doc_id"), "vector"))
    return rows.select(F.col("query_id").alias("left_id"), F.col("doc_id").alias("right_id"), F.col("score").alias("cosine"))


class _Codes(dict):
    """Place and sign of a word, as 2 * place + 1 for a sign of minus, made once for each task that meets it."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        self[word] = code = h % self.dim * 2 + h // self.dim % 2
        return code


def hashed_vectors(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, vector) of (doc_id, text), row by row: the offline embedder. Each token adds its sign to one of dim places; unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, word, codes = _folded(), re.compile("[a-z0-9]+"), _Codes(dim)
        for b in slices(batches):
            if len(codes) > MEMO:
                codes.clear()
            found: list[int] = []
            count = np.empty(b.num_rows, dtype=np.int64)
            for i, text in enumerate(b.column("text").to_pylist()):
                words = word.findall(fold(text)) if text else []
                found.extend(map(codes.__getitem__, words))
                count[i] = len(words)
            code = np.array(found, dtype=np.int64)
            at = np.repeat(np.arange(b.num_rows), count) * dim + (code >> 1)
            v = np.bincount(at, 1.0 - 2.0 * (code & 1), b.num_rows * dim).astype(np.float64).reshape(-1, dim)  # without any token it counts
            v /= np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["doc_id", "vector"])

    return texts.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, vector array<double>")


def embedder(model: Callable[[list[str]], Sequence], batch: int = 16, attempts: int = 3, wait: float = 1.0, eps: float = 1e-12) -> Callable[[DataFrame], DataFrame]:
    """(doc_id, text) to (doc_id, vector) by a model that is asked for batch texts at a time, in the tasks that hold them.

    The model answers with a vector for each text, or with (index, vector) pairs in any order. A failed call is
    repeated after wait * 1.5**n seconds, attempts times in all. Vectors get unit length; null texts are empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                own = texts[at : at + batch]
                for attempt in range(attempts):
                    try:
                        got = list(model(own))
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                        time.sleep(wait * 1.5**attempt)
                pairs = sorted(got, key=lambda x: x[0]) if got and isinstance(got[0], tuple) else list(enumerate(got))
                if [i for i, _ in pairs] != list(range(len(own))):
                    raise ValueError(f"{len(own)} texts got {len(pairs)} vectors")
                rows += [np.asarray(v, dtype=np.float64) for _, v in pairs]
            unit = [(v / max(float(np.sqrt(v @ v)), eps)).tolist() for v in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(unit, pa.list_(pa.float64()))], ["doc_id", "vector"])

    return lambda df: df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, vector array<double>")


def strategies(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """The k first hits of each fusion strategy side by side."""
    names = ("dense_only", "lexical_only", "rrf", "weighted")
    out = None
    for name in names:
        rows = fuse(left, right, name, k=k).select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank", "score")
        out = rows if out is None else out.unionByName(rows)
    return out

"""Mixing sources to target weights with DataFrame functions only.

Sizes are words per document. Tokens are aggregated per source, each source gets a repetition rate, and
each document is taken floor(rate) times plus once more with a probability equal to the fraction, drawn
from a hash of seed and doc_id, so that reruns agree.

Defined edge cases: a null or blank text has size 0 and is taken floor(rate) or more times without adding
words; a null source is a source of its own and comes last; a source without words has target 0; an empty
table gives an empty result; rows that repeat a doc_id share their draw; other columns pass through
`emit` unchanged, except ones named like the operator's own, which it replaces in `plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17
#: Up to so many sources the table of targets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, no target above most times its source.

    Sources are ordered by most * size / weight; the capped ones are a prefix of that order, and the level
    is the first share a weight gets that does not exceed the next source's own limit.
    """
    sizes = docs.select("source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    least = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "rank", "share"))).over(every)["share"]
    level = level.withColumn("level", least)
    return level.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies."""
    shares = cut(targets(docs, weights, most))
    small = shares.count() <= BROADCAST_SOURCES
    shares = shares.withColumnRenamed("source", "_mix_source")
    shares = F.broadcast(shares) if small else shares
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    sized = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long"))
    joined = sized.join(shares, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return joined.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix: every document as often as it is taken, with the columns of docs."""
    names = docs.columns
    keys = ("text", "source", "doc_id")
    safe = docs.select(*[F.col(f"`{c}`").alias(c if c in keys else f"_keep_{i}") for i, c in enumerate(names)])
    taken = plan(safe, weights, most, seed).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(c if c in keys else f"_keep_{i}").alias(c) for i, c in enumerate(names)])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = plan(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM sizes),
weighed AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM weighed),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM ratios),
level AS (SELECT arg_min(share, rk_all) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, rk) AS rk_all FROM shares) WHERE share <= ratio),
targets AS (SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM shares, level),
rated AS (
  SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""

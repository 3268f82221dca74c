"""Metrics, resampling, multiple comparisons and calibration."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260801


def retrieval_metrics(questions: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """recall, precision, rr, ndcg and first_rank for each question (query_id)."""
    n_gold = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = hits.where(F.col("rank") <= k).join(gold.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    per = marked.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    out = questions.select("query_id").join(per, "query_id", "left").join(n_gold, "query_id", "left").fillna(0, ["n", "hits", "n_gold"]).fillna(0.0, ["dcg"])
    most = F.least("n_gold", F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.select("query_id", safe(F.col("hits"), most).alias("recall"), safe(F.col("hits"), F.col("n")).alias("precision"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"), safe(F.col("dcg"), ideal).alias("ndcg"), "first_rank")


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "precision", "rr", "ndcg")], F.avg(F.when(F.col("recall") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))


#: Values in one block of a resampled vector, and resamples that one task draws from it.
BLOCK, CHUNK = 1 << 15, 250


def _draw(seed: int, *parts: str) -> str:
    """A number of 32 bits from a hash that every SQL engine has."""
    return f"CAST(conv(substring(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8), 16, 10) AS bigint)"


def _blocks(rows: DataFrame, by: list[str], *values: Column) -> DataFrame:
    """(by, lo, n, <values>) of rows (by, i, ...): arrays (i, <values>) of at most BLOCK places from lo on, of n rows in all."""
    held = F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), *values)))
    blocks = rows.groupBy(*by, F.floor(F.col("i") / BLOCK).cast("long").alias("block")).agg(held.alias("held"))
    return blocks.withColumn("lo", F.col("block") * BLOCK).withColumn("n", F.sum(F.size("held")).over(Window.partitionBy(*by)))


def _resampled(blocks: DataFrame, by: list[str], resamples: int, places: str | None = None) -> DataFrame:
    """Each block once for every resample b, and for each range of places from j on where those are asked for.

    A block travels once for CHUNK resamples; what it is copied for stays in the task that adds it up.
    """
    wide = blocks.withColumn("j", F.explode(F.expr(places))) if places else blocks.withColumn("j", F.lit(0).cast("long"))
    wide = wide.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), F.lit(CHUNK).cast("long"))))
    dealt = wide.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "lo", "j", "c")
    return dealt.withColumn("b", F.explode(F.expr(f"sequence(c, least(c + {CHUNK}, {resamples}) - 1)")))


def bootstrap_ci(values: DataFrame, resamples: int = 1000, confidence: float = 0.95, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of the mean of values (by, i, value), i from 0 in each group: by, estimate, lower, upper, n. No rows give none.

    Each task adds up what its block of values gives to its resamples, so one number for each block and
    resample is exchanged, however many draws a resample takes.
    """
    by = by or []
    blocks = _blocks(values, by, F.col("value").cast("double").alias("value")).withColumn("v", F.expr("transform(held, x -> x.value)")).drop("held")
    sums = F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))).over(Window.partitionBy(*by))
    blocks = blocks.withColumn("estimate", sums / F.col("n"))
    drawn = f"CAST({_draw(seed, 'b', 'p')} % n - lo AS int)"
    part = F.expr(f"aggregate(sequence(j, least(j + {BLOCK}, n) - 1), 0D, (s, p) -> s + coalesce(get(v, {drawn}), 0D))")
    parts = _resampled(blocks, by, resamples, f"sequence(0L, n - 1, {BLOCK}L)").select(*by, "estimate", "n", "b", part.alias("part"))
    means = parts.groupBy(*by, "estimate", "n", "b").agg(F.round(F.sum("part") / F.first("n"), 12).alias("m"))
    tail = (1 - confidence) / 2
    return means.groupBy(*by, "estimate", "n").agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper")).select(*by, "estimate", "lower", "upper", "n")


def permutation_test(pairs: DataFrame, resamples: int = 1000, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """Two-sided paired sign-flip test of pairs (by, i, a, b), each with its own i: by, mean_a, mean_b, diff, p, d, n.

    As in bootstrap_ci a task adds the flipped differences of its block, and one number for each block and resample leaves it.
    """
    by = by or []
    every = Window.partitionBy(*by)
    blocks = _blocks(pairs, by, F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    sums = lambda x: F.sum(F.expr(f"aggregate(held, 0D, (s, x) -> s + ({x}))")).over(every)
    blocks = blocks.withColumn("mean_a", sums("x.a") / F.col("n")).withColumn("mean_b", sums("x.b") / F.col("n")).withColumn("v", F.expr("transform(held, x -> struct(x.i AS i, x.a - x.b AS d))")).withColumn("diff", sums("x.a - x.b") / F.col("n"))
    spread = F.sum(F.expr("aggregate(v, 0D, (s, x) -> s + (x.d - diff) * (x.d - diff))")).over(every)
    blocks = blocks.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1)))).withColumn("most", F.max(F.expr("array_max(transform(v, x -> abs(x.d)))")).over(every)).drop("held")
    kept = [*by, "mean_a", "mean_b", "diff", "sd", "most", "n"]
    flip = f"aggregate(v, 0D, (s, x) -> s + x.d * (1 - 2 * ({_draw(seed, 'b', 'x.i')} % 2)))"
    parts = _resampled(blocks, by, resamples).select(*kept, "b", F.expr(flip).alias("part"))
    means = parts.groupBy(*kept, "b").agg((F.sum("part") / F.first("n")).alias("m"))
    extreme = F.count_if(F.round(F.abs("m"), 12) >= F.round(F.abs("diff"), 12))
    p = F.when(F.col("most") <= 1e-8, F.lit(1.0)).otherwise((F.col("extreme") + 1) / F.lit(float(resamples + 1)))
    effect = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("diff") / F.col("sd")).otherwise(F.lit(0.0))
    return means.groupBy(*kept).agg(extreme.alias("extreme")).select(*by, "mean_a", "mean_b", "diff", p.alias("p"), effect.alias("d"), "n")


def permutation_exact(pairs: DataFrame) -> DataFrame:
    """All sign flips of each test of at most 16 pairs (test, i, a, b), i from 0: test, diff and p; larger tests raise."""
    d = pairs.select("test", "i", (F.col("a") - F.col("b")).alias("d"))
    size = d.groupBy("test").agg(F.count("*").alias("n"), F.avg("d").alias("diff"))
    n = F.when(F.col("n") <= 16, F.col("n")).otherwise(F.raise_error(F.lit("an exact test takes at most 16 pairs"))).cast("int")
    masks = size.select("test", "diff", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)).alias("mask"))
    means = d.join(masks, "test").groupBy("test", "mask", "diff").agg(F.avg(F.col("d") * (1 - 2 * F.expr("shiftright(mask, cast(i AS int)) & 1"))).alias("m"))
    return means.groupBy("test", "diff").agg(F.avg(F.when(F.round(F.abs("m"), 12) >= F.round(F.abs("diff"), 12), 1.0).otherwise(0.0)).alias("p"))


#: Rows in one range of a running sum, and the most ranges there are.
RANGE_ROWS, RANGES = 1 << 20, 1024


def running(rows: DataFrame, key: str, sums: dict[str, Column], ties: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with <name>_before and <name>_all for each of sums, over the order of key (a number), then ties; next_key is the row after.

    Ranges of the key are cut at approximate quantiles, which are asked for first; each range's sums are
    local, and its beginning is the sum of the ranges below, of which there are RANGES at most. Rows of
    one key stay together, so the key should be nearly unique.
    """
    coarse = 32
    facts = rows.agg(F.count("*").alias("n"), F.percentile_approx(F.col(key).cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first()
    step = max(1, RANGES // max(1, -(-facts["n"] // range_rows)))
    edges = sorted(set((facts["q"] or [])[step - 1 :: step]))
    if edges:
        # The edges below a key are counted by blocks of edges first, then inside of the one that holds the key.
        blocks = [edges[i : i + coarse] for i in range(0, len(edges), coarse)]
        lists = F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in blocks])
        value = F.col(key).cast("double")
        before = F.size(F.filter(F.array(*[F.lit(float(b[-1])) for b in blocks]), lambda e: e < value))
        within = F.size(F.filter(F.coalesce(F.get(lists, before), F.array().cast("array<double>")), lambda e: e < value))
        part = F.when(value.isNull(), F.lit(-1)).otherwise(before * coarse + within)
    else:
        part = F.lit(0)
    placed = rows.withColumn("_part", part.cast("int"))
    for name, c in sums.items():
        placed = placed.withColumn(f"_{name}", c)
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.min(key).alias("_least"), *[F.sum(f"_{x}").alias(f"_{x}_sum") for x in sums])
    # A row for each range: RANGES and one for nulls at most.
    totals = totals.select("_part", F.lead("_least").over(Window.orderBy("_part")).alias("_after"), *[F.coalesce(F.sum(f"_{x}_sum").over(below), F.lit(0)).alias(f"_{x}_low") for x in sums], *[F.sum(f"_{x}_sum").over(Window.partitionBy()).alias(f"{x}_all") for x in sums])
    local = Window.partitionBy("_part").orderBy(key, *ties)
    joined = placed.join(F.broadcast(totals), "_part")
    upto = local.rowsBetween(Window.unboundedPreceding, -1)
    out = joined.select(*rows.columns, F.coalesce(F.lead(key).over(local), "_after").alias("next_key"), *[(F.col(f"_{x}_low") + F.coalesce(F.sum(f"_{x}").over(upto), F.lit(0))).alias(f"{x}_before") for x in sums], *[f"{x}_all" for x in sums])
    return out


def numbered(rows: DataFrame, key: str, ties: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with i, their place from 0 in the order of key, then ties."""
    return running(rows, key, {"i": F.lit(1).cast("long")}, ties, range_rows).withColumnRenamed("i_before", "i").drop("next_key", "i_all")


def numbered_groups(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with i, their place from 0 in their group; groups are sets of questions, which one task can sort."""
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def holm(tests: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """tests (by, name, p) with reject: step-down in each family, stops at the first failure; equal p go by name."""
    if by:
        family, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("p", "name")
        ranked = tests.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(family))
        ok = F.col("p") <= F.lit(alpha) / (F.col("_m") - F.col("_r") + 1)
        failed = F.min(F.when(~ok, F.col("_r"))).over(family)
    else:
        ranked = running(tests, "p", {"_r": F.lit(1).cast("long")}, ("name",)).drop("next_key").withColumnsRenamed({"_r_before": "_r", "_r_all": "_m"})
        ok = F.col("p") <= F.lit(alpha) / (F.col("_m") - F.col("_r"))
        first = ranked.agg(F.min(F.when(~ok, F.col("_r"))).alias("_failed"))
        ranked, failed = ranked.crossJoin(F.broadcast(first)), F.col("_failed")
    return ranked.withColumn("reject", F.coalesce(F.col("_r") < failed, F.lit(True))).select(*tests.columns, "reject")


def required_sample_size(d: float, power: float = 0.8, alpha: float = 0.05) -> int:
    if d <= 0:
        return 0
    z = NormalDist().inv_cdf
    return math.ceil(((z(1 - alpha / 2) + z(power)) / d) ** 2)


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def verdict(p: Column, reject: Column, significant: Column | None = None, alpha: float = 0.05) -> Column:
    """Whether a corrected test is significant, would have been alone, or is not."""
    return F.when(reject, F.lit("significant") if significant is None else significant).when(p < alpha, "lost to the correction").otherwise("not significant")


def interpretation(diff: Column, p: Column, d: Column, n: Column, alpha: float = 0.05) -> Column:
    """A test in words; a positive difference is for the one that is judged."""
    none = F.format_string("no significant difference (diff=%+.4f, p=%.4f, n=%d)", diff, p, n)
    some = F.format_string("%s (diff=%+.4f, p=%.4f, d=%.2f %s, n=%d)", F.when(diff > 0, "better").otherwise("worse"), diff, p, d, effect_label(d), n)
    return F.when(p >= alpha, none).otherwise(some)


def half_width(lower: Column, upper: Column) -> Column:
    return (upper - lower) / 2


def intervals_overlap(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    """Whether two intervals meet, which is no test: those that meet may still differ significantly."""
    return ~((upper_a < lower_b) | (upper_b < lower_a))


def _score_counts(scored: DataFrame) -> DataFrame:
    """Distinct scores with their numbers of positive and negative labels: ties are one row, however many they are."""
    return scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))


def auc(scored: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Mann-Whitney area of (score, label), ties half: one row; null with one class only. Ranks come from counts of distinct scores."""
    counts = running(_score_counts(scored), "score", {"below": F.col("neg")}, range_rows=range_rows)
    return counts.withColumn("won", F.col("pos") * (F.col("below_before") + F.col("neg") / 2.0)).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def threshold_sweep(scored: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Confusion counts and rates at each midpoint of distinct scores and beyond both ends: answer where score >= threshold."""
    cum = running(_score_counts(scored), "score", {"p": F.col("pos"), "n": F.col("neg")}, range_rows=range_rows)
    above = F.struct(F.coalesce((F.col("score") + F.col("next_key")) / 2, F.col("score") + 1e-6).alias("threshold"), (F.col("p_before") + F.col("pos")).alias("fn"), (F.col("n_before") + F.col("neg")).alias("tn"))
    # The least score has a threshold below it too.
    first = F.when((F.col("p_before") == 0) & (F.col("n_before") == 0), F.struct((F.col("score") - 1e-6).alias("threshold"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("tn")))
    out = cum.select(F.col("p_all").alias("p"), F.col("n_all").alias("n"), F.explode(F.array_compact(F.array(first, above))).alias("x")).select("x.*", "p", "n")
    out = out.select("threshold", (F.col("p") - F.col("fn")).alias("tp"), (F.col("n") - F.col("tn")).alias("fp"), "fn", "tn")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", precision).withColumn("recall", recall).withColumn("accuracy", rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(scored: DataFrame, objective: str = "f1") -> DataFrame:
    """The sweep's best row; the lowest threshold wins ties."""
    return threshold_sweep(scored).orderBy(F.round(objective, 12).desc(), "threshold").limit(1)


def safety_threshold(scored: DataFrame, least_recall: float = 0.9, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The highest observed score that, as threshold, keeps the recall."""
    cum = running(_score_counts(scored), "score", {"p": F.col("pos")}, range_rows=range_rows)
    recall = (F.col("p_all") - F.col("p_before")) / F.col("p_all")
    return cum.where(recall >= least_recall).agg(F.max("score").alias("threshold"))


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over (lo, hi]; confidence 0 lies in none."""
    edges = scored.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    joined = scored.join(F.broadcast(edges), (F.col("confidence") > F.col("lo")) & (F.col("confidence") <= F.col("hi")))
    return joined.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("outcome").alias("accuracy"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """ece, mce and brier of (confidence, outcome); Brier counts rows that no bin has."""
    total = scored.agg(F.count("*").alias("total"), F.avg(F.pow(F.col("confidence") - F.col("outcome"), 2)).alias("brier"))
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return calibration_bins(scored, bins).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("total") * gap).alias("ece"), F.max(gap).alias("mce"), F.first("brier").alias("brier"))


def _order(values: DataFrame, by: str) -> DataFrame:
    """Distinct values of each group with their count, how many are not above, and the group's size."""
    counts = values.groupBy(by, "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    return counts.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))


def _at(place: Column) -> Column:
    """The value at a place, from 1, of a group's order."""
    return F.min(F.when(F.col("upto") >= place, F.col("value")))


def latency_summary(values: DataFrame, by: str) -> DataFrame:
    """count, total, median (interpolated), p95 (nearest rank, half to even) and max of (by, value), from counts of distinct values."""
    place = F.greatest(F.lit(1), F.bround(F.lit(0.95) * F.col("n"), 0).cast("long"))
    middle = (_at(F.floor((F.col("n") + 1) / 2)) + _at(F.floor(F.col("n") / 2) + 1)) / 2
    return _order(values, by).groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("value") * F.col("c")).alias("total"), middle.alias("median"), _at(place).alias("p95"), F.max("value").alias("most"))


def run_latency(values: DataFrame, by: str) -> DataFrame:
    """p50, p95, max and mean of a run's (by, value): p50 is the value after n // 2 others, p95 the nearest rank."""
    n = F.col("n")
    last = F.when(n > 1, F.least(n, F.bround(F.lit(0.95) * n, 0).cast("long"))).otherwise(F.lit(1))
    return _order(values, by).groupBy(by).agg(_at(F.floor(n / 2) + 1).alias("p50"), _at(last).alias("p95"), F.max("value").alias("most"), (F.sum(F.col("value") * F.col("c")) / F.max("n")).alias("mean"))


def is_bounded(scored: DataFrame) -> DataFrame:
    """One row: whether all scores lie in 0..1, without which a calibration error says nothing."""
    return scored.agg(((F.min("score") >= 0) & (F.max("score") <= 1)).alias("bounded"))

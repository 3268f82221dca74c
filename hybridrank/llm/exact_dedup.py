"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame functions only.

Each input partition is a run: the digests of its texts, sorted, each with its best document and its number of
documents. In every round 2**FAN_BITS runs become one: the runs of a group cut their digests at the same
leading bits and exchange the pieces, so a merged run covers a narrower range of digests and no task grows
with the number of runs. A merge keeps, for each digest that its check verifies, the best document of all
runs. The last round's groups are pushed down the same tree, so a digest that half of all documents share
meets at most 2**FAN_BITS runs in a task, going up as well as down.

Texts are equal when they are identical after deleting the characters of SPACES; null counts as empty. The
document that stays has the most code points in its original text, then the smallest doc_id (a null one
comes last), then the earliest place in the table: of rows that repeat a doc_id and a text one stays. Null
and blank texts are one group. An empty table gives an empty result. Other columns may have any name: the
operator takes doc_id and text, and `deduplicate` carries the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The characters of [\x20\x09-\x0D], which do not count.
SPACES = " \t\n\x0b\x0c\r"
#: A round merges 2**FAN_BITS runs and cuts the digests at as many more leading bits.
FAN_BITS = 3


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _runs(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, run, doc_id, points, digest, verify, head) and the carried columns as carry_<i>; head holds the digest's first 32 bits."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalized(F.col("text")).alias("plain"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    digest = text.select("row", "run", "doc_id", "points", F.sha2("plain", 256).alias("hex"), F.xxhash64("plain", F.octet_length("plain")).alias("verify"), *[f"carry_{i}" for i in range(len(carry))])
    return digest.withColumn("head", F.conv(F.substring("hex", 1, 8), 16, 10).cast("long")).withColumn("digest", F.unhex("hex")).drop("hex")


def _merge_round(runs: DataFrame, width: int) -> DataFrame:
    """The next runs, each of 2**width partitions: (slot, run, head, digest, verify, best, n)."""
    slot = F.shiftright("head", max(0, 32 - width))
    placed = runs.select(slot.alias("slot"), F.shiftright("run", FAN_BITS).alias("run"), "head", "digest", "verify", "best", "n")
    # The first round sorts each partition into a run before anything is exchanged; later runs are sorted already.
    exchanged = placed if width <= FAN_BITS else placed.repartition("slot", "run")
    return exchanged.groupBy("slot", "run", "head", "digest", "verify").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text, ...), then the carried columns as carry_<i>."""
    carry = carry or []
    rows = cut(_runs(docs, carry))  # texts are read and hashed once
    last = rows.agg(F.max("run")).first()[0] or 0
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    levels, width = [rows.select(F.col("run").cast("long").alias("run"), "head", "digest", "verify", best.alias("best"), F.lit(1).cast("long").alias("n"))], 0
    while not width or last >> width:
        width += FAN_BITS
        levels.append(_merge_round(levels[-1], width))
    # Only groups of several documents go down the tree; the others answer for themselves.
    found = levels[-1].where("n > 1").select(F.col("run").alias("to"), "digest", "verify", "best", "n")
    for level in reversed(levels[1:-1]):
        own = level.select("run", F.shiftright("run", FAN_BITS).alias("to"), "digest", "verify")
        found = own.join(found, ["to", "digest", "verify"]).select(F.col("run").alias("to"), "digest", "verify", "best", "n")
    told = rows.withColumn("to", F.shiftright("run", FAN_BITS).cast("long")).join(found, ["to", "digest", "verify"], "left")
    alone = F.col("n").isNull()
    return told.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *[f"carry_{i}" for i in range(len(carry))],
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with their columns."""
    marked = exact_groups(docs, docs.columns).where("kept")
    return marked.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY k ORDER BY points DESC, doc_id NULLS LAST)
"""

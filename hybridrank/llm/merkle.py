"""A Merkle manifest of a table, with a proof of every row, by DataFrame functions.

Bottom up: the leaves of a group are numbered, blocks of 2**STRIDE neighbours become one persisted row each with
all hashes inside of the block, and the blocks' topmost hashes are the next level's nodes. The groups' roots
are a tree of their own. Top down: a level's blocks are joined to the proof suffixes that its parents
inherited, and each child puts its own siblings before the suffix of its parent. Only one suffix for each
block travels; the leaves' own proofs are folded where they arise and never written.

A node is the hash of two neighbours, or of one where a run has no second; a lone node of a group stays as it
is. Rows are leaves in order of doc_id, null first, then of their hash, so repeated rows are neighbours with
the same leaf and proofs of their own. Null columns are hashed as `-`. Columns of other names are not read. An
empty table gives an empty result. A null doc_id or n_chars is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Binary levels in one persisted level.
STRIDE = 8
#: Tampered with are rows whose checksum this divides.
TAMPER = 7

# All hashes of a block: its nodes, then one array for each of m levels above.
_LEVELS = """aggregate(if(m > 0, sequence(1, m), cast(array() AS array<int>)), array(hashes), (t, b) -> concat(t, array(
  transform(sequence(0, (size(element_at(t, -1)) - 1) div 2), i -> sha2(concat(element_at(t, -1)[2 * i], coalesce(get(element_at(t, -1), 2 * i + 1), '')), 256)))))"""
# What stands beside the node at place p on each level of its block; what has no sibling there has two empty texts.
_BESIDE = """transform(if(m > 0, sequence(0, m - 1), cast(array() AS array<int>)), b -> if(shiftright(p, b) % 2 = 1,
  struct(levels[b][shiftright(p, b) - 1] AS l, '' AS r), struct('' AS l, coalesce(get(levels[b], shiftright(p, b) + 1), '') AS r)))"""
_FOLD = "aggregate({proof}, {leaf}, (a, s) -> sha2(concat(s.l, a, s.r), 256))"


def field(c: Column) -> Column:
    """A value as its count of bytes, a colon and itself, or a dash."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def height(n: Column) -> Column:
    """Binary levels above n nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, hash, changed): grp is the language as text, null first; changed is the leaf of a tampered row, else null.

    Hashes are 32 bytes here, and hexadecimal where they are hashed again.
    """
    col = {c: F.col(c) for c in FIELDS}
    tampered = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    more = leaf(*[c if name != "n_chars" else c.cast("decimal(38,0)") + 1 for name, c in col.items()])
    grp = F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("lang")))
    return docs.select(grp.alias("grp"), "doc_id", F.unhex(leaf(*col.values())).alias("hash"), F.unhex(F.when(tampered, more)).alias("changed"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, ...) with idx, their place from 0 in their group, and total, the group's size.

    Ranges of (grp, order) are counted, and a range begins where those before it end, so no task holds a group.
    """
    keyed = cut(nodes.withColumn("uid", F.monotonically_increasing_id()))
    ranges = cut(keyed.repartitionByRange("grp", *order, "uid").withColumn("part", F.spark_partition_id()))
    counts = ranges.groupBy("grp", "part").agg(F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    offsets = counts.select("grp", "part", F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    at = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "uid")) - 1
    return ranges.withColumn("at", at).join(offsets, ["grp", "part"]).withColumn("idx", F.col("before") + F.col("at")).drop("at", "before", "part", "uid")


def _blocks(nodes: DataFrame, done: int, *more: str) -> DataFrame:
    """(grp, at, total, m, kids, levels) of nodes (grp, idx, total, hash): kids is an array of (idx, *more), levels all hashes of the block."""
    m = F.least(F.greatest(height(F.col("total")) - done, F.lit(0)), F.lit(STRIDE)).cast("int")
    kids = F.sort_array(F.collect_list(F.struct("idx", "hash", *more)))
    rows = nodes.groupBy("grp", F.shiftright("idx", STRIDE).alias("at"), "total").agg(kids.alias("kids")).withColumn("m", m)
    hashes = rows.withColumn("hashes", F.expr("transform(kids, k -> lower(hex(k.hash)))")).withColumn("levels", F.expr(_LEVELS)).drop("hashes")
    return hashes.withColumn("kids", F.transform("kids", lambda k: F.struct(k["idx"], *[k[x] for x in more])))


def build(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The persisted levels over nodes (grp, idx, total, hash, *more), lowest first, and (grp, root)."""
    levels, done = [], 0
    while True:
        levels.append(cut(_blocks(nodes, done, *(more if not levels else ()))))
        done += STRIDE
        tops = levels[-1].select("grp", F.col("at").alias("idx"), "total", F.unhex(F.expr("element_at(levels, -1)[0]")).alias("hash"))
        if (levels[-1].agg(F.max(height(F.col("total")))).first()[0] or 0) <= done:
            return levels, tops.select("grp", F.lower(F.hex("hash")).alias("root"))
        nodes = tops


def _inherited(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(grp, at, suffix, ...) for the blocks of the lowest level, from roots (grp, suffix, ...), by joins of children to parents."""
    held = roots.withColumn("at", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        kid = level.join(held, ["grp", "at"]).select(*[c for c in held.columns if c not in ("at", "suffix")], "m", "levels", "suffix", F.posexplode("kids").alias("p", "kid"))
        held = kid.select(*[c for c in held.columns if c not in ("at", "suffix")], F.concat(F.expr(_BESIDE), "suffix").alias("suffix"), F.col("kid.idx").alias("at"))
    return held


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_leaf, folded_root) of every row; proof is the array of (l, r) beside its nodes from leaf to root."""
    trees, subroots = build(numbered(leaves(docs), ["doc_id", "hash"]), "doc_id", "changed")
    over = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_key"), F.unhex("root").alias("hash")), ["lang_key"])
    top, roots = build(over, "lang_key")
    empty = F.expr("cast(array() AS array<struct<l: string, r: string>>)")
    above = _inherited(top, roots.select("grp", "root", empty.alias("suffix")))
    kids = top[0].join(above, ["grp", "at"]).select("m", "levels", "suffix", "root", F.posexplode("kids").alias("p", "kid"))
    langs = kids.select(F.col("kid.lang_key").alias("grp"), F.expr("levels[0][p]").alias("subroot"), "root", F.concat(F.expr(_BESIDE), "suffix").alias("suffix"))
    held = trees[0].join(_inherited(trees, langs), ["grp", "at"])
    proof = f"concat({_BESIDE}, suffix)"
    rows = held.withColumn("rows", F.expr(f"transform(kids, (k, p) -> struct(k.doc_id AS doc_id, levels[0][p] AS leaf, coalesce(lower(hex(k.changed)), levels[0][p]) AS folded_leaf, {proof} AS proof))"))
    # Proofs are folded inside of the block, so none of them leaves it.
    folded = F.expr(f"transform(rows, x -> struct(x.doc_id AS doc_id, x.leaf AS leaf, x.folded_leaf AS folded_leaf, x.proof AS proof, {_FOLD.format(proof='x.proof', leaf='x.folded_leaf')} AS folded_root))")
    return rows.select("subroot", "root", F.explode(folded).alias("x")).select("x.doc_id", "x.leaf", "subroot", "root", "x.proof", "x.folded_leaf", "x.folded_root")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    text = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", text.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, base: str) -> str:
    """<name>: all nodes (grp, lvl, i, h, n) over the rows (grp, i, h, n) of base."""
    return f"""{name} AS (SELECT grp, 0 AS lvl, i, h, n FROM {base} UNION ALL
  SELECT grp, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, lvl, i // 2, n)"""


def _fold_sql(name: str, base: str, tree: str) -> str:
    """<name>: (id, grp, i, lvl, acc, proof, n) of the rows of base, folded level by level."""
    return f"""{name} AS (SELECT id, grp, i, 0 AS lvl, acc, proof, n FROM {base} UNION ALL
  SELECT f.id, f.grp, f.i // 2, f.lvl + 1, sha256(CASE WHEN f.i % 2 = 1 THEN concat(s.h, f.acc) ELSE concat(f.acc, coalesce(s.h, '')) END), concat(f.proof, coalesce(s.h, '')), (f.n + 1) // 2
  FROM {name} f LEFT JOIN {tree} s ON s.grp = f.grp AND s.lvl = f.lvl AND s.i = f.i + 1 - 2 * (f.i % 2) WHERE f.n > 1)"""


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in FIELDS) + "))"
_CRC = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"

OP13_SQL = f"""
WITH RECURSIVE lv AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE concat('v', lang) END AS grp, {_LEAF} AS h,
  CASE WHEN {_CRC} % {TAMPER} = 0 AND n_chars IS NOT NULL THEN {_LEAF.replace('n_chars', '(n_chars + 1)')} ELSE {_LEAF} END AS changed FROM documents),
nu AS MATERIALIZED (SELECT id, doc_id, grp, h, changed, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM lv),
{_tree_sql("tr", "nu")},
sr AS MATERIALIZED (SELECT grp AS lang_key, '' AS grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM tr WHERE n = 1),
{_tree_sql("tp", "sr")},
a0 AS (SELECT id, grp, i, changed AS acc, '' AS proof, n FROM nu),
{_fold_sql("fa", "a0", "tr")},
b0 AS (SELECT fa.id, '' AS grp, sr.i, fa.acc, fa.proof, sr.n FROM fa JOIN sr ON sr.lang_key = fa.grp WHERE fa.n = 1),
{_fold_sql("fb", "b0", "tp")}
SELECT nu.doc_id, nu.h AS leaf, sr.h AS subroot, rt.h AS root, sha256(fb.proof) AS proof_sha256, fb.acc AS folded_root, fb.acc = rt.h AS verified
FROM nu JOIN fb USING (id) JOIN sr ON sr.lang_key = nu.grp, (SELECT h FROM tp WHERE n = 1) rt WHERE fb.n = 1
"""

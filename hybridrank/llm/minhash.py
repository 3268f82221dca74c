"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with the same shingle set are one class and enter once. Each class posts itself under POSTED of
its COORDINATES (coordinate, value) pairs. A pair of documents at the wanted similarity shares at least LEAST
of those and MATCHES of all (binomial tails below 1e-9), so with all pairs put in one order, rarest first, it
shares one among the first POSTED - LEAST + 1 of both: only that prefix is joined, and a value that one
document alone has is never posted. Collisions are then counted coordinate block by coordinate block, and a
pair is skipped once it can no longer reach MATCHES.

Pairs stay inside the task that finds them; what leaves it is a forest, at most one row for each member.

1. A posting list is dealt in parts of about LIST_BLOCK members, each with a copy of the list's leader, and a
   part gives a spanning forest of its matching pairs. Lists of one part are done. Components of all forests
   are families: a link of two documents lies within one.
2. Lists of several parts that still hold several families are compared part against part, but not within
   the largest family, and join further families.
3. A family's full shingle sets meet in one task, where the links that hold on them give a forest again. A
   family of more than FAMILY_BLOCK members is first linked to its leaders; members that are joined by that
   are compared with the others only, part against part.

Defined edge cases: a null text or one without words has an empty set, is linked with nothing and kept;
fewer words than a shingle are one shingle; ties of doc_id do not occur by contract, and rows that repeat a
doc_id share its result; an empty table gives an empty result; columns other than doc_id and text are not
read. A document with a null doc_id gets component null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, components, cut, ensure_checkpoint_dir, expand, lower_ascii, mix, span_hash, table, text_bytes, words

COORDINATES, MATCHES = 64, 30
POSTED, LEAST = 32, 10
SIMILARITY = (80, 100)
STAR_BLOCK = 512
LIST_BLOCK = 512
#: Members and shingles of a part of a family.
FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 1 << 19
#: Pairs that are counted at once.
PAIRS = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, joined, and n + 1 offsets."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, doc = words(low, offsets)
    h = span_hash(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    # The last k - 1 words of a text start no shingle; with fewer than k words the first one starts the only one.
    place = np.arange(len(h)) - first[doc]
    start = np.flatnonzero((place <= count[doc] - k) | ((place == 0) & (count[doc] < k)))
    length = np.minimum(count[doc[start]], k)
    out = length.astype(np.uint64)
    for j in range(k):
        at = start + j
        has = j < length
        out = np.where(has, mix(out + h[np.minimum(at, max(len(h) - 1, 0))]) if len(h) else out, out)
    owner = doc[start]
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def signatures(sets: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """One row of size 32-bit minima for each set that is not empty."""
    rows = np.flatnonzero(np.diff(offsets))
    if not len(rows):
        return np.empty((0, size), dtype=np.uint32)
    out = np.empty((len(rows), size), dtype=np.uint32)
    at = offsets[:-1][rows]
    for c, factor in enumerate(_factors(size)):  # x -> factor * x permutes hashes that are mixed already
        out[:, c] = np.minimum.reduceat(sets * factor, at) >> np.uint64(32)
    return out


def _factors(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key and signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets, offsets = shingle_sets(*text_bytes(b.column("text")), k)
            n = np.diff(offsets)
            full = n > 0
            sig = np.empty((len(n), COORDINATES), dtype=np.uint32)
            sig[full] = signatures(sets, offsets, COORDINATES)
            at = offsets[:-1][full]
            key = np.zeros((len(n), 2), dtype=np.uint64)
            if len(at):
                key[full, 0] = np.add.reduceat(mix(sets), at)
                key[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
            keys = [key[i].tobytes() if full[i] else None for i in range(len(n))]
            sigs = [sig[i].tobytes() if full[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _elements(classes: DataFrame) -> DataFrame:
    """(doc, element) for each posted coordinate of each class; an element is a hash of coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, POSTED + 1, dtype=np.uint64))
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                element = mix(_rows(part.column("signature"))[:, :POSTED].astype(np.uint64) + salt[None, :]).view(np.int64)
                doc = np.repeat(part.column("doc").to_numpy(zero_copy_only=False), POSTED)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(element.ravel())], ["doc", "element"])

    return classes.select("doc", "signature").mapInArrow(run, "doc long, element long")


def _rows(signatures_: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures_.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a's set is built once for a block of its partners.

    A hub a is dealt out in blocks of about STAR_BLOCK partners, each with a copy of a's text. Both texts
    are shuffled once for each block, partners stream past the hub's set.
    """
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("parts")))
    pairs = cut(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt")))
    hubs = pairs.select("a", "salt").distinct().withColumn("doc", F.col("a")).withColumn("hub", F.lit(0))
    members = pairs.select("a", "salt", F.col("b").alias("doc"), F.lit(1).alias("hub"))
    spokes = hubs.unionByName(members).join(texts, "doc")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spokes.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "hub").select("a", "hub", "doc", "text")
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: np.ndarray | None = None
        for b in blocks(batches):
            sets, offsets = shingle_sets(*text_bytes(b.column("text")), k)
            is_hub = (b.column("hub").to_numpy(zero_copy_only=False) == 0).tolist()
            good = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                own = sets[offsets[i] : offsets[i + 1]]
                if is_hub[i]:
                    hub = own.copy()
                elif den * min(len(own), len(hub)) >= num * max(len(own), len(hub)):
                    at = np.searchsorted(hub, own)
                    both = int((hub[np.minimum(at, len(hub) - 1)] == own).sum())
                    good[i] = den * both >= num * (len(own) + len(hub) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("doc").filter(keep)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _count_matches(signature: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with at least MATCHES equal coordinates; pairs that cannot reach it any more are skipped."""
    count = np.zeros(len(i), dtype=np.int16)
    step = 8
    for c in range(0, COORDINATES, step):
        count += (signature[i, c : c + step] == signature[j, c : c + step]).sum(axis=1, dtype=np.int16)
        alive = count + (COORDINATES - c - step) >= MATCHES
        # A coin-flip pair keeps far fewer matches than needed, so most pairs go after the first blocks.
        i, j, count = i[alive], j[alive], count[alive]
        if not len(i):
            break
    return i, j


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join places of different label, none of them twice; label is brought up to date."""
    kept_i, kept_j = [], []
    while True:
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        # Each label that is the larger one of a pair is hung below the smaller one of one pair.
        high, low = np.maximum(a, b), np.minimum(a, b)
        own, first = np.unique(high, return_index=True)
        kept_i.append(i[first])
        kept_j.append(j[first])
        below = low[first]
        while (more := np.isin(below, own)).any():
            below[more] = below[np.searchsorted(own, below[more])]
        at = np.minimum(np.searchsorted(own, label), len(own) - 1)
        hung = own[at] == label
        label[hung] = below[at[hung]]
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (kept_i, kept_j))  # type: ignore[return-value]


def _dealt(rows: DataFrame, key: str, members: int, weight: int) -> DataFrame:
    """rows (key, doc, label, weight) of the keys with several labels, dealt to blocks (key, p, q) by their part.

    A key of at most so many members and weight is one block. In a larger one the most frequent label and
    the rest are cut into parts each; every two parts meet, but those of the most frequent label not each other.
    """
    labels = rows.groupBy(key, "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    facts = labels.groupBy(key).agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "label", "w")).alias("main")).where("labels > 1")
    parts = lambda n, w: F.greatest(F.lit(1), F.ceil(n / members), F.ceil(w / weight)).cast("int")
    one = parts(F.col("n"), F.col("w")) == 1
    facts = cut(facts.select(key, F.col("main.label").alias("main"), F.when(one, 0).otherwise(parts(F.col("main.n"), F.col("main.w"))).alias("same"), F.when(one, 0).otherwise(parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w"))).alias("others")))
    joined, h = rows.join(facts, key), F.xxhash64("doc")
    part = F.when(F.col("same") == 0, 0).when(F.col("label") == F.col("main"), F.pmod(h, F.col("same"))).otherwise(F.col("same") + F.pmod(h, F.col("others"))).cast("int")
    last = F.col("same") + F.col("others") - 1
    partners = F.when(F.col("same") == 0, F.array(F.lit(0))).when(F.col("label") == F.col("main"), F.sequence(F.col("same"), last)).otherwise(F.sequence(F.lit(0), last))
    dealt = joined.withColumn("part", part).withColumn("other", F.explode(partners))
    return dealt.select(key, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "doc", "label")


def _by_block(dealt: DataFrame, keys: list[str], judge: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], most_rows: int, bytes_of: str) -> DataFrame:
    """(a, b) from judge, which gets whole blocks of equal keys, several at once up to so many rows or BLOCK_TEXT bytes."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = judge(pa.Table.from_batches(held))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            for c in keys:
                value = b.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= value[1:] != value[:-1]
            first = tuple(b.column(c)[0].as_py() for c in keys)
            new[0] = first != last
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in keys)
            edge = np.unique(np.concatenate([[0], np.flatnonzero(new), [b.num_rows]]))
            own = np.diff(np.asarray(_offsets(b.column(bytes_of))))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                more = int(own[s:e].sum())
                if new[s] and held and (rows + e - s > most_rows or size + more > BLOCK_TEXT):
                    yield from flush()
                    held, rows, size = [], 0, 0
                held.append(b.slice(s, e - s))
                rows, size = rows + e - s, size + more
        yield from flush()

    return dealt.mapInArrow(run, "a long, b long")


#: Bytes of text or signatures that whole blocks are gathered to before they are judged.
BLOCK_TEXT = 2 << 20


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]


def _runs(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each block begins, and the number of rows."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in keys:
        value = t[c].to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _pairs(edge: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run, or those across its two sides; at most about PAIRS at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        split = side is not None and side[s:e].any() and not side[s:e].all()
        left = s + np.flatnonzero(side[s:e]) if split else np.arange(s, e)
        right = s + np.flatnonzero(~side[s:e]) if split else left
        step = max(1, PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            x, y = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
            if not split:
                x, y = x[x < y], y[x < y]
            if held and size + len(x) > PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*held))  # type: ignore[misc]
                held, size = [], 0
            held.append((x, y))
            size += len(x)
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))  # type: ignore[misc]


def _matching(keys: list[str]) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Forests of the pairs in blocks that match in MATCHES coordinates; sides and labels count where there are any."""

    def judge(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, edge = t["doc"].to_numpy(), _runs(t, keys)
        signature = _rows(t["signature"])
        run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        side = t["part"].to_numpy() == t["q"].to_numpy() if "q" in keys else None
        if "label" in t.column_names:  # places of one label in one block are joined already
            order = np.lexsort((t["label"].to_numpy(), run))
            value = t["label"].to_numpy()[order]
            new = np.append(True, (value[1:] != value[:-1]) | (run[order][1:] != run[order][:-1]))
            label = np.empty(len(doc), dtype=np.int64)
            label[order] = np.cumsum(new) - 1
        else:
            label = np.arange(len(doc))
        out_a, out_b = [], []
        for i, j in _pairs(edge, side):
            apart = label[i] != label[j]
            i, j = forest(label, *_count_matches(signature, i[apart], j[apart]))
            out_a.append(doc[i])
            out_b.append(doc[j])
        return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_a, out_b))  # type: ignore[return-value]

    return judge


def _signed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select("doc", "signature"), "doc")


def _within_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Forests of matching pairs within the parts of each list; a part holds the list's leader too.

    The leader is the member with the most common values, the likely original of a group of edited copies.
    """
    sizes = cut(lists.groupBy("element").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("parts"), F.max(F.struct("weight", F.negative("doc").alias("doc")))["doc"].alias("leader")))
    own = lists.join(sizes.select("element", "parts"), "element").select("element", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
    led = sizes.where("parts > 1").select("element", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.negative("leader").alias("doc"))
    keys = ["element", "part"]
    return _by_block(_signed(own.unionByName(led), classes), keys, _matching(keys), 4096, "signature")


def _across_lists(lists: DataFrame, families: DataFrame, classes: DataFrame) -> DataFrame:
    """Forests of matching pairs of different families in lists of several parts."""
    rows = cut(lists.join(families.withColumnRenamed("id", "doc"), "doc", "left").select("element", "doc", F.coalesce("component", "doc").alias("label"), F.lit(1).alias("weight")))
    keys = ["element", "p", "q"]
    return _by_block(_signed(_dealt(rows, "element", LIST_BLOCK, LIST_BLOCK), classes), keys, _matching(keys), 4096, "signature")


def set_links(sets: np.ndarray, offsets: np.ndarray, label: np.ndarray, side: np.ndarray | None, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the pairs of similar enough sets, across two sides or among all, that join different labels.

    Each set counts its shingles' posting lists, which gives its intersections with all others at once.
    """
    n, (num, den) = len(offsets) - 1, similarity
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    _, ids = np.unique(sets, return_inverse=True)
    posted = owner[np.argsort(ids, kind="stable")]
    df = np.bincount(ids, minlength=1)
    first = np.cumsum(df) - df
    out: list[tuple[int, int]] = []
    split = side is not None and side.any() and not side.all()
    for i in np.flatnonzero(side).tolist() if split else range(n):
        other = label != label[i]
        if split:
            other &= ~side
        if not other.any():
            continue
        own = ids[offsets[i] : offsets[i + 1]]
        both = np.bincount(posted[expand(first[own], df[own])], minlength=n)
        for j in np.flatnonzero(other & (den * both >= num * (size[i] + size - both))).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _within_families(dealt: DataFrame, texts: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Forests of the links of (family, p, q, part, doc, label) on full sets."""
    keys = ["family", "p", "q"]

    def judge(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, label, edge = t["doc"].to_numpy(), t["label"].to_numpy(), _runs(t, keys)
        side = t["part"].to_numpy() == t["q"].to_numpy()
        sets, offsets = shingle_sets(*text_bytes(t["text"].combine_chunks()), k)
        a, b = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            at = offsets[s : e + 1]
            for i, j in set_links(sets[at[0] : at[-1]], at - at[0], label[s:e].copy(), side[s:e], similarity):
                a.append(doc[s + i])
                b.append(doc[s + j])
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    return _by_block(dealt.join(texts, "doc"), keys, judge, 1 << 20, "text")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    sketch = cut(_sketch(docs, k))
    classes = cut(sketch.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature"), F.min("n_shingles").alias("size")))
    elements = _elements(classes)
    common = cut(elements.groupBy("element").agg(F.count("*").alias("df")).where("df > 1"))
    of_doc = Window.partitionBy("doc")
    posted = elements.join(common, "element").withColumn("rank", F.row_number().over(of_doc.orderBy("df", "element"))).withColumn("held", F.count("*").over(of_doc)).withColumn("weight", F.sum("df").over(of_doc))
    # Values of one document alone come first in the order and use up the prefix.
    prefix = POSTED - LEAST + 1
    lists = cut(posted.where(F.col("rank") <= F.lit(prefix - POSTED) + F.col("held")).select("element", "doc", "weight"))
    families = components(_within_lists(lists, classes))
    large = cut(lists.groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") > LIST_BLOCK).select("element"))
    if large.take(1):
        more = _across_lists(lists.join(large, "element"), families, classes)
        families = components(families.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    members = cut(families.select(F.col("id").alias("doc"), F.col("component").alias("family")).join(classes.select("doc", F.col("size").alias("weight")), "doc"))
    links = _links(members, docs, k, similarity)
    by_class = classes.join(components(links).withColumnRenamed("id", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component_id"))
    joined = sketch.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(members: DataFrame, docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """A forest of the links within the families of members (family, doc, weight)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members.select("doc"), "doc", "left_semi")
    texts = cut(texts.groupBy("doc").agg(F.min("text").alias("text")))
    sizes = members.groupBy("family").agg(((F.count("*") > FAMILY_BLOCK) | (F.sum("weight") > FAMILY_SHINGLES)).alias("large"), F.max(F.struct("weight", "doc"))["doc"].alias("widest"))
    rows = cut(members.join(sizes, "family"))  # a table of its own, so that a large family's join can be split
    deal = lambda x: _dealt(x.select("family", "doc", "label", "weight"), "family", FAMILY_BLOCK, FAMILY_SHINGLES)
    small = _within_families(deal(rows.where("NOT large").withColumn("label", F.col("doc"))), texts, k, similarity)
    large = rows.where("large")
    if not large.take(1):
        return small
    # A large family is linked to its least member and its largest set first.
    star = large.select(F.explode(F.array("family", "widest")).alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()
    led = cut(_confirm(star, texts, k, similarity))
    labelled = cut(large.join(components(led).withColumnRenamed("id", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")))
    return small.unionByName(led).unionByName(_within_families(deal(labelled), texts, k, similarity))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)

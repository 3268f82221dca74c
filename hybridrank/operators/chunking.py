"""Chunkers: fixed windows, recursive, sentence windows and semantic, and the merge of short chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, dot
from .postings import slices

CHUNK_SIZE, OVERLAP, LEAST_CHARS, WINDOW, PERCENTILE = 900, 150, 120, 2, 90.0
# Separators from the strongest to the weakest.
SEPARATORS = [
    re.compile(r"\n(?=MADDE\s+\d+)", re.IGNORECASE),
    re.compile(r"\n(?=Madde\s+\d+)"),
    re.compile(r"\n(?=\d+\.\s+[A-ZÇĞİÖŞÜ])"),
    re.compile(r"\n\n+"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.!?])\s+"),
    re.compile(r"\s+"),
]
# Abbreviations whose period ends no sentence.
ABBREVIATIONS = [
    "dr", "prof", "doç", "yrd", "öğr", "gör", "arş", "av", "sy", "sn",
    "md", "bkz", "vb", "vs", "örn", "yy", "no", "nu", "sf", "s", "c",
    "bkn", "age", "agm", "çev", "haz", "ed", "yay", "bşk", "gen", "alb",
    "tbmm", "yök", "ösym", "mad", "fık", "krş",
]


def fixed_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, text): windows with a stride of size - overlap, the last one ending with the text."""
    stride = max(1, size - overlap)
    n = F.length("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))
    out = docs.where(n > 0).select("doc_id", F.col("text").alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    out = out.select("doc_id", F.col("i").alias("_i"), (F.col("i") * stride).cast("long").alias("char_start"), F.expr(f"substring(_t, i * {stride} + 1, {size})").alias("text"))
    out = out.where(F.trim("text") != "").withColumn("char_end", F.col("char_start") + F.length("text"))
    order = Window.partitionBy("doc_id").orderBy("char_start")
    return out.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "char_start", "char_end", "text")


def recursive_pieces(text: str, size: int = CHUNK_SIZE) -> list[str]:
    """Pieces of at most size characters, cut at the strongest separators that serve, neighbours packed together."""
    out: list[str] = []
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            out += [part] if part.strip() else []
        elif level == len(SEPARATORS):
            out += [part[i : i + size] for i in range(0, len(part), size)]
        else:
            groups: list[str] = []
            for x in SEPARATORS[level].split(part):
                if not x.strip():
                    continue
                if groups and len(groups[-1]) + 1 + len(x) <= size:
                    groups[-1] += "\n" + x
                else:
                    groups.append(x)
            # Packed again to one piece that fits, it is that piece; a single part goes down by itself.
            todo += [(g, level + 1) for g in reversed(groups)] if groups and (len(groups) > 1 or groups[0] != part) else [(part, level + 1)]
    return out


def with_overlap(spans: list[tuple[str, int, int]], overlap: int) -> list[tuple[str, int, int]]:
    """Each chunk starts with the end of the one before, from a word on."""
    done = spans[:1]
    for text, start, end in spans[1:]:
        tail = done[-1][0][-overlap:] if overlap > 0 else ""
        head, space, rest = tail.partition(" ")
        tail = rest if space and head else tail
        done.append((f"{tail.strip()}\n{text}", max(0, start - len(tail)), end) if tail.strip() else (text, start, end))
    return done


def merge_short(spans: list[tuple[str, int, int]], least: int) -> list[tuple[str, int, int]]:
    """Chunks shorter than least join the one before; a short first one joins the next."""
    out: list[tuple[str, int, int]] = []
    for text, start, end in spans:
        if out and (len(text) < least or (len(out) == 1 and len(out[0][0]) < least)):
            out[-1] = (f"{out[-1][0]}\n{text}", out[-1][1], end)
        else:
            out.append((text, start, end))
    return out


def recursive_spans(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = LEAST_CHARS) -> list[tuple[str, int, int]]:
    """(text, start, end) of a text's chunks; offsets are approximate where pieces were packed."""
    spans, cursor = [], 0
    for piece in recursive_pieces(text, size):
        found = text.find(piece, cursor)
        start = cursor if found < 0 else found
        cursor = start + len(piece)
        spans.append((piece.strip(), start, cursor))
    return merge_short(with_overlap(spans, overlap), least)


def recursive_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, text): the packing is sequential, so it runs in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(d, i, s, e, t) for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, (t, s, e) in enumerate(recursive_spans(text or "", size, overlap, least))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in columns[1:4]], pa.array(columns[4], pa.string())], ["doc_id", "ordinal", "char_start", "char_end", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal long, char_start long, char_end long, text string")


def sentences(c: Column) -> Column:
    """Sentences of a text: a period after a number, a single capital or an abbreviation ends none."""
    keep = "\ue000"
    short = "|".join(ABBREVIATIONS)
    for _ in range(2):  # neighbours share the character between them
        c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_’'])(\p{{N}}+|\p{{Lu}}|(?iu:{short}))\.(?=\s|$)", "$1" + keep)
    parts = F.split(c, r"(?<=[.!?…])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, keep, "."))), lambda s: s != "")


def sentence_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, ordinal, text, window_text): a chunk for each sentence, with its neighbours."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("ordinal", "text"))
    around = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(-width, width)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "text", F.array_join(F.collect_list("text").over(around), " ").alias("window_text"))


def _segmented(sentences_: DataFrame, percentile: float) -> DataFrame:
    """sentences_ with distance and segment in place of the vector. All windows are over a document, so rows are exchanged once."""
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("ordinal")
    rows = sentences_.withColumn("distance", 1 - dot(F.col("vector"), F.lead("vector").over(order))).drop("vector")
    limited = rows.withColumn("limit", F.percentile("distance", F.lit(percentile / 100)).over(whole)).withColumn("n", F.count("*").over(whole))
    cut = F.when((F.col("n") >= 3) & (F.round("distance", 9) > F.round("limit", 9)), 1).otherwise(0)
    before = F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return limited.withColumn("cut", cut).withColumn("segment", before.cast("long")).drop("limit", "n", "cut")


def semantic_segments(sentences_: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, ordinal, distance, segment) of sentences (doc_id, ordinal, vector): a cut follows each distance above the percentile."""
    return _segmented(sentences_.select("doc_id", "ordinal", "vector"), percentile).select("doc_id", "ordinal", "distance", "segment")


def merged(chunks: DataFrame, least: int) -> DataFrame:
    """Chunks shorter than least join the one before; a short first one joins the next. A document's chunks meet in one row."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, s, e, t) for d, own in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist()) for i, (t, s, e) in enumerate(merge_short([(x["text"], x["char_start"], x["char_end"]) for x in own], least))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in columns[1:4]], pa.array(columns[4], pa.string())], ["doc_id", "ordinal", "char_start", "char_end", "text"])

    own = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "char_start", "char_end", "text"))).alias("own"))
    return own.mapInArrow(run, f"doc_id {kind}, ordinal long, char_start long, char_end long, text string")


def semantic_chunks(sentences_: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """Chunks of sentences (doc_id, ordinal, text, vector): the sentences between two cuts, joined by a space."""
    rows = _segmented(sentences_.select("doc_id", "ordinal", "text", "vector"), percentile)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "segment").agg(text.alias("text")).select("doc_id", F.col("segment").alias("ordinal"), "text")


CHUNK_COLUMNS = ["doc_id", "ordinal", "char_start", "char_end", "text", "window_text", "strategy"]


def embedded_sentences(texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, ordinal, text, vector) of the sentences of texts (doc_id, text); embed maps (doc_id, text) to (doc_id, vector), and here doc_id is a sentence."""
    rows = texts.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("ordinal", "text"))
    # A sentence travels with its id, so its vector needs no join.
    made = embed(rows.select(F.struct("doc_id", "ordinal", "text").alias("doc_id"), "text")).select(F.col("doc_id").alias("sentence"), "vector")
    return made.select("sentence.doc_id", F.col("sentence.ordinal").cast("long").alias("ordinal"), "sentence.text", "vector")


def chunk(docs: DataFrame, strategy: str = "recursive", size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = LEAST_CHARS, width: int = WINDOW, percentile: float = PERCENTILE, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """CHUNK_COLUMNS of docs (doc_id, text), cleaned first; each strategy takes the knobs that it has.

    semantic needs vectors of sentences: embed makes them, (doc_id, text) to (doc_id, vector); without it docs are
    sentences (doc_id, ordinal, text, vector).
    """
    if strategy not in ("fixed", "recursive", "sentence_window", "semantic"):
        raise ValueError(f"unknown chunk strategy: {strategy}")
    if strategy == "semantic":
        if embed:
            docs = embedded_sentences(docs.select("doc_id", clean_text(F.col("text")).alias("text")), embed)
        elif "vector" not in docs.columns:
            raise ValueError("semantic chunks need sentence vectors")
        out = semantic_chunks(docs, percentile)
    else:
        texts = docs.select("doc_id", clean_text(F.col("text")).alias("text"))
        if strategy == "fixed":
            out = merged(fixed_chunks(texts, size, overlap), least)
        else:
            out = recursive_chunks(texts, size, overlap, least) if strategy == "recursive" else sentence_windows(texts, width)
    kinds = {"char_start": "long", "char_end": "long", "window_text": "string"}
    for name, kind in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("text", F.trim("text")).withColumn("strategy", F.lit(strategy)).select(*CHUNK_COLUMNS)

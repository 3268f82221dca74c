"""Sources of documents: text, Markdown, HTML, pages of text; and what cleans them as they are read."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import clean_text, detect_language, turkish_lower
from ..operators.postings import slices
from ..operators.retrieval import kept

DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "title")
#: Elements whose text a parsed page does not have.
SKIPPED_ELEMENTS = ("script", "style", "nav", "footer", "header")
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&"))
#: Shorter texts are no documents.
LEAST_TEXT = 50
SUFFIXES = (".md", ".markdown", ".txt", ".html", ".htm")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalized(docs: DataFrame) -> DataFrame:
    """NFC of text; only rows with a combining mark or beyond Latin-1 pass through Python."""
    plain = F.coalesce(~F.col("text").rlike(r"[̀-￿]"), F.lit(True))
    return docs.where(plain).unionByName(docs.where(~plain).withColumn("text", nfc("text")))


def html_title(c):
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c):
    """Text without scripts, styles, navigation, footer and header; tags become line breaks."""
    for tag in DROPPED_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s*\n\s*", "\n"))


class _Page(HTMLParser):
    """Texts between tags, without those inside of skipped elements; the title is kept apart as well."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[list[str]] = []
        self.title: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.titled = False
        self.between = True

    def handle_comment(self, data: str) -> None:
        self.between = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.between = True
        if tag not in VOID_ELEMENTS:
            self.open.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.between = True

    def handle_endtag(self, tag: str) -> None:
        self.between = True
        # What was left open inside of an element ends with it; an end without a beginning ends nothing.
        while self.count[tag]:
            last = self.open.pop()
            self.count[last] -= 1
            self.titled |= last == "title"
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if any(self.count[x] for x in SKIPPED_ELEMENTS):
            return
        if self.count["title"] and not self.titled:
            self.title.append(data)
        # Text comes in pieces where a mark in it is no tag.
        if self.between or not self.texts:
            self.texts.append([data])
        else:
            self.texts[-1].append(data)
        self.between = False


def _parsed(raw: str | None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    page = _Page()
    try:
        page.feed(raw)
        page.close()
    except Exception:  # one broken page stops no corpus
        return None, None
    return " ".join("".join(page.title).split()), "\n".join(t for t in ("".join(x).strip() for x in page.texts) if t)


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def parse_html(pages: pd.Series) -> pd.DataFrame:
    """Title and text of HTML, by its tags: nested and unclosed ones, comments and all character references; null gives nulls. The title's text is a line of the text."""
    return pd.DataFrame([_parsed(p) for p in pages], columns=["title", "text"])


def markdown_title(c):
    return F.trim(F.regexp_extract(c, r"(?m)^# (.*)$", 1))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the files have fewer splits than that, as a single row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Reasons of a file that gives no document.
UNSUPPORTED, UNREADABLE, TOO_SHORT = "unsupported", "unreadable", "too short"


def scanned_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, source, text, path, language, reason) of every file below path, from one scan: reason is null for documents.

    The id is the relative path without suffix. Bytes that are no UTF-8 become replacement characters; a file whose
    size is not what was read, or whose parser fails, is unreadable. Empty files are in no scan; a missing folder raises.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        raise FileNotFoundError(path)
    root = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    raw = F.when(F.length("content") == F.col("length"), F.expr("make_valid_utf8(cast(content AS string))"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", raw.alias("raw"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    # Paths come with percent-encoded bytes and a scheme; the root is cut off as plain text.
    plain = F.expr("try_url_decode(replace(path, '+', '%2B'))")
    base = F.substring_index(F.coalesce(plain, "path"), root, -1)
    rows = files.withColumn("suffix", suffix).withColumn("base", base).withColumn("supported", F.col("suffix").isin(*SUFFIXES))
    is_html, is_markdown = F.col("suffix").isin(".html", ".htm"), F.col("suffix").isin(".md", ".markdown")
    rows = rows.withColumn("page", parse_html(F.when(is_html & F.col("supported"), F.col("raw"))))
    title = F.when(is_html, F.col("page.title")).when(is_markdown, markdown_title(F.col("raw"))).otherwise(F.lit(""))
    text = F.when(is_html, F.col("page.text")).otherwise(F.col("raw"))
    stem = F.regexp_extract("base", r"([^/]+?)(?:\.[^./]+)?$", 1)
    docs = rows.select(F.regexp_replace("base", r"\.[^./]+$", "").alias("doc_id"), F.coalesce(F.nullif(title, F.lit("")), stem).alias("source"), F.when(F.col("supported"), text).alias("text"), "path", "supported")
    cleaned = normalized(docs).withColumn("text", clean_text(F.col("text")))
    reason = F.when(~F.col("supported"), UNSUPPORTED).when(F.col("text").isNull(), UNREADABLE).when(F.length("text") < LEAST_TEXT, TOO_SHORT)
    return cleaned.withColumn("language", detect_language(F.col("text"))).withColumn("reason", reason).drop("supported")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, source, text, path, language) of every readable file below path that has enough text."""
    return scanned_files(spark, path, recursive).where("reason IS NULL").drop("reason")


def refused(scanned: DataFrame) -> DataFrame:
    """(path, reason) of the files of scanned_files that give no document."""
    return scanned.where("reason IS NOT NULL").select("path", "reason")


def load_corpus(spark: SparkSession, path: str, recursive: bool = True, repair: bool = True) -> DataFrame:
    """read_files with broken words repaired by the corpus's own vocabulary; repairs is their number in each document."""
    docs = read_files(spark, path, recursive)
    if not repair:
        return docs.withColumn("repairs", F.lit(0))
    return repair_word_breaks(docs, vocabulary(docs))


def as_documents(docs: DataFrame) -> DataFrame:
    """Cleaned texts of at least LEAST_TEXT characters, with their language."""
    cleaned = normalized(docs).withColumn("text", clean_text(F.col("text")))
    return cleaned.where(F.length("text") >= LEAST_TEXT).withColumn("language", detect_language(F.col("text")))


def repeated_lines(pages: DataFrame, least_share: float = 0.6) -> DataFrame:
    """(doc_id, line, n): lines among the first or last three of pages (doc_id, page, text) often enough to be headers or footers."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    top, end = Window.partitionBy("doc_id", "page").orderBy("at"), Window.partitionBy("doc_id", "page").orderBy(F.desc("at"))
    ranked = lines.withColumn("head", F.row_number().over(top)).withColumn("tail", F.row_number().over(end))
    edges = ranked.where("head <= 3").select("doc_id", "line").unionAll(ranked.where("tail <= 3").select("doc_id", "line")).where(F.length("line").between(3, 120))
    count = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = edges.groupBy("doc_id", "line").agg(F.count("*").alias("n")).join(count, "doc_id")
    return often.where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * least_share)))).select("doc_id", "line", "n")


def strip_repeated_lines(pages: DataFrame, least_share: float = 0.6) -> DataFrame:
    """pages without their repeated lines; a line goes by its trimmed text."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("key", F.trim("line"))
    kept = lines.join(repeated_lines(pages, least_share).select("doc_id", F.col("line").alias("key")), ["doc_id", "key"], "left_anti")
    joined = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(joined, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, n_pages): pages behind [[page:N]] marks, blank ones left out."""
    block = F.concat(F.lit("[[page:"), F.col("page").cast("string"), F.lit("]]\n"), F.col("text"))
    item = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("page", block.alias("block")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["block"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))


#: What turkish_lower makes a letter of a word of.
LETTERS = "a-zA-ZçÇğĞıİöÖşŞüÜ\u212a"
#: Bytes of text whose words a task counts at once.
COUNT_BYTES = 8 << 20


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=COUNT_BYTES):
        counts = pc.value_counts(pc.split_pattern_regex(b.column("text"), f"[^{LETTERS}]+").flatten())
        words = counts.field("values")
        long = pc.greater_equal(pc.utf8_length(words), 2)
        yield pa.RecordBatch.from_arrays([words.filter(long), counts.field("counts").filter(long)], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = 2) -> DataFrame:
    """(term, n) of words that occur at least so often.

    A task counts the words of a slice of its texts as they are written; lower case is made of what it has counted.
    """
    counts = docs.select(F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(_words, "word string, n long")
    return counts.groupBy(turkish_lower(F.col("word")).alias("term")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


BREAK = r"(?iuU)\b([a-zçğıöşü]{3,})\s([a-zçğıöşü]{1,3})\b"


def _pairs(c: Column) -> Column:
    """What may be a broken word, from left to right; no two share a letter."""
    return F.regexp_extract_all(c, F.lit(BREAK), F.lit(0))


#: A text cut behind each pair; what follows the last one is a piece as well.
PIECES = r"(?siuU).*?\b[a-zçğıöşü]{3,}\s[a-zçğıöşü]{1,3}\b|.+"


#: What a pair has between its words, and letters of its longest tail.
SPACE, TAIL = r"[\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", 3


def _lowered(words: pa.Array) -> pa.Array:
    """turkish_lower of words of letters alone; each distinct one once."""
    words = words.dictionary_encode()
    return pa.array([w.replace("İ", "i").replace("I", "ı").lower() for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)


def _loose(short: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose tail is none of short, with their place, words and the lower-cased whole."""
    known = pa.array(sorted(short), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("pairs")
            row, pairs = pc.list_parent_indices(lists), pc.list_flatten(lists)
            number = row.to_numpy()
            place = np.arange(len(number)) - np.searchsorted(number, number)
            words = pc.list_flatten(pc.split_pattern_regex(pairs, SPACE))
            tail = words.take(pa.array(np.arange(1, len(words), 2)))
            loose = pa.array(np.flatnonzero(~pc.is_in(_lowered(tail), value_set=known).to_numpy(zero_copy_only=False)))
            tail, head = tail.take(loose), words.take(pc.multiply(loose, 2))
            whole = pc.binary_join_element_wise(head, tail, "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row.take(loose)), pa.array(place.astype(np.int32)).take(loose), head, tail, _lowered(whole)], ["doc_id", "place", "head", "tail", "term"])

    return run


def _breaks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, place, head, tail, term): pairs whose tail is no known word, term being the whole, yet to be looked up.

    A tail has TAIL letters at most, so that known words of that length are a bounded number, which every task gets;
    most pairs go before anything is exchanged.
    """
    letters = F.col("term").rlike(f"^[{LETTERS}ſ]{{1,{TAIL}}}$")
    short = {r.term for r in known.where(letters).distinct().toLocalIterator()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _pairs(F.col("text")).alias("pairs")).mapInArrow(_loose(short), f"doc_id {kind}, place int, head string, tail string, term string")


def word_breaks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(head, tail, n): pairs to be joined, as the whole is a known word and the tail is none."""
    known = kept(known.select("term"))
    pairs = _breaks(docs.select(F.lit(0).alias("doc_id"), "text"), known).groupBy("term", "head", "tail").agg(F.count("*").alias("n"))
    return pairs.join(known, "term", "left_semi").select("head", "tail", "n")


def repair_word_breaks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with those pairs joined, in one pass from left to right: a joined pair begins no other. repairs is their number.

    Pairs are judged by a join with the vocabulary, which is made once. A text is cut behind its pairs, and only the
    pieces that end in a broken word are written anew. Rows of one doc_id must be one row.
    """
    known = kept(known.select("term"))
    docs = docs.repartition("doc_id")  # pairs and repaired texts read one exchange where docs has no other columns
    broken = _breaks(docs, known).join(known, "term", "left_semi")
    found = broken.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("head", "tail").alias("whole")))).alias("_fixes"))
    pieces = F.when(F.col("_fixes").isNotNull(), F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)))
    cut = docs.join(found, "doc_id", "left").withColumn("_pieces", pieces)
    # Places count from 0 and slices from 1; a pair has one character more than its whole.
    between = lambda first, end: F.array_join(F.slice("_pieces", first + 1, F.greatest(end - first, F.lit(0))), "")
    before = lambda j: F.when(j == 0, 0).otherwise(F.get("_fixes", j - 1)["place"] + 1)
    own = lambda f: F.get("_pieces", f["place"])
    fixed = F.transform("_fixes", lambda f, j: F.concat(between(before(j), f["place"]), F.left(own(f), F.length(own(f)) - F.length(f["whole"]) - 1), f["whole"]))
    rest = between(F.element_at("_fixes", -1)["place"] + 1, F.size("_pieces"))
    text = F.when(F.col("_fixes").isNull(), F.col("text")).otherwise(F.concat(F.array_join(fixed, ""), rest))
    repairs = F.when(F.col("_fixes").isNull(), 0).otherwise(F.size("_fixes")).cast("int")
    return cut.withColumns({"text": text, "repairs": repairs}).drop("_fixes", "_pieces")

"""One query for each operator over the driver's tables, and its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import reports as X
from ..operators import retrieval as R
from .. import sources as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """documents for work on their texts, over all cores."""
    return S.spread(read(spark, d, "documents"))


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def six(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- text ---------------------------------------------------------------------------------------------------------
_FROM, _TO = (x.replace("'", "''") for x in T.fold_map())


def fold_sql(c: str) -> str:
    return f"lower(translate({c}, '{_FROM}', '{_TO}'))"


def tokens_sql(c: str, stemmed: bool = True, truncate: int | None = None) -> str:
    found = f"regexp_extract_all({fold_sql(c)}, '[a-z0-9]+')"
    w = rf"regexp_replace(regexp_replace(w, '{T.SUFFIX_PATTERN}', '\1'), '{T.SUFFIX_PATTERN}', '\1')" if stemmed else "w"
    w = f"substr({w}, 1, {truncate})" if truncate else w
    return f"list_transform({found}, lambda w: {w})" if w != "w" else found


LOWER = "lower(translate({}, 'İI', 'iı'))"


@query(f"SELECT doc_id, md5({LOWER.format('text')}) AS low, md5(upper(translate(text, 'iıß', 'İIs'))) AS up FROM documents")
def turkish_case(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.turkish_lower(F.col("text"))).alias("low"), F.md5(T.turkish_upper(F.translate("text", "ß", "s"))).alias("up"))


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


def _token_query(name: str, stemmed: bool, truncate: int | None) -> None:
    sql = f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text', stemmed, truncate)} AS t FROM documents)"

    @query(sql, name)
    def run(spark, d):
        t = read(spark, d, "documents").select("doc_id", T.lexical_tokens(F.col("text"), stemmed, truncate).alias("t"))
        return t.select("doc_id", big(F.size("t")).alias("n_tokens"), big(F.size(F.array_distinct("t"))).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


_token_query("lexical_tokens", True, None)
_token_query("lexical_tokens_nostem", False, None)
_token_query("truncate_tokens", True, 6)

_MARK = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN special / length(sample) > 0.004 THEN 'tr' WHEN tr > en THEN 'tr' WHEN en > tr THEN 'en' ELSE 'unknown' END AS language FROM (
  SELECT *, length(sample) - length(translate(sample, '{T.TURKISH_CHARACTERS}', '')) AS special, len(list_intersect(words, {_MARK(T.TURKISH_WORDS)})) AS tr, len(list_intersect(words, {_MARK(T.ENGLISH_WORDS)})) AS en FROM (
    SELECT *, list_distinct(regexp_extract_all({LOWER.format('sample')}, '[\\p{{L}}\\p{{N}}_’'']+')) AS words FROM (SELECT doc_id, text, substr(text, 1, 2000) AS sample FROM documents)))""")
def detect_language(spark, d):
    return read(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


_DIRTY = "concat('  ', replace(text, 'th', 't-\nh'), '\r\n\n\n\n x \t y ')"


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  concat('  ', replace(text, 'th', concat('t-', chr(10), 'h')), chr(13), chr(10), chr(10), chr(10), chr(10), ' x ', chr(9), ' y '),
  '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{{00A0}}\x{{2000}}-\x{{200B}}]+', ' ', 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents""")
def clean_text(spark, d):
    dirty = F.concat(F.lit("  "), F.replace("text", F.lit("th"), F.lit("t-\nh")), F.lit("\r\n\n\n\n x \t y "))
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(dirty)).alias("cleaned"))


@query(r"""SELECT doc_id, CAST(nullif(regexp_extract(t, '\[\[page:(\d+)\]\]', 1), '') AS BIGINT) AS page, md5(regexp_replace(t, '\[\[page:\d+\]\]\s*', '', 'g')) AS shown
FROM (SELECT doc_id, concat(substr(text, 1, 20), '[[page:', doc_id % 7, ']] ', text) AS t FROM documents)""")
def page_markers(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 20), F.lit("[[page:"), (F.col("doc_id") % 7).cast("string"), F.lit("]] "), "text").alias("t"))
    return t.select("doc_id", T.page_number(F.col("t")).alias("page"), F.md5(T.strip_page_markers(F.col("t"))).alias("shown"))


@query(r"""SELECT conv_id, turn, CASE WHEN n <= 5 THEN 0.0 ELSE round(1 - len(list_distinct(g)) / CAST(n - 4 AS DOUBLE), 6) END AS repetition FROM (
  SELECT *, list_transform(range(1, n - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT *, CAST(len(w) AS BIGINT) AS n FROM (
    SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM conversations)))""")
def repetition_score(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", six(T.repetition(F.col("text"))).alias("repetition"))


@query(f"SELECT conv_id, turn, {' OR '.join(f'contains(lower(t), {chr(39)}{m}{chr(39)})' for m in T.REFUSALS)} AS refusal FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(text, ' It does not contain that.') ELSE text END AS t FROM conversations)")
def refusal_flags(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" It does not contain that."))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(t).alias("refusal"))


@query(r"""SELECT conv_id, turn, CAST(len(v) AS BIGINT) AS n_valid, CAST(len(c) - len(v) AS BIGINT) AS n_invalid, array_to_string(v, ',') AS cited FROM (SELECT *, list_filter(c, lambda x: x BETWEEN 1 AND 5) AS v FROM (
  SELECT conv_id, turn, list_distinct_ordered AS c FROM (SELECT conv_id, turn, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (
    SELECT conv_id, turn, list_transform(regexp_extract_all(t, '\[(\d{1,2})\]', 1), lambda x: CAST(x AS BIGINT)) AS a FROM (
      SELECT conv_id, turn, concat(text, ' [', turn % 4 + 1, '] and [', conv_id % 9, '] [', turn % 4 + 1, ']') AS t FROM conversations)))))""")
def citation_check(spark, d):
    t = F.concat("text", F.lit(" ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("] and ["), (F.col("conv_id") % 9).cast("string"), F.lit("] ["), (F.col("turn") % 4 + 1).cast("string"), F.lit("]"))
    c = read(spark, d, "conversations").select("conv_id", "turn", T.citations(t).alias("c")).withColumn("v", F.filter("c", lambda x: x.between(1, 5)))
    return c.select("conv_id", "turn", big(F.size("v")).alias("n_valid"), big(F.size("c") - F.size("v")).alias("n_invalid"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("cited"))


@query(r"""SELECT item_id, array_to_string(list_concat(v, list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(v, x))), ',') AS ordering FROM (
  SELECT item_id, list_filter(a, lambda x, i: x >= 0 AND x < 5 AND list_position(a, x) = i) AS v FROM (
    SELECT item_id, list_transform(regexp_extract_all(concat('Order: ', item_id % 5 + 1, ', ', item_id % 3 + 1, ' > 9, ', item_id % 4), '\d+'), lambda x: CAST(x AS BIGINT) - 1) AS a FROM benchmark))""")
def parse_ordering(spark, d):
    raw = F.concat(F.lit("Order: "), (F.col("item_id") % 5 + 1).cast("string"), F.lit(", "), (F.col("item_id") % 3 + 1).cast("string"), F.lit(" > 9, "), (F.col("item_id") % 4).cast("string"))
    return read(spark, d, "benchmark").select("item_id", F.array_join(F.transform(T.parse_ordering(raw, F.lit(5)), lambda x: x.cast("string")), ",").alias("ordering"))


# -- sources ------------------------------------------------------------------------------------------------------
_HTML = "html"
for _tag in S.DROPPED_TAGS:
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', chr(10), 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _n, _c in S.ENTITIES:
    _HTML = f"replace({_HTML}, '&{_n};', '{_c}')"
_HTML = rf"trim(regexp_replace({_HTML}, '\s*\n\s*', chr(10), 'g'))"


@query(rf"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5({_HTML}) AS body FROM pages")
def html_source(spark, d):
    return read(spark, d, "pages").select("page_id", S.html_title(F.col("html")).alias("title"), F.md5(S.html_text(F.col("html"))).alias("body"))


def _pages(spark, d):
    """Documents as the pages of their source, under a running head."""
    docs = read(spark, d, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.concat(F.lit("Running head of "), "source", F.lit("\n"), "text", F.lit("\n\n  foot  ")).alias("text"))


_PAGES = "pg AS (SELECT source AS doc_id, doc_id AS page, concat('Running head of ', source, chr(10), text, chr(10), chr(10), '  foot  ') AS text FROM documents)"


@query(f"""WITH {_PAGES}, ln AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pg),
nb AS (SELECT doc_id, page, pos, trim(line) AS line FROM ln WHERE trim(line) <> ''),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS t FROM nb),
ed AS (SELECT doc_id, line FROM rk WHERE h <= 3 AND length(line) BETWEEN 3 AND 120 UNION ALL SELECT doc_id, line FROM rk WHERE t <= 3 AND length(line) BETWEEN 3 AND 120),
pc AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY doc_id)
SELECT doc_id, line, count(*) AS n FROM ed JOIN pc USING (doc_id) GROUP BY doc_id, line, pages HAVING pages >= 3 AND count(*) >= greatest(3, floor(pages * 0.6))""")
def boilerplate_lines(spark, d):
    return S.repeated_lines(_pages(spark, d))


@query(f"""WITH {_PAGES} SELECT doc_id, count(*) AS n_pages, md5(coalesce(string_agg(CASE WHEN trim(text) <> '' THEN concat('[[page:', page, ']]', chr(10), text) END, chr(10) || chr(10) ORDER BY page), '')) AS joined FROM pg GROUP BY doc_id""")
def page_markers_joined(spark, d):
    return S.join_pages(_pages(spark, d)).select("doc_id", "n_pages", F.md5("text").alias("joined"))


_VOCABULARY = f"(SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all({LOWER.format('text')}, '[a-zçğıöşü]{{2,}}')) AS term FROM documents) GROUP BY term HAVING count(*) >= 2)"


@query(f"SELECT term, n FROM {_VOCABULARY}")
def vocabulary(spark, d):
    return S.vocabulary(texts(spark, d))


# Texts in ASCII, as a word ends elsewhere in the other engine next to other letters, with words broken before their last letters.
_BROKEN = "regexp_replace(regexp_replace(text, '[^ -~\n]', ' ', 'g'), '([a-z])(ion|s|en|er) ', '\\1 \\2 ', 'g')"
_BREAK = r"(?i)\b([a-z]{3,})\s([a-z]{1,3})\b"
_BREAKS = f"""vo AS MATERIALIZED {_VOCABULARY}, tx AS (SELECT doc_id, {_BROKEN} AS t FROM documents), pa AS (SELECT doc_id, unnest(m) AS pair, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{_BREAK}') AS m FROM tx)),
fx AS (SELECT pair, head, tail FROM (SELECT DISTINCT pair, regexp_extract(pair, '{_BREAK}', 1) AS head, regexp_extract(pair, '{_BREAK}', 2) AS tail FROM pa) WHERE {LOWER.format('concat(head, tail)')} IN (SELECT term FROM vo) AND {LOWER.format('tail')} NOT IN (SELECT term FROM vo))"""


def _broken(spark, d):
    text = F.regexp_replace(F.regexp_replace("text", "[^ -~\n]", " "), "([a-z])(ion|s|en|er) ", "$1 $2 ")
    return read(spark, d, "documents").select("doc_id", text.alias("text"))


@query(f"WITH {_BREAKS} SELECT head, tail, count(*) AS n FROM pa JOIN fx USING (pair) GROUP BY head, tail")
def word_breaks(spark, d):
    return S.word_breaks(_broken(spark, d), S.vocabulary(read(spark, d, "documents")))


@query(f"""WITH {_BREAKS}, bt AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{_BREAK}') AS p FROM tx))
SELECT doc_id, count(fx.pair) AS repairs, md5(string_agg(concat(x, coalesce(head || tail, pa.pair, '')), '' ORDER BY i)) AS text FROM bt LEFT JOIN pa USING (doc_id, i) LEFT JOIN fx ON fx.pair = pa.pair GROUP BY doc_id""")
def repair_corpus(spark, d):
    fixed = S.repair_word_breaks(_broken(spark, d), S.vocabulary(read(spark, d, "documents")))
    return fixed.select("doc_id", big("repairs").alias("repairs"), F.md5("text").alias("text"))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE length(text) >= 300")
def eligible_passages(spark, d):
    return read(spark, d, "documents").where(F.length("text") >= 300).select("doc_id", "source", "lang", "n_chars")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, d):
    return read(spark, d, "documents").where("doc_id = 42").select("doc_id", "source", "lang", "n_chars")


# -- chunks -------------------------------------------------------------------------------------------------------
_FIXED = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, CAST(i * 750 AS BIGINT) AS char_start, CAST(i * 750 + length(c) AS BIGINT) AS char_end, c FROM (
  SELECT doc_id, i, substr(text, i * 750 + 1, 900) AS c FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) <= 900 THEN 0 ELSE ceil((length(text) - 900) / 750.0) END AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)) WHERE trim(c) <> ''"""


@query(f"SELECT doc_id, ordinal, char_start, char_end, md5(c) AS chunk FROM ({_FIXED})")
def fixed_chunks(spark, d):
    return C.fixed_chunks(texts(spark, d)).select("doc_id", "ordinal", "char_start", "char_end", F.md5("text").alias("chunk"))


@query(f"""SELECT count(*) AS n, min(x) AS least, max(x) AS most, list_sort(list(x))[count(*) // 4 + 1] AS q1, list_sort(list(x))[count(*) // 2 + 1] AS median, list_sort(list(x))[3 * count(*) // 4 + 1] AS q3, round(avg(x), 1) AS mean FROM (SELECT char_end - char_start AS x FROM ({_FIXED}))""")
def chunk_length_stats(spark, d):
    """Order statistics by counts of each length, which are few however many chunks there are."""
    lengths = C.fixed_chunks(read(spark, d, "documents")).select((F.col("char_end") - F.col("char_start")).alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    w = Window.orderBy("x")
    cum = lengths.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.lit(k) * F.col("n") / 4), F.col("x")))
    return cum.agg(F.max("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"), F.round(F.sum(F.col("x") * F.col("c")) / F.max("n"), 1).alias("mean"))


@query()
def recursive_chunks(spark, d):
    return C.recursive_chunks(texts(spark, d)).select("doc_id", "ordinal", "char_start", "char_end", F.md5("text").alias("chunk"))


_HELD = "text"
for _ in range(2):  # neighbours share the character between them
    _HELD = rf"regexp_replace({_HELD}, '(^|[^\p{{L}}\p{{N}}_’''])(\p{{N}}+|\p{{Lu}}|(?i:{'|'.join(C.ABBREVIATIONS)}))\.(\s|$)', '\1\2' || chr(57344) || '\3', 'g')"


@query(rf"""WITH se AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_HELD}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(57344), '.'))), lambda x: x <> '') AS p FROM documents),
un AS (SELECT doc_id, p, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM se) SELECT doc_id, i - 1 AS ordinal, md5(s) AS sentence, md5(array_to_string(p[greatest(1, i - 2):i + 2], ' ')) AS around FROM un""")
def sentence_windows(spark, d):
    return C.sentence_windows(read(spark, d, "documents")).select("doc_id", big("ordinal").alias("ordinal"), F.md5("text").alias("sentence"), F.md5("window_text").alias("around"))


_SEM = "SELECT label AS doc_id, vec_id AS ordinal, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"""WITH s AS ({_SEM}), ds AS (SELECT doc_id, ordinal, 1 - list_inner_product(v, lead(v) OVER (PARTITION BY doc_id ORDER BY ordinal)) AS distance FROM s),
lim AS (SELECT doc_id, quantile_cont(distance, 0.9) AS lim, count(*) AS n FROM ds GROUP BY doc_id),
ct AS (SELECT ds.*, CASE WHEN n >= 3 AND round(distance, 9) > round(lim, 9) THEN 1 ELSE 0 END AS cut FROM ds JOIN lim USING (doc_id))
SELECT CAST(doc_id AS BIGINT) AS doc_id, ordinal, CAST(coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM ct""")
def semantic_breaks(spark, d):
    v = read(spark, d, "embeddings").select(big("label").alias("doc_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return C.semantic_segments(v).select("doc_id", "ordinal", "segment")


_KEPT = "trim(regexp_replace(t, ' +', ' ', 'g'))"
for _ in range(2):  # neighbours share the character between them
    _KEPT = rf"regexp_replace({_KEPT}, '(^|[^A-Za-z0-9])([0-9]+|[A-Z]|(?i:{'|'.join(C.ABBREVIATIONS)}))\.( |$)', '\1\2~\3', 'g')"


@query(rf"""WITH tx AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\.', '\1', 'g'), '[^A-Za-z0-9 .?!]', ' ', 'g') AS t FROM documents),
se AS (SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_KEPT}, '([.?!]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(replace(x, '~', '.'))), lambda x: x <> '') AS p FROM tx))),
tk AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS term FROM se), hs AS (SELECT doc_id, pos, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) AS h FROM tk),
pl AS (SELECT doc_id, pos, h % 64 AS place, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM hs GROUP BY doc_id, pos, place), nm AS (SELECT doc_id, pos, greatest(sqrt(sum(w * w)), 1e-12) AS nm FROM pl GROUP BY doc_id, pos),
dp AS (SELECT a.doc_id, a.pos, sum(a.w * b.w) AS d FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.place = b.place GROUP BY a.doc_id, a.pos),
ds AS (SELECT se.doc_id, se.pos, se.s AS s, CASE WHEN nx.pos IS NOT NULL THEN 1 - coalesce(d, 0) / (coalesce(n1.nm, 1e-12) * coalesce(n2.nm, 1e-12)) END AS distance FROM se LEFT JOIN se nx ON nx.doc_id = se.doc_id AND nx.pos = se.pos + 1
  LEFT JOIN dp ON dp.doc_id = se.doc_id AND dp.pos = se.pos LEFT JOIN nm n1 ON n1.doc_id = se.doc_id AND n1.pos = se.pos LEFT JOIN nm n2 ON n2.doc_id = se.doc_id AND n2.pos = se.pos + 1),
lim AS (SELECT doc_id, quantile_cont(distance, 0.9) AS lim, count(*) AS n FROM ds GROUP BY doc_id), ct AS (SELECT ds.*, CASE WHEN n >= 3 AND round(distance, 9) > round(lim, 9) THEN 1 ELSE 0 END AS cut FROM ds JOIN lim USING (doc_id)),
sg AS (SELECT doc_id, pos, s, CAST(coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM ct)
SELECT doc_id, segment AS ordinal, md5(string_agg(s, ' ' ORDER BY pos)) AS chunk FROM sg GROUP BY doc_id, segment""")
def semantic_chunks(spark, d):
    """Chunks of texts, whose sentences get the offline vectors. Texts are brought to letters, digits and marks first, so that both engines see the same sentences."""
    plain = F.regexp_replace(F.regexp_replace("text", r"([0-9])\.", "$1"), r"[^A-Za-z0-9 .?!]", " ")
    docs = texts(spark, d).select("doc_id", plain.alias("text"))
    return C.chunk(docs, "semantic", embed=R.hashed_vectors).select("doc_id", "ordinal", F.md5("text").alias("chunk"))


# -- retrieval ----------------------------------------------------------------------------------------------------
def bm25_sql(k: int, stemmed: bool = True, truncate: int | None = None) -> str:
    return f"""
dt AS (SELECT doc_id, {tokens_sql('text', stemmed, truncate)} AS t FROM documents), qt AS (SELECT item_id AS query_id, unnest({tokens_sql('text', stemmed, truncate)}) AS term FROM benchmark),
sz AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), po AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM dt) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term), qf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY query_id, term),
sc AS (SELECT query_id, doc_id, sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / avgdl)))) AS score FROM qf JOIN po USING (term) JOIN df USING (term), sz GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


def dense_sql(k: int) -> str:
    return f"""
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= {k})"""


def _lexical(spark, d, k=30, stemmed=True, truncate=None):
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(items, texts(spark, d).select("doc_id", "text"), k, stemmed, truncate)


def _dense(spark, d, k=30):
    e = read(spark, d, "embeddings")
    asked = e.join(read(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense(asked, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), k)


def _bm25_query(name: str, stemmed: bool, truncate: int | None) -> None:
    @query(f"WITH {bm25_sql(5, stemmed, truncate)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lex", name)
    def run(spark, d):
        return _lexical(spark, d, 5, stemmed, truncate).select("query_id", "doc_id", "rank", six("score").alias("score"))


_bm25_query("bm25_topk", True, None)
_bm25_query("bm25_nostem", False, None)
_bm25_query("bm25_truncate6", True, 6)


@query(f"WITH {bm25_sql(5)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lex")
def bm25_blocked(spark, d):
    """The hits of bm25_topk from lists in blocks, most of which long questions leave unread."""
    docs = texts(spark, d).select("doc_id", "text")
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    size = R.kept(R.corpus_size(docs))
    asked = R.terms_of(items).select("term").distinct()
    # Blocks of terms that no question has would never be read, so only those of the others are exchanged and kept.
    blocks = R.kept(R.blocked(R.postings(docs).join(F.broadcast(asked), "term", "left_semi"), size, R.span_count(size.first()["n"])))
    return R.blocked_bm25(items, blocks, size, 5).select("query_id", "doc_id", "rank", six("score").alias("score"))


@query(f"WITH {bm25_sql(5)} SELECT term, df, round(ln(n / CAST(df AS DOUBLE)), 6) AS idf FROM df, sz")
def term_idf(spark, d):
    docs = read(spark, d, "documents")
    df = R.postings(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", six(F.log(F.col("n") / F.col("df"))).alias("idf"))


@query(f"WITH {dense_sql(10)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM den")
def dense_topk(spark, d):
    return _dense(spark, d, 10).select("query_id", "doc_id", "rank", six("score").alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS w FROM embeddings))")
def l2_normalize(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", T.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", six(T.dot(F.col("v"), F.col("v"))).alias("norm"), six(F.col("v")[0]).alias("first"))


def fused_sql(strategy: str, rrf_k: int = 60, alpha: float = 0.5, k: int = 5) -> str:
    mm = lambda t: f"SELECT query_id, doc_id, rank, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {t})"
    a = {"dense_only": 1.0, "lexical_only": 0.0}.get(strategy, alpha)
    only = {"dense_only": ("den", "(SELECT * FROM lex WHERE false)"), "lexical_only": ("(SELECT * FROM den WHERE false)", "lex")}.get(strategy, ("den", "lex"))
    score = f"coalesce(1e0 / ({rrf_k} + dr), 0) + coalesce(1e0 / ({rrf_k} + lr), 0)" if strategy == "rrf" else f"{a}e0 * coalesce(ds, 0) + {1 - a}e0 * coalesce(ls, 0)"
    return f"""{bm25_sql(30)}, {dense_sql(30)},
da AS ({mm(only[0])}), la AS ({mm(only[1])}),
bo AS (SELECT coalesce(da.query_id, la.query_id) AS query_id, coalesce(da.doc_id, la.doc_id) AS doc_id, da.score AS ds, da.rank AS dr, la.score AS ls, la.rank AS lr FROM da FULL JOIN la ON da.query_id = la.query_id AND da.doc_id = la.doc_id),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM (SELECT *, {score} AS score FROM bo)) WHERE rank <= {k})"""


def _fuse_query(name: str, strategy: str, rrf_k: int = 60, alpha: float = 0.5) -> None:
    @query(f"WITH {fused_sql(strategy, rrf_k, alpha)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM fu", name)
    def run(spark, d):
        return R.fuse(_dense(spark, d), _lexical(spark, d), strategy, rrf_k, alpha, 5).select("query_id", "doc_id", "rank", six("score").alias("score"))


_fuse_query("fuse_rrf", "rrf")
_fuse_query("fuse_rrf_k20", "rrf", 20)
_fuse_query("fuse_weighted05", "weighted")
_fuse_query("fuse_weighted07", "weighted", alpha=0.7)
_fuse_query("fuse_dense_only", "dense_only")
_fuse_query("fuse_lexical_only", "lexical_only")


def mmr_sql(pool: str, k: int = 5, trade: float = 0.7) -> str:
    """mm: (query_id, doc_id, step) picked from pool (query_id, doc_id, rank, rel, v), one step after the other; v may be null."""
    dot = "list_inner_product(p.v, s.v)"
    steps = [f"m1 AS MATERIALIZED (SELECT query_id, doc_id, v, 1 AS step FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({trade}e0 * rel, 9) DESC, rank) AS r FROM {pool} WHERE v IS NOT NULL) WHERE r = 1)"]
    for i in range(2, k + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT * FROM m{i - 1} UNION ALL SELECT query_id, doc_id, v, {i} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank) AS r FROM (
    SELECT p.query_id, p.doc_id, p.rank, any_value(p.v) AS v, round({trade}e0 * any_value(p.rel) - (1 - {trade}e0) * max({dot}), 9) AS value FROM {pool} p JOIN m{i - 1} s USING (query_id)
    WHERE p.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m{i - 1} t WHERE t.query_id = p.query_id AND t.doc_id = p.doc_id) GROUP BY p.query_id, p.doc_id, p.rank)) WHERE r = 1)""")
    last = f"""mm AS (SELECT query_id, doc_id, step FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, place) AS step FROM (
    SELECT query_id, doc_id, 0 AS late, step AS place FROM m{k} UNION ALL SELECT query_id, doc_id, 1, rank FROM {pool} WHERE v IS NULL)) WHERE step <= {k})"""
    return ", ".join([*steps, last])


_VECTOR = "list_transform({}.embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"WITH {dense_sql(15)}, pool AS MATERIALIZED (SELECT query_id, doc_id, rank, score AS rel, {_VECTOR.format('e')} AS v FROM den JOIN embeddings e ON e.vec_id = doc_id), {mmr_sql('pool')} SELECT query_id, doc_id, step FROM mm")
def mmr_top5(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    pool = _dense(spark, d, 15).join(v, "doc_id").withColumnRenamed("score", "relevance")
    return R.mmr(pool, 0.7, 5)


@query(f"""WITH {bm25_sql(12)} SELECT query_id, doc_id, rank, CASE WHEN rank <= 5 THEN 6 - rank ELSE rank END AS new_rank FROM lex WHERE query_id IN (SELECT query_id FROM lex GROUP BY query_id HAVING count(*) >= 5)""")
def rerank_apply(spark, d):
    hits = _lexical(spark, d, 12)
    order = hits.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 5").select("query_id", F.array(*map(F.lit, [4, 3, 2, 1, 0])).alias("ordering"))
    return R.rerank(hits.join(order.select("query_id"), "query_id", "left_semi"), order, 5).select("query_id", "doc_id", "rank", "new_rank")


@query(f"""WITH {bm25_sql(5)}, bl AS (SELECT query_id, rank, length(concat('[', rank, '] (', doc_id, ')', chr(10), text)) AS x FROM lex JOIN documents USING (doc_id)),
cu AS (SELECT *, CAST(sum(x) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM bl) SELECT query_id, rank, used FROM cu WHERE rank = 1 OR used <= 6000""")
def context_budget(spark, d):
    hits = _lexical(spark, d, 5).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    blocks = hits.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("doc_id").cast("string"), F.lit(")\n"), "text"))
    return R.context(blocks, 6000).select("query_id", "rank", "used")


@query(f"""WITH {fused_sql('weighted')}, be AS (SELECT query_id, max(sc.score) AS raw FROM fu JOIN lex AS sc USING (query_id, doc_id) GROUP BY query_id),
al AS (SELECT f.query_id, coalesce(any_value(be.raw), max(CASE WHEN rank = 1 THEN score END)) AS sig FROM fu f LEFT JOIN be USING (query_id) GROUP BY f.query_id)
SELECT item_id AS query_id, round(sig, 6) AS signal, sig IS NULL OR sig < 20 AS abstains FROM benchmark LEFT JOIN al ON item_id = al.query_id""")
def abstain_decision(spark, d):
    hits = R.fuse(_dense(spark, d), _lexical(spark, d), "weighted", k=5)
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return R.abstention(items, hits, 20.0).select("query_id", six("signal").alias("signal"), "abstains")


def _engine(spark, d, **options):
    from . import Config, Engine

    passages = texts(spark, d).select("doc_id", "text")
    return Engine(passages, Config(fusion="lexical_only", **options)), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {fused_sql('lexical_only')} SELECT query_id, fu.doc_id, fu.rank, round(fu.score, 6) AS score, round(lex.score, 6) AS raw FROM fu JOIN lex USING (query_id, doc_id)")
def engine_retrieve(spark, d):
    engine, asked = _engine(spark, d)
    return engine.retrieve(asked).select("query_id", "doc_id", "rank", six("score").alias("score"), six("lexical_score").alias("raw"))


@query(f"WITH {bm25_sql(5)} SELECT item_id AS query_id, coalesce(max(score), 0) < 20 AS abstained, coalesce(max(score), 0) >= 20 AS grounded FROM benchmark LEFT JOIN lex ON item_id = query_id GROUP BY item_id")
def engine_abstain(spark, d):
    engine, asked = _engine(spark, d, threshold=20.0)
    return engine.ask(asked).select("query_id", "abstained", "grounded")


_COSINE = "list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_COSINE}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT item_id FROM benchmark)")
def cosine_matrix(spark, d):
    v = read(spark, d, "embeddings").join(read(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.cosine_matrix(v, v).select("left_id", "right_id", six("cosine").alias("cosine"))


@query(f"""WITH tk AS (SELECT doc_id, unnest({tokens_sql('text', False)}) AS term FROM documents), hs AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) AS h FROM tk),
pl AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM hs GROUP BY doc_id, place), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS nm FROM pl GROUP BY doc_id)
SELECT doc_id, place, round(w / nm, 6) AS value FROM pl JOIN nm USING (doc_id) WHERE w <> 0""")
def hashed_vectors(spark, d):
    v = R.hashed_vectors(texts(spark, d).select("doc_id", "text")).select("doc_id", F.posexplode("vector").alias("place", "value"))
    return v.where("value <> 0").select("doc_id", big("place").alias("place"), six("value").alias("value"))


@query("""SELECT page_id, concat_ws(' · ', coalesce(nullif(src, ''), CAST(page_id AS VARCHAR)), nullif(head, ''), CASE WHEN page_id % 3 > 0 THEN concat('s.', page_id % 3) END) AS label,
  CASE WHEN page_id % 2 = 0 THEN 'window' ELSE url END AS shown, page_id % 5 = 0 AS leaked, CASE page_id % 4 WHEN 0 THEN 'gpu' WHEN 1 THEN 'npu' WHEN 2 THEN 'cpu' ELSE 'unknown' END AS provider,
  CASE WHEN page_id % 3 = 1 THEN 'en' ELSE 'tr' END AS language, CAST(page_id % 4 AS BIGINT) AS repairs
FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS src, CASE WHEN page_id % 5 = 0 THEN 'Head' ELSE '' END AS head FROM pages)""")
def passage_labels(spark, d):
    n = lambda k: F.col("page_id") % k
    text = F.when(n(3) > 0, F.concat(F.lit("[[page:"), n(3).cast("string"), F.lit("]]\nbody"))).otherwise("body")
    label = T.citation_label(F.when(n(2) == 0, F.col("url")).otherwise(""), F.col("page_id"), text, F.when(n(5) == 0, "Head").otherwise(""))
    model = F.concat(F.lit("model-generic"), F.when(n(4) == 0, "-gpu:4").when(n(4) == 1, "-npu").when(n(4) == 2, "-cpu:1").otherwise(":2"))
    asked = F.when(n(3) == 1, "which of the rules are for this?").otherwise("bu nedir ve hangisi?")
    words = F.concat(F.repeat(F.lit("ab c "), n(4).cast("int")), F.lit("end"))
    reply = F.when(n(5) == 0, "Kurallar: 1. RULES:").otherwise("fine")
    return read(spark, d, "pages").select(
        "page_id", label.alias("label"), T.read_text(F.when(n(2) == 0, "window").otherwise(""), F.col("url")).alias("shown"), T.leaked(reply).alias("leaked"), T.execution_provider(model).alias("provider"),
        T.prompt_language(asked).alias("language"), big(T.repair_count(words, F.replace(words, F.lit("ab c"), F.lit("abc")))).alias("repairs"),
    )


# -- evaluation ---------------------------------------------------------------------------------------------------
_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = f"""{bm25_sql(5)}, {_GOLD}, ng AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY query_id),
pe AS (SELECT lex.query_id, count(*) AS n, count(gold.doc_id) AS h, min(CASE WHEN gold.doc_id IS NOT NULL THEN rank END) AS first_rank, sum(CASE WHEN gold.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg FROM lex LEFT JOIN gold USING (query_id, doc_id) GROUP BY lex.query_id),
me AS (SELECT item_id AS query_id, CASE WHEN ng > 0 THEN coalesce(h, 0) / CAST(least(ng, 5) AS DOUBLE) ELSE 0.0 END AS recall, CASE WHEN n > 0 THEN h / CAST(n AS DOUBLE) ELSE 0.0 END AS precision, coalesce(1.0 / first_rank, 0.0) AS rr,
  CASE WHEN ng > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(ng, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END AS ndcg, first_rank FROM benchmark LEFT JOIN pe ON pe.query_id = item_id LEFT JOIN ng ON ng.query_id = item_id)"""


def _gold(spark, d):
    """Items whose text a document contains.

    A document that contains an item has the item's inner words, those between two spaces, among its own. So an item meets
    only documents with the longest of them, and contains decides; items of fewer than three words meet all.
    """
    words = F.split("passage", " ", -1)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")).withColumn("anchor", F.nullif(longest, F.lit("")))
    docs = texts(spark, d).select("doc_id", "text")
    own = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("anchor"))
    held = own.join(F.broadcast(items.where("anchor IS NOT NULL")), (own["anchor"] == items["anchor"]) & F.expr("contains(text, passage)"))
    short = docs.join(F.broadcast(items.where("anchor IS NULL").drop("anchor")), F.expr("contains(text, passage)"))
    return held.select("query_id", "doc_id").unionAll(short.select("query_id", "doc_id"))


def _metrics(spark, d, k=5, stemmed=True):
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return E.retrieval_metrics(items, _lexical(spark, d, k, stemmed), _gold(spark, d), k)


@query(f"WITH {_METRICS} SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, CAST(coalesce(first_rank, 0) AS BIGINT) AS first_rank FROM me")
def retrieval_metrics(spark, d):
    return _metrics(spark, d).select("query_id", *[six(c).alias(c) for c in ("recall", "precision", "rr", "ndcg")], F.coalesce("first_rank", F.lit(0)).cast("long").alias("first_rank"))


@query(f"WITH {_METRICS} SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM me")
def metrics_aggregate(spark, d):
    m = E.macro(_metrics(spark, d))
    return m.select("n", *[six(c).alias(c) for c in ("recall", "precision", "rr", "ndcg", "hit_rate")])


# Length of a document as the score, its quality as the label.
_SCORED = "sc AS (SELECT n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))


@query(f"WITH {_SCORED} SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM sc a, sc b WHERE a.label = 1 AND b.label = 0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM sc")
def auc_signals(spark, d):
    return E.auc(_scored(spark, d)).select(six("auc").alias("auc"), "n_pos", "n_neg")


_SWEEP = f"""{_SCORED}, ds AS (SELECT DISTINCT score FROM sc), th AS (SELECT coalesce((score + lead(score) OVER (ORDER BY score)) / 2e0, score + 1e-6) AS threshold FROM ds UNION ALL SELECT min(score) - 1e-6 FROM ds),
cf AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn FROM th, sc GROUP BY threshold),
sw AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2e0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) ELSE 0e0 END AS f1 FROM cf)"""


@query(f"WITH {_SWEEP} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1 FROM sw ORDER BY round(f1, 12) DESC, sw.threshold LIMIT 1")
def threshold_f1(spark, d):
    return E.best_threshold(_scored(spark, d)).select(six("threshold").alias("threshold"), "tp", "fp", "fn", "tn", six("f1").alias("f1"))


@query(f"WITH {_SCORED} SELECT max(score) AS threshold FROM (SELECT a.score FROM (SELECT DISTINCT score FROM sc) a, sc b GROUP BY a.score HAVING count(*) FILTER (label = 1 AND b.score >= a.score) / CAST(count(*) FILTER (label = 1) AS DOUBLE) >= 0.9)")
def threshold_safe(spark, d):
    return E.safety_threshold(_scored(spark, d))


_CONF = "cn AS (SELECT least(n_chars / 4000e0, 1.0) AS confidence, quality AS outcome FROM documents JOIN labels USING (doc_id)), bn AS (SELECT i AS bin, count(*) AS n, avg(confidence) AS c, avg(outcome) AS a FROM cn, range(10) t(i) WHERE confidence > i / 10e0 AND confidence <= (i + 1) / 10e0 GROUP BY i)"


def _confidence(spark, d):
    return _scored(spark, d).select(F.least(F.col("score") / 4000, F.lit(1.0)).alias("confidence"), F.col("label").alias("outcome"))


@query(f"WITH {_CONF} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM bn")
def ece_bins(spark, d):
    return E.calibration_bins(_confidence(spark, d)).select("bin", "n", six("confidence").alias("confidence"), six("accuracy").alias("accuracy"))


@query(f"WITH {_CONF} SELECT round(sum(n / CAST((SELECT count(*) FROM cn) AS DOUBLE) * abs(c - a)), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round((SELECT avg((confidence - outcome) ** 2) FROM cn), 6) AS brier FROM bn")
def ece_summary(spark, d):
    return E.calibration(_confidence(spark, d)).select(six("ece").alias("ece"), six("mce").alias("mce"), six("brier").alias("brier"))


_DRAW = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
_VALUES = "va AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, CAST(length(text) % 17 AS DOUBLE) AS a, CAST(length(text) % 11 AS DOUBLE) AS b FROM benchmark)"


def _values(spark, d):
    return E.numbered(read(spark, d, "benchmark").select("item_id", "text"), "item_id").select("i", (F.length("text") % 17).cast("double").alias("a"), (F.length("text") % 11).cast("double").alias("b"))


@query(f"""WITH {_VALUES}, sz AS (SELECT count(*) AS n, avg(a) AS estimate FROM va), dr AS (SELECT b, {_DRAW.format("concat_ws(':', '20260801', b, j)")} % n AS i FROM range(300) x(b), sz, range((SELECT n FROM sz)) y(j)),
mn AS (SELECT dr.b, round(avg(a), 12) AS m FROM dr JOIN va USING (i) GROUP BY dr.b) SELECT round(estimate, 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, n FROM mn, sz GROUP BY estimate, n""")
def bootstrap_ci(spark, d):
    v = _values(spark, d).select("i", F.col("a").alias("value"))
    return E.bootstrap_ci(v, 300).select(six("estimate").alias("estimate"), six("lower").alias("lower"), six("upper").alias("upper"), "n")


@query(f"""WITH {_VALUES}, ob AS (SELECT avg(a - b) AS diff, count(*) AS n, stddev_samp(a - b) AS sd FROM va), mn AS (SELECT r, avg((a - b) * (1 - 2 * ({_DRAW.format("concat_ws(':', '20260801', r, i)")} % 2))) AS m FROM va, range(300) x(r) GROUP BY r)
SELECT round(any_value(diff), 6) AS diff, round((count(*) FILTER (round(abs(m), 12) >= round(abs(diff), 12)) + 1) / 301e0, 6) AS p, round(any_value(diff / sd), 6) AS d, any_value(n) AS n FROM mn, ob""")
def permutation_test(spark, d):
    return E.permutation_test(_values(spark, d), 300).select(six("diff").alias("diff"), six("p").alias("p"), six("d").alias("d"), "n")


@query(f"""WITH {_VALUES}, fe AS (SELECT i // 10 AS test, i % 10 AS i, a - b AS d FROM va), sz AS (SELECT test, count(*) AS n, avg(d) AS diff FROM fe GROUP BY test),
mn AS (SELECT test, diff, k, avg(d * (1 - 2 * ((k >> i) & 1))) AS m FROM fe JOIN sz USING (test), range(1024) x(k) WHERE k < (1 << n) GROUP BY test, diff, k)
SELECT test, round(diff, 6) AS diff, round(avg(CASE WHEN round(abs(m), 12) >= round(abs(diff), 12) THEN 1.0 ELSE 0.0 END), 6) AS p FROM mn GROUP BY test, diff""")
def permutation_exact(spark, d):
    """All rows, in tests of ten pairs each."""
    pairs = _values(spark, d).select(F.floor(F.col("i") / 10).alias("test"), (F.col("i") % 10).alias("i"), "a", "b")
    return E.permutation_exact(pairs).select("test", six("diff").alias("diff"), six("p").alias("p"))


_P = "pv AS (SELECT CAST(item_id AS VARCHAR) AS name, (item_id * 37 % 1009 + 1) / 1000000e0 AS p FROM benchmark)"


@query(f"WITH {_P} SELECT name, p, min(CASE WHEN p <= 0.05e0 / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY r) = 1 AS reject FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM pv)")
def holm(spark, d):
    t = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), ((F.col("item_id") * 37 % 1009 + 1) / 1000000).alias("p"))
    return E.holm(t)


@query(f"""WITH {bm25_sql(1)}, tk AS (SELECT query_id, doc_id, list_distinct({tokens_sql('b.text')}) AS q, list_distinct({tokens_sql('d.text')}) AS g FROM lex JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, g)) / CAST(len(q) AS DOUBLE) END, 6) AS overlap, round(len(list_intersect(q, g)) / CAST(len(list_distinct(list_concat(q, g))) AS DOUBLE), 6) AS jaccard FROM tk""")
def gold_overlap(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.lexical_tokens(F.col("text")).alias("q"))
    t = read(spark, d, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("g"))
    both = _lexical(spark, d, 1).select("query_id", "doc_id").join(b, "query_id").join(t, "doc_id")
    return both.select("query_id", "doc_id", six(T.overlap(F.col("q"), F.col("g"))).alias("overlap"), six(T.jaccard(F.col("q"), F.col("g"))).alias("jaccard"))


@query(f"""WITH ky AS (SELECT doc_id, md5(array_to_string({tokens_sql('text')}, ' ')) AS k, md5(concat('7:', doc_id)) AS draw FROM documents WHERE length(text) >= 300), un AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY draw, doc_id) AS r FROM ky)
SELECT doc_id, row_number() OVER (ORDER BY draw, doc_id) AS attempt FROM un WHERE r = 1 QUALIFY attempt <= 50""")
def sample_questions(spark, d):
    from pyspark.sql import Window

    docs = read(spark, d, "documents").where(F.length("text") >= 300)
    keyed = docs.select("doc_id", F.md5(F.array_join(T.lexical_tokens(F.col("text")), " ")).alias("k"), F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("draw"))
    first = keyed.groupBy("k").agg(F.min(F.struct("draw", "doc_id")).alias("x")).select("x.*")
    drawn = first.orderBy("draw", "doc_id").limit(50)
    return drawn.select("doc_id", F.row_number().over(Window.orderBy("draw", "doc_id")).cast("long").alias("attempt"))


_ASKED = "concat(substr(text, 1, doc_id % 60), CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN ' metinde nedir?' ELSE ' is what?' END)"


@query(rf"""WITH pool AS (SELECT doc_id, source, trim(text) AS passage, row_number() OVER (ORDER BY md5(concat('20260801:', doc_id)), doc_id) AS attempt FROM documents WHERE length(text) >= 300 QUALIFY attempt <= 100),
rp AS (SELECT doc_id, source, attempt, substr(passage, 1, 1500) AS passage, trim(string_split(trim({_ASKED.replace('text', 'passage')}), chr(10))[1]) AS q FROM pool),
cl AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(q, '^(?:\d+[.)]|[-*•])\s*', ''), '^["''“”]+|["''“”]+$', '', 'g')), '(?i)^(?:soru|question)\s*:\s*', '')) AS question FROM rp),
us AS (SELECT *, {tokens_sql('question')} AS t FROM cl WHERE length(question) BETWEEN 15 AND 250 AND contains(question, '?') AND NOT ({' OR '.join(f"contains({LOWER.format('question')}, '{p}')" for p in X.REFERENTIAL)})),
fi AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY array_to_string(t, ' ') ORDER BY attempt) = 1), nu AS (SELECT *, row_number() OVER (ORDER BY attempt) - 1 AS position FROM fi)
SELECT position, attempt, doc_id, source AS source_doc, md5(question) AS question, md5(substr(passage, 1, 400)) AS gold_answer, round(len(list_intersect(list_distinct(t), list_distinct({tokens_sql('passage')}))) / CAST(greatest(len(list_distinct(t)), 1) AS DOUBLE), 4) AS gold_overlap FROM nu WHERE position < 40""")
def generated_questions(spark, d):
    """Questions by a rule in place of a model: the beginning of the passage, with a fault in some."""
    def generate(rows):
        i = F.col("doc_id")
        tail = F.when(i % 5 == 0, "").when(i % 7 == 0, " metinde nedir?").otherwise(" is what?")
        return rows.select("doc_id", F.concat(F.expr("substring(passage, 1, cast(doc_id % 60 AS int))"), tail).alias("raw"))

    rows = X.generated_questions(read(spark, d, "documents").select("doc_id", "source", "text"), generate, 40)
    return rows.select("position", "attempt", F.col("gold")[0].alias("doc_id"), "source_doc", F.md5("question").alias("question"), F.md5("gold_answer").alias("gold_answer"), "gold_overlap")


_CANDIDATES = "concat(CASE a WHEN 0 THEN text WHEN 1 THEN array_to_string(list_reverse(string_split(text, ' '))[1:5], ' ') ELSE array_to_string(string_split(text, ' ')[3:9], ' ') END, CASE WHEN (item_id + a) % 4 = 0 THEN '' ELSE '?' END)"


@query(rf"""WITH ca AS (SELECT item_id, a, {_CANDIDATES} AS raw FROM benchmark, (VALUES (0), (1), (2)) t(a)),
cl AS (SELECT item_id, a, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(string_split(trim(raw), chr(10))[1]), '^(?:\d+[.)]|[-*•])\s*', ''), '^["''“”]+|["''“”]+$', '', 'g')), '(?i)^(?:soru|question)\s*:\s*', '')) AS q FROM ca),
us AS (SELECT c.item_id, a, q, list_distinct({tokens_sql('q')}) AS x, list_distinct({tokens_sql('b.text')}) AS y FROM cl c JOIN benchmark b USING (item_id) WHERE length(q) BETWEEN 15 AND 250 AND contains(q, '?') AND NOT ({' OR '.join(f"contains({LOWER.format('q')}, '{p}')" for p in X.REFERENTIAL)})),
sm AS (SELECT item_id, a, q, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END AS sim FROM us),
be AS (SELECT item_id, arg_min(q, a) FILTER (sim <= 0.8) AS first, arg_max(q, a) AS last FROM sm GROUP BY item_id)
SELECT b.item_id, md5(coalesce(first, last, text)) AS question, first IS NULL AS echo, round(CASE WHEN len(tk) = 0 THEN 0.0 ELSE len(list_intersect(tk, list_distinct({tokens_sql('text')}))) / CAST(len(tk) AS DOUBLE) END, 6) AS gold_overlap
FROM (SELECT b.item_id, b.text, be.first, be.last, list_distinct({tokens_sql('coalesce(be.first, be.last, b.text)')}) AS tk FROM benchmark b LEFT JOIN be USING (item_id)) b""")
def paraphrases(spark, d):
    """The items reworded by three candidates each: themselves, some words turned round, some words from the middle."""
    items = read(spark, d, "benchmark")
    words = F.split("text", " ")
    tries = F.array(F.col("text"), F.array_join(F.slice(F.reverse(words), 1, 5), " "), F.array_join(F.slice(words, 3, 7), " "))
    rows = items.select("item_id", F.posexplode(tries).alias("attempt", "own"))
    raw = rows.select("item_id", "attempt", F.concat("own", F.when((F.col("item_id") + F.col("attempt")) % 4 == 0, "").otherwise("?")).alias("raw"))
    out = X.paraphrases(items.select("item_id", F.col("text").alias("question"), F.col("text").alias("gold_text")), raw)
    return out.select("item_id", F.md5("question").alias("question"), "echo", six("gold_overlap").alias("gold_overlap"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY lang")
def corpus_stats(spark, d):
    from pyspark.sql import Window

    docs = read(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang")
    cum = docs.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("n", F.sum("c").over(w))
    return cum.groupBy("lang").agg(F.max("n").alias("n"), F.sum(F.col("n_chars") * F.col("c")).alias("total"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("n_chars"))).alias("median"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS median, round(list_sort(list(value))[greatest(1, CAST(round_even(0.95e0 * count(*), 0) AS BIGINT))], 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY event_type")
def telemetry_summary(spark, d):
    t = E.latency_summary(read(spark, d, "events").select("event_type", "value"), "event_type")
    return t.select("event_type", "n", F.round("total", 4).alias("total"), six("median").alias("median"), six("p95").alias("p95"), six("most").alias("most"))


# -- runs and reports ---------------------------------------------------------------------------------------------
_ANSWERS = """an AS (SELECT item_id AS query_id, item_id % 3 = 0 AS ab, item_id % 4 = 0 AS sh, CASE WHEN item_id % 6 = 5 THEN [] ELSE [item_id % 3 + 1, item_id % 7 + 1] END AS ci, item_id % 5 = 0 AS inv, item_id % 3 AS g FROM benchmark),
me AS (SELECT *, len(ci) > 0 AS hc, CASE WHEN len(list_filter(ci, lambda c: c <= 4)) > 0 THEN len(list_filter(ci, lambda c: c <= 4 AND c - 1 = g)) / CAST(len(list_filter(ci, lambda c: c <= 4)) AS DOUBLE) ELSE 0.0 END AS cp FROM an)"""


def _answers(spark, d):
    i = F.col("item_id")
    rows = read(spark, d, "benchmark").select(
        i.alias("query_id"), (i % 3 == 0).alias("abstained"), (i % 4 == 0).alias("should_abstain"), F.when(i % 6 == 5, F.array().cast("array<bigint>")).otherwise(F.array(i % 3 + 1, i % 7 + 1)).alias("citations"),
        F.when(i % 5 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).alias("invalid"), F.array(*[i + k for k in range(4)]).alias("retrieved"), F.array(i + i % 3).alias("gold"),
    )
    return X.answer_metrics(rows)


@query(f"WITH {_ANSWERS} SELECT query_id, hc AS has_citations, inv AS has_invalid, round(cp, 6) AS citation_precision, ab = sh AS abstention_correct FROM me")
def answer_metrics(spark, d):
    return _answers(spark, d).select("query_id", "has_citations", "has_invalid", six("citation_precision").alias("citation_precision"), "abstention_correct")


@query(f"""WITH {_ANSWERS} SELECT count(*) AS n, round(avg(CASE WHEN ab = sh THEN 1.0 ELSE 0 END), 6) AS abstention_accuracy, round(avg(CASE WHEN hc THEN 1.0 ELSE 0 END), 6) AS citation_rate, round(avg(CASE WHEN inv THEN 1.0 ELSE 0 END), 6) AS invalid_rate,
  round(avg(CASE WHEN ab THEN 1.0 ELSE 0 END) FILTER (sh), 6) AS refusal_recall, round(avg(CASE WHEN ab THEN 0 ELSE 1.0 END) FILTER (NOT sh), 6) AS answer_rate, round(avg(cp) FILTER (NOT sh), 6) AS citation_precision FROM me""")
def answer_summary(spark, d):
    out = X.answer_summary(_answers(spark, d))
    return out.select("n", *[six(c).alias(c) for c in out.columns if c != "n"])


@query("SELECT event_type, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS p50, round(list_sort(list(value))[CASE WHEN count(*) > 1 THEN least(count(*), CAST(round_even(0.95e0 * count(*), 0) AS BIGINT)) ELSE 1 END], 6) AS p95, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def run_latency(spark, d):
    out = E.run_latency(read(spark, d, "events").select("event_type", "value"), "event_type")
    return out.select("event_type", *[six(c).alias(c) for c in ("p50", "p95", "most", "mean")])


def _runs(spark, d):
    rows = _values(spark, d)
    own = lambda value: rows.select(F.col("i").alias("position"), F.concat(F.lit("q"), F.col("i").cast("string")).alias("question"), F.lit(True).alias("answerable"), F.array("i").alias("gold"), value.alias("value"))
    return own(F.col("a")), own(F.col("b")), own(F.col("a") + F.col("i") % 2)


_TEST = f"mn AS (SELECT name, r, avg(d * (1 - 2 * ({_DRAW.format(chr(39).join(['concat_ws(', ':', ', ', '20260801', ', r, i)']))} % 2))) AS m FROM pr, range(200) x(r) GROUP BY name, r), ob AS (SELECT name, avg(d) AS diff, max(abs(d)) AS most FROM pr GROUP BY name), te AS (SELECT name, any_value(diff) AS diff, CASE WHEN any_value(most) <= 1e-8 THEN 1.0 ELSE (count(*) FILTER (round(abs(m), 12) >= round(abs(diff), 12)) + 1) / 201e0 END AS p FROM mn JOIN ob USING (name) GROUP BY name)"


@query(f"""WITH {_VALUES}, pr AS (SELECT 'b' AS name, i, a - b AS d FROM va UNION ALL SELECT 'shifted', i, -(i % 2) FROM va), {_TEST}
SELECT name, round(diff, 6) AS diff, round(p, 6) AS p, min(CASE WHEN p <= 0.05e0 / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY r) = 1 AS reject FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM te)""")
def compare_configs(spark, d):
    a, b, shifted = _runs(spark, d)
    return X.compare_many({"b": b, "shifted": shifted}, a, resamples=200).select("name", six("diff").alias("diff"), six("p").alias("p"), "reject")


@query(f"WITH {_VALUES}, pr AS (SELECT 'g' AS name, i, a - b AS d FROM va), {_TEST} SELECT round(diff, 6) AS diff, round(p, 6) AS p FROM te")
def compare_by_gold(spark, d):
    a, b, _ = _runs(spark, d)
    return X.compare_by_gold(a, b.withColumn("question", F.lit("reworded")), 200).select(six("diff").alias("diff"), six("p").alias("p"))


@query("""SELECT variant, count(*) AS n, count(*) FILTER (variant <> 'unanswerable') AS n_answerable, count(DISTINCT source) AS documents, round(avg(CASE WHEN variant = 'unanswerable' THEN NULL ELSE n_chars % 10 / 10e0 END), 4) AS gold_overlap,
  count(*) FILTER (variant = 'paraphrased' AND doc_id % 4 = 1) AS echoes, round(avg(length(coalesce(lang, ''))), 1) AS mean_chars
FROM (SELECT *, ['generated', 'paraphrased', 'unanswerable'][doc_id % 3 + 1] AS variant FROM documents) GROUP BY variant""")
def evalset_stats(spark, d):
    i = F.col("doc_id")
    variant = F.when(i % 3 == 0, "generated").when(i % 3 == 1, "paraphrased").otherwise("unanswerable")
    rows = read(spark, d, "documents").select(variant.alias("variant"), (i % 3 != 2).alias("answerable"), F.col("source").alias("source_doc"), F.coalesce("lang", F.lit("")).alias("question"), F.when(i % 3 != 2, F.col("n_chars") % 10 / 10).alias("gold_overlap"), (i % 4 == 1).alias("echo"))
    return X.evalset_stats(rows)


@query(f"WITH pr AS (SELECT {_COSINE} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(min(c), 6) AS least, round(quantile_cont(c, 0.1), 6) AS p10, count(*) FILTER (c < 0.8) AS suspect FROM pr")
def paraphrase_fidelity(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select(T.dot(F.col("embedding"), F.col("other")).alias("cosine"))
    out = X.fidelity(pairs)
    return out.select("n", "suspect", *[six(c).alias(c) for c in ("mean", "median", "least", "p10")])


@query("SELECT role AS model, count(*) AS n, round(avg(length(text)), 6) AS mean_latency, count(*) FILTER (turn % 3 <> 0 AND contains(lower(text), 'the')) AS grounded, count(*) FILTER (turn % 3 = 0 AND conv_id % 2 = 0) AS refused FROM conversations GROUP BY role")
def model_comparison(spark, d):
    c = read(spark, d, "conversations")
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" Not present in it."))).otherwise(F.col("text"))
    rows = c.select(F.col("role").alias("model"), answer.alias("answer"), F.length("text").alias("latency"), F.array(F.lit("THE")).alias("must_contain"), (F.col("turn") % 3 == 0).alias("expect_refusal"))
    return X.model_comparison(rows).select("model", "n", six("mean_latency").alias("mean_latency"), "grounded", "refused")


@query("""SELECT role AS language, CAST(turn % 4 AS BIGINT) AS budget, count(*) FILTER (conv_id % 2 = 1 AND conv_id % 3 = 0) AS refused, count(*) FILTER (conv_id % 5 = 0) AS leaks, count(*) FILTER (conv_id % 2 = 0 AND conv_id % 3 <> 0) AS answered, round(avg(length(text)), 6) AS mean_latency FROM conversations GROUP BY role, turn % 4""")
def prompt_ablation(spark, d):
    i = F.col("conv_id")
    answer = F.concat("text", F.when(i % 3 == 0, " It cannot answer.").otherwise(" [1]"), F.when(i % 5 == 0, " Rules: none").otherwise(""))
    rows = read(spark, d, "conversations").select(F.col("role").alias("language"), big(F.col("turn") % 4).alias("budget"), (i % 2 == 0).alias("answerable"), answer.alias("answer"), T.citations(answer).alias("citations"), F.length("text").alias("latency"))
    return X.prompt_ablation(rows).select("language", "budget", "refused", "leaks", "answered", six("mean_latency").alias("mean_latency"))


@query("SELECT bool_and(confidence BETWEEN 0 AND 1) AS bounded FROM (SELECT least(n_chars / 4000e0, 1.0) AS confidence FROM documents JOIN labels USING (doc_id))")
def bounded_scores(spark, d):
    return E.is_bounded(_confidence(spark, d).withColumnRenamed("confidence", "score"))


# -- sweep --------------------------------------------------------------------------------------------------------
RESAMPLES = 200
#: Sign flips of a test of configurations, as many as in the reference.
FLIPS = 10_000


def _sweep(spark, d, resamples=RESAMPLES):
    """All configurations over the items as they are and over the last halves of them; an item's vector is that of its id, a half's of the next one."""
    from ..functions.text import lexical_tokens
    from .sweep import Sweep, overlap_order

    items = read(spark, d, "benchmark").select("item_id", "text")
    gold = _gold(spark, d).withColumnRenamed("query_id", "item_id")
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.size(words)), " ")
    wordings = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.lit("generated").alias("variant"), F.col("text").alias("asked")), F.struct(F.lit(1).alias("w"), F.lit("paraphrased").alias("variant"), half.alias("asked"))))
    rows = items.select("item_id", wordings.alias("x")).select((F.col("item_id") * 2 + F.col("x.w")).alias("query_id"), (F.col("item_id") + F.col("x.w")).alias("vec_id"), F.col("x.asked").alias("text"), "x.variant", F.col("item_id").alias("position"))
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    golds = gold.select(F.explode(F.array(F.col("item_id") * 2, F.col("item_id") * 2 + 1)).alias("query_id"), "doc_id")
    passages = texts(spark, d).select("doc_id", "text")
    vectors = v.withColumnRenamed("vec_id", "doc_id").join(read(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return Sweep(rows.join(v, "vec_id", "left").drop("vec_id"), golds, passages, reorder=lambda heads: overlap_order(heads, lexical_tokens), resamples=resamples, vectors=vectors)


def _sweep_sql() -> str:
    """me: (variant, config, position, recall, precision, rr, ndcg) of every configuration."""
    from . import sweep_configs

    configs = sweep_configs()
    stems = sorted({(c.stemmed, c.truncate) for c in configs if c.fusion != "dense_only"}, key=str)
    of = {x: i for i, x in enumerate(stems)}
    lex = []
    for (stemmed, truncate), i in of.items():
        lex.append(f"""dt{i} AS (SELECT doc_id, {tokens_sql('text', stemmed, truncate)} AS t FROM documents), qf{i} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('text', stemmed, truncate)}) AS term FROM qs) GROUP BY query_id, term),
po{i} AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM dt{i}) GROUP BY doc_id, term), df{i} AS (SELECT term, count(*) AS df FROM po{i} GROUP BY term), sz{i} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt{i}),
lx{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / avgdl)))) AS score FROM qf{i} JOIN po{i} USING (term) JOIN df{i} USING (term), sz{i} GROUP BY query_id, doc_id)) WHERE rank <= 30)""")
    alpha = {"dense_only": 1.0, "lexical_only": 0.0}
    table = ", ".join(f"('{c.name}', {c.fusion == 'rrf'}, {c.rrf_k}, {float(alpha.get(c.fusion, c.alpha))}e0, {c.fusion != 'lexical_only'}, {of[(c.stemmed, c.truncate)] if c.fusion != 'dense_only' else 'NULL'}, {c.use_mmr}, {c.rerank})" for c in configs)
    every = " UNION ALL ".join(f"SELECT {i} AS arm, * FROM lx{i}" for i in of.values())
    return f"""{_GOLD}, qs AS MATERIALIZED (SELECT item_id * 2 + w AS query_id, item_id + w AS vec_id, item_id AS position, CASE w WHEN 0 THEN 'generated' ELSE 'paraphrased' END AS variant,
  CASE w WHEN 0 THEN text ELSE array_to_string(string_split(text, ' ')[len(string_split(text, ' ')) // 2 + 1:], ' ') END AS text FROM benchmark, (VALUES (0), (1)) t(w) WHERE item_id IN (SELECT query_id FROM gold)),
gd AS (SELECT qs.query_id, doc_id FROM qs JOIN gold ON gold.query_id = qs.position), em AS MATERIALIZED (SELECT vec_id, {_VECTOR.format('embeddings')} AS v FROM embeddings),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT q.query_id, e.vec_id AS doc_id, list_inner_product(a.v, e.v) AS score FROM qs q JOIN em a ON a.vec_id = q.vec_id, em e WHERE e.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 30),
{", ".join(lex)}, lx AS ({every}), cf(config, rrf, rrf_k, alpha, dense, arm, mmr, rerank) AS (VALUES {table}),
hi AS MATERIALIZED (SELECT config, rrf, rrf_k, alpha, mmr, rerank, 'd' AS side, query_id, doc_id, score, rank FROM cf, dn WHERE dense UNION ALL SELECT config, rrf, rrf_k, alpha, mmr, rerank, 'l', query_id, doc_id, score, rank FROM cf JOIN lx USING (arm)),
sc AS (SELECT *, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hi WINDOW w AS (PARTITION BY config, side, query_id))),
bo AS (SELECT config, rrf, rrf_k, alpha, mmr, rerank, query_id AS q, doc_id, max(rank) FILTER (side = 'd') AS dr, max(rank) FILTER (side = 'l') AS lr, max(s) FILTER (side = 'd') AS ds, max(s) FILTER (side = 'l') AS ls FROM sc GROUP BY ALL),
fu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY round(score, 9) DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank, count(*) OVER (PARTITION BY config, q) AS n FROM (
  SELECT *, CASE WHEN rrf THEN coalesce(1e0 / (rrf_k + dr), 0) + coalesce(1e0 / (rrf_k + lr), 0) ELSE alpha * coalesce(ds, 0) + (1 - alpha) * coalesce(ls, 0) END AS score FROM bo)),
ov AS (SELECT f.config, f.q, f.doc_id, f.rank, len(list_intersect(a, b)) / CAST(greatest(len(a), 1) AS DOUBLE) AS share FROM (
  SELECT f.config, f.q, f.doc_id, f.rank, list_distinct({tokens_sql('qs.text')}) AS a, list_distinct({tokens_sql('d.text')}) AS b FROM fu f JOIN qs ON qs.query_id = f.q JOIN documents d ON d.doc_id = f.doc_id WHERE f.rerank AND f.rank <= 12 AND f.n > 1) f),
re AS (SELECT config, q, doc_id, row_number() OVER (PARTITION BY config, q ORDER BY round(share, 9) DESC, rank) AS new FROM ov),
pool AS MATERIALIZED (SELECT f.q AS query_id, f.doc_id, f.rank, e.v, list_inner_product(a.v, e.v) AS rel FROM fu f JOIN qs ON qs.query_id = f.q LEFT JOIN em a ON a.vec_id = qs.vec_id LEFT JOIN em e ON e.vec_id = f.doc_id WHERE mmr AND n > 5 AND rank <= 15), {mmr_sql('pool')},
ht AS (SELECT config, q, doc_id, CASE WHEN rerank THEN coalesce(new, rank) WHEN mmr AND n > 5 THEN step ELSE rank END AS rank FROM fu LEFT JOIN re USING (config, q, doc_id) LEFT JOIN mm ON mm.query_id = fu.q AND mm.doc_id = fu.doc_id),
pe AS (SELECT config, q, count(*) AS n, count(gd.doc_id) AS h, min(CASE WHEN gd.doc_id IS NOT NULL THEN rank END) AS first_rank, sum(CASE WHEN gd.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg FROM ht LEFT JOIN gd ON gd.query_id = ht.q AND gd.doc_id = ht.doc_id WHERE rank <= 5 GROUP BY config, q),
ng AS (SELECT query_id, count(*) AS ng FROM gd GROUP BY query_id),
me AS MATERIALIZED (SELECT variant, cf.config, position, coalesce(h, 0) / CAST(least(ng, 5) AS DOUBLE) AS recall, CASE WHEN n > 0 THEN h / CAST(n AS DOUBLE) ELSE 0.0 END AS precision, coalesce(1.0 / first_rank, 0.0) AS rr,
  coalesce(dcg, 0) / list_sum(list_transform(range(1, least(ng, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM cf CROSS JOIN qs JOIN ng ON ng.query_id = qs.query_id LEFT JOIN pe ON pe.config = cf.config AND pe.q = qs.query_id)"""


_SWEPT = _sweep_sql()


@query(f"""WITH {_SWEPT}, nu AS (SELECT *, row_number() OVER (PARTITION BY variant, config ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY variant, config) AS n FROM me),
mn AS (SELECT s.variant, s.config, b, round(avg(ndcg), 12) AS m FROM (SELECT DISTINCT variant, config, n FROM nu) s, range({RESAMPLES}) x(b), range((SELECT max(n) FROM nu)) y(j), nu WHERE j < s.n AND nu.variant = s.variant AND nu.config = s.config AND nu.i = {_DRAW.format("concat_ws(':', '20260801', b, j)")} % s.n GROUP BY ALL)
SELECT variant, config, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(any_value(lo), 6) AS ndcg_lower, round(any_value(hi), 6) AS ndcg_upper FROM me JOIN (SELECT variant, config, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY variant, config) USING (variant, config) GROUP BY variant, config""")
def sweep_metrics(spark, d):
    rows = _sweep(spark, d).summary()
    return rows.select("variant", "config", "n", *[six(c).alias(c) for c in ("recall", "precision", "rr", "ndcg", "hit_rate", "ndcg_lower", "ndcg_upper")])


def _tests_sql(pairs: str, by: str, resamples: int = RESAMPLES) -> str:
    """te: (by..., mean, other, diff, p, d, n) of the pairs (by..., i, a, b)."""
    return f"""pr AS MATERIALIZED ({pairs}), ob AS (SELECT {by}, avg(a) AS mean, avg(b) AS other, avg(a - b) AS diff, max(abs(a - b)) AS most, stddev_samp(a - b) AS sd, count(*) AS n FROM pr GROUP BY {by}),
fl AS (SELECT {by}, r, avg((a - b) * (1 - 2 * ({_DRAW.format("concat_ws(':', '20260801', r, i)")} % 2))) AS m FROM pr, range({resamples}) x(r) GROUP BY {by}, r),
te AS (SELECT {by}, mean, other, diff, CASE WHEN most <= 1e-8 THEN 1.0 ELSE (extreme + 1) / {resamples + 1}e0 END AS p, CASE WHEN coalesce(sd, 0) > 0 THEN diff / sd ELSE 0e0 END AS d, n FROM ob JOIN (
  SELECT {by}, count(*) FILTER (round(abs(m), 12) >= round(abs(diff), 12)) AS extreme FROM fl JOIN ob USING ({by}) GROUP BY {by}) USING ({by}))"""


_HOLM = "min(CASE WHEN p <= 0.05e0 / (m - r + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY {0} ORDER BY r) = 1 AS reject FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY p, config) AS r, count(*) OVER (PARTITION BY {0}) AS m FROM te)"


@query(f"""WITH {_SWEPT}, {_tests_sql("SELECT x.variant, x.config, x.position AS i, x.ndcg AS a, y.ndcg AS b FROM me x JOIN me y USING (variant, position) WHERE y.config = 'baseline-dense' AND x.config <> y.config", "variant, config", FLIPS)}
SELECT variant, config, round(mean, 6) AS mean, round(other, 6) AS baseline, round(diff, 6) AS diff, round(p, 6) AS p, round(d, 6) AS d, n, reject, CASE WHEN reject THEN 'significant' WHEN p < 0.05 THEN 'lost to the correction' ELSE 'not significant' END AS verdict
FROM (SELECT *, {_HOLM.format('variant')})""")
def sweep_comparisons(spark, d):
    rows = _sweep(spark, d, FLIPS).comparisons()
    return rows.select("variant", "config", *[six(c).alias(c) for c in ("mean", "baseline", "diff", "p", "d")], "n", "reject", "verdict")


@query(f"""WITH {_SWEPT}, {_tests_sql("SELECT y.config, y.position AS i, y.ndcg AS a, x.ndcg AS b FROM me x JOIN me y USING (config, position) WHERE x.variant = 'generated' AND y.variant = 'paraphrased'", "config", FLIPS)}
SELECT config, round(other, 6) AS mean_first, round(mean, 6) AS mean_second, round(diff, 6) AS diff, round(p, 6) AS p, reject, CASE WHEN reject THEN CASE WHEN diff < 0 THEN 'significant drop' ELSE 'significant gain' END WHEN p < 0.05 THEN 'lost to the correction' ELSE 'not significant' END AS verdict
FROM (SELECT *, {_HOLM.format('1')})""")
def wording_gap(spark, d):
    rows = _sweep(spark, d, FLIPS).wording_gap()
    return rows.select("config", *[six(c).alias(c) for c in ("mean_first", "mean_second", "diff", "p")], "reject", "verdict")


@query(f"""WITH {_SWEPT}, {_tests_sql("SELECT x.variant, x.config, y.config AS other_config, x.position AS i, x.ndcg AS a, y.ndcg AS b FROM me x JOIN me y USING (variant, position) WHERE (x.config, y.config) IN (('lexical-only', 'lexical-nostem'), ('rrf', 'baseline-dense'), ('weighted-rerank', 'weighted-0.5'))", "variant, config, other_config")}
SELECT variant, config, other_config AS other, round(mean, 6) AS mean, round(other, 6) AS other_mean, round(diff, 6) AS diff, round(p, 6) AS p, round(d, 6) AS d, n FROM te""")
def planned_comparisons(spark, d):
    rows = _sweep(spark, d).planned()
    return rows.select("variant", "config", "other", *[six(c).alias(c) for c in ("mean", "other_mean", "diff", "p", "d")], "n")


@query("""WITH q AS (SELECT count(*) AS n FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)))
SELECT variant, n, effect, d, CAST(needed AS BIGINT) AS needed, n >= needed AS sufficient FROM q, (VALUES ('generated'), ('paraphrased')) v(variant), (VALUES ('small', 0.2e0, 197), ('medium', 0.5e0, 32), ('large', 0.8e0, 13)) e(effect, d, needed) WHERE n > 0""")
def sweep_power(spark, d):
    return _sweep(spark, d).power()


# -- end to end ---------------------------------------------------------------------------------------------------
def _end_to_end(spark, d):
    from .end_to_end import evaluate

    engine, asked = _engine(spark, d, threshold=20.0)
    gold = _gold(spark, d)
    known = asked.join(gold.select("query_id").distinct().withColumn("answerable", F.lit(True)), "query_id", "left").fillna(False, ["answerable"])
    return evaluate(engine, known, gold)


# The offline generator cites the first passage.
_ENDED = f"""{_METRICS}, en AS (SELECT item_id AS query_id, ng IS NOT NULL AS answerable, coalesce(score, 0) < 20 AS abstained, gold.doc_id IS NOT NULL AS right_first, me.* EXCLUDE (query_id) FROM benchmark
  JOIN me ON me.query_id = item_id LEFT JOIN ng ON ng.query_id = item_id LEFT JOIN lex ON lex.query_id = item_id AND rank = 1 LEFT JOIN gold ON gold.query_id = item_id AND gold.doc_id = lex.doc_id)"""


@query(f"""WITH {_ENDED} SELECT query_id, answerable, abstained, abstained <> answerable AS abstention_correct, NOT abstained AS has_citations, false AS has_invalid, CASE WHEN NOT abstained AND right_first THEN 1e0 ELSE 0e0 END AS citation_precision,
  CASE WHEN answerable THEN round(recall, 6) END AS recall, CASE WHEN answerable THEN round(rr, 6) END AS rr, CASE WHEN answerable THEN round(ndcg, 6) END AS ndcg FROM en""")
def end_to_end(spark, d):
    rows = _end_to_end(spark, d)
    return rows.select("query_id", "answerable", "abstained", "abstention_correct", "has_citations", "has_invalid", *[six(c).alias(c) for c in ("citation_precision", "recall", "rr", "ndcg")])


@query(f"""WITH {_ENDED}, nu AS (SELECT ndcg, row_number() OVER (ORDER BY query_id) - 1 AS i FROM en WHERE answerable), dr AS (SELECT b, avg(ndcg) AS m FROM range({RESAMPLES}) x(b), range((SELECT count(*) FROM nu)) y(j), nu WHERE i = {_DRAW.format("concat_ws(':', '20260801', b, j)")} % (SELECT count(*) FROM nu) GROUP BY b)
SELECT count(*) AS n, count(*) FILTER (answerable) AS n_answerable, round(avg(CASE WHEN abstained <> answerable THEN 1.0 ELSE 0 END), 6) AS abstention_accuracy, round(avg(CASE WHEN abstained THEN 0 ELSE 1.0 END), 6) AS citation_rate,
  round(avg(CASE WHEN abstained THEN 1.0 ELSE 0 END) FILTER (NOT answerable), 6) AS refusal_recall, round(avg(CASE WHEN abstained THEN 0 ELSE 1.0 END) FILTER (answerable), 6) AS answer_rate,
  round(avg(CASE WHEN NOT abstained AND right_first THEN 1.0 ELSE 0.0 END) FILTER (answerable), 6) AS citation_precision, round(avg(recall) FILTER (answerable), 6) AS recall, round(avg(ndcg) FILTER (answerable), 6) AS ndcg,
  (SELECT round(quantile_cont(m, 0.025), 6) FROM dr) AS ndcg_lower, (SELECT round(quantile_cont(m, 0.975), 6) FROM dr) AS ndcg_upper FROM en""")
def end_to_end_summary(spark, d):
    from .end_to_end import summarize

    row = summarize(_end_to_end(spark, d), RESAMPLES)
    return row.select("n", "n_answerable", *[six(c).alias(c) for c in ("abstention_accuracy", "citation_rate", "refusal_recall", "answer_rate", "citation_precision", "recall", "ndcg", "ndcg_lower", "ndcg_upper")])

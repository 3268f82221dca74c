"""Text functions: Turkish casing, folding, stemming, tokens, cleaning, language, citations."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the folded alphabet: inflectional suffixes, the longest first.
SUFFIXES = [
    "larindan", "lerinden", "lariyla", "leriyle", "larimiz", "lerimiz",
    "lardan", "lerden", "siniz", "sunuz",
    "larin", "lerin", "lara", "lere", "lari", "leri",
    "imiz", "iniz", "ndan", "nden",
    "lar", "ler", "dan", "den", "tan", "ten", "nin", "nun",
    "lik", "luk", "cik", "cuk",
    "in", "un", "im", "um", "si", "su", "ya", "ye",
    "da", "de", "ta", "te", "na", "ne", "yi", "yu", "ci", "cu", "li", "lu",
    "i", "u", "e", "a",
]
# Characters and words that mark a language.
TURKISH_CHARACTERS = "ğışĞİŞ"
TURKISH_SHARE = 0.004
TURKISH_WORDS = ["ve", "bir", "için", "ile", "bu", "olarak", "veya", "da", "de", "en"]
ENGLISH_WORDS = ["the", "and", "for", "with", "this", "that", "are", "from", "which"]
# Phrases of copied instructions, the two refusals, and phrases of a refusal.
LEAK_MARKERS = ["yalnızca bağlamdaki", "kendi bilgini ekleme", "kurallar:", "use only information", "do not add outside", "rules:", "biçiminde belirt", "cite the source"]
REFUSAL_TEXT = {"tr": "Bu bilgi verilen belgelerde bulunmuyor.", "en": "This information is not present in the provided documents."}
REFUSALS = ["bulunmuyor", "belgelerde yok", "bilgi yok", "mevcut değil", "not present", "not contain", "cannot answer", "yanıtlayamıyorum"]
SUFFIX_PATTERN = f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$"
TURNED_PATTERN = f"^(?:{'|'.join(x[::-1] for x in SUFFIXES)})(?=.{{4}})"
WORD_CHARACTERS = r"[\p{L}\p{N}_’']+"


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Characters that fold to one ASCII letter or digit with what they fold to, then combining marks, which go."""
    source, target, gone = [], [], []
    for point in range(0x80, 0x30000):
        c = chr(point)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        folded = "".join(x for x in unicodedata.normalize("NFD", {"İ": "i", "I": "ı"}.get(c, c).lower()) if not unicodedata.combining(x)).replace("ı", "i")
        if len(folded) == 1 and folded.isascii() and folded.isalnum() and folded != c:
            source.append(c)
            target.append(folded)
    return "".join(source + gone), "".join(target)


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def turkish_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def fold(c: Column) -> Column:
    """Lower case without diacritics; ASCII texts skip the character table."""
    source, target = fold_map()
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.lower(F.translate(c, source, target))).otherwise(F.lower(c))


def stem(word: Column) -> Column:
    """At most two suffixes off a folded word, leaving four letters at least.

    The word is turned round, so that a suffix either matches at once or not at all.
    """
    for_two = F.regexp_replace(F.regexp_replace(F.reverse(word), TURNED_PATTERN, ""), TURNED_PATTERN, "")
    return F.reverse(for_two)


def lexical_tokens(c: Column, stemmed: bool = True, truncate: int | None = None) -> Column:
    """The tokens of the lexical index; null gives none."""
    tokens = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    if not stemmed and not truncate:
        return tokens

    def one(w: Column) -> Column:
        w = stem(w) if stemmed else w
        return F.substring(w, 1, truncate) if truncate else w

    return F.transform(tokens, one)


def clean_text(c: Column) -> Column:
    """Hyphen breaks, line ends, runs of spaces and of newlines, and margins; the text must be NFC already."""
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \\t\\u00A0\\u2000-\\u200B]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def detect_language(c: Column) -> Column:
    """tr, en or unknown, by Turkish characters and then by marker words of the first 2000 characters."""
    sample = F.substring(c, 1, 2000)
    special = F.length(sample) - F.length(F.translate(sample, TURKISH_CHARACTERS, ""))
    words = F.array_distinct(F.regexp_extract_all(turkish_lower(sample), F.lit(WORD_CHARACTERS), F.lit(0)))
    tr = F.size(F.array_intersect(words, F.array(*map(F.lit, TURKISH_WORDS))))
    en = F.size(F.array_intersect(words, F.array(*map(F.lit, ENGLISH_WORDS))))
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank, "unknown").when(special / F.length(sample) > F.lit(TURKISH_SHARE), "tr").when(tr > en, "tr").when(en > tr, "en").otherwise("unknown")


def strip_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\[page:\d+\]\]\s*", "")


def page_number(c: Column) -> Column:
    found = F.regexp_extract(c, r"\[\[page:(\d+)\]\]", 1)
    return F.when(found != "", found.cast("long"))


def citations(c: Column) -> Column:
    """Distinct [n] marks in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("long")))


def is_refusal(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda m: F.contains(low, m))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, phrases)), lambda m: F.contains(low, F.lower(m)))


def leaked(c: Column) -> Column:
    """Whether a reply repeats its instructions."""
    return contains_any(c, LEAK_MARKERS)


def citation_label(source: Column, doc_id: Column, text: Column, heading: Column | None = None) -> Column:
    """Source (or document), heading and page of a passage, what is missing left out."""
    page = page_number(text)
    name = F.coalesce(F.nullif(source, F.lit("")), doc_id.cast("string"))
    parts = [name, *([F.nullif(heading, F.lit(""))] if heading is not None else []), F.when(page.isNotNull(), F.concat(F.lit("s."), page.cast("string")))]
    return F.concat_ws(" · ", *parts)


def read_text(window_text: Column, text: Column) -> Column:
    """What a reader gets: the window around a passage where there is one."""
    return F.coalesce(F.nullif(window_text, F.lit("")), text)


def with_instruction(question: Column, template: str, enabled: bool = True) -> Column:
    """A question inside the query template of an embedding model; {query} marks its place."""
    before, _, after = template.partition("{query}")
    return F.concat(F.lit(before), question, F.lit(after)) if enabled else question


def prompt_language(question: Column, configured: str = "auto") -> Column:
    """The configured language, else English for a question in English, else Turkish."""
    return F.lit(configured) if configured != "auto" else F.when(detect_language(question) == "en", "en").otherwise("tr")


def execution_provider(model_id: Column) -> Column:
    found = F.regexp_extract(F.split(model_id, ":")[0], "-(npu|gpu|cpu)$", 1)
    return F.when(found != "", found).otherwise("unknown")


def repair_count(before: Column, after: Column) -> Column:
    """Each repair joins two words, so the drop in their number is the number of repairs."""
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return count(before) - count(after)


def repetition(c: Column, n: int = 5) -> Column:
    """1 - distinct / all word n-grams; 0 for n words or fewer."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    count = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), count - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(count <= n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))


def parse_ordering(raw: Column, n: Column) -> Column:
    """Zero-based order of a listwise reply: its valid numbers first, then the missing ones."""
    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    named = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long") - 1)
    valid = F.array_distinct(F.filter(named, lambda x: (x >= 0) & (x < n)))
    return F.concat(valid, F.array_except(every, valid))


def clean_question(raw: Column) -> Column:
    """First line without list mark, quotes and a leading label."""
    line = F.trim(F.split(F.trim(raw), "\n")[0])
    line = F.regexp_replace(line, r"^(?:\d+[.)]|[-*•])\s*", "")
    line = F.regexp_replace(line, r"^[\"'“”]+|[\"'“”]+$", "")
    return F.trim(F.regexp_replace(line, r"(?i)^(?:soru|question)\s*:\s*", ""))


def is_usable_question(c: Column, referential: list[str]) -> Column:
    low = turkish_lower(c)
    return F.length(c).between(15, 250) & F.contains(c, F.lit("?")) & ~F.exists(F.array(*map(F.lit, referential)), lambda m: F.contains(low, m))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has."""
    a = F.array_distinct(a)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, F.array_distinct(b))) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / norm)

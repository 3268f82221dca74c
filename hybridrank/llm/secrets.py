"""Secret scans: candidate strings, and a random forest that removes the false positives.

A candidate is a run of at least LEAST_LENGTH characters of [A-Za-z0-9+/_-] with a digit or a known prefix, or any
of at least LEAST_KEYED after a word such as password and = or :. Its features
are length, shares of character classes, transitions between classes, distinct characters, coverage by
dictionary words, traces of a path or address, and words next to it. The forest is trained on findings that
`labelled_findings` makes and labels (keys, tokens and passwords in their usual places against ids, checksums,
numbers, paths, versions, placeholders and words), then written out as one SQL expression, so a scan is a
narrow projection: it shuffles nothing and reads each text once.

Defined edge cases: a null or empty text has no candidate; every candidate of a very long text is judged;
a string that occurs twice is found and redacted twice; repeated rows repeat their result; an empty table
gives an empty result; `redact` keeps all columns, and names that clash with its own scratch columns are safe.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_LENGTH = 12
#: After a word such as password and a sign of assignment, shorter values and values without a digit are candidates too.
LEAST_KEYED = 8
TREES, DEPTH, SEED = 24, 7, 11
#: Labelled findings that the forest is fitted on.
TRAINING_ROWS = 6000
MARK = "[SECRET]"
_RUN = rf"[A-Za-z0-9+/_\\-]{{{LEAST_KEYED},}}={{0,2}}"
_KEYED = r"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?[a-z_]{0,12}[\"]?[ ]*[=:]+[ ]*[\"]?"
_HAS = rf"(?<![A-Za-z0-9+/_\\-])(?=[A-Za-z+/_\\-]*[0-9])[A-Za-z0-9+/_\\-]{{{LEAST_LENGTH},}}|(?:AKIA|ASIA|gh[pousr]_|sk_|xox[bp]-|AIza|glpat-|npm_|hf_)[A-Za-z0-9_\\-]{{8,}}|(?i){_KEYED}[A-Za-z0-9+/_\\-]{{{LEAST_KEYED},}}"
_PREFIX = "AKIA|ASIA|gh[pousr]_|sk_|xox[bp]-|AIza|glpat-|npm_|hf_"
_KEYWORDS = r"(pass|pwd|secret|token|api|key|auth|credential|private|bearer|access|client)"
_HARMLESS = r"(example|sample|placeholder|dummy|uuid|guid|sha|md5|commit|checksum|digest|etag|isbn|phone|tel|order|invoice|card|version|build|file|path|id$|id[ =:\"]|ref|hash|revision)"
#: Words whose letters count as covered by the dictionary.
_DICTIONARY = r"(image|photo|video|file|index|page|article|report|version|release|build|module|package|config|system|service|server|client|public|static|assets|download|upload|content|document|table|figure|chapter|section|order|invoice|number|january|february|march|april|june|july|august|september|october|november|december|windows|linux|android|the|and|for|ing|tion|ment|with|from|user|name|date|time|test|data|home|work|news|blog|post|item|list|view|part|line|code|type|base|main|site|html|json|text|data|example|sample)"

_FEATURES = f"""array(
  cast(length(c.value) AS double),
  length(regexp_replace(c.value, '[^0-9]', '')) / cast(length(c.value) AS double),
  length(regexp_replace(c.value, '[^A-Z]', '')) / cast(length(c.value) AS double),
  length(regexp_replace(c.value, '[^a-z]', '')) / cast(length(c.value) AS double),
  (regexp_count(c.value, '[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+') - 1) / cast(length(c.value) - 1 AS double),
  size(array_distinct(split(c.value, ''))) / cast(length(c.value) AS double),
  1 - length(regexp_replace(lower(c.value), '{_DICTIONARY}', '')) / cast(length(c.value) AS double),
  cast(length(c.value) - length(replace(c.value, '/', '')) AS double),
  cast(length(c.value) - length(replace(replace(c.value, '-', ''), '_', '')) AS double),
  IF(c.word rlike '://|^www|^/|[.](html?|php|png|jpe?g|gif|pdf|zip|js|css)', 1d, 0d),
  IF(c.word rlike '@', 1d, 0d),
  IF(c.value rlike '^[0-9a-f]+$' OR c.value rlike '^[0-9A-F]+$', 1d, 0d),
  IF(c.value rlike '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-', 1d, 0d),
  IF(c.value rlike '^(AKIA|ASIA|gh[pousr]_|sk_|sk-|pk_|rk_|xox|AIza|eyJ|glpat-|npm_|hf_|SG)', 1d, 0d),
  IF(c.near rlike '{_KEYWORDS}', 1d, 0d),
  IF(c.near rlike '[=:]', 1d, 0d),
  IF(c.near rlike '{_HARMLESS}', 1d, 0d),
  IF(lower(c.value) rlike 'example|sample|placeholder|your|changeme|xxxx|0000|1234567|abcdef', 1d, 0d))"""

_CANDIDATES = rf"""IF(_text rlike '{_HAS}',
  filter(flatten(transform(filter(transform(_words, (w, i) -> named_struct('w', w, 'i', i)), x -> x.w rlike '{_RUN}'),
    x -> transform(regexp_extract_all(x.w, '{_RUN}', 0),
      v -> named_struct('value', v, 'word', x.w, 'place', x.i, 'near',
        lower(concat_ws(' ', IF(x.i > 1, get(_words, x.i - 2), ''), IF(x.i > 0, get(_words, x.i - 1), ''), substring_index(x.w, v, 1))))))),
    c -> (length(c.value) >= {LEAST_LENGTH} AND c.value rlike '[0-9]|^({_PREFIX})') OR c.near rlike '{_KEYED}$'),
  cast(array() AS array<struct<value:string,word:string,place:int,near:string>>))"""


def candidates(docs: DataFrame) -> DataFrame:
    """docs with _found: an array of (value, word, place, near, features)."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", F.expr(r"split(_text, '[\\x20\\x09-\\x0D]+')"))
    out = out.withColumn("_candidates", F.expr(_CANDIDATES)).drop("_words")
    return out.withColumn("_found", F.expr(f"transform(_candidates, c -> named_struct('value', c.value, 'word', c.word, 'place', c.place, 'near', c.near, 'features', {_FEATURES}))")).drop("_candidates")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """(text, label): sentences that hold one finding each, made from hashes of their numbers."""
    h = f"sha2(concat('{seed}:', id), 256)"
    more = f"sha2(concat('{seed}+', id), 256)"
    b64 = f"translate(base64(unhex(concat({h}, {more}))), '+/=', 'aZ9')"
    upper = f"translate(upper(substr(base64(unhex({more})), 1, 40)), '+/=01', 'QXK27')"
    digits = f"translate({h}, 'abcdef', '493817')"
    word = f"element_at(array('the', 'value', 'of', 'is', 'uses', 'with', 'and', 'from', 'by', 'set'), cast(conv(substr({more}, 60, 2), 16, 10) AS int) % 10 + 1)"
    name = f"element_at(array('password', 'token', 'secret', 'api_key', 'auth', 'access_key', 'pwd', 'client_secret'), cast(conv(substr({more}, 50, 2), 16, 10) AS int) % 8 + 1)"
    assign = f"element_at(array('=', ' = \"', ': ', '=\"', ' = ', ':'), cast(conv(substr({more}, 52, 2), 16, 10) AS int) % 6 + 1)"
    size = f"(16 + cast(conv(substr({more}, 54, 2), 16, 10) AS int) % 26)"
    harmless = f"element_at(array('commit', 'sha', 'checksum', 'md5', 'digest', 'revision', 'etag', 'uuid'), cast(conv(substr({more}, 50, 2), 16, 10) AS int) % 8 + 1)"
    noun = f"element_at(array('article', 'report', 'image', 'photo', 'release', 'download', 'document', 'static'), cast(conv(substr({more}, 48, 2), 16, 10) AS int) % 8 + 1)"
    kinds = [
        (1, f"concat('AKIA', substr({upper}, 1, 16))"),
        (1, f"concat('ghp_', substr({b64}, 1, 36))"),
        (1, f"concat({name}, {assign}, substr({h}, 1, {size}))"),
        (1, f"concat({name}, {assign}, substr({b64}, 1, {size}))"),
        (1, f"concat('sk_live_', substr({b64}, 1, 24))"),
        (1, f"concat({name}, {assign}, substr({h}, 1, 18))"),
        (1, f"concat({name}, {assign}, substr({h}, 1, 40))"),
        (1, f"concat('Bearer eyJ', substr({b64}, 1, 50))"),
        (1, f"concat({name}, {assign}, translate(substr({h}, 1, {size}), '0123456789', 'ghkmnpqrtw'))"),
        (1, f"concat({name}, {assign}, substr({b64}, 1, 9))"),
        (0, f"concat({harmless}, {assign}, substr({h}, 1, {size}))"),
        (0, f"concat({word}, ' id=', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"),
        (0, f"substr({digits}, 1, {size})"),
        (0, f"substr({digits}, 1, 16)"),
        (0, f"concat('https://www.site.example/', {noun}, '/', substr({digits}, 1, 4), '/', {noun}, '-', substr({digits}, 5, 6), '.html')"),
        (0, f"concat('/usr/', {noun}, '/', {noun}, '_', substr({digits}, 1, 4), '_', {word})"),
        (0, f"concat({noun}, '-', {noun}, '-', substr({digits}, 1, 4), '-', {word})"),
        (0, f"concat({name}, {assign}, 'your_', {name}, '_here_123')"),
        (0, f"concat({name}, {assign}, 'xxxxxxxxxxxx', substr({digits}, 1, 2))"),
        (0, f"concat('AKIA', 'EXAMPLE', substr({digits}, 1, 9))"),
        (0, f"concat('order ', upper({noun}), substr({digits}, 1, {size} div 2))"),
        (0, f"concat({word}, {noun}, {noun}, substr({digits}, 1, 2), {word})"),
        (0, f"concat('2024-', substr({digits}, 1, 2), '-', substr({digits}, 3, 2), 'T', substr({digits}, 5, 6))"),
        (0, f"concat('tel:+', substr({digits}, 1, 13))"),
        (0, f"concat({name}, {assign}, {noun}, {word})"),
        (0, f"concat({name}, ' ', {word}, ': ', {noun}, '_', {name})"),
    ]
    cases = " ".join(f"WHEN {k} THEN named_struct('label', {float(label)}d, 'finding', {text})" for k, (label, text) in enumerate(kinds))
    made = spark.range(rows).select(F.expr(f"CASE id % {len(kinds)} {cases} END").alias("made"), F.expr(word).alias("before"), F.expr(f"reverse({word})").alias("after"))
    return made.select(F.concat_ws(" ", "before", F.col("made.finding"), "after").alias("text"), F.col("made.label").alias("label"))


def forest_sql(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> str:
    """The share of trees that vote for a secret, as SQL over the features of a struct c."""
    found = candidates(labelled_findings(spark, rows, seed)).select("label", F.inline("_found")).select("label", array_to_vector("features").alias("features"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(found)
    return f"(({' + '.join(_tree(t.toDebugString) for t in model.trees)}) / {float(TREES)}d)"


def _tree(text: str) -> str:
    lines = iter(x.strip() for x in text.splitlines()[1:] if x.strip())

    def node() -> str:
        line = next(lines)
        if m := re.match(r"Predict: ([-\d.Ee]+)", line):
            return f"{float(m[1])}d"
        m = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", line)
        yes = node()
        next(lines)  # the Else line says the opposite
        return f"CASE WHEN c.features[{m[1]}] <= {float(m[2])!r}d THEN {yes} ELSE {node()} END"

    return node()


_forests: dict[tuple, str] = {}


def scan(docs: DataFrame) -> DataFrame:
    """docs with _candidates (their number), _secrets (values judged real) and _redacted (the text without them)."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, TRAINING_ROWS, SEED)
    if key not in _forests:
        _forests[key] = forest_sql(spark)
    found = candidates(docs).withColumn("_secrets", F.expr(f"transform(filter(_found, c -> {_forests[key]} > 0.5d), c -> c.value)"))
    longest_first = "array_sort(array_distinct(_secrets), (a, b) -> IF(length(a) <> length(b), length(b) - length(a), IF(a < b, -1, IF(a > b, 1, 0))))"
    redacted = f"IF(size(_secrets) = 0, text, aggregate({longest_first}, _text, (t, s) -> replace(t, s, '{MARK}')))"
    return found.withColumn("_candidates", F.size("_found").cast("long")).withColumn("_redacted", F.expr(redacted)).drop("_found", "_text")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the confirmed secrets in text replaced by MARK; n_chars, where there is one, follows."""
    names = docs.columns
    safe = scan(docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"keep_{i}") for i, c in enumerate(names)]))
    value = {"text": F.col("_redacted"), "n_chars": F.length("_redacted").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return safe.select(*[(value[c] if c in value else F.col(f"keep_{i}")).alias(c) for i, c in enumerate(names)])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_candidates").alias("n_candidates"), F.size("_secrets").cast("long").alias("n_secrets"), "_secrets", "_redacted").select(
        "doc_id", "n_candidates", "n_secrets", F.transform("_secrets", lambda s: F.sha2(s, 256)).alias("secret_sha256"), F.sha2(F.coalesce("_redacted", F.lit("")), 256).alias("redacted_sha256")
    )

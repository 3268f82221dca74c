"""Language identification by bit-sliced Bloom filters of character trigrams.

Training counts trigrams of letters per language over all labelled rows; a language's filter takes those
trigrams whose relative frequency there is at least LEAST_SHARE and at least LEAST_RATIO of the highest of
any language. All filters share one table: a slot is a bit mask of languages, so one lookup (the AND of
the slots that HASHES hash functions pick) returns all languages that contain a trigram. A text's score
for a language is the popcount of its bit over all trigrams, corrected for the filter's false positives.

Defined edge cases: a null text or one without a letter is `und` with score 0, and so is everything if no
labelled text has a letter; ties go to the language that is first by code point; very long texts are read
whole, in blocks; repeated rows repeat their result; an empty table gives an empty result; a document whose
doc_id is null is trained on; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, table
from .ngrams import codes, count_grams, gathered, letter_alphabet, symbols

BITS, ORDER = 6, 3
SIZE = 1 << (BITS * ORDER)
SLOTS = 1 << 18
HASHES = 3
LEAST_SHARE = 2e-5
LEAST_RATIO = 0.2


class Filters:
    """A slot holds one bit for each language, in words of 64."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts, key=lambda x: x.encode())
        share = np.zeros((len(self.languages), SIZE))
        for k, name in enumerate(self.languages):
            grams, n = counts[name]
            share[k, grams] = n / n.sum()
        top = share.max(axis=0) if self.languages else None
        self.slots = np.zeros((SLOTS, (len(self.languages) + 63) // 64), dtype=np.uint64)
        self.false = np.zeros(len(self.languages))
        for k in range(len(self.languages)):
            own = np.flatnonzero((share[k] >= LEAST_SHARE) & (share[k] >= LEAST_RATIO * top))
            bit = np.uint64(1 << (k % 64))
            for at in self._at(own):
                self.slots[at, k // 64] |= bit
            self.false[k] = ((self.slots[:, k // 64] & bit) != 0).mean() ** HASHES

    @staticmethod
    def _at(grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64) + np.uint64(0x51ED270B))
        return [((h >> np.uint64(18 * j)) % np.uint64(SLOTS)).astype(np.int64) for j in range(HASHES)]

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = self._at(grams)
        return self.slots[a] & self.slots[b] & self.slots[c]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return pred, score
        seq, owner = symbols(texts, letter_alphabet())
        grams, at = codes(seq, ORDER, BITS)
        keep = grams != 0
        grams, own = grams[keep], owner[at[keep]]
        total = np.bincount(own, minlength=len(texts))
        lettered = np.bincount(owner[(seq != 0) & (seq != 63)], minlength=len(texts)) > 0
        unique, where = np.unique(grams, return_inverse=True)
        masks = self.languages_of(unique)
        part = np.empty((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            has = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            share = np.bincount(own, weights=has.astype(np.float64)[where], minlength=len(texts)) / np.maximum(total, 1)
            part[k] = np.maximum(0.0, (share - self.false[k]) / max(1e-9, 1 - self.false[k]))
        best = part.argmax(axis=0)
        for i in np.flatnonzero(lettered):
            pred[i], score[i] = self.languages[best[i]], min(1.0, float(part[best[i], i]))
        return pred, score


def train(labelled: DataFrame) -> Filters:
    """Filters of the rows (text, lang) that have a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        for b in blocks(batches):
            seq, owner = symbols(b.column("text").to_pylist(), letter_alphabet())
            grams, at = codes(seq, ORDER, BITS)
            grams, own = grams[grams != 0], owner[at[grams != 0]]
            langs = b.column("lang").dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False)
            of = number[own] if len(own) else own
            for k, name in enumerate(langs.dictionary.to_pylist()):
                if len(mine := grams[of == k]):
                    yield name, mine

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    return Filters(gathered(count_grams(rows, SIZE, count)))


def held_out(column: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            pred, score = shared.value.predict(b.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, filters, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

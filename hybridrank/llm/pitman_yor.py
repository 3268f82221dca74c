"""Hierarchical Pitman-Yor language model of words, its seating sampled by Gibbs.

The root restaurant serves all words over a uniform base of V + 1 dishes, one of them for all unknown words.
Every word of the training texts, and the beginning of a text, is a context with a restaurant of its own, and
all of these share the root as parent. There is no level above one word of history.

Texts are packed. Each pack asks once for each distinct (context, word) pair, dealt by the hash of both, and
the first pack that holds a pair in training learns its count; packs then ask for their distinct words, with
the pairs they were first for. A pair with one customer has one table for good, so only pairs of two or more
are seated, and so are the words found twice or more.

Bucket b of the sampler has the pairs of one share of hashes and the root's words of another. A sweep is two
exchanges of compressed blobs: pairs send what tables they have added by word and by context, and the root
samples its tables and answers with the customers, tables and totals that each pair needs. A table count is
drawn from its conditional given all others as they last stood, with the pair's own tables taken out of the
restaurant and of the root: generalised Stirling numbers times the parent's predictive probability, for any
number of customers. No sweep passes the driver, and shuffle
files are all that is kept between them. The last SAMPLES sweeps are averaged and sent back to the packs,
which add the logarithms up by text.

Defined edge cases: a null or blank text is its end token alone; with no training text every word is unknown
and V is 0; very long texts make one large pack; a null doc_id trains, as its remainder is not HELD_OUT's; rows
that repeat a doc_id count and are scored each; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, mix, release, span_hash, table, words
from .packs import by_bucket, dealt, edges, packed, text_buckets, unpack, unzipped, zipped

#: Contexts of the in-memory _Bucket; the query has no such bound.
HEADS = 255
BURN_IN, SAMPLES = 1, 2
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
#: Up to so many customers a table of Stirling numbers is kept; beyond, they come from a sum of TERMS terms at most.
EXACT, TERMS = 1024, 400
SEED = 29
END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0x0F1E2D3C4B5A6978)


def is_held_out(ids: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 7, is 2."""
    return np.array([not gone and zlib.crc32(str(i).encode()) % 7 == 2 for i, gone in zip(ids.tolist(), is_null.tolist())], dtype=bool)


def _tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every token, each text's end included."""
    low = lower_ascii(data)
    starts, ends, doc = words(low, offsets)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, dtype=np.uint64)
    out[np.arange(len(starts)) + doc] = span_hash(low, starts, ends)
    owner = np.empty(len(out), dtype=np.int64)
    count = np.bincount(doc, minlength=n) + 1
    return out, np.repeat(np.arange(n), count) if n else owner


def _pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of 56 bits, in the upper bytes."""
    return mix(mix(context ^ np.uint64(0x5851F42D4C957F2D)) + word) & ~np.uint64(0xFF)


def _packed_hashes(sorted_: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes byte by byte, all first bytes first: the upper and the empty bytes cost nothing once zipped."""
    return np.ascontiguousarray(np.diff(sorted_, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).reshape(-1).view(np.uint64)


def _unpacked_hashes(packed_: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(packed_.view(np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


class _Pack:
    """Distinct words of a pack in order of hash, contexts among them, with training counts."""

    def __init__(self, blob: bytes) -> None:
        self.ids, self.is_null, offsets, data = unpack(blob)
        tokens, self.owner = _tokens(offsets, data)
        self.held_out = is_held_out(self.ids, self.is_null)
        self.words, at = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        self.word, begin = at[:-1], at[-1]
        context = np.full(len(tokens), begin)
        context[1:] = np.where(self.owner[1:] == self.owner[:-1], self.word[:-1], begin)
        trained = ~self.held_out[self.owner]
        self.count = np.bincount(self.word[trained], minlength=len(self.words))
        # Distinct pairs in order of their hash.
        self.pair_value, self.pair = np.unique(_pair_hash(self.words[context], tokens), return_inverse=True)
        self.pair_count = np.bincount(self.pair[trained], minlength=len(self.pair_value))
        self.pair_word, self.pair_context = np.empty((2, len(self.pair_value)), dtype=np.int64)
        self.pair_word[self.pair], self.pair_context[self.pair] = self.word, context


_ROW = "pack long, bucket int, data binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([zipped(r[2]) for r in rows], pa.binary())], ["pack", "bucket", "data"])


def _parts(value: np.ndarray, buckets: int, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    """Each bucket's share of sorted hashes and of columns beside them."""
    cut_at = edges(value >> np.uint64(17), buckets)
    for i in np.flatnonzero(np.diff(cut_at)).tolist():
        own = slice(cut_at[i], cut_at[i + 1])
        yield i, _blob(_packed_hashes(value[own]), *[c[own] for c in columns])


def _blob(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], dtype=np.int64).tobytes() + b"".join(c.tobytes() for c in columns)


def _read(raw: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, dtype=np.int64, count=1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _joined(blobs: list[bytes], *kinds, hashed: bool = False) -> tuple[list[int], list[np.ndarray]]:
    """Lengths and joined columns of blobs; hashed: the first column is packed hashes."""
    parts = [_read(unzipped(x), *kinds) for x in blobs]
    if hashed:
        parts = [[_unpacked_hashes(p[0]), *p[1:]] for p in parts]
    return [len(p[0]) for p in parts], [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, dtype=kind) for k, kind in enumerate(kinds)]


def _ask_pairs(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, blob in zip(b.column("pack").to_pylist(), b.column("texts")):
                p = _Pack(blob.as_py())
                yield _sent([(pack, i, x) for i, x in _parts(p.pair_value, buckets, (p.pair_count.astype(np.int32),))])

    return run


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket a row (pack -1) with its counts, then for each pack where its pairs are among them, and the count of those it is first to train."""
    for bucket, held, blobs in by_bucket(batches, "data"):
        lengths, (value, own) = _joined(blobs, np.uint64, np.int32, hashed=True)
        unique, where = np.unique(value, return_inverse=True)
        count = np.bincount(where, weights=own, minlength=len(unique)).astype(np.int64)
        trained = np.flatnonzero(own)
        known, first = np.unique(where[trained], return_index=True)
        told = np.zeros(len(value), dtype=np.int64)
        told[trained[first]] = count[known]
        at = np.concatenate([[0], np.cumsum(lengths)])
        yield _sent([(-1, bucket, _blob(count))])
        for k, pack in enumerate(held):
            w = where[at[k] : at[k + 1]]
            yield _sent([(pack, bucket, _blob(np.diff(w, prepend=0).astype(np.int32), told[at[k] : at[k + 1]]))])


def _ask_words(buckets: int) -> Callable:
    """Words with their counts and the pairs the pack is first for, by context and by word; pairs of two or more customers under -1 less their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, blob, answers in zip(b.column("pack").to_pylist(), b.column("texts"), b.column("answers")):
                p = _Pack(blob.as_py())
                got = sorted(answers.as_py() or [], key=lambda x: x["bucket"])
                parts = [_read(unzipped(x["data"]), np.int32, np.int64) for x in got]
                if not parts:
                    continue
                of = np.repeat(np.array([x["bucket"] for x in got], dtype=np.int32), [len(q[0]) for q in parts])
                at, told = np.concatenate([np.cumsum(q[0], dtype=np.int64) for q in parts]), np.concatenate([q[1] for q in parts])
                n, first = len(p.words), np.flatnonzero(told)
                as_context, as_dish = (np.bincount(x[first], minlength=n) for x in (p.pair_context, p.pair_word))
                yield _sent([(pack, i, x) for i, x in _parts(p.words, buckets, (p.count, as_context, as_dish))])
                live = np.flatnonzero(told > 1)  # in order of bucket
                ends = np.flatnonzero(np.diff(of[live], append=-1)) + 1
                yield _sent([(pack, -1 - int(of[own[0]]), _blob(p.words[p.pair_context[own]], p.words[p.pair_word[own]], at[own], told[own])) for own in np.split(live, ends[:-1]) if len(own)])

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket a row (pack -1) with its words, then for each pack where its words are among them."""
    for bucket, held, blobs in by_bucket(batches, "data"):
        lengths, (value, *own) = _joined(blobs, np.uint64, np.int64, np.int64, np.int64, hashed=True)
        unique, where = np.unique(value, return_inverse=True)
        yield _sent([(-1, bucket, _blob(unique, *[np.bincount(where, weights=x, minlength=len(unique)).astype(np.int64) for x in own]))])
        at = np.concatenate([[0], np.cumsum(lengths)])
        for k, pack in enumerate(held):
            yield _sent([(pack, bucket, _blob(np.diff(where[at[k] : at[k + 1]], prepend=0).astype(np.int32)))])


def _facts(column: int) -> Callable:
    """Sum and numbers of counts above 0, of 1 and of 2 of each row with a bucket's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                count = _read(unzipped(x.as_py()), *[np.int64] * (column + 1))[column]
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum())], ["total", "some", "ones", "twos"])

    return run


def _counted(rows: DataFrame, column: int) -> tuple[int, int, int, int]:
    found = rows.mapInArrow(_facts(column), "total long, some long, ones long, twos long")
    return tuple(int(x or 0) for x in found.agg(*[F.sum(c) for c in found.columns]).first())


def root_probability(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, vocabulary: int, discount: float) -> np.ndarray:
    """Predictive probability of words in the root."""
    fresh = (ROOT_STRENGTH + discount * all_tables) / (vocabulary + 1)
    return (np.maximum(customers - discount * tables, 0.0) + fresh) / (ROOT_STRENGTH + all_customers)


@dataclass
class Shape:
    """What a _Bucket shares with others: customers and tables of each context, the root's tables last, and totals."""

    customers: np.ndarray
    tables: np.ndarray
    direct: int
    tokens: int
    vocabulary: int
    discount: float
    root_discount: float


class _Bucket:
    """Words with their counts and one table for each pair, in memory."""

    def __init__(self, bucket: int, raw: bytes, shape: Shape) -> None:
        n, m = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
        self.count, self.shape = np.frombuffer(raw, dtype=np.int64, count=n, offset=16 + 8 * n), shape
        pairs, own = np.frombuffer(raw, dtype=np.int64, count=2 * m, offset=16 + 16 * n).reshape(2, m)
        word = pairs // (HEADS + 1)
        self.customers = self.count + np.bincount(word, weights=np.minimum(own, 1) - own, minlength=n)

    def root(self, tables: np.ndarray) -> np.ndarray:
        s = self.shape
        return root_probability(self.customers, np.minimum(self.customers, 1), s.direct + tables[: HEADS + 1].sum(), tables[HEADS + 1], s.vocabulary, s.root_discount)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers of a discount, for c, t up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - t * discount, 0.0))
        out[c + 1] = stay
        out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def _log_factorials(most: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])


def _log_tilted(count: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Saddle point of log P(t sizes add up to count), for sizes with generating function 1 - (1 - z)**discount and t below count."""
    low, high = np.full(len(t), -700.0), np.zeros(len(t))
    for _ in range(80):  # the log of 1 - z, by halving
        mid = (low + high) / 2
        u = np.exp(mid)
        more = -np.expm1(mid) * discount * np.exp((discount - 1) * mid) / -np.expm1(discount * mid) > count / t
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    f, z = -np.expm1(discount * mid), -np.expm1(mid)
    first = z * discount * u ** (discount - 1) / f
    variance = first + z * z * discount * (1 - discount) * u ** (discount - 2) / f - first**2
    return t * np.log(f) - count * np.log(z) - 0.5 * np.log(2 * np.pi * t * variance)


def _log_few_more(count: int, t: np.ndarray, discount: float) -> np.ndarray:
    """The same where there are few more customers than tables: the power of a series, all of whose terms are positive."""
    most = int(count - t[0])
    k = np.arange(1, most + 1)
    share = np.cumprod((k - discount) / (k + 1))  # of tables of k + 1 customers, against those of one
    held = np.zeros((most + 1, len(t)))
    held[0] = 1.0
    for m in range(1, most + 1):
        held[m] = ((k[:m, None] * t - (m - k[:m, None])) * share[:m, None] * held[m - k[:m]]).sum(axis=0) / m
    return np.log(held[count - t, np.arange(len(t))]) + t * math.log(discount)


def log_ways(count: int, most: int, discount: float) -> np.ndarray:
    """log of S(count, t) * t! * discount**t / count! for t from 1 to most: the chance that t table sizes add up to count.

    The number of ways is an alternating sum whose terms fall off quickly while t is small against count**discount.
    Where its digits run out, at about three times that, a power of a series tells the rest if customers and
    tables are nearly as many, else the saddle point follows on from the last good value.
    """
    t = np.arange(1, most + 1)
    j = np.arange(1, min(TERMS, most) + 1)
    j = j[discount * j < count]
    fact = _log_factorials(most)
    shared = (_LGAMMA(1 + discount * j) + _LGAMMA(count - discount * j) - math.lgamma(count + 1) - math.log(math.pi)).astype(float) - fact[j]
    sign = np.sin(np.pi * discount * j) * np.where(j % 2 == 1, 1.0, -1.0)
    out = np.full(most, -np.inf)
    good = 0
    for s in range(0, most, 256):
        own = t[s : s + 256, None]
        few = 40 + int(8 * own[-1, 0] * count**-discount)
        for n in (few, len(j)):  # few terms are enough nearly always
            size = np.where(j[:n] <= own, fact[own] - fact[np.maximum(own - j[:n], 0)] + shared[:n], -np.inf)
            peak = size.max(axis=1, keepdims=True)
            terms = np.exp((size - peak).astype(np.longdouble)) * sign[:n]
            total = terms.sum(axis=1)
            # Terms that were left out, whatever the sign of the last one, or digits that were lost, end what the sum can tell.
            fine = (total > 1e-6) & ((np.exp(size[:, -1] - peak[:, 0]) < 1e-12 * total) | (own[:, 0] <= j[:n][-1]))
            if fine.all():
                break
        stop = len(fine) if fine.all() else int(np.argmin(fine))
        out[s : s + stop] = (np.log(total[:stop]) + peak[:stop, 0]).astype(float)
        good = s + stop
        if stop < len(fine):
            break
    last = max(good, 1)
    if good < most and count - last <= min(last, 256):
        out[last - 1 :] = _log_few_more(count, t[last - 1 :], discount)
    elif good < most:
        rest = t[last - 1 :]
        tilted = _log_tilted(count, np.minimum(rest, count - 1).astype(float), discount)
        out[last - 1 :] = tilted + (out[last - 1] - tilted[0] if good else 0.0)
        if most == count:
            out[-1] = count * math.log(discount)
    return out


def log_table_weights(count: int, others: float, parent: float, strength: float, discount: float) -> np.ndarray:
    """log of the unnormalised conditional of 1, 2, ... tables, up to where no weight is left."""
    before = (strength + discount * others) / discount
    # Without the ways, tables are negative binomial; these add at most about one, and only shorten the right side.
    mean = (before * parent + 1) / max(1 - parent, 1e-3)
    most = int(min(count, mean + 14 * math.sqrt(mean / max(1 - parent, 1e-3)) + 60))
    t = np.arange(1, most + 1)
    return np.cumsum(np.log(before + np.arange(most))) + t * math.log(parent) - _log_factorials(most)[1:] + log_ways(count, most, discount)


def sample_tables(count: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables that serve count customers of a dish, given the restaurant's other tables and the parent's probability.

    p(t) is proportional to S(c, t) * prod_{k < t} (strength + discount * (others + k)) * parent^t, for any count: up
    to what stirling holds the numbers are looked up, beyond they are summed for each dish.
    """
    most = len(stirling) - 1
    out = np.minimum(count, 1).astype(np.int64)
    several = np.flatnonzero((count > 1) & (count <= most))
    order = several[np.argsort(count[several], kind="stable")]
    values, begins = np.unique(count[order], return_index=True)
    for c, mine in zip(values.tolist(), np.split(order, begins[1:])):
        for s in range(0, len(mine), 1 + (1 << 20) // c):
            own = mine[s : s + 1 + (1 << 20) // c]
            steps = np.log(strength + discount * (others[own, None] + np.arange(c)[None, :])) + np.log(parent[own])[:, None]
            weight = stirling[c, 1 : c + 1][None, :] + np.cumsum(steps, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (rng.random(len(own))[:, None] * weight[:, -1:] > weight).sum(axis=1)
    for i in np.flatnonzero(count > most):
        weight = log_table_weights(int(count[i]), float(others[i]), float(parent[i]), strength, discount)
        weight = np.cumsum(np.exp(weight - weight.max()))
        out[i] = 1 + np.searchsorted(weight, rng.random() * weight[-1], side="left")
    return out


@dataclass
class Totals:
    vocabulary: int
    discount: float
    root_discount: float
    customers: float
    tables: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return root_probability(customers, tables, self.customers, self.tables, self.vocabulary, self.root_discount)


#: Kinds of rows of the sampler's buckets, in the order in which a bucket gets them.
ROOT, SEATS, PIECE, TABLES, REPLY = range(5)
_STATE = "bucket int, kind int, src long, data binary"


def _dump(*values) -> bytes:
    return zipped(pickle.dumps(values, protocol=5))


def _load(raw: bytes) -> tuple:
    return pickle.loads(unzipped(raw))


def _stated(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "kind", "src", "data"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """Each bucket's rows by kind; they follow one another, sorted by kind and source."""
    bucket, rows = None, {}
    for b in batches:
        for k, kind, src, x in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("src").to_pylist(), b.column("data")):
            if k != bucket and rows:
                yield bucket, rows
                rows = {}
            bucket = k
            rows.setdefault(kind, []).append((src, x.as_py()))
    if rows:
        yield bucket, rows


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root's rows: the words whose seating can change, all that are found twice or more, and the beginning."""
    for b in batches:
        for bucket, x in zip(b.column("bucket").to_pylist(), b.column("data")):
            word, count, as_context, as_dish = _read(unzipped(x.as_py()), np.uint64, np.int64, np.int64, np.int64)
            own = (count > 1) | (word == BEGIN)
            yield _stated([(bucket, ROOT, 0, _dump(word[own], as_context[own], as_dish[own], as_dish[own], np.minimum(as_dish[own], 1), as_context[own], [], {}))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _stated([(-1 - k, PIECE, pack, x.as_py()) for pack, k, x in zip(b.column("pack").to_pylist(), b.column("bucket").to_pylist(), b.column("data"))])


def _seated(pieces: list[bytes]) -> list:
    """Pairs in order of their place, which is kept as the distance from the one before, with one table each, and the distinct words that they name, in order of hash."""
    _, (context, word, at, n) = _joined(pieces, np.uint64, np.uint64, np.int64, np.int64)
    order = np.argsort(at)
    keys, where = np.unique(np.concatenate([context[order], word[order]]), return_inverse=True)
    where = where.astype(np.int32)
    return [keys, where[: len(at)], where[len(at) :], np.diff(at[order], prepend=0), n[order], np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.float32)]


def _seat(sweep: int, buckets: int, totals: Totals, once: int) -> Callable:
    """Takes the root's replies, samples the tables of pairs, and sends sums of those added; sweep -1 only begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = log_stirling(totals.discount)
        for bucket, rows in _grouped(batches):
            root = _load(rows[ROOT][0][1]) if ROOT in rows else None
            seats, now = _load(rows[SEATS][0][1]) if SEATS in rows else (_seated([x for _, x in rows.get(PIECE, [])]), totals)
            keys, of_context, of_word, at, n, t, own = seats
            if sweep >= 0:
                parts = [_load(x) for _, x in rows[REPLY]]  # in order of the root's buckets, as keys are
                customers, tables, here = (np.concatenate([p[k] for p in parts]) for k in range(3))
                now = replace(now, customers=once + sum(p[3] for p in parts), tables=once + sum(p[4] for p in parts))
                c, kept = customers[of_word] - t, np.minimum(tables[of_word], customers[of_word] - t)
                parent = root_probability(c, kept, now.customers - t, now.tables - (tables[of_word] - kept), now.vocabulary, now.root_discount)
                t = sample_tables(n, np.maximum(here[of_context] - t, 0), parent, STRENGTH, now.discount, stirling, np.random.default_rng([SEED, sweep, bucket]))
                if sweep >= BURN_IN:
                    own = own + (np.maximum(n - now.discount * t, 0.0) / SAMPLES).astype(np.float32)
                    if root:
                        root[6].append((now.root(root[3], root[4]).astype(np.float32), root[5].astype(np.float32)))
            size = int(max(of_context.max(initial=-1), of_word.max(initial=-1))) + 1
            # Words are named once; later on the root knows them by their order, and only their shares are kept here.
            cut_at = edges(keys >> np.uint64(17), buckets) if sweep < 0 else keys
            out = [(bucket, SEATS, 0, _dump([cut_at, of_context, of_word, at, n, t, own], now))]
            if root:
                out.append((bucket, ROOT, 0, _dump(*root)))
            dish, context = (np.bincount(x, weights=t - 1, minlength=size).astype(np.int64) for x in (of_word, of_context))
            for i in np.flatnonzero(np.diff(cut_at)).tolist():
                part = slice(cut_at[i], cut_at[i + 1])
                out.append((i, TABLES, bucket, _dump(_packed_hashes(keys[part]) if sweep < 0 else None, dish[part], context[part])))
            yield _stated(out)

    return run


def _sample_root(sweep: int, buckets: int, totals: Totals) -> Callable:
    """Adds up the tables of all pairs, samples those of the root and replies to every bucket."""
    base = 1.0 / (totals.vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = log_stirling(totals.root_discount)
        for bucket, rows in _grouped(batches):
            none = np.empty(0, dtype=np.int64)
            word, as_context, as_dish, _, tables, _, facts, places = _load(rows[ROOT][0][1]) if ROOT in rows else (none.astype(np.uint64), none, none, none, none, none, [], {})
            _, now = _load(rows[SEATS][0][1]) if SEATS in rows else (None, totals)
            customers, here, asked = as_dish.copy(), as_context.copy(), {}
            for src, x in rows.get(TABLES, []):
                keys, dish, context = _load(x)
                if keys is not None:
                    places[src] = np.diff(np.searchsorted(word, _unpacked_hashes(keys)), prepend=0).astype(np.int32)
                at = asked[src] = np.cumsum(places[src], dtype=np.int64)
                customers[at] += dish
                here[at] += context
            tables = sample_tables(customers, np.maximum(now.tables - tables, 0), np.full(len(word), base), ROOT_STRENGTH, now.root_discount, stirling, np.random.default_rng([SEED, sweep, bucket, 1]))
            out = [(bucket, ROOT, 0, _dump(word, as_context, as_dish, customers, tables, here, facts, places))]
            out += [(bucket, SEATS, 0, x) for _, x in rows.get(SEATS, [])]
            sums = int(customers.sum()), int(tables.sum())
            out += [(i, REPLY, bucket, _dump(*[x[asked.get(i, none)] for x in (customers, tables, here)], *sums)) for i in range(buckets)]
            yield _stated(out)

    return run


def _sampled(kind: int) -> Callable:
    """What the replies need of the last state, as rows of pack -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, x in zip(b.column("bucket").to_pylist(), b.column("data")):
                if kind == SEATS:
                    (_, _, _, at, _, _, own), _ = _load(x.as_py())
                    yield _sent([(-2, bucket, _blob(np.cumsum(at), own))])
                else:
                    word, *_, facts, _ = _load(x.as_py())
                    yield _sent([(-2, bucket, _blob(word, *[c for f in facts for c in f]))])

    return run


def _reply_pairs(discount: float) -> Callable:
    """For each pack and bucket, the averaged customers less discounts of its pairs, by the number -1 - bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held, blobs in by_bucket(batches, "data"):
            sampled = held.count(-2)
            if sampled == len(held):
                continue  # nothing was asked here
            _, (at, value) = _joined(blobs[:sampled], np.int64, np.float32)
            own = np.maximum(_read(unzipped(blobs[sampled]), np.int64)[0] - discount, 0.0).astype(np.float32)
            own[at] = value
            yield _sent([(pack, -1 - bucket, _blob(own[np.cumsum(_read(unzipped(x), np.int32)[0], dtype=np.int64)])) for pack, x in zip(held[sampled + 1 :], blobs[sampled + 1 :])])

    return run


def _reply_words(samples: list[Totals]) -> Callable:
    """For each pack and bucket, the counts of its words, and in each sample their root probability and their tables as contexts."""
    kinds = [np.uint64, *[np.float32] * (2 * len(samples))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held, blobs in by_bucket(batches, "data"):
            sampled = held.count(-2)
            if sampled == len(held):
                continue  # nothing was asked here
            _, (word, *drawn) = _joined(blobs[:sampled], *kinds)
            value, count, as_context, as_dish = _read(unzipped(blobs[sampled]), np.uint64, np.int64, np.int64, np.int64)
            at, facts = np.searchsorted(value, word), []
            for k, totals in enumerate(samples):  # words that were not sampled have one table in the root and one in each pair
                p, here = totals.root(as_dish, np.minimum(as_dish, 1)).astype(np.float32), as_context.astype(np.float32)
                p[at], here[at] = drawn[2 * k : 2 * k + 2]
                facts += [p, here]
            for pack, x in zip(held[sampled + 1 :], blobs[sampled + 1 :]):
                w = np.cumsum(_read(unzipped(x), np.int32)[0], dtype=np.int64)
                yield _sent([(pack, bucket, _blob(count[w], *[f[w] for f in facts]))])

    return run


def _score(tokens: int, vocabulary: int, discount: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, answers in zip(b.column("texts"), b.column("answers")):
                p = _Pack(blob.as_py())
                got = answers.as_py() or []
                of_words = [x["data"] for x in sorted((x for x in got if x["bucket"] >= 0), key=lambda x: x["bucket"])]
                of_pairs = [x["data"] for x in sorted((x for x in got if x["bucket"] < 0), key=lambda x: -x["bucket"])]
                _, (own,) = _joined(of_pairs, np.float32)
                _, (count, *facts) = _joined(of_words, np.int64, *[np.float32] * (2 * SAMPLES))
                # Every training text has one beginning and one end, and every other word is followed as often as it is found.
                customers = np.where(p.words == BEGIN, count[np.searchsorted(p.words, END)], count)
                c, w = p.pair_context, p.pair_word
                fresh = np.mean([(STRENGTH + discount * facts[2 * k + 1][c].astype(np.float64)) * facts[2 * k][w] for k in range(SAMPLES)], axis=0)
                logs = np.log10((own + fresh) / (STRENGTH + customers[c]))[p.pair]
                n, known = len(p.ids), count[p.word]
                base = np.log10((known + 1.0) / (tokens + 1.0 * (vocabulary + 1)))
                add = lambda x: np.bincount(p.owner, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.ids, mask=p.is_null.astype(bool)), pa.array(p.held_out), pa.array(np.bincount(p.owner, minlength=n)), pa.array(np.bincount(p.owner[known > 0], minlength=n)), pa.array(np.full(n, tokens)), pa.array(add(base)), pa.array(add(logs))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _answered(texts: DataFrame, answers: DataFrame) -> DataFrame:
    return texts.join(answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "data")).alias("answers")), "pack", "left").select("pack", "texts", "answers")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    texts = packed(docs)
    buckets = text_buckets(texts)
    pairs = cut(dealt(texts.mapInArrow(_ask_pairs(buckets), _ROW), buckets).mapInArrow(_merge_pairs, _ROW))
    release(spark)
    asked = cut(_answered(texts, pairs.where("pack >= 0")).mapInArrow(_ask_words(buckets), _ROW))
    release(spark)
    vocab = cut(dealt(asked.where("bucket >= 0"), buckets).mapInArrow(_merge_words, _ROW))
    all_pairs, all_words = _counted(pairs.where("pack = -1"), 0), _counted(vocab.where("pack = -1"), 1)
    discount, root_discount = (min(0.95, max(0.05, (x[2] + 1) / (x[2] + 2 * x[3] + 2))) for x in (all_pairs, all_words))
    tokens, vocabulary, once = all_words[:3]

    # Words found once stay at one customer and one table of the root; the others, and pairs found twice, are sampled.
    of_root = _counted(vocab.where("pack = -1"), 3)
    begun = Totals(vocabulary, discount, root_discount, float(of_root[0]), float(of_root[1]))
    by_state = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "src")
    state = vocab.where("pack = -1").mapInArrow(_beginnings, _STATE).unionAll(asked.where("bucket < 0").mapInArrow(_pieces, _STATE))
    state = cut(by_state(state).mapInArrow(_seat(-1, buckets, begun, once), _STATE))
    del asked
    release(spark)
    samples = []
    for sweep in range(BURN_IN + SAMPLES):
        state = by_state(state).mapInArrow(_sample_root(sweep, buckets, begun), _STATE)
        state = by_state(state).mapInArrow(_seat(sweep, buckets, begun, once), _STATE)
        state = cut(state)
        release(spark)
        if sweep >= BURN_IN:
            row = state.where(f"kind = {SEATS}").select("data").first()
            samples.append(_load(bytes(row["data"]))[1] if row else begun)
    last = {k: state.where(f"kind = {k}").mapInArrow(_sampled(k), _ROW) for k in (SEATS, ROOT)}
    of_pairs = dealt(pairs.unionAll(last[SEATS]), buckets).mapInArrow(_reply_pairs(discount), _ROW)
    of_words = dealt(vocab.unionAll(last[ROOT]), buckets).mapInArrow(_reply_words(samples), _ROW)
    answers = cut(of_pairs.unionAll(of_words))
    del pairs, vocab, state, last, of_pairs, of_words
    release(spark)
    return _answered(texts, answers).mapInArrow(_score(tokens, vocabulary, discount), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

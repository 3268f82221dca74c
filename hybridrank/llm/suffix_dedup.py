"""Removal of byte strings of at least LENGTH bytes that start in an earlier document too.

Each LENGTH-byte window belongs to its minimizer, the least hash among its K-byte substrings, so all equal
windows meet under one minimizer; a run of neighbouring windows with one minimizer travels as one segment.

1. Texts are packed, about PACK_BYTES to a row, into a table in the shared checkpoint folder.
2. Each pack asks, bucket by bucket, which of its minimizers occur in more than one document.
3. Segments of those, once for each distinct string of a pack and with their least doc_id, go to the bucket.
4. A bucket builds a Burrows-Wheeler transform of blocks of its distinct segments and expands intervals
   breadth-first by backward extension. Level n marks the places where neighbouring suffixes have a common
   prefix of n bytes, in increasing order; after level LENGTH - 1 it stops, and what no mark parts is one class
   of windows. The least doc_id of a class answers all its windows. Where a minimizer has one distinct
   segment, that is its only class already.
5. The answers go back to the packs, which cut the covered bytes out.

A pack sends a string once however often it holds it, so a passage that a third of all documents share
costs one entry a pack. Packs also tell about how many runs a minimizer has; where these come to HOT or more
in all, as when a common phrase stands in ever other surroundings, its runs are cut into single windows, and
each window is dealt to a bucket by its own hash. So no bucket gets more than HOT segments, by the packs'
rough counts, of one minimizer. Blocks of a transform hold whole minimizers; one whose segments exceed two
blocks is cut into single windows too, of which equal ones, by a 64-bit hash, are a class without a transform.

Defined edge cases: a null text is empty; texts shorter than LENGTH keep all bytes; strings never cross
texts; rows that repeat a doc_id don't count as earlier than one another; a null doc_id counts as later than
all; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _byte_table, _powers, cut, expand, mix, span_hash, table
from .packs import NO_ID, bucket_count, by_bucket, dealt, edges, packed, unpack, unzipped, zipped

LENGTH = 50
K = 24
STEP = 1 << 19
BLOCK = 1 << 18
#: Runs of a minimizer from which on it is dealt out window by window.
HOT = 1 << 14
#: Bits of a minimizer or window hash; the remaining ones of 48 say whether two documents of a pack have it, and how often.
BITS = 45
LEVELS = np.array([1, 4, 32, 256])
SLICE = 1 << 20


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer and document number of each run of windows."""
    total = len(data) - LENGTH + 1
    parts = []
    long_enough = np.diff(offsets) >= LENGTH
    first_window, end_window = offsets[:-1][long_enough], offsets[1:][long_enough] - LENGTH + 1
    number = np.flatnonzero(long_enough)
    w = LENGTH - K + 1
    for s in range(0, max(total, 0), STEP):
        e = min(total, s + STEP)
        part = data[s : e + LENGTH - 1]
        up, down = _powers(1 << (STEP + LENGTH).bit_length())
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_byte_table(0)[part] * up[: len(part)], out=prefix[1:])
        h = mix((prefix[K:] - prefix[:-K]) * down[: len(part) - K + 1])
        m = h
        for shift in (1, 2, 4, 8):  # least of 16 neighbours by doubling, then of w
            m = np.minimum(m[:-shift], m[shift:])
        m = np.minimum(m[: e - s], m[w - 16 : w - 16 + e - s])
        # Valid windows lie within one text; a text's edge starts a run.
        a, b = int(np.searchsorted(end_window, s, side="right")), int(np.searchsorted(first_window, e))
        lo, hi = np.maximum(first_window[a:b], s), np.minimum(end_window[a:b], e)
        change = np.zeros(e - s, dtype=bool)
        change[1:] = m[1:] != m[:-1]
        change[lo - s] = True
        at = np.flatnonzero(change)
        owner = np.searchsorted(lo - s, at, side="right") - 1
        ok = owner >= 0
        at, owner = at[ok], owner[ok]
        ends = np.minimum(np.append(at[1:], e - s), hi[owner] - s)
        ok = ends > at
        at, owner, ends = at[ok], owner[ok], ends[ok]
        parts.append((at + s, ends - at, mix(m[at]), number[a:b][owner]))  # minima are small values; mixed, they spread evenly over buckets
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def _asked(minimizer: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct minimizers, shortened to BITS, whether two documents of the pack have them, and the level of their number of runs."""
    short = _short(minimizer)
    if not len(short):
        return short, np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)
    order = np.argsort(short, kind="stable")
    short, doc = short[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    level = np.searchsorted(LEVELS, np.diff(np.append(start, len(short))), side="right") - 1
    return short[start], np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), level


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, blob in zip(b.column("pack").to_pylist(), b.column("texts")):
                ids, _, offsets, data = unpack(blob.as_py())
                _, _, minimizer, doc = runs(data, offsets)
                short, several, level = _asked(minimizer, ids[doc])
                coded = (short << np.uint64(3) | level.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :6]
                cut_at = edges(short, buckets, BITS)
                full = np.flatnonzero(np.diff(cut_at))
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([coded[cut_at[i] : cut_at[i + 1]].tobytes() for i in full.tolist()], pa.binary())], ["pack", "bucket", "asked"])

    return run


def _answer(hot: int):
    """Two bits for each minimizer asked for: whether more than one document has it, and whether it is dealt out by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held, blobs in by_bucket(batches, "asked"):
            size = [len(x) // 6 for x in blobs]
            raw = np.zeros((sum(size), 8), dtype=np.uint8)
            raw[:, :6] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
            coded = raw.view(np.uint64).ravel()
            order = np.argsort(coded >> np.uint64(3), kind="stable")
            coded = coded[order]
            value, several, level = coded >> np.uint64(3), (coded & np.uint64(1)).astype(bool), (coded >> np.uint64(1) & np.uint64(3)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            count = np.diff(np.append(start, len(value)))
            many = (count > 1) | np.logical_or.reduceat(several, start)
            busy = np.add.reduceat(LEVELS[level], start) >= hot
            out = np.empty((2, len(coded)), dtype=bool)
            out[:, order] = np.repeat(np.stack([many, busy]), count, axis=1)
            at = np.concatenate([[0], np.cumsum(size)])
            bits = [np.packbits(out[:, at[i] : at[i + 1]], axis=1).tobytes() for i in range(len(held))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array(bits, pa.binary())], ["pack", "bucket", "bits"])

    return run


def _segments(blob: bytes, answers: list, buckets: int) -> dict:
    """The runs of a pack whose minimizers several documents have, and their distinct strings in order of bucket."""
    ids, is_null, offsets, data = unpack(blob)
    start, count, minimizer, doc = runs(data, offsets)
    short, _, _ = _asked(minimizer, ids[doc])
    cut_at = edges(short, buckets, BITS)
    told = np.zeros((2, len(short)), dtype=bool)
    for x in answers:
        lo, hi = cut_at[x["bucket"]], cut_at[x["bucket"] + 1]
        told[:, lo:hi] = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8).reshape(2, -1), axis=1, count=int(hi - lo)).astype(bool)
    own = _short(minimizer)
    shared, hot = told[:, np.searchsorted(short, own)] if len(own) else told
    start, count, own, doc, hot = start[shared], count[shared], own[shared], doc[shared], hot[shared]
    if hot.any():  # single windows under their own hash; runs stay in order of place
        size = np.where(hot, count, 1)
        at = expand(start, size)
        doc, of_hot = np.repeat(doc, size), np.repeat(hot, size)
        own, count = np.repeat(own, size), np.where(of_hot, 1, np.repeat(count, size))
        start = at
        own[of_hot] = _short(span_hash(data, start[of_hot], start[of_hot] + LENGTH, 7))
    h = span_hash(data, start, start + count + LENGTH - 1, 5)
    order = np.lexsort((h, own))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    least = np.minimum.reduceat(ids[doc][order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
    return {"ids": ids, "is_null": is_null, "offsets": offsets, "data": data, "start": start, "count": count, "doc": doc, "which": which, "first": first, "least": least, "value": own[first], "hash": h[first]}


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, blob, answers in zip(b.column("pack").to_pylist(), b.column("texts"), b.column("answers")):
                s = _segments(blob.as_py(), answers.as_py() or [], buckets)
                cut_at = edges(s["value"], buckets, BITS)
                rows = []
                for i in np.flatnonzero(np.diff(cut_at)).tolist():
                    part = slice(cut_at[i], cut_at[i + 1])
                    first = s["first"][part]
                    length = s["count"][first] + LENGTH - 1
                    text = s["data"][expand(s["start"][first], length)]
                    head = np.array([len(first)], dtype=np.int64).tobytes()
                    rows.append((i, zipped(head + s["value"][part].tobytes() + s["hash"][part].tobytes() + s["least"][part].tobytes() + length.astype(np.int64).tobytes() + text.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pack", "bucket", "segments"])

    return run


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rotations, by the first 64 bytes at least, and the Burrows-Wheeler transform of the text."""
    n = len(text)
    padded = np.concatenate([text, np.resize(text, 8)])  # rotations, so that rows and what is before them agree at the ends too
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    order = np.argsort(key)
    depth = 8
    while True:
        ordered = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if depth > LENGTH or new.all():
            break
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << np.uint64(32) | np.roll(rank, -depth)
        # Only suffixes whose key is shared so far need sorting again, within their place.
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        at = np.flatnonzero(tied)
        own = order[at]
        order[at] = own[np.argsort(key[own])]
        depth *= 2
    return order, text[order - 1]


def expand_intervals(bwt: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where neighbouring suffixes have a common prefix shorter than length, found by increasing prefix.

    An interval of suffixes that start with w is extended to those that start with cw for each c before
    it. An extension whose right end is not marked yet gets the mark of this level and is extended in turn.
    """
    n = len(bwt)
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = mark[n] = True
    order = np.argsort(bwt, kind="stable")  # row that maps to each place
    order = order.astype(np.int32)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        width = hi - lo + 1
        rows = expand(lo, width).astype(np.int32)
        left, right = np.repeat(lo.astype(np.int32), width), np.repeat(hi.astype(np.int32), width)
        to, c = place[rows], bwt[rows]
        after, before = order[np.minimum(to + 1, n - 1)], order[np.maximum(to - 1, 0)]
        last = (to == n - 1) | (bwt[after] != c) | (after > right)
        first = (to == 0) | (bwt[before] != c) | (before < left)
        i, j = np.sort(to[first]), np.sort(to[last])
        fresh = ~mark[j + 1]
        lo, hi = i[fresh], j[fresh]
        mark[hi + 1] = True
        if not len(lo):
            break
    return mark[:n]


def window_minima(texts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each segment, in order, the least doc among the segments that hold its bytes."""
    size = lengths + 1
    starts = np.cumsum(size) - size
    joined = np.zeros(int(size.sum()), dtype=np.uint8)
    joined[expand(starts, lengths)] = texts
    order, bwt = transform(joined)
    mark = expand_intervals(bwt)
    owner = np.repeat(np.arange(len(lengths)), size)
    is_window = np.zeros(len(joined), dtype=bool)
    windows = expand(starts, lengths - LENGTH + 1)
    is_window[windows] = True
    group = np.cumsum(mark) - 1
    doc = np.where(is_window, docs[owner], NO_ID)[order]
    least = np.minimum.reduceat(doc, np.flatnonzero(mark))
    out = np.empty(len(joined), dtype=np.int64)
    out[order] = least[group]
    return out[windows]


def _minima(value: np.ndarray, texts: np.ndarray, text_at: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """window_minima of segments sorted by minimizer, which start at text_at, block by block."""
    windows = lengths - LENGTH + 1
    out = np.repeat(docs, windows)
    at = np.cumsum(windows) - windows
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
    several = np.diff(edge) > 1
    groups = np.flatnonzero(several)
    if not len(groups):
        return out
    weight = np.add.reduceat(lengths + 1, edge[:-1])[groups]
    i = 0
    while i < len(groups):
        j = max(i + 1, int(np.searchsorted(np.cumsum(weight[i:]), BLOCK, side="right")) + i)
        members = expand(edge[groups[i:j]], (edge[groups[i:j] + 1] - edge[groups[i:j]]))
        spans = expand(at[members], windows[members])
        if weight[i:j].sum() <= 2 * BLOCK:
            out[spans] = window_minima(texts[expand(text_at[members], lengths[members])], lengths[members], docs[members])
        else:
            begin = np.cumsum(lengths[members]) - lengths[members]
            starts = expand(begin, windows[members])
            h = span_hash(texts[expand(text_at[members], lengths[members])], starts, starts + LENGTH, 9)
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.minimum.reduceat(np.repeat(docs[members], windows[members])[order], first)
            out[spans[order]] = np.repeat(least, np.diff(np.append(first, len(h))))
        i = j
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, held, blobs in by_bucket(batches, "segments"):
        size, value, h, least, length, text = [], [], [], [], [], []
        for x in blobs:
            raw = unzipped(x)
            n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
            size.append(n)
            value.append(np.frombuffer(raw, dtype=np.uint64, count=n, offset=8))
            h.append(np.frombuffer(raw, dtype=np.uint64, count=n, offset=8 + 8 * n))
            least.append(np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 16 * n))
            length.append(np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 24 * n))
            text.append(np.frombuffer(raw, dtype=np.uint8, offset=8 + 32 * n))
        value, h, least, length, text = (np.concatenate(x) for x in (value, h, least, length, text))
        order = np.lexsort((h, value))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (h[order][1:] != h[order][:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        docs = np.minimum.reduceat(least[order], np.flatnonzero(new))
        text_at = np.cumsum(length) - length
        minima = _minima(value[first], text, text_at[first], length[first], docs)
        windows = length[first] - LENGTH + 1
        at = np.cumsum(windows) - windows
        # Answers as runs: the first window of each run of equal minima, and the minimum.
        edge = np.ones(len(minima), dtype=bool)
        edge[1:] = minima[1:] != minima[:-1]
        edge[at] = True
        where = np.flatnonzero(edge)
        run_first = np.searchsorted(where, at)
        run_count = np.diff(np.append(run_first, len(where)))
        offset = where - np.repeat(at, run_count)
        low = minima[where]
        begin = 0
        out = []
        for n in size:
            own = which[begin : begin + n]
            begin += n
            c = run_count[own]
            take = expand(run_first[own], c)
            out.append(zipped(np.array([n], dtype=np.int64).tobytes() + c.astype(np.int32).tobytes() + offset[take].astype(np.int32).tobytes() + low[take].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array(out, pa.binary())], ["pack", "bucket", "minima"])


def _cut_out(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, answers, judged in zip(b.column("texts"), b.column("answers"), b.column("judged")):
                s = _segments(blob.as_py(), answers.as_py() or [], buckets)
                ids, offsets, data = s["ids"], s["offsets"], s["data"]
                counts, offset, low = [], [], []
                for x in sorted(judged.as_py() or [], key=lambda x: x["bucket"]):
                    raw = unzipped(x["minima"])
                    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
                    c = np.frombuffer(raw, dtype=np.int32, count=n, offset=8).astype(np.int64)
                    m = int(c.sum())
                    counts.append(c)
                    offset.append(np.frombuffer(raw, dtype=np.int32, count=m, offset=8 + 4 * n).astype(np.int64))
                    low.append(np.frombuffer(raw[8 + 4 * n + 4 * m :], dtype=np.int64))
                delta = np.zeros(len(data) + 1, dtype=np.int32)
                if counts:
                    counts, offset, low = (np.concatenate(x) for x in (counts, offset, low))
                    first = np.cumsum(counts) - counts
                    c = counts[s["which"]]
                    take = expand(first[s["which"]], c)
                    begin = np.repeat(s["start"], c) + offset[take]
                    stop = np.append(begin[1:], 0)
                    ends = np.cumsum(c) - 1
                    stop[ends] = s["start"] + s["count"]
                    gone = low[take] < np.repeat(ids[s["doc"]], c)
                    np.add.at(delta, begin[gone], 1)
                    np.add.at(delta, stop[gone] + LENGTH - 1, -1)
                gone_bytes, spans, digest = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64), []
                i, open_ = 0, 0
                while i < len(ids):  # what ends with a slice's last text is taken off at the first byte of the next one
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
                    base, at = offsets[i], offsets[i : j + 1] - offsets[i]
                    depth = np.cumsum(delta[base : offsets[j]]) + open_
                    open_ = int(depth[-1]) if len(depth) else open_
                    removed = depth > 0
                    begins = removed.copy()
                    begins[1:] &= ~removed[:-1]
                    edge = at[:-1][at[:-1] < len(removed)]
                    begins[edge] = removed[edge]
                    gone_bytes[i:j] = np.diff(np.concatenate([[0], np.cumsum(removed)])[at])
                    spans[i:j] = np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
                    for k in range(j - i):
                        own = slice(at[k], at[k + 1])
                        digest.append(hashlib.sha256(data[base : offsets[j]][own][~removed[own]].tobytes()).hexdigest())
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=s["is_null"].astype(bool)), pa.array(np.diff(offsets)), pa.array(gone_bytes), pa.array(spans), pa.array(digest, pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts = packed(docs)
    buckets = bucket_count(texts)
    asked = texts.mapInArrow(_ask(buckets), "pack long, bucket int, asked binary")
    bits = dealt(asked, buckets).mapInArrow(_answer(hot), "pack long, bucket int, bits binary")
    answers = cut(bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")))
    joined = texts.join(answers, "pack", "left").select("pack", "texts", "answers")
    sent = joined.mapInArrow(_send(buckets), "pack long, bucket int, segments binary")
    judged = dealt(sent, buckets).mapInArrow(_judge, "pack long, bucket int, minima binary").groupBy("pack").agg(F.collect_list(F.struct("bucket", "minima")).alias("judged"))
    last = joined.join(judged, "pack", "left").select("texts", "answers", "judged")
    return last.mapInArrow(_cut_out(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

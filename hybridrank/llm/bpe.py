"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is a vocabulary entry takes
its rank at once. Tier two, for the misses, merges linked bytes in the order of a heap of pair ranks.
Pre-tokens are looked up once for each distinct one of a block of texts.

Defined edge cases: a null or empty text has no ids; a very long text is cut only where a letter, a space
and a letter meet, which is always a pre-token boundary; repeated rows repeat their result; an empty table
gives an empty result; extra columns are kept by `encode` unless named ids or n_tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, expand, mix, span_hash, table

PIECE_CHARS = 1 << 20
MEMO_ENTRIES = 700_000
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys: buckets displaced in falling order of size."""

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.n, self.m = n, max(1, n // 3)
        bucket = (keys % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.seed = np.zeros(self.m, dtype=np.uint64)
        self.slot_key = np.zeros(n, dtype=np.uint64)
        self.slot_rank = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            seed = 0
            tries = np.arange(64, dtype=np.uint64)
            while True:
                slots = self._slots(keys[own][None, :], (tries + np.uint64(seed))[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    break
                seed += 64
            self.seed[b] = seed + at
            free[slots[at]] = False
            self.slot_key[slots[at]] = keys[own]
            self.slot_rank[slots[at]] = own

    def _slots(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(keys + (seeds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among those it was built of, or -1."""
        slots = self._slots(keys, self.seed[(keys % np.uint64(self.m)).astype(np.int64)])
        return np.where(self.slot_key[slots] == keys, self.slot_rank[slots], -1)


class Vocabulary:
    """Ranks of a tiktoken file, with the perfect hash and the bytes of every id."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        tokens = list(self.ranks)
        self.rank_of = np.fromiter(self.ranks.values(), dtype=np.int64, count=len(tokens))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        data, offsets = _joined(tokens)
        self.perfect = PerfectHash(span_hash(data, offsets[:-1], offsets[1:]))
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            by_id[r] = t
        self.bytes, self.byte_offsets = _joined(by_id)
        # Merged tokens: sorted hashes, where their ids begin and how many they are; and the ids.
        self.memo = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        self.memo_ids = np.empty(0, dtype=np.uint32)

    def merged(self, keys: np.ndarray, lengths: np.ndarray, token: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct tokens with these hashes and lengths, joined, and how many each has.

        Tokens of up to 64 bytes are remembered in arrays, which take a tenth of the memory of a dictionary; when
        there are more than MEMO_ENTRIES, only those of this call stay.
        """
        hashes, first, size = self.memo
        at = np.searchsorted(hashes, keys)
        known = hashes[np.minimum(at, len(hashes) - 1)] == keys if len(hashes) else np.zeros(len(keys), dtype=bool)
        firsts, sizes = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        firsts[known], sizes[known] = first[at[known]], size[at[known]]
        new, ids = np.flatnonzero(~known), self.memo_ids
        if len(new):
            fresh = [self._merge(token(i)) for i in new.tolist()]
            sizes[new] = [len(x) for x in fresh]
            firsts[new] = len(ids) + np.cumsum(sizes[new]) - sizes[new]
            ids = np.concatenate([ids, np.fromiter((x for m in fresh for x in m), dtype=np.uint32, count=int(sizes[new].sum()))])
        out = ids[expand(firsts, sizes)]
        short = np.flatnonzero(lengths[new] <= 64)
        if len(short) and len(hashes) + len(short) <= MEMO_ENTRIES:
            add = new[short]
            moved = len(self.memo_ids) + np.cumsum(sizes[add]) - sizes[add]
            ids = np.concatenate([self.memo_ids, ids[expand(firsts[add], sizes[add])]])
            self._remember(np.concatenate([hashes, keys[add]]), np.concatenate([first, moved]), np.concatenate([size, sizes[add]]), ids)
        elif len(short):
            add = np.flatnonzero(lengths <= 64)[:MEMO_ENTRIES]
            self._remember(keys[add], np.cumsum(sizes[add]) - sizes[add], sizes[add], ids[expand(firsts[add], sizes[add])])
        return out, sizes

    def _remember(self, hashes: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.memo, self.memo_ids = (hashes[order], first[order], size[order]), ids

    def _merge(self, token: bytes) -> tuple[int, ...]:
        """Tier two: repeatedly join the adjacent pair of least rank, leftmost first.

        The parts are linked by their ends and predecessors; a heap entry packs rank, start and end of a pair.
        """
        get, n = self.ranks.get, len(token)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            r = get(token[i : i + 2])
            if r is not None:
                heap.append((r << bits | i) << bits | (i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            stop, i = x & mask, x >> bits & mask
            j = end[i]
            if not j or j == n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                e = end[stop]
                r = get(token[i:e])
                if r is not None:
                    push(heap, (r << bits | i) << bits | e)
            if i:
                p = before[i]
                r = get(token[p:stop])
                if r is not None:
                    push(heap, (r << bits | p) << bits | stop)
        out, i = [], 0
        while i < n:
            e = end[i]
            out.append(self.ranks[token[i:e]])
            i = e
        return tuple(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and n + 1 offsets."""
        ids, counts = [], np.zeros(len(texts), dtype=np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                flat, lengths = self._look_up(held)
                ids.append(flat)
                at = 0
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for k, n in owners:
                    counts[k] += ends[at + n] - ends[at]
                    at += n
                held.clear()
                owners.clear()

        for k, text in enumerate(texts):
            for piece in _pieces(text):
                found = self.pattern.findall(piece)
                held.extend(found)
                owners.append((k, len(found)))
                if len(held) > 400_000:
                    flush()
        flush()
        return np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array(tokens, type=pa.string()).dictionary_encode()
        unique = coded.dictionary.cast(pa.large_string())
        offsets = np.frombuffer(unique.buffers()[1], dtype=np.int64)[: len(unique) + 1]
        raw = unique.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)
        keys = span_hash(data, offsets[:-1], offsets[1:])
        at = self.perfect.find(keys)
        parts = self.rank_of[np.maximum(at, 0)]
        size = np.ones(len(unique), dtype=np.int64)
        missed = np.flatnonzero(at < 0)
        merged, size[missed] = self.merged(keys[missed], np.diff(offsets)[missed], lambda k: bytes(raw[offsets[missed[k]] : offsets[missed[k] + 1]]))
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), dtype=np.uint32)
        hit = at >= 0
        flat[first[hit]] = parts[hit]
        if len(missed):
            flat[expand(first[missed], size[missed])] = merged
        index = coded.indices.to_numpy(zero_copy_only=False)
        return flat[expand(first[index], size[index])], size[index]

    def decode(self, ids: np.ndarray) -> bytes:
        first = self.byte_offsets[ids]
        return self.bytes[expand(first, self.byte_offsets[ids.astype(np.int64) + 1] - first)].tobytes()


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:] if at else text


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids (array of int) and n_tokens."""
    path, pattern = _defaults(path, pattern)
    kept = docs.drop("ids", "n_tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in blocks(batches):
            ids, offsets = vocab.encode(b.column("text").fill_null("").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(offsets))], [*b.schema.names, "ids", "n_tokens"])

    return kept.mapInArrow(run, f"{schema}, ids array<int>, n_tokens long")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for b in blocks(batches):
            ids, offsets = vocab.encode(b.column("text").fill_null("").to_pylist())
            ids_hash, back_hash = [], []
            for i in range(b.num_rows):
                own = ids[offsets[i] : offsets[i + 1]]
                ids_hash.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back = hashlib.sha256()
                for k in range(0, len(own), 1 << 18):
                    back.update(vocab.decode(own[k : k + (1 << 18)]))
                back_hash.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

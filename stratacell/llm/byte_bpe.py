"""Byte-level BPE encoding and decoding by merge ranks.

The pairs of pre-tokens wait in buckets, one for each merge rank, that hold linked-list positions. A
hierarchical bitmap says which buckets are in use; find-first-set picks the next rank and the bucket's
leftmost position is merged. Entries whose pair has changed meanwhile are skipped. A merge costs
O(log n), so a pre-token of a million bytes is no special case. Unknown pre-tokens of many texts share
one queue: no pair spans two of them, so none changes the order of another's merges. Large buckets are
merged in arrays, of each pre-token the leftmost position alone if its merge may bring a lower rank into
use. Pre-tokens that recur are remembered in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import textkit as tk

#: Most pre-tokens that a Python worker remembers from one slice to the next, and their characters.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 4_000_000
#: Bytes of texts that are encoded together; of pre-tokens that share a queue (a longer one has its own).
SLICE_BYTES, QUEUE_BYTES = 2 << 20, 1 << 20
#: Least entries of a bucket that is merged in arrays.
LARGE = 24
#: Ranks of one bitmap word, as a power of two.
WORD_BITS = 8


class _Numbers(dict):
    """Numbers from 0, in the order in which tokens are first asked for."""

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        return n


def _by_rank(at: np.ndarray, rank: np.ndarray) -> list[tuple[int, list[int]]]:
    """Each rank from 0 and its positions, ascending."""
    both = np.sort((rank << 32 | at)[rank >= 0])
    rank, at = both >> 32, (both & 0xFFFFFFFF).tolist()
    cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
    return [(r, at[a:b]) for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:])] if at else []


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.words = [0] * ((max(ranks.values()) >> WORD_BITS) + 1)
        # Each way to make a token of two: left id * base + right id, ascending, and the token's rank.
        self.base = max(ranks.values()) + 1
        ways = [(ranks[t[:k]] * self.base + ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, made = np.array(sorted(ways), np.int64).reshape(-1, 2).T.copy()
        self.keys, self.made = np.append(keys, -1 % (1 << 63)), np.append(made, -1)
        #: Tokens after whose merge a lower rank may come into use.
        self.unsteady = set(np.concatenate([x[made < x] for x in (keys // self.base, keys % self.base)]).tolist())
        self.same = list(range(self.base))  # one object for each id, which lists of ids share
        self.cache, self.ids, self.chars = _Numbers(), [], 0

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        """Ranks from lines of a base64 token and its rank."""
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}, pattern)

    def rate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where there is none."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of these pre-tokens."""
        buf, rank_of = b"".join(pieces), self.ranks.get
        n, ends = len(buf), np.cumsum([len(x) for x in pieces])
        # Each array is also seen as numpy's. The first position of a pre-token, and the end of all, have none before.
        ids, after, before, pair = (array("q", bytes(8 * (n + 1))) for _ in range(4))
        np_ids, np_after, np_before, np_pair = (np.frombuffer(x, np.int64) for x in (ids, after, before, pair))
        single = np.array([rank_of(bytes([i]), -1) for i in range(256)])
        np_ids[:n] = single[np.frombuffer(buf, np.uint8)]
        if np_ids.min() < 0:
            raise ValueError("a byte has no rank")
        np_after[:], np_before[:] = np.arange(1, n + 2), np.arange(-1, n)
        np_before[0] = np_before[ends] = -1
        np_pair[:-1] = self.rate(np_ids[:-1], np_ids[1:])
        np_pair[ends - 1] = np_pair[n] = -1
        # The queue: positions by rank, bitmap words of the ranks in use, and a bitmap of those words.
        buckets: dict[int, list[int]] = {}
        words, top, mask = self.words, 0, (1 << WORD_BITS) - 1
        owner = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        fresh = _by_rank(np.arange(n), np_pair[:-1])
        while True:
            for rank, places in fresh:
                bucket = buckets.get(rank)
                if bucket is not None:
                    for i in places:
                        heappush(bucket, i)
                    continue
                buckets[rank] = places
                w = rank >> WORD_BITS
                top |= 1 << w
                words[w] |= 1 << (rank & mask)
            if not top:
                break
            w = (top & -top).bit_length() - 1  # the least rank in use
            low = words[w] & -words[w]
            rank = w << WORD_BITS | low.bit_length() - 1
            bucket, fresh = buckets[rank], ()
            if len(bucket) >= LARGE:
                at = np.sort(np.array(bucket))
                at = at[np_pair[at] == rank]
                least = np.append(True, owner[at[1:]] != owner[at[:-1]]) if rank in self.unsteady and len(at) else np.ones(len(at), bool)
                bucket = at[~least].tolist()
                if len(bucket) * 2 <= len(at):
                    fresh = self._merge_all(at[least], rank, np_ids, np_after, np_before, np_pair)
                    buckets[rank] = bucket
                else:  # few pre-tokens hold most of them
                    buckets[rank] = bucket = at.tolist()
            while bucket and not fresh:  # the leftmost position, until a pair arises
                i = heappop(bucket)
                if pair[i] != rank:
                    continue
                j = after[i]
                k = after[i] = after[j]
                ids[i], ids[j], pair[i], pair[j] = rank, -1, -1, -1
                b = before[i]
                if before[k] >= 0:
                    before[k] = i
                    new = rank_of(buf[i : after[k]])
                    if new is not None:
                        pair[i] = new
                        fresh = ((new, [i]),)
                if b >= 0:
                    new = rank_of(buf[b:k])
                    pair[b] = -1 if new is None else new
                    if new is not None:
                        fresh = (*fresh, (new, [b]))
            if not bucket:
                del buckets[rank]
                words[w] ^= low
                if not words[w]:
                    top ^= 1 << w
        left = np.flatnonzero(np_ids[:n] >= 0)
        out = list(map(self.same.__getitem__, np_ids[left].tolist()))
        cuts = [0, *np.searchsorted(left, ends).tolist()]
        return [tuple(out[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _merge_all(self, at: np.ndarray, rank: int, ids: np.ndarray, after: np.ndarray, before: np.ndarray, pair: np.ndarray) -> list[tuple[int, list[int]]]:
        """Merges these ascending positions, none stale, as one by one from the left; the positions of pairs that
        arise, by rank."""
        follows = np.append(False, after[at[:-1]] == at[1:])
        if follows.any():  # of overlapping pairs in a row, each second one is gone when its turn comes
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
        gone = after[at]
        end = after[gone]
        after[at], ids[at], ids[gone], pair[at], pair[gone] = end, rank, -1, -1, -1
        inner = before[end] >= 0
        before[end[inner]] = at[inner]
        # A pair of two of these is rated once, at the left one.
        ahead = before[at]
        ahead = ahead[(ahead >= 0) & ~np.append(False, end[:-1] == at[1:])]
        left = np.append(at[inner], ahead)
        new = self.rate(ids[left], ids[after[left]])
        pair[left] = new
        return _by_rank(left, new)

    def _merged(self, tokens: list[str]) -> Iterator[tuple[int, ...]]:
        """The ids of each pre-token, those of a queue at a time."""
        pieces = [x.encode() for x in tokens]
        whole = list(map(self.ranks.get, pieces))
        parts = [x for x, rank in zip(pieces, whole) if rank is None]
        total = np.cumsum([len(x) for x in parts], dtype=np.int64)

        def queues() -> Iterator[tuple[int, ...]]:
            i = 0
            while i < len(parts):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + QUEUE_BYTES, "right")))
                yield from self.merge(parts[i:j])
                i = j

        merged = queues()
        for rank in whole:
            yield next(merged) if rank is None else (rank,)

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; the texts' unknown pre-tokens are merged together."""
        cache, ids, known = self.cache, self.ids, len(self.cache)
        del ids[known:]
        found = [list(map(cache.__getitem__, self.find(x))) for x in texts]
        new = list(islice(cache, known, None))
        ids.extend(self._merged(new))
        for numbers in found:
            yield list(chain.from_iterable(map(ids.__getitem__, numbers)))
        self.chars += sum(map(len, new))
        if len(cache) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            cache.clear()
            ids.clear()
            self.chars = 0

    def encode(self, text: str) -> list[int]:
        (ids,) = self.encode_all([text])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[tuple, ByteBpe] = {}


def _coder(ranks, pattern: str) -> ByteBpe:
    """One coder for each Python worker, so that its cache lasts from task to task."""
    key = ranks.value[0], pattern
    if key not in _made:
        _made.clear()
        _made[key] = ByteBpe(ranks.value[1], pattern)
    return _made[key]


def _broadcast(df: DataFrame, path: str):
    """The rank table; its size is that of the vocabulary, whatever the corpus."""
    table = ByteBpe.from_file(path, "").ranks
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(Path(path).read_bytes()).hexdigest(), table))


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of ``documents``.

    Null and empty texts have no ids. Ids may be null or repeat; other columns are not read. Nothing is
    shuffled. ``path``: a file of merge ranks that the driver can read.
    """
    ranks = _broadcast(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for ids, texts in _slices(batch, "text"):
                out = list(coder.encode_all([t or "" for t in texts.to_pylist()]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(tk.trimmed(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary) of a table of ids; null ids decode to nothing."""
    ranks = _broadcast(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, "")
        for batch in batches:
            for ids, lists in _slices(batch, "ids"):
                out = [coder.decode(x or []) for x in lists.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Some rows at a time, for Python objects take many times the room; a long one is alone."""
    keys, column = tk.take(batch, "doc_id"), tk.take(batch, name)
    lists = pa.types.is_nested(column.type)
    length = pc.list_value_length(column) if lists else pc.binary_length(column)
    # An id as an object takes some 16 times the room of a character.
    total = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64) * (16 if lists else 1)
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield keys[i:j], column[i:j]
        i = j


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded from its ids.

    As ``encode_documents`` and ``decode_documents`` in one pass. Digests are lowercase hex, of the
    decimal ids joined by a space and of the decoded bytes.
    """
    ranks = _broadcast(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        decimal = {i: b"%d" % i for i in coder.bytes_of}.__getitem__
        for batch in batches:
            for keys, texts in _slices(batch, "text"):
                n, ids_sha, decoded_sha = [], [], []
                for ids in coder.encode_all([t or "" for t in texts.to_pylist()]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
                    decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

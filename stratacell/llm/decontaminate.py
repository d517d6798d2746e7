"""Benchmark decontamination by suffix arrays over training shards.

Each task cuts its texts into shards of bounded size and builds, for each, an array of its word suffixes in
lexicographic order of word hashes. Every benchmark suffix that begins a window is binary-searched in it:
the range of suffixes that begin with the window is the list of its locations. From each location the
longest verbatim match is found among the benchmark's own suffixes, which are sorted too. Suffixes are
compared to their ends by hashes of prefixes. Shard suffixes whose first words begin no benchmark window
cannot be in any range and are left out before sorting, so the work of sorting follows the overlap.

There is no shuffle: documents stay where they were read. The benchmark travels in blocks of at most
``BLOCK_BYTES`` of text, each a broadcast of its own of about twice that size. A task gathers
``ROUND_BYTES`` of text, and holds one block at a time against it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW = 13
BLOCK_BYTES, ROUND_BYTES = 16 << 20, 16 << 20
HEAD = 4
#: Words that one step of sorting looks at, and pairs of documents and items that are named at a time.
_STEP, _NAMED = 8, 1 << 20

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, longest_match long, longest_item string, longest_start long"
)


class Suffixes:
    """Suffixes of word sequences: each begins at ``start`` and stops before ``stop``."""

    def __init__(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.words, self.start, self.stop = words, start, stop
        self.prefix = np.zeros(len(words) + 1, tk.U64)
        np.cumsum(words * tk._power_table(tk.BASE, len(words)), dtype=tk.U64, out=self.prefix[1:])
        self.order = np.zeros(0, np.int64)

    def sort(self, limit: int) -> None:
        """Puts ``order`` into lexicographic order of the first ``limit`` words; an end comes before any word."""
        n = len(self.start)
        rank, pending, depth = np.zeros(n, np.int64), np.arange(n), 0
        while len(pending) and depth < limit:
            keys = np.zeros((len(pending), 1 + _STEP), ">u8")
            keys[:, 0] = rank[pending]
            for j in range(_STEP):
                at = self.start[pending] + depth + j
                inside = at < self.stop[pending]
                keys[inside, 1 + j] = self.words[at[inside]]
            flat = keys.reshape(-1).view(f"S{8 * (1 + _STEP)}")
            order = np.argsort(flat, kind="stable")
            flat, pending = flat[order], pending[order]
            new, group = np.ones(len(flat), bool), np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            old = rank[pending]
            group[1:] = old[1:] != old[:-1]
            begin = lambda mark: np.maximum.accumulate(np.where(mark, np.arange(len(mark)), 0))
            rank[pending] = old + begin(new) - begin(group)
            tied = ~new | ~np.append(new[1:], True)
            depth += _STEP
            pending = pending[tied & (self.start[pending] + depth < self.stop[pending])]
        self.order = np.argsort(rank, kind="stable")

    def take(self, which: np.ndarray) -> Suffixes:
        out = Suffixes.__new__(Suffixes)
        out.words, out.prefix, out.start, out.stop = self.words, self.prefix, self.start[which], self.stop[which]
        return out

    def word(self, offset: np.ndarray) -> np.ndarray:
        """Each suffix's word at its offset, 0 at its end."""
        at = self.start + offset
        inside = at < self.stop
        return np.where(inside, self.words[np.where(inside, at, 0)], tk.U64(0)) if len(self.words) else np.zeros(len(at), tk.U64)


def common(a: Suffixes, b: Suffixes, most: np.ndarray | int | None = None) -> np.ndarray:
    """How many first words the pairs of suffixes share, ``most`` at most."""
    limit = np.minimum(a.stop - a.start, b.stop - b.start)
    if most is not None:
        limit = np.minimum(limit, most)
    power = tk._power_table(tk.BASE, max(len(a.words), len(b.words)) + 1)
    out, step = np.zeros(len(limit), np.int64), 1 << int(limit.max(initial=0)).bit_length()
    while step:
        n = np.minimum(out + step, limit)
        x = (a.prefix[a.start + n] - a.prefix[a.start]) * power[b.start]
        y = (b.prefix[b.start + n] - b.prefix[b.start]) * power[a.start]
        out = np.where((out + step <= limit) & (x == y), out + step, out)
        step >>= 1
    return out


def bisect(queries: Suffixes, array: Suffixes, most: np.ndarray, right: bool) -> np.ndarray:
    """Where the first ``most`` words of each query belong in a sorted array: before the suffixes that begin
    with them, or, with ``right``, behind."""
    low, high = np.zeros(len(queries.start), np.int64), np.full(len(queries.start), len(array.order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        own, other = queries.take(open_), array.take(array.order[mid])
        n = common(own, other, most[open_])
        less = np.where(n >= most[open_], right, other.word(n) < own.word(n))
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]


def _slot(columns, bits: int) -> np.ndarray:
    out = None
    for j, c in enumerate(columns):
        out = c * tk.NGRAM[j] if out is None else out + c * tk.NGRAM[j]
    return (tk.mix(out) >> tk.U64(64 - bits)).astype(np.int64)


class BenchmarkBlock:
    """The suffixes of some benchmark items that begin a window, sorted. Word hashes and the order travel;
    what follows from them is made where the block arrives."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.names = window, [k for k, _ in items]
        parts, sizes = [], []
        for piece in tk.pieces(pa.array([t for _, t in items], pa.large_string())):
            start, end, text = piece.words(tk.ALNUM)
            parts.append(piece.span_hash(piece.prefix(tk.FOLDED_VALUES), start, end))
            sizes.append(np.diff(tk.group_bounds(text, piece.n)))
        self.words = np.concatenate(parts) if parts else np.zeros(0, tk.U64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self._derive()
        self.suffixes.sort(int(self.size.max(initial=0)))
        self.order = self.suffixes.order.astype(np.int32)
        self._group()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("window", "names", "words", "size", "order")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._derive()
        self.suffixes.order = self.order.astype(np.int64)
        self._group()

    def _derive(self) -> None:
        begin = np.cumsum(self.size) - self.size
        windows = np.where(self.size > 0, np.maximum(1, self.size - self.window + 1), 0)
        self.owner = np.repeat(np.arange(len(self.size)), windows)
        start = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.suffixes = Suffixes(self.words, start, (begin + self.size)[self.owner])

    def _group(self) -> None:
        """Equal windows stand in a row of the order: a group."""
        s = self.suffixes
        need = np.minimum(s.stop - s.start, self.window)[s.order]
        new = np.ones(len(need), bool)
        if len(need) > 1:
            shared = common(s.take(s.order[1:]), s.take(s.order[:-1]), self.window)
            new[1:] = (need[1:] != need[:-1]) | (shared < need[1:])
        self.first = np.append(np.flatnonzero(new), len(need))
        self.need = need[self.first[:-1]]
        self.windows = s.take(s.order[self.first[:-1]])
        self.longest = int(self.size.max(initial=0))
        self.head = int(min(HEAD, self.need.min(initial=HEAD)))
        self.bits = min(26, max(16, 3 + len(need).bit_length()))
        self.heads = _slot([self.words[self.windows.start + j] for j in range(self.head)], self.bits)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.heads] = True


class Shard:
    """The words of a piece and what the blocks met in them."""

    def __init__(self, piece: tk.Piece):
        start, end, text = piece.words(tk.ALNUM)
        self.words = piece.span_hash(piece.prefix(tk.FOLDED_VALUES), start, end)
        self.text, self.bounds = text.astype(np.int32), tk.group_bounds(text, piece.n)
        self.cover = np.zeros(len(self.words) + 1, np.int32)
        self.items: dict[int, set[str]] = {}
        self.best: dict[int, tuple[int, int, str]] = {}

    def meet(self, block: BenchmarkBlock) -> None:
        n = len(self.words) - block.head + 1
        if n <= 0 or not len(block.need):
            return
        slot = _slot([self.words[j : n + j] for j in range(block.head)], block.bits)
        at = np.flatnonzero(block.bitmap[slot])
        if not len(at):
            return
        suffixes = Suffixes(self.words, at, self.bounds[self.text[at] + 1])
        suffixes.sort(block.longest)
        present = np.zeros(1 << block.bits, bool)
        present[slot[at]] = True
        asked = np.flatnonzero(present[block.heads])
        windows, need = block.windows.take(asked), block.need[asked]
        low, high = bisect(windows, suffixes, need, False), bisect(windows, suffixes, need, True)
        count = high - low
        group = np.repeat(asked, count)
        place = at[suffixes.order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]]
        if len(place):
            np.add.at(self.cover, place, 1)
            np.add.at(self.cover, place + block.need[group], -1)
            self._name(block, place, group)
            self._extend(block, place, group)

    def _name(self, block: BenchmarkBlock, place: np.ndarray, group: np.ndarray) -> None:
        """Adds the items of each document's windows, some at a time."""
        pairs = np.unique(np.stack([self.text[place].astype(np.int64), group]), axis=1)
        until = np.cumsum(block.first[pairs[1] + 1] - block.first[pairs[1]])
        for k in range(int(until[-1]) // _NAMED + 1):
            doc, g = pairs[:, (until > k * _NAMED) & (until <= (k + 1) * _NAMED)]
            count = block.first[g + 1] - block.first[g]
            entry = np.repeat(block.first[g], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            both = np.unique(np.stack([np.repeat(doc, count), block.owner[block.suffixes.order[entry]]]), axis=1)
            for d, owner in both.T.tolist():
                self.items.setdefault(d, set()).add(block.names[owner])

    def _extend(self, block: BenchmarkBlock, place: np.ndarray, group: np.ndarray) -> None:
        """Each document's longest match from one of the places on: as far as a benchmark suffix goes along, or,
        if that is less than a window, the longest of the short items found there."""
        order = np.lexsort((-block.need[group], place))
        first = order[np.append(True, place[order][1:] != place[order][:-1])]
        place, group = place[first], group[first]
        found = Suffixes(self.words, place, self.bounds[self.text[place] + 1])
        tests = block.suffixes
        at = bisect(found, tests, np.full(len(place), block.longest), False)
        after, before = np.minimum(at, len(tests.order) - 1), np.maximum(at - 1, 0)
        length = np.maximum(common(found, tests.take(tests.order[after])), common(found, tests.take(tests.order[before])))
        length = np.where(length >= block.window, length, block.need[group])
        doc = self.text[place]
        order = np.lexsort((place, -length, doc))
        top = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        own = found.take(top)
        low, high = bisect(own, tests, length[top], False), bisect(own, tests, length[top], True)
        short = length[top] < block.window
        low, high = np.where(short, block.first[group[top]], low), np.where(short, block.first[group[top] + 1], high)
        for d, n, p, a, b in zip(doc[top].tolist(), length[top].tolist(), place[top].tolist(), low.tolist(), high.tolist()):
            name = min(block.names[x] for x in np.unique(block.owner[tests.order[a:b]]).tolist())
            run = (-n, p - int(self.bounds[d]), name)
            self.best[d] = min(run, self.best.get(d, run))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text and those that a window covers."""
        hit = np.append(0, np.cumsum(np.cumsum(self.cover[:-1]) > 0))
        return np.diff(self.bounds), hit[self.bounds[1:]] - hit[self.bounds[:-1]]


def _rounds(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Slices of the batches with their shards, which have met every block. One block stays loaded; of
    several, each is read from its broadcast file once a round, so that a task holds one at a time."""
    waiting, held = [], 0

    def meet() -> None:
        for handle in blocks:
            block: BenchmarkBlock = handle.value if len(blocks) == 1 else handle.load_from_path(handle._path)
            for _, shard in waiting:
                shard.meet(block)

    for batch in batches:
        for piece in tk.pieces(tk.take(batch, "text")):
            waiting.append((batch.slice(piece.first, piece.n), Shard(piece)))
            held += len(piece.buf)
            if held >= ROUND_BYTES:
                meet()
                yield from waiting
                waiting, held = [], 0
    meet()
    yield from waiting


def match_batches(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    for batch, shard in _rounds(batches, blocks):
        n_words, n_hit = shard.result()
        docs = range(batch.num_rows)
        names = [sorted(shard.items.get(d, ())) for d in docs]
        best = [shard.best.get(d, (0, None, None)) for d in docs]
        yield pa.RecordBatch.from_arrays(
            [
                tk.take(batch, "doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array((n_hit > 0) & (20 * n_hit >= n_words), pa.bool_()),
                pa.array(names, pa.list_(pa.string())),
                pa.array([-b[0] for b in best], pa.int64()),
                pa.array([b[2] for b in best], pa.string()),
                pa.array([b[1] for b in best], pa.int64()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list[Broadcast]:
    """The benchmark in broadcasts of at most ``block_bytes`` of text (a longer item alone)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator()
    blocks, own, size = [], [], 0
    for r in rows:
        n = len(r.text.encode())
        if own and size + n > block_bytes:
            blocks.append(spark.sparkContext.broadcast(BenchmarkBlock(own, window)))
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += n
    if own:
        blocks.append(spark.sparkContext.broadcast(BenchmarkBlock(own, window)))
    return blocks


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document with its overlap with the benchmark.

    A null or empty text has no words and no hits. An item without id, text or words is never found.
    Items of fewer than ``window`` words are one window. Repeated rows each get a row; extra columns of
    either table are not read. ``longest_*``: the longest verbatim match that begins with a window (0 and
    nulls without one), the word it starts at and its item; of equally long ones the earliest, then that
    of the smallest item id as text.
    """
    blocks = benchmark_blocks(documents.sparkSession, benchmark, window=window)

    def run(batches):
        return match_batches(batches, blocks)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that benchmark text does not affect, with all their columns.

    A document goes if it holds a verbatim match of ``window`` words or more, however long it is itself, or
    if items shorter than that cover a twentieth of its words. Rows are judged one by one by their own
    text, so rows may share an id or have none; rows with null or empty texts stay. Columns may have any
    name.
    """
    blocks = benchmark_blocks(documents.sparkSession, benchmark, window=window)

    def run(batches):
        for batch, shard in _rounds(batches, blocks):
            n_words, n_hit = shard.result()
            longest = np.array([-shard.best.get(d, (0,))[0] for d in range(batch.num_rows)], np.int64)
            yield batch.filter(pa.array((longest < window) & ~((n_hit > 0) & (20 * n_hit >= n_words))))

    return documents.mapInArrow(tk.trimmed(run), documents.schema)

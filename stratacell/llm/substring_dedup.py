"""Substring deduplication by content-defined chunks.

A gear rolling hash of the last 16 bytes ends a chunk where its top bits are zero and no such place lies
just before. Both depend on a few bytes alone, so an insertion moves only the chunks that touch it, and
two copies of a passage are cut alike from some twenty bytes on. Chunks are compared by 96-bit digests
over the whole corpus: of each digest the smallest (document id, row, position) keeps its copy, and
neighbouring chunks that are held before join into passages.

Each task settles the copies among some megabytes of its own text first. Of each digest only one chunk for
each such block is shuffled, so a line that a third of all rows hold sends one row a block, and chunks are
made once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .names import fresh
from .scratch import Scratch

#: A chunk ends where CUT_BITS bits are zero, unless they are within LEAST bytes before too, and after MOST
#: bytes at the latest (a little later where a character would be cut).
CUT_BITS, LEAST, MOST = 4, 8, 512
#: The least words or bytes of a passage: more than a line that many documents share, and less than the whole
#: chunks in fifty shared words. Bytes count for scripts without spaces. A passage that only its own text holds
#: before needs twice as much, for it may be a line of a list.
PASSAGE_WORDS, PASSAGE_BYTES = 25, 400
#: Bytes of text whose copies a task settles by itself.
BLOCK_BYTES = 8 << 20
_REACH = 16
_GEAR = (tk.constants(3, 256) >> tk.U64(20)).astype(np.uint16)


def chunk_ends(piece: tk.Piece) -> np.ndarray:
    """The ends of all chunks in the piece's bytes, ascending; every text ends one."""
    length, size = np.diff(piece.offs), len(piece.buf)
    text = np.repeat(np.arange(piece.n), length)
    place = np.arange(size) + _REACH * text
    h = np.zeros(size + _REACH * piece.n, np.uint16)
    h[place] = _GEAR[piece.buf]
    step = 1
    while step < _REACH:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    whole = np.ones(size + 1, bool)  # no character goes on from here
    whole[:size] = (piece.buf & 0xC0) != 0x80
    at = np.flatnonzero((h[place] >> np.uint16(16 - CUT_BITS)) == 0) + 1
    lonely = np.ones(len(at), bool)
    lonely[1:] = (np.diff(at) >= LEAST) | (text[at[1:] - 1] != text[at[:-1] - 1])
    ends = np.unique(np.concatenate([at[lonely & whole[at]], piece.offs[1:][length > 0]]))
    begins = np.append(0, ends[:-1])
    extra = []
    for i in np.flatnonzero(ends - begins > MOST).tolist():
        last, end = int(begins[i]), int(ends[i])
        while end - last > MOST:
            last += MOST
            while not whole[last]:
                last += 1
            if last < end:
                extra.append(last)
    return np.sort(np.append(ends, np.array(extra, np.int64))) if extra else ends


_PLACE = "none boolean, doc long, row long, pos int"
CHUNKS = f"hi long, lo int, {_PLACE}, size int, words int, hnone boolean, hdoc long, hrow long, hpos int"
REPEATS = CHUNKS.split(", ", 2)[2]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The chunks of a batch, piece by piece, with the bytes of each piece."""
    ids, rows = tk.take(batch, "doc_id"), tk.take(batch, "row").to_numpy()
    none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    for piece in tk.pieces(tk.take(batch, "text")):
        ends = chunk_ends(piece)
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        raw = piece.buf.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(begins.tolist(), ends.tolist())])
        both, own = np.frombuffer(digests, [("hi", "<i8"), ("lo", "<i4")]), piece.text_of(begins)
        starts = piece.words(tk.NON_SPACE)[0]
        words = np.searchsorted(starts, ends) - np.searchsorted(starts, begins)
        at = piece.first + own
        yield len(raw), {"hi": both["hi"], "lo": both["lo"], "none": none[at], "doc": ids[at], "row": rows[at], "pos": begins - piece.offs[own], "size": ends - begins, "words": words}


def _settled(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """A block's chunks. One that the block holds before comes with that place, the others with digests."""
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.lexsort((c["pos"], c["row"], c["doc"], c["none"], c["lo"], c["hi"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    back = np.argsort(order)  # in order of texts, where numbers compress well
    new, first = new[back], first[back]
    columns = [pa.array(c[k][back], t, mask=m) for k, t, m in (("hi", pa.int64(), ~new), ("lo", pa.int32(), ~new))]
    columns += [pa.array(c[k][back], t) for k, t in (("none", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("words", pa.int32()))]
    columns += [pa.array(c[k][first], t, mask=new) for k, t in (("none", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=_names(CHUNKS))


def _chunks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for n, c in _chunks_of(batch):
                parts.append(c)
                held += n
                if held >= block_bytes:
                    yield _settled(parts)
                    parts, held = [], 0
        if parts:
            yield _settled(parts)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks whose digest stands before. Rows come ordered by digest and place."""
    keys, place, rest = ("hi", "lo"), ("none", "doc", "row", "pos"), ("size", "words")
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: tk.take(batch, k).to_numpy(zero_copy_only=False) for k in (*keys, *place, *rest)}
        if last is not None:
            c = {k: np.append(last[k], v) for k, v in c.items()}
        new = np.ones(len(c["hi"]), bool)
        new[1:] = (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = np.flatnonzero(~new)
        columns = [c[k][again] for k in (*place, *rest)] + [c[k][first[again]] for k in place]
        last = {k: v[first[-1:]] for k, v in c.items()}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_names(REPEATS))


PASSAGES = "row long, doc_id long, start_byte long, end_byte long, n_words long, n_chunks long, first_doc_id long"


def _join_runs(least_words: int, least_bytes: int):
    """Passages of the repeated chunks, which come ordered by row and position.

    Neighbours join. Chunks whose earlier copy is in the same row must lie as far from it as those before,
    so that one line written over and over is no passage.
    """
    names = _names(REPEATS)

    def passages(c: dict[str, np.ndarray], begin: np.ndarray) -> pa.RecordBatch:
        end = np.append(begin[1:], len(c["row"])) - 1
        total = {k: np.append(0, np.cumsum(c[k], dtype=np.int64)) for k in ("words", "size")}
        words, size = (total[k][end + 1] - total[k][begin] for k in ("words", "size"))
        apart = np.append(0, np.cumsum(c["row"] != c["hrow"]))
        factor = np.where(apart[end + 1] > apart[begin], 1, 2)
        ok = (words >= factor * least_words) | (size >= factor * least_bytes)
        begin, end = begin[ok], end[ok]
        start = c["pos"][begin].astype(np.int64)
        columns = [
            pa.array(c["row"][begin]),
            pa.array(c["doc"][begin], mask=c["none"][begin]),
            pa.array(start),
            pa.array(start + size[ok]),
            pa.array(words[ok]),
            pa.array((end - begin + 1).astype(np.int64)),
            pa.array(c["hdoc"][begin], mask=c["hnone"][begin]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_names(PASSAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: tk.take(batch, k).to_numpy(zero_copy_only=False) for k in names}
            if open_ is not None:
                c = {k: np.append(open_[k], v) for k, v in c.items()}
            n = len(c["row"])
            new = np.ones(n, bool)
            new[1:] = (c["row"][1:] != c["row"][:-1]) | (c["pos"][1:] != c["pos"][:-1] + c["size"][:-1])
            inside = np.flatnonzero(c["row"] == c["hrow"])
            if len(inside) > 1:
                shift, segment = (c["pos"] - c["hpos"])[inside], np.cumsum(new)[inside]
                new[inside[1:][(shift[1:] != shift[:-1]) & (segment[1:] == segment[:-1])]] = True
            begin = np.flatnonzero(new)
            open_ = {k: v[begin[-1] :] for k, v in c.items()}
            yield passages({k: v[: begin[-1]] for k, v in c.items()}, begin[:-1])
        if open_ is not None:
            yield passages(open_, np.zeros(1, np.int64))

    return run


def _passages(numbered: DataFrame, least_words: int, least_bytes: int, block_bytes: int) -> DataFrame:
    """PASSAGES of a table (doc_id, row, text)."""
    chunks = Scratch(numbered.sparkSession, "substring-dedup").save(numbered.mapInArrow(_chunks(block_bytes), CHUNKS))
    place = ("none", "doc", "row", "pos")
    firsts = chunks.where("hi is not null").select("hi", "lo", *place, "size", "words")
    apart = firsts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", *place).mapInArrow(_repeats, REPEATS)
    near = chunks.where("hi is null").select(*_names(REPEATS))
    return apart.unionByName(near).repartition("row").sortWithinPartitions("row", "pos").mapInArrow(_join_runs(least_words, least_bytes), PASSAGES)


def repeated_passages(documents: DataFrame, least_words: int = PASSAGE_WORDS, least_bytes: int = PASSAGE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_words, n_chunks, first_doc_id): one row for each passage of a document
    whose chunks stand before, in a document of a smaller id or earlier in the same text; ``first_doc_id`` is
    a document that holds its first chunk before.

    Offsets are of UTF-8 bytes; ``n_words`` are the words that begin in the passage. A passage has
    ``least_words`` of them or ``least_bytes``, and twice that if no other row holds any of it. Null and empty texts have no chunks. Rows that repeat an id
    are rows of their own, each held against those before; rows without id come after all others and their
    passages come without one. Other columns are not read, so any names are allowed. Nothing is left out for
    being frequent.
    """
    numbered = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return _passages(numbered, least_words, least_bytes, block_bytes).drop("row")


def remove_passages(documents: DataFrame, least_words: int = PASSAGE_WORDS, least_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """The documents, their texts without the passages that stand before; all rows and columns stay.

    Rows are numbered, so rows that share an id, or have none, lose what they themselves repeat. Null texts
    stay null. Columns may have any name.
    """
    columns = documents.columns
    row, spans = fresh(columns, "row", "spans")
    numbered = Scratch(documents.sparkSession, "passages").save(documents.withColumn(row, F.monotonically_increasing_id()))
    found = _passages(numbered.select("doc_id", F.col(row).alias("row"), "text"), least_words, least_bytes, BLOCK_BYTES)
    of_row = found.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, own in zip(tk.take(batch, "text").to_pylist(), tk.take(batch, spans).to_pylist()):
                if t and own:
                    raw, last, parts = t.encode(), 0, []
                    for s in own:
                        parts.append(raw[last : s["start_byte"]])
                        last = s["end_byte"]
                    t = b"".join([*parts, raw[last:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else tk.take(batch, c) for c in columns], names=columns)

    return numbered.join(of_row, row, "left").select(*columns, spans).mapInArrow(run, documents.schema)

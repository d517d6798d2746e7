"""Token-id output in grammar-compressed files, with random access.

A file holds consecutive documents of one shard. Re-Pair replaces frequent pairs of neighbouring ids by
nonterminals, round after round, until none is frequent enough; no pair spans two documents. Rules come
with their expansion lengths and documents with their first symbol, so any document, or any range of
ids in it, is decoded alone.

Layout, little-endian: magic ``RPR1``, six uint32 (documents, terminals, rules, symbols, tokens,
reserved); doc ids int64 and their null flags uint8; each document's tokens uint32 and first symbol
uint32 (one more, the end); each rule's left and right symbol uint32 and expansion length uint32; the
symbols uint16 if all fit, else uint32.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch

MAGIC = b"RPR1"
END_ID = 1
#: Tokens after which a file is closed; a longer document is a file of its own.
FILE_TOKENS = 1 << 19
#: How often a pair must occur to be replaced: a rule takes 12 bytes and a replaced pair saves 2. A round
#: takes the most frequent pairs first and leaves the others to later rounds.
LEAST_COUNT, ROUND_RULES = 8, 4096
#: Most remembered words of a Python worker.
CACHE_ENTRIES = 1_500_000
_BITS = 18


def _frequent_pairs(symbols: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, ascending, the places where one begins, and which it is."""
    cell = (symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - _BITS)
    enough = np.bincount(cell, minlength=1 << _BITS) >= LEAST_COUNT
    place = np.flatnonzero(enough[cell] & ~closed[:-1])
    base = tk.U64(int(symbols.max()) + 1)
    values, _, inverse, counts = tk.grouped(symbols[place].astype(tk.U64) * base + symbols[place + 1])
    often = np.flatnonzero(counts >= LEAST_COUNT)
    if len(often) > ROUND_RULES:
        often = np.sort(often[np.lexsort((values[often], -counts[often]))[:ROUND_RULES]])
    number = np.full(len(values), -1)
    number[often] = np.arange(len(often))
    which = number[inverse]
    chosen = np.stack([values[often] // base, values[often] % base], axis=1).astype(np.int64)
    return chosen, place[which >= 0], which[which >= 0]


def repair(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), their expansion lengths, the symbols and the documents' symbol bounds.

    ``ends``: the number of ids up to each document's end, ascending.
    """
    symbols = ids.astype(np.uint32)
    closed = np.zeros(len(symbols), bool)
    closed[ends[ends > 0] - 1] = True
    rules, lengths = np.zeros((0, 2), np.int64), np.ones(terminals, np.int64)
    while len(symbols) > 1:
        chosen, place, which = _frequent_pairs(symbols, closed)
        if not len(chosen):
            break
        # Of overlapping pairs in a row, each second one waits for the next round.
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1] + 1
        first = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        taken = (np.arange(len(place)) - first) % 2 == 0
        place = place[taken]
        used = np.bincount(which[taken], minlength=len(chosen)) > 0
        number = (np.cumsum(used) - 1)[which[taken]]
        base = terminals + len(rules)
        pairs = chosen[used]
        rules = np.concatenate([rules, pairs])
        lengths = np.append(lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]])
        symbols[place] = (base + number).astype(np.uint32)
        closed[place] = closed[place + 1]
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        symbols, closed = symbols[stay], closed[stay]
    filled = np.diff(np.append(0, ends)) > 0
    bounds = np.zeros(len(ends) + 1, np.int64)
    stops = np.flatnonzero(closed) + 1
    bounds[1:] = np.append(0, stops)[np.cumsum(filled)]
    return rules, lengths[terminals:], symbols, bounds


def write_file(doc_ids: list[int | None], lists: list[np.ndarray], terminals: int) -> bytes:
    counts = np.array([len(x) for x in lists], np.int64)
    ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    rules, lengths, symbols, bounds = repair(ids, np.cumsum(counts), terminals)
    kind = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    head = np.array([len(doc_ids), terminals, len(rules), len(symbols), len(ids), 0], "<u4")
    parts = [head, np.array([0 if x is None else x for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), counts.astype("<u4"), bounds.astype("<u4"), rules.astype("<u4").reshape(-1), lengths.astype("<u4"), symbols.astype(kind)]
    return MAGIC + b"".join(x.tobytes() for x in parts)


class TokenFile:
    """A file's documents, decoded on demand."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        self._blob, self._at = blob, 4
        n, terminals, n_rules, n_symbols, self.n_tokens, _ = (int(x) for x in self._read("<u4", 6))
        keys, empty = self._read("<i8", n), self._read(np.uint8, n)
        self.doc_ids = [None if e else int(k) for k, e in zip(keys, empty)]
        self.counts, self.bounds = self._read("<u4", n).astype(np.int64), self._read("<u4", n + 1).astype(np.int64)
        self.rules = self._read("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2)
        lengths = self._read("<u4", n_rules).astype(np.int64)
        self.symbols = self._read("<u2" if terminals + n_rules <= 1 << 16 else "<u4", n_symbols).astype(np.int64)
        self.lengths = np.append(np.ones(terminals, np.int64), lengths)
        self.begin = np.append(np.arange(terminals), terminals + np.cumsum(lengths) - lengths)
        self.flat = np.append(np.arange(terminals), np.zeros(int(lengths.sum()), np.int64))
        # Rules in a row that use none of each other are expanded together.
        most, k = np.maximum.accumulate(self.rules.max(axis=1, initial=0)), 0
        while k < n_rules:
            stop = int(np.searchsorted(most, terminals + k))
            to = int(self.begin[terminals + k])
            self.flat[to : to + int(lengths[k:stop].sum())] = self.expand(self.rules[k:stop].reshape(-1))
            k = stop

    def _read(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._blob, kind, n, self._at)
        self._at += out.nbytes
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.begin[symbols], n) + offset]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.bounds[i] : self.bounds[i + 1]])

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop - 1 of document i, expanding only the symbols that hold them."""
        own = self.symbols[self.bounds[i] : self.bounds[i + 1]]
        until = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(until, start, "right"), np.searchsorted(until, stop, "left") + 1
        skipped = int(until[a - 1]) if a else 0
        return self.expand(own[a:b])[start - skipped : stop - skipped]


class WordTokenizer:
    """The tokenizers library's ids, remembered by word.

    The vocabulary's normaliser and pre-tokens never act across white space, so a text's ids are those of
    its words in a row, and of their parts where ``_parts`` cuts them. Words are known by 64-bit hashes
    of their bytes, words of ASCII and Latin-1 letters alone with their case folded: before a combining
    mark the case matters, for marks are composed before letters are lowered and some letters have a
    composed form in one case only. Unknown words are encoded many in one call. Those of ASCII and Latin-1
    letters are one pre-token each, so they end where an id ends a pre-token; others are told apart by a
    mark that is a pre-token of one id. Texts with that mark or what may be a special token go through the library
    whole.
    """

    _mark = "\x01"

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's idle threads would spin
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.terminals = self.library.get_vocab_size(with_added_tokens=True)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.terminals, bool)
        self.last[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        (self.mark_id,) = self._ids(self._mark)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begin, self.length = np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, none with the mark, and how many each has."""
        ids = np.array(self._ids(f" {self._mark} ".join([*words, ""])), np.int32)
        return ids[ids != self.mark_id], np.diff(np.flatnonzero(ids == self.mark_id), prepend=-1) - 1

    def _lettered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_marked``, of words of letters alone."""
        ids = np.array(self._ids(" ".join(words)), np.int32)
        last = np.flatnonzero(self.last[ids])
        if len(last) != len(words) or last[-1] + 1 != len(ids):  # a vocabulary that ends words in another way
            return self._marked(words)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words, in ascending order of their hashes; one that holds the mark as nothing, for its text goes
        another way."""
        words = ["" if self._mark in w else w for w in words]
        lettered = np.array([_LETTERS(w) is not None for w in words])
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for encode, places in ((self._lettered, np.flatnonzero(lettered)), (self._marked, np.flatnonzero(~lettered))):
            for i in range(0, len(places), 1000):
                own = places[i : i + 1000]
                ids, n = encode([words[j] for j in own.tolist()])
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.append(self.flat[: self.used], np.zeros(len(ids) + self.used, np.int32))
                self.flat[self.used : self.used + len(ids)] = ids
                begin[own], length[own] = self.used + np.cumsum(n) - n, n
                self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begin = np.insert(self.begin, at, begin)
        self.length = np.insert(self.length, at, length)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        here = np.minimum(at, max(0, len(self.hashes) - 1))
        return here, self.hashes[here] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def encode(self, piece: tk.Piece) -> list[np.ndarray]:
        """The ids of each text of a piece, END_ID last."""
        start, end, text = _parts(piece)
        hashes, first, inverse, _ = tk.grouped(piece.span_hash(_folded(piece, start, end).prefix(), start, end))
        at, known = self._places(hashes)
        if not known.all():
            if len(self.hashes) + len(hashes) > CACHE_ENTRIES:
                self._forget()
                known[:] = False
            raw, new = piece.buf.tobytes(), np.flatnonzero(~known)
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            at, known = self._places(hashes)
        n = self.length[at][inverse]
        before = np.cumsum(n) - n
        out = np.full(int(n.sum()) + piece.n, END_ID, np.int32)
        offset = np.arange(n.sum()) - np.repeat(before, n)
        out[np.repeat(before + text, n) + offset] = self.flat[np.repeat(self.begin[at][inverse], n) + offset]
        bounds = np.append(0, np.cumsum(np.bincount(text, n, minlength=piece.n).astype(np.int64) + 1))
        lists = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        special = np.flatnonzero(piece.buf == 1)
        if len(piece.buf) > 1:
            special = np.append(special, np.flatnonzero((piece.buf[:-1] == 0x3C) & (piece.buf[1:] == 0x7C)))
        for i in np.unique(piece.text_of(special)).tolist():
            whole = piece.buf[piece.offs[i] : piece.offs[i + 1]].tobytes().decode()
            lists[i] = np.array([*self._ids(whole), END_ID], np.int32)
        return lists


#: Words that normalising and lowering leave letters, which are one pre-token.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: ASCII letters and digits; signs of ASCII but for the apostrophe, which may begin a pre-token with letters; the
#: second bytes of letters from U+00C0 to U+00FF.
_ALNUM = tk.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)])
_SIGN = tk.byte_class([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
_LATIN = tk.byte_class([(0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)])
_LATIN_UPPER = tk.byte_class([(0x80, 0x96), (0x98, 0x9E)])


def _parts(piece: tk.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, cut between a letter or digit and an ASCII sign other than the apostrophe. There a pre-token ends,
    and nothing is composed with an ASCII character before which a cut is. Far fewer parts than words differ."""
    start, end, text = piece.words(tk.NON_SPACE)
    b = piece.buf
    if len(b) < 2:
        return start, end, text
    alnum, sign = _ALNUM[b], _SIGN[b]
    before = alnum.copy()
    before[1:] |= (b[:-1] == 0xC3) & _LATIN[b[1:]]
    cut = np.flatnonzero(before[:-1] & sign[1:] | sign[:-1] & alnum[1:]) + 1
    bounds = np.zeros((2, len(b) + 1), bool)
    for own, at in zip(bounds, (start, end)):
        own[at] = own[cut] = True
    start, end = map(np.flatnonzero, bounds)
    return start, end, piece.text_of(start)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(piece: tk.Piece, start: np.ndarray, end: np.ndarray) -> tk.Piece:
    """The piece with A-Z, and U+00C0 to U+00DE, folded in words of characters below U+0080 or from U+00C0 to U+00FF
    alone, among which there are no marks."""
    b, buf = piece.buf, _LOWER[piece.buf]
    wide = b >= 0x80
    if wide.any():
        second = np.append(False, b[:-1] == 0xC3)
        buf[second & _LATIN_UPPER[b]] += 32
        other = np.append(0, np.cumsum(wide & (b != 0xC3) & ~second, dtype=np.int64))
        at = np.flatnonzero(buf != b)
        word = np.searchsorted(start, at, "right") - 1
        at = at[other[end[word]] > other[start[word]]]
        buf[at] = b[at]
    return tk.Piece(piece.first, buf, piece.offs)


_made: dict[str, WordTokenizer] = {}


def _tokenizer(definition) -> WordTokenizer:
    key = hashlib.sha256(definition.value.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = WordTokenizer(definition.value)
    return _made[key]


FILES = "part int, seq int, start long, n_tokens long, payload binary"


def token_files(documents: DataFrame, path: str, scratch: Scratch, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """(part, seq, start, n_tokens, payload): the files of all documents, written and ready to be read.

    Files follow (part, seq) in ascending doc_id order, null ids first; rows that repeat an id are
    ordered by their text. ``start``: the tokens before the file in its part. A null or empty text has
    the end id alone. A file is one row of a Parquet table in the shared folder, its bytes in
    ``payload``. ``path``: a definition of the tokenizers library that the driver can read.
    """
    definition = documents.sparkSession.sparkContext.broadcast(Path(path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _tokenizer(definition), TaskContext.get().partitionId()
        keys, lists, held, seq, start = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": start, "n_tokens": held, "payload": write_file(keys, lists, coder.terminals)}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            names = tk.take(batch, "doc_id").to_pylist()
            for piece in tk.pieces(tk.take(batch, "text")):
                for key, ids in zip(names[piece.first : piece.first + piece.n], coder.encode(piece)):
                    if keys and held + len(ids) > file_tokens:
                        yield close()
                        seq, start, held, keys, lists = seq + 1, start + held, 0, [], []
                    keys.append(key)
                    lists.append(ids)
                    held += len(ids)
        if keys:
            yield close()

    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return scratch.save(ordered.select("doc_id", "text").mapInArrow(run, FILES))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), each document decoded from its file.

    The tokens before a part are summed over a table of one row for each part, which goes to every task.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(tk.take(batch, "first").to_pylist(), tk.take(batch, "payload")):
                f = TokenFile(blob.as_py())
                crc = [zlib.crc32(f.document(i).astype("<u4").tobytes()) for i in range(len(f.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(first + np.cumsum(f.counts) - f.counts, pa.int64()), pa.array(f.counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("start")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Language-model scoring by cross-entropy difference.

Two bigram models with the same vocabulary, order and smoothing: a target model counted on trusted
documents and a background model counted on the whole corpus. A document's score is the mean, over its
tokens, of the target's loss less the background's; the lower, the more it resembles the target. No model
counts the document that it scores: its own counts are taken off first.

Neither model is ever in one place. Texts are gathered where they lie into bundles of bounded size, as numbers of
words, and only ids are joined with labels. A bundle sends each word and word pair that it holds, once, with
its counts, to one of the slices of the vocabulary; the slice sums them up and sends each bundle the sums of
what it holds. Words and pairs are told apart by hashes whose
bits grow with the corpus, and so does the number of slices; so a task holds a bundle or a slice, whatever the
size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from . import textkit as tk
from .scratch import Scratch

#: Bytes of text of a bundle (a longer one alone), and of corpus for each slice of the vocabulary.
BUNDLE_BYTES, SLICE_BYTES = 4 << 20, 8 << 20
LEAST_SLICES = 16
#: Pseudo-tokens of each context that follow the unigram, and its share that goes to all words alike.
PAIR_PRIOR, UNIFORM = 20.0, 0.05


def hash_bits(n_bytes: int) -> int:
    """Bits of a word's or pair's hash for a corpus of so many bytes: four thousand values for each byte."""
    return min(63, max(40, n_bytes.bit_length() + 12))


def pack(x: np.ndarray) -> bytes:
    """An array, byte planes apart, compressed: the high bytes of small numbers take no room."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


class Tokens:
    """Word hashes of some texts, in a row. ``text``: each token's text; ``first``: whether it is its first."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, bits: int):
        self.lengths, self.bits = lengths, bits
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.first = np.zeros(len(words), bool)
        self.first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        self.vocabulary, self.word = np.unique(words, return_inverse=True)
        before = np.where(self.first, tk.U64(0), np.append(tk.U64(0), words[:-1]))
        hashes = tk.mix(before * tk.NGRAM[7] + words * tk.NGRAM[8]) >> tk.U64(64 - bits)
        self.pairs, self.pair = np.unique(hashes, return_inverse=True)


def words_of(piece: tk.Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a piece's texts, without case of A-Z, and how many each text has."""
    start, end, text = piece.words(tk.NON_SPACE)
    hashes = tk.mix(piece.span_hash(piece.prefix(tk.FOLDED_VALUES), start, end)) >> tk.U64(64 - bits)
    return hashes, np.bincount(text, minlength=piece.n)


BUNDLES = "bundle long, ids array<long>, lengths array<int>, payload binary"


def _bundles(bits: int, bundle_bytes: int):
    """A bundle's ids and numbers of tokens, and its tokens as numbers of words of its own vocabulary."""

    def close(number: int, ids: pa.Array, words: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        vocabulary, word = np.unique(words, return_inverse=True)
        parts = pack_sorted(vocabulary), pack(word.astype("<u4"))
        payload = len(parts[0]).to_bytes(4, "little") + b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=_names(BUNDLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def close_parts() -> pa.RecordBatch:
            ids, *others = zip(*parts)
            return close(number, pa.concat_arrays(ids), *map(np.concatenate, others))

        for batch in batches:
            ids = tk.take(batch, "doc_id").cast(pa.int64())
            for piece in tk.pieces(tk.take(batch, "text"), min(tk.PIECE_BYTES, bundle_bytes)):
                parts.append((ids.slice(piece.first, piece.n), *words_of(piece, bits)))
                held += len(piece.buf)
                if held >= bundle_bytes:
                    yield close_parts()
                    number, held, parts = number + 1, 0, []
        if parts:
            yield close_parts()

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


#: A bundle's rows, in the order of ``slice``: its texts (-2), the numbers of those trusted (-1), sums of slices.
PARTS = "bundle long, slice int, ids array<long>, lengths array<int>, payload binary, chosen array<int>, words int, counts binary, target binary"


def _gathered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, list, Tokens, np.ndarray, list[tuple]]]:
    """Each bundle of rows ordered by bundle and slice: number, ids, tokens, which texts are trusted, its sums."""
    own, chosen, rows = None, None, []

    def opened() -> tuple:
        number, ids, lengths, payload = own
        size = int.from_bytes(payload[:4], "little")
        words = unpack_sorted(payload[4 : 4 + size])[unpack(payload[4 + size :], "<u4")]
        trusted = np.zeros(len(lengths), bool)
        trusted[chosen or []] = True
        return number, ids, Tokens(words, np.array(lengths, np.int64), bits), trusted, rows

    for batch in batches:
        for number, k, ids, lengths, payload, marks, *sums in zip(*(tk.take(batch, c).to_pylist() for c in _names(PARTS))):
            if k == -2:
                if own is not None:
                    yield opened()
                own, chosen, rows = (number, ids, lengths, payload), None, []
            elif k == -1:
                chosen = marks
            else:
                rows.append(tuple(sums))
    if own is not None:
        yield opened()


GRAMS = "bundle long, slice int, words int, grams binary, counts binary, target binary"


def _grams(bits: int, slices: int):
    """For each slice the distinct words, then pairs, that a bundle holds, and how often in all and in trusted
    texts."""
    bounds = np.array([(k << bits) // slices for k in range(slices)] + [1 << bits], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, t, trusted, _ in _gathered(batches, bits):
            weight, rows = trusted[t.text].astype(float), []
            both = (t.word, t.vocabulary), (t.pair, t.pairs)
            cuts = [np.searchsorted(v, bounds) for _, v in both]
            counts = [np.bincount(x, minlength=len(v)).astype("<u4") for x, v in both]
            target = [np.bincount(x, weight, minlength=len(v)).astype("<u4") for x, v in both]
            for k in range(slices):
                a, b = (slice(int(c[k]), int(c[k + 1])) for c in cuts)
                if a.stop > a.start or b.stop > b.start:
                    grams = pack_sorted(t.vocabulary[a]), pack_sorted(t.pairs[b])
                    rows.append((number, k, a.stop - a.start, len(grams[0]).to_bytes(4, "little") + b"".join(grams), *(pack(np.append(x[0][a], x[1][b])) for x in (counts, target))))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_names(GRAMS))

    return run


TOTALS = "bundle long, slice int, words int, counts binary, target binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bundle and slice the corpus sums of what the bundle holds, in the order it came in; and for
    each slice a row without bundle with the number of its distinct words. Rows come ordered by slice."""
    names = _names(TOTALS)

    def finish(number: int, rows: list[tuple]) -> pa.RecordBatch:
        out = [[], []]
        for kind in range(2):  # words, pairs
            grams = np.concatenate([r[1][kind] for r in rows])
            values, inverse = np.unique(grams, return_inverse=True)
            for k in range(2):  # all, trusted
                total = np.bincount(inverse, np.concatenate([r[2 + k][kind] for r in rows]), minlength=len(values)).astype("<u8")[inverse]
                out[k].append(np.split(total, np.cumsum([len(r[1][kind]) for r in rows])[:-1]))
        words = len(np.unique(np.concatenate([r[1][0] for r in rows])))
        columns = [pa.array([r[0] for r in rows] + [None], pa.int64()), pa.array([number] * (len(rows) + 1), pa.int32()), pa.array([len(r[1][0]) for r in rows] + [words], pa.int32())]
        columns += [pa.array([pack(np.append(a, b)) for a, b in zip(*x)] + [None], pa.binary()) for x in out]
        return pa.RecordBatch.from_arrays(columns, names=names)

    slice_, rows = None, []
    for batch in batches:
        for bundle, k, n, grams, counts, target in zip(*(tk.take(batch, c).to_pylist() for c in ("bundle", "slice", "words", "grams", "counts", "target"))):
            if k != slice_ and rows:
                yield finish(slice_, rows)
                rows = []
            slice_ = k
            size = int.from_bytes(grams[:4], "little")
            both = unpack_sorted(grams[4 : 4 + size]), unpack_sorted(grams[4 + size :])
            rows.append((bundle, both, *(np.split(unpack(x, "<u4"), [n]) for x in (counts, target))))
    if rows:
        yield finish(slice_, rows)


SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double, selected boolean"


class Sizes:
    """Of all and of trusted documents: tokens and texts with tokens; and the words of the vocabulary."""

    def __init__(self, tokens: tuple[int, int], texts: tuple[int, int], words: int):
        self.tokens, self.texts, self.words = tokens, texts, words


def losses(t: Tokens, counts: tuple[np.ndarray, np.ndarray], tokens: int, texts: int, words: int, scale: float, without: np.ndarray) -> np.ndarray:
    """Each token's loss in nats under the model of these counts of the bundle's words and pairs, scaled.
    ``without``: of these texts the own counts are taken off first."""
    off = without[t.text].astype(float)
    single, pair = (c[x] - off * own_counts(t, x, len(c)) for c, x in zip(counts, (t.word, t.pair)))
    before = np.where(t.first, texts - off, np.append(0.0, single[:-1])) * scale
    single, pair = single * scale, pair * scale
    total = np.maximum((tokens - without * t.lengths) * scale, 1.0)[t.text]
    base = (1 - UNIFORM) * single / total + UNIFORM / max(1, words)
    return -np.log((np.minimum(pair, before) + PAIR_PRIOR * base) / (before + PAIR_PRIOR))


def own_counts(t: Tokens, x: np.ndarray, n: int) -> np.ndarray:
    """For each token, how often its text holds its word (or pair)."""
    _, inverse, counts = np.unique(t.text * np.int64(max(1, n)) + x, return_inverse=True, return_counts=True)
    return counts[inverse]


def _scores(sizes: Sizes, bits: int, cut: float):
    """Rows come ordered by bundle and slice, a bundle's texts first."""

    scale = sizes.tokens[1] / sizes.tokens[0] if sizes.tokens[1] else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, t, trusted, rows in _gathered(batches, bits):
            sums = [[np.concatenate([np.split(unpack(r[k], "<u8"), [r[0]])[kind] for r in rows] or [np.zeros(0)]).astype(float) for kind in range(2)] for k in (1, 2)]
            n, everyone = np.maximum(t.lengths, 1), np.ones(len(ids), bool)
            background = losses(t, sums[0], sizes.tokens[0], sizes.texts[0], sizes.words, scale, everyone)
            target = losses(t, sums[1], sizes.tokens[1], sizes.texts[1], sizes.words, 1.0, trusted) if sizes.tokens[1] else background
            a, b = (np.bincount(t.text, x, minlength=len(ids)) / n for x in (target, background))
            columns = [pa.array(ids, pa.int64()), pa.array(t.lengths), pa.array(a), pa.array(b), pa.array(a - b), pa.array((t.lengths > 0) & (a - b <= cut))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(SCHEMA))

    return run


def score(documents: DataFrame, labels: DataFrame, cut: float = 0.0, bundle_bytes: int = BUNDLE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: tokens, mean losses in nats, their difference and whether it is at most ``cut``.

    The background counts every row; the target every document with label ``quality`` 1. Without any, the
    two are one and all differences 0. A null or empty text has no tokens, losses of 0 and is not selected.
    Ids may be null, which is never trusted, or repeat, and then each row has its own score; other columns
    are not read.
    """
    scratch = Scratch(documents.sparkSession, "lm-score")
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, slices = hash_bits(n_bytes), max(LEAST_SLICES, -(-n_bytes // slice_bytes))
    bundles = scratch.save(documents.select("doc_id", "text").mapInArrow(_bundles(bits, bundle_bytes), BUNDLES))
    each = bundles.select("bundle", F.posexplode(F.arrays_zip("ids", "lengths")).alias("i", "x")).select("bundle", "i", F.col("x.ids").alias("doc_id"), F.col("x.lengths").alias("n"))
    chosen = scratch.save(each.where("doc_id is not null").join(samples.trusted(labels).hint("shuffle_hash"), "doc_id", "left_semi"))
    of_all = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    of_trusted = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    none = documents.sparkSession.createDataFrame([], PARTS)
    marks = chosen.groupBy("bundle").agg(F.collect_list("i").alias("chosen")).withColumn("slice", F.lit(-1))
    texts = none.unionByName(bundles.withColumn("slice", F.lit(-2)), allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    gathered = lambda parts: parts.repartition("bundle").sortWithinPartitions("bundle", "slice")
    grams = gathered(texts).mapInArrow(_grams(bits, slices), GRAMS)
    sums = scratch.save(grams.repartition("slice").sortWithinPartitions("slice", "bundle").mapInArrow(_sums, TOTALS))
    words = sums.where("bundle is null").agg(F.sum("words")).first()[0] or 0
    model = Sizes((of_all[0], of_trusted[0]), (of_all[1], of_trusted[1]), int(words))
    parts = texts.unionByName(sums.where("bundle is not null"), allowMissingColumns=True)
    return gathered(parts).mapInArrow(_scores(model, bits, cut), SCHEMA)

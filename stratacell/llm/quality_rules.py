"""Quality rules: counts of repetition and symbols, and a hashed n-gram likelihood ratio.

Words and word pairs fall into a fixed number of hash buckets. One multinomial over the buckets is
counted from trusted documents, one from the whole corpus; a document's score is the mean log ratio of
its n-grams, and every document is kept or not by one threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, samples
from . import textkit as tk
from .scratch import Scratch

BUCKET_BITS = 18
#: Parts of 1, and of so many each way, in which the scores of labelled documents are counted for the threshold.
CELLS, MOST = 1024, 64
#: Without labelled documents of both classes: the least mean log ratio of a kept document.
THRESHOLD = -1.0
#: Pseudo-counts of the target for each bucket, dealt out as the corpus is.
SMOOTHING = 0.5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
NEWLINE = np.arange(256) == 10


class Words:
    """The words of a piece and the buckets of its n-grams."""

    def __init__(self, piece: tk.Piece):
        self.start, self.end, self.text = piece.words(tk.NON_SPACE)
        self.prefix = piece.prefix()
        self.hash = piece.span_hash(self.prefix, self.start, self.end)
        self.bounds = tk.group_bounds(self.text, piece.n)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text number of every word and word pair, text by text within each of the two."""
        pairs, at = tk.ngrams(self.hash, self.text, 2)
        both = np.concatenate([tk.mix(self.hash), pairs]) >> tk.U64(64 - BUCKET_BITS)
        return both.astype(np.int64), np.concatenate([self.text, self.text[at]])


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[offs[1:]] - total[offs[:-1]]


def _later_equal_lines(piece: tk.Piece, words: Words) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line."""
    n = len(piece.buf)
    breaks = np.flatnonzero(NEWLINE[piece.buf])
    start = np.unique(np.concatenate([piece.offs[:-1][np.diff(piece.offs) > 0], breaks + 1]))
    start = start[start < n]
    owner = piece.text_of(start)
    stop = np.append(breaks, n)[np.searchsorted(breaks, start)]
    stop = np.minimum(stop, piece.offs[owner + 1])
    full = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop, owner = start[full], stop[full], owner[full]
    h = piece.span_hash(words.prefix, start, stop)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=piece.n)


def _repeated_words(piece: tk.Piece, words: Words) -> np.ndarray:
    """For each text, its words that stand in a 5-word window found more than once in it."""
    grams, at = tk.ngrams(words.hash, words.text, 5)
    if not len(at):
        return np.zeros(piece.n, np.int64)
    owner = words.text[at]
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    cover = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(cover, at[repeated], 1)
    np.add.at(cover, at[repeated] + 5, -1)
    return _sums(np.cumsum(cover[:-1]) > 0, words.bounds)


def base_rules(piece: tk.Piece, words: Words) -> dict[str, np.ndarray]:
    n = np.diff(words.bounds)
    repeated = _repeated_words(piece, words)
    return {
        "n_words": n,
        "word_chars": _sums((tk.NON_SPACE & NOT_CONTINUATION)[piece.buf], piece.offs),
        "n_symbols": _sums(SYMBOLS[piece.buf], piece.offs),
        "n_dup_lines": _later_equal_lines(piece, words),
        "n_repeat_words": repeated,
        "base_failed": (n < 10) | (100 * repeated > 20 * n),
    }


def scores(piece: tk.Piece, words: Words, ratios: np.ndarray) -> np.ndarray:
    """Each text's mean log ratio over its n-grams; 0 without words."""
    bucket, owner = words.buckets()
    n = np.bincount(owner, minlength=piece.n)
    return np.bincount(owner, ratios[bucket], minlength=piece.n) / np.maximum(n, 1)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the target multinomial, smoothed towards the raw one, to that. A bucket that the corpus
    lacks has ratio 0."""
    share = raw / max(1, raw.sum())
    weight = SMOOTHING * len(raw)
    mixed = (target + weight * share) / (target.sum() + weight)
    return np.log(np.where(raw > 0, mixed, 1) / np.where(raw > 0, share, 1))


class Model:
    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios.astype(np.float32), threshold


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of all and of trusted documents."""
    raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        trusted = tk.take(batch, "trusted").to_numpy(zero_copy_only=False).astype(bool)
        for piece in tk.pieces(tk.take(batch, "text")):
            bucket, owner = Words(piece).buckets()
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[trusted[piece.first + owner]], minlength=len(target))
    yield from counts.strands(raw, 0)
    yield from counts.strands(target, 1)


def score_without_own(bucket: np.ndarray, target: np.ndarray, raw: np.ndarray) -> float:
    """The mean log ratio of one trusted document's n-grams, its own counts taken off the target."""
    return float(scores_without_own(bucket, np.zeros(len(bucket), np.int64), 1, target, raw)[0])


def scores_without_own(bucket: np.ndarray, owner: np.ndarray, texts: int, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """``score_without_own`` of each of some texts; of one that is not trusted it means nothing."""
    key, n = np.unique(owner << np.int64(BUCKET_BITS) | bucket, return_counts=True)
    values, text = key & ((1 << BUCKET_BITS) - 1), key >> np.int64(BUCKET_BITS)
    size = np.bincount(owner, minlength=texts)
    share, weight = raw[values] / max(1, raw.sum()), SMOOTHING * len(raw)
    mixed = (np.maximum(target[values] - n, 0) + weight * share) / (np.maximum(target.sum() - size[text], 0) + weight)
    return np.bincount(text, n * np.log(mixed / share), minlength=texts) / np.maximum(size, 1)


def _judged(documents: DataFrame, labels: DataFrame, model: Model, target: np.ndarray, raw: np.ndarray) -> DataFrame:
    """(y, value): the label and the score of every labelled document that has a text."""
    sent = documents.sparkSession.sparkContext.broadcast((model, target, raw))  # 3 * 2**BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, target, raw = sent.value
        for batch in batches:
            ids = tk.take(batch, "doc_id")
            for piece in tk.pieces(tk.take(batch, "text")):
                words = Words(piece)
                out = scores(piece, words, m.ratios), scores_without_own(*words.buckets(), piece.n, target, raw)
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, piece.n), *map(pa.array, out)], names=["doc_id", "score", "alone"])

    scored = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, score double, alone double")
    y = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    return scored.join(y, "doc_id").select("y", F.when(F.col("y") == 1, F.col("alone")).otherwise(F.col("score")).alias("value"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Counts the corpus and the trusted documents (label ``quality`` 1) and fits the threshold.

    The corpus counts cover all rows, the target's every trusted document, the threshold's every labelled one.
    Trusted ones are scored without their own counts, as documents that nobody has judged will be. Scores that
    agree to a part of CELLS are not told apart by the threshold; the driver gets a row for each such part.
    """
    scratch = Scratch(documents.sparkSession, "quality-rules")
    partial = scratch.save(samples.with_trust(documents, labels).mapInArrow(_count, counts.SCHEMA))
    raw, target = counts.gather(partial, 1 << BUCKET_BITS, 2)
    scratch.drop(partial)
    model = Model(log_ratios(target, raw) if target.any() else np.zeros(1 << BUCKET_BITS), THRESHOLD)
    if not target.any():
        return model
    cell = F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("value"))) * CELLS)
    sums = _judged(documents, labels, model, target, raw).groupBy(cell.alias("cell")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    low, high, good, bad = np.array([tuple(x) for x in sums.orderBy("cell").drop("cell").collect()], float).reshape(-1, 4).T
    if good.sum() and bad.sum():
        model.threshold = best_cut(low, high, good, bad)
    return model


def best_threshold(value: np.ndarray, good: np.ndarray) -> float:
    """The cut with the highest sum of kept good and rejected bad shares, amid the values beside it."""
    order = np.argsort(value, kind="stable")
    value, good = value[order], good[order]
    return best_cut(value, value, good.astype(float), (~good).astype(float))


def best_cut(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """``best_threshold`` between groups of values, ascending, of which the ends and the numbers are known."""
    gain = np.append(0, np.cumsum(bad / bad.sum() - good / good.sum()))
    k = int(np.argmax(gain))
    if k in (0, len(low)):
        return float(low[0] - 1) if k == 0 else float(high[-1] + 1)
    return float((high[k - 1] + low[k]) / 2)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def apply(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document with its counts, its score and whether it is kept.

    A null or empty text has no words and fails the base rules. Ids may be null or repeat; other columns
    are not read. Nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids = tk.take(batch, "doc_id")
            for piece in tk.pieces(tk.take(batch, "text")):
                words = Words(piece)
                out = base_rules(piece, words)
                score = scores(piece, words, m.ratios)
                out |= {"score": score, "kept": ~out["base_failed"] & (score >= m.threshold)}
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, piece.n), *(pa.array(x) for x in out.values())], names=["doc_id", *out])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)

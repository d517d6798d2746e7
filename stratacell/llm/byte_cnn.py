"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of the whole document. It is cut into chunks that overlap by a
filter's width; each filter is max-pooled over a chunk, and the largest and the mean of the chunks'
maxima combine into one probability. As a filter's response is a sum of one value for each of its
bytes, scoring adds up rows of small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import samples
from . import textkit as tk

EMBED, WIDTH, FILTERS, STRIDE = 8, 6, 16, 2
#: Windows of a chunk: CHUNK * STRIDE bytes.
CHUNK = 512
#: The classifier is fitted on at most so many labelled documents of each class.
DOCS_PER_CLASS, EPOCHS, BATCH, RATE = 1200, 6, 32, 0.02
HELD_OUT = (4, 2)
THRESHOLD = 0.7
_BLOCK = 1 << 15


class Windows:
    """Window starts of a piece's texts, each text followed by zero bytes, and the chunks they form."""

    def __init__(self, piece: tk.Piece):
        length = np.diff(piece.offs)
        text = np.repeat(np.arange(piece.n), length)
        self.buf = np.zeros(len(piece.buf) + WIDTH * piece.n, np.uint8)
        self.buf[np.arange(len(piece.buf)) + WIDTH * text] = piece.buf
        n = -(-length // STRIDE)
        own = np.repeat(np.arange(piece.n), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = piece.offs[own] + WIDTH * own + STRIDE * inside
        self.chunk = np.flatnonzero(inside % CHUNK == 0)
        self.owner = own[self.chunk]
        self.chunks = np.bincount(self.owner, minlength=piece.n)


class ByteCnn:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "offset": np.zeros(1),
        }

    def tables(self) -> np.ndarray:
        return np.ascontiguousarray(np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"]), np.float32)

    def responses(self, w: Windows, tables: np.ndarray, first: int, last: int) -> np.ndarray:
        at = w.at[first:last]
        z = tables[0][w.buf[at]]
        for k in range(1, WIDTH):
            z += tables[k][w.buf[at + k]]
        return z

    def chunk_maxima(self, w: Windows, tables: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each chunk, before the bias."""
        out = np.zeros((len(w.chunk), FILTERS), np.float32)
        ends = np.append(w.chunk[1:], len(w.at))
        i = 0
        while i < len(w.chunk):
            j = max(i + 1, int(np.searchsorted(ends, w.chunk[i] + _BLOCK, "right")))
            z = self.responses(w, tables, w.chunk[i], ends[j - 1])
            out[i:j] = np.maximum.reduceat(z, w.chunk[i:j] - w.chunk[i], axis=0)
            i = j
        return out

    @staticmethod
    def pool(maxima: np.ndarray, w: Windows) -> np.ndarray:
        """Largest and mean chunk maximum of each text; zeros for an empty one."""
        out = np.zeros((len(w.chunks), 2 * FILTERS))
        full = np.flatnonzero(w.chunks)
        if len(full):
            begin = (np.cumsum(w.chunks) - w.chunks)[full]
            out[full, :FILTERS] = np.maximum.reduceat(maxima, begin, axis=0)
            out[full, FILTERS:] = np.add.reduceat(maxima, begin, axis=0) / w.chunks[full][:, None]
        return out

    def features(self, piece: tk.Piece, tables: np.ndarray) -> np.ndarray:
        w = Windows(piece)
        return self.pool(np.maximum(self.chunk_maxima(w, tables) + self.p["bias"], 0), w)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["offset"], -30, 30)))

    def gradients(self, piece: tk.Piece, y: np.ndarray) -> dict[str, np.ndarray]:
        w, tables = Windows(piece), self.tables()
        maxima, winner = np.zeros((len(w.chunk), FILTERS)), np.zeros((len(w.chunk), FILTERS), np.int64)
        ends = np.append(w.chunk[1:], len(w.at))
        for c, (a, b) in enumerate(zip(w.chunk.tolist(), ends.tolist())):
            z = self.responses(w, tables, a, b)
            best = z.argmax(0)
            maxima[c], winner[c] = z[best, np.arange(FILTERS)], a + best
        active = np.maximum(maxima + self.p["bias"], 0)
        pooled = self.pool(active, w)
        d = (self.probability(pooled) - y) / len(y)
        back = d[:, None] * self.p["out"]
        top = (active == pooled[w.owner, :FILTERS]).astype(float)
        ties = np.zeros((piece.n, FILTERS))
        np.add.at(ties, w.owner, top)
        top /= np.maximum(ties, 1)[w.owner]
        of_chunk = (back[w.owner, :FILTERS] * top + back[w.owner, FILTERS:] / w.chunks[w.owner][:, None]) * (active > 0)
        table_back = np.zeros((WIDTH, 256, FILTERS))
        columns = np.broadcast_to(np.arange(FILTERS), winner.shape)
        for k in range(WIDTH):
            np.add.at(table_back[k], (w.buf[w.at[winner] + k], columns), of_chunk)
        return {
            "embed": np.einsum("kbf,kef->be", table_back, self.p["filters"]),
            "filters": np.einsum("be,kbf->kef", self.p["embed"], table_back),
            "bias": of_chunk.sum(0),
            "out": pooled.T @ d,
            "offset": np.array([d.sum()]),
        }

    def train(self, texts: list[tuple[str, int]], seed: int = 6) -> ByteCnn:
        """Adam over shuffled batches; both classes weigh the same through repetition of the rarer."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in texts if y == v] for v in (0, 1)]
        if not all(by):
            return self
        moment, square, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        moment, square = moment
        n = max(map(len, by))
        for _ in range(EPOCHS):
            order = np.concatenate([np.stack([np.full(n, v), np.concatenate([rng.permutation(len(by[v])) for _ in range(-(-n // len(by[v])))])[:n]], 1) for v in (0, 1)])
            rng.shuffle(order)
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                column = pa.array([by[v][j] for v, j in own], pa.large_string())
                for piece in tk.pieces(column, 8 << 20):
                    step += 1
                    for k, g in self.gradients(piece, own[piece.first : piece.first + piece.n, 0]).items():
                        moment[k] = 0.9 * moment[k] + 0.1 * g
                        square[k] = 0.99 * square[k] + 0.01 * g * g
                        self.p[k] -= RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        return self


def fit(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> ByteCnn:
    """A network fitted on at most DOCS_PER_CLASS whole texts of each label; without labels of both
    classes it stays untrained and scores everything near one half."""
    return ByteCnn().train(samples.labelled_texts(documents, labels, "quality", DOCS_PER_CLASS, held_out))


def score(documents: DataFrame, model: ByteCnn, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of ``documents``.

    A null or empty text gets the score of an empty document. Ids may be null or repeat; other columns
    are not read. Nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # some 50 kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables()
        for batch in batches:
            ids = tk.take(batch, "doc_id")
            for piece in tk.pieces(tk.take(batch, "text"), 1 << 19):
                p = net.probability(net.features(piece, tables))
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, piece.n), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")

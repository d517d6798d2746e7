"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of N letters that span at most SPAN letters, the
product of their weights, DECAY for each letter skipped. Letters of every script count; signs inside a
word, invisible characters, marks and spaces between single letters are left out beforehand, digits and
signs that stand for letters are replaced; so inserted and gapped spellings still share most
subsequences with the insult.

Landmarks are pieces of words of the labelled sentences: those of toxic ones that tell them best from clean
ones. Landmark kernel values,
whitened, are the features of a linear machine, trained on the toxic sentences' windows nearest to the toxic
landmarks and on the clean ones' worst windows, of which each round adds more. A logistic curve, fitted to the machine's margins of the labelled texts, gives probabilities.
Features of a string are linear in its weighted subsequences, so the trained machine folds into one weight
for each subsequence, and a text is scored by table look-ups at every position: the largest sum over a
window of starts in one word. Subsequences are told apart by hashes of 2**TABLE_BITS values.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import samples
from . import textkit as tk

N, SPAN, DECAY = 4, 6, 0.7
#: Starts that one window sums up.
WINDOW = 6
LANDMARKS = 64
#: How many times as frequent in toxic texts a landmark from those is.
MORE = 20.0
#: The same of what the kernel takes for it, counted in so many texts of each class.
NEAR, NEAR_TEXTS = 5.0, 500
#: Letters of a landmark.
SIZES = (4, 5, 6, 7)
#: The machine is fitted on at most so many labelled documents of each class, and bytes of them.
DOCS_PER_CLASS, BYTES, ROUNDS = 2000, 16 << 20, 3
HELD_OUT = (3, 1)
THRESHOLD = 0.7
TABLE_BITS = 22

OFFSETS = [(o, DECAY ** (o[-1] - (N - 1))) for o in combinations(range(1, SPAN), N - 1)]
_SPACE = -1
_PLACES = (tk.constants(4, N) >> tk.U64(32)).astype(np.uint32) | np.uint32(1)
# Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def letter_of(point: int) -> int:
    """The code point of a character's letter without case and marks, _SPACE for white space, else 0."""
    ch = chr(point)
    if ch.isspace():
        return _SPACE
    ch = LOOKALIKES.get(ch, ch)
    base = unicodedata.normalize("NFKD", ch)[0].lower()[0]
    if ord(base) >= 0x530:  # beyond Latin, Greek and Cyrillic a decomposed letter is no longer itself
        base = ch.lower()[0]
    return ord(base) if base.isalpha() else 0


@functools.cache
def _letters_of_plane() -> np.ndarray:
    """letter_of for the first 2**16 code points."""
    return np.array([0 if 0xD800 <= c < 0xE000 else letter_of(c) for c in range(1 << 16)], np.int32)


#: A look-alike counts only beside a letter.
_SIGN = np.zeros(128, bool)
_SIGN[[ord(c) for c in LOOKALIKES]] = True


class Letters:
    """Letters of some texts: ``code``, ``unit`` (the word, or run of single letters) and ``text``."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), length)
        code = _letters_of_plane()[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            values, inverse = np.unique(points[far], return_inverse=True)
            code[far] = np.array([letter_of(int(v)) for v in values], np.int32)[inverse]
        first = np.zeros(len(points), bool)
        first[(np.cumsum(length) - length)[length > 0]] = True
        space = code == _SPACE
        is_sign = (points < 128) & _SIGN[np.minimum(points, 127)]
        sign = np.flatnonzero(is_sign)
        if len(sign):
            around = np.concatenate([[False], (code > 0) & ~is_sign, [False]])
            code[sign[~(around[sign] | around[sign + 2])]] = 0
        unit = np.cumsum(space | first)
        keep = code > 0
        self.code, unit, self.text = code[keep], unit[keep], text[keep]
        # Words that are single letters join the word before them if that is one too.
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(unit)))
        joins = np.zeros(len(begin), bool)
        joins[1:] = (size[1:] == 1) & (size[:-1] == 1) & (self.text[begin[1:]] == self.text[begin[:-1]])
        self.unit = np.repeat(np.cumsum(~joins), size)
        self.n = len(texts)

    @functools.cached_property
    def _placed(self) -> list[np.ndarray]:
        """Each letter's share in a subsequence's hash, for each of the N places."""
        h = tk.mix(self.code.astype(tk.U64) * tk.NGRAM[11]).astype(np.uint32)
        return [np.append(h, np.zeros(SPAN, np.uint32)) * m for m in _PLACES]

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each shape: hash at each start, whether it stays in the unit, and its weight."""
        n = len(self.code)
        unit = np.append(self.unit, np.full(SPAN, -1))
        inside = {d: unit[d : n + d] == self.unit for d in range(1, SPAN)}
        for offsets, weight in OFFSETS:
            c = self._placed[0][:n].copy()
            for k, d in enumerate(offsets, 1):
                c += self._placed[k][d : n + d]
            yield c >> np.uint32(32 - TABLE_BITS), inside[offsets[-1]], weight

    def shapes_at(self, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """As ``subsequences``, at some starts only."""
        last = len(self.code) - 1
        for offsets, weight in OFFSETS:
            c = self._placed[0][place]
            for k, d in enumerate(offsets, 1):
                c = c + self._placed[k][place + d]
            end = place + offsets[-1]
            yield c >> np.uint32(32 - TABLE_BITS), (end <= last) & (self.unit[np.minimum(end, last)] == self.unit[place]), weight

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and hash of each run of n letters inside a unit."""
        begin = np.flatnonzero(self.unit[: max(0, len(self.unit) - n + 1)] == self.unit[n - 1 :])
        return begin, tk.Piece.span_hash(self._prefix, begin, begin + n)

    @functools.cached_property
    def _prefix(self) -> np.ndarray:
        out = np.zeros(len(self.code) + 1, tk.U64)
        np.cumsum(tk.mix(self.code.astype(tk.U64) * tk.NGRAM[12]) * tk._power_table(tk.BASE, len(self.code)), dtype=tk.U64, out=out[1:])
        return out

    def window_sums(self, at_start: np.ndarray) -> np.ndarray:
        """Sum over WINDOW starts from each start on, within its unit."""
        total = np.append(0, np.cumsum(at_start, dtype=np.float64))
        stop = np.searchsorted(self.unit, self.unit, "right")
        return total[np.minimum(np.arange(len(at_start)) + WINDOW, stop)] - total[:-1]

    def responses(self, table: np.ndarray) -> np.ndarray:
        """The machine's response for the window from each letter on."""
        out = np.zeros(len(self.code), np.float32)
        for code, inside, weight in self.subsequences():
            out += np.float32(weight) * table[code] * inside
        return self.window_sums(out)


def features_of(run: str) -> dict[int, float]:
    """The weighted subsequences of one letter run."""
    out: dict[int, float] = {}
    for code, inside, weight in Letters([run]).subsequences():
        for c in code[inside].tolist():
            out[c] = out.get(c, 0.0) + weight
    return out


def without_copies(texts: list[str]) -> list[str]:
    """Texts of which at most one in four least 3-word hashes was seen before: a group of copies must not
    pass for evidence from many texts."""
    out, seen = [], [set(), set(), set(), set()]
    for piece in tk.pieces(pa.array(texts, pa.large_string())):
        start, end, text = piece.words(tk.NON_SPACE)
        grams, at = tk.ngrams(piece.span_hash(piece.prefix(), start, end), text, 3)
        bounds = tk.group_bounds(text[at], piece.n)
        for i in range(piece.n):
            own = grams[bounds[i] : bounds[i + 1]]
            least = [int(tk.mix(own ^ tk.NGRAM[k]).min()) if len(own) else (i, piece.first) for k in range(4)]
            if sum(h in s for h, s in zip(least, seen)) <= 1:
                out.append(texts[piece.first + i])
            for h, s in zip(least, seen):
                s.add(h)
    return out


def _chunks(texts: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """The texts some at a time, of ``most`` characters (a longer one alone)."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


class Frequencies:
    """In how many of some texts each run of n letters stands; hashes ascending."""

    def __init__(self, texts: list[str], n: int, least: int = 1):
        self.texts, self.n = texts, n
        hashes, counts = [], []
        for part in _chunks(texts):
            letters = Letters(part)
            begin, h = letters.runs(n)
            order = np.lexsort((letters.text[begin], h))
            h, text = h[order], letters.text[begin][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            values, found = np.unique(h[new], return_counts=True)
            hashes.append(values)
            counts.append(found)
        self.hashes, inverse = np.unique(np.concatenate(hashes or [np.zeros(0, tk.U64)]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate(counts or [np.zeros(0)]), minlength=len(self.hashes)).astype(np.int64)
        often = self.counts >= least
        self.hashes, self.counts = self.hashes[often], self.counts[often]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)

    def spelled(self, which: np.ndarray) -> list[str]:
        """The runs' letters, sought in the texts once more."""
        wanted, out = set(self.hashes[which].tolist()), {}
        for part in _chunks(self.texts):
            if len(out) == len(wanted):
                break
            letters = Letters(part)
            begin, h = letters.runs(self.n)
            values, first = np.unique(h, return_index=True)
            for i in np.flatnonzero(np.isin(values, self.hashes[which])).tolist():
                if int(values[i]) not in out:
                    at = begin[first[i]]
                    out[int(values[i])] = "".join(map(chr, letters.code[at : at + self.n].tolist()))
        return [out[int(x)] for x in self.hashes[which]]


def _texts_of(runs: list[str], texts: list[str]) -> list[set[int]]:
    """For each run the texts that hold it."""
    out: list[set[int]] = [set() for _ in runs]
    keys = {n: {int(Letters([w]).runs(n)[1][0]): i for i, w in enumerate(runs) if len(w) == n} for n in SIZES}
    first = 0
    for part in _chunks(texts):
        letters = Letters(part)
        for n in SIZES:
            begin, h = letters.runs(n)
            at = np.flatnonzero(np.isin(h, np.array(list(keys[n]), tk.U64)))
            for x, t in set(zip(h[at].tolist(), letters.text[begin[at]].tolist())):
                out[keys[n][x]].add(first + t)
        first += len(part)
    return out


def choose_landmarks(toxic: list[str], clean: list[str]) -> list[str]:
    """Runs of SIZES letters from toxic sentences.

    A run's weight is its count of toxic texts times the log of how much more frequent it is in them. It counts
    if it is MORE times as frequent as in clean texts and stands in as many toxic ones as chance does not
    explain: of the runs of as many clean texts that no toxic one holds, not a tenth as many stand in that
    many, up to half as many again. The heaviest comes first, of about as many texts the longest;
    passed over is one that does not tell the classes apart once what is like it counts, or shares N letters in a row with another, or stands only where one twice as frequent does.
    """
    toxic, alone = without_copies(toxic), without_copies(clean)
    sample = alone[: len(toxic)]
    share = lambda n, texts: np.log((n + 0.5) / (len(texts) + 1))
    words, often, weight, control = [], [], [], []
    for n in SIZES:
        found, rest = Frequencies(toxic, n, 2), Frequencies(alone, n)
        lean = share(found.counts, toxic) - share(rest.of(found.hashes), alone)
        # A run of N letters is a single subsequence and counts for less.
        heavy = np.where(lean > np.log(MORE), found.counts * lean * (0.7 if n == N else 1.0), 0)
        own = np.sort(np.argsort(-heavy, kind="stable")[: 20 * LANDMARKS])
        own = own[heavy[own] > 0]
        often.append(np.where(heavy > 0, found.counts, 0))
        words += found.spelled(own)
        weight.append(np.stack([heavy[own], found.counts[own]]))
        other, all_toxic = Frequencies(sample, n, 2), Frequencies(toxic, n)
        control.append(other.counts[all_toxic.of(other.hashes) == 0])
    often, control, (heavy, counts) = np.concatenate(often), np.concatenate(control), np.concatenate(weight, axis=1)
    band = lambda x, k: ((x >= k) & (x <= 1.5 * k)).sum()
    least = next((k for k in range(2, int(often.max(initial=0)) + 1) if band(often, k) and band(control, k) <= 0.1 * band(often, k)), None)
    if least is None:
        return []
    order = [i for i in np.lexsort((words, -np.array([len(w) for w in words]), -heavy)).tolist() if counts[i] >= least]
    held = dict(zip(order, _texts_of([words[i] for i in order], toxic)))
    chosen: list[str] = []
    reached: list[set[int]] = []
    taken: set[str] = set()
    for i in order:
        word = max((words[j] for j in order if words[i] in words[j] and counts[j] >= 0.97 * counts[i]), key=len)
        own = {word[k : k + N] for k in range(len(word) - N + 1)}
        if len(chosen) == LANDMARKS or taken & own or any(len(held[i] & r) > 0.9 * len(held[i]) and 2 * len(held[i]) <= len(r) for r in reached):
            continue
        chosen.append(word)
        reached.append(held[i])
        taken |= own
    return [w for w in chosen if _tells_apart(w, toxic[:NEAR_TEXTS], alone[:NEAR_TEXTS])]


def _tells_apart(word: str, toxic: list[str], clean: list[str]) -> bool:
    """Whether windows whose kernel value with the run is half its own or more, which the machine will take for it,
    stand in NEAR times as many toxic texts as clean ones."""
    own = features_of(word)
    m = Machine()
    m.table[list(own)] = np.array(list(own.values())) / _value(own, own)
    near = [np.concatenate([m.worst(Letters(part)) for part in _chunks(texts)]) >= 0.5 for texts in (toxic, clean)]
    return (near[0].sum() + 0.5) / (len(toxic) + 1) > NEAR * (near[1].sum() + 0.5) / (len(clean) + 1)


def _value(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(v * b.get(k, 0.0) for k, v in a.items())


class Machine:
    """``table``: weight of each subsequence; ``scale`` and ``shift`` turn a response into log odds."""

    def __init__(self, landmarks: list[str] = (), table: np.ndarray | None = None, scale: float = 0.0, shift: float = -2.0):
        self.landmarks = list(landmarks)
        self.table = np.zeros(1 << TABLE_BITS, np.float32) if table is None else table.astype(np.float32)
        self.scale, self.shift = scale, shift

    def __getstate__(self) -> dict:
        """Only the filled cells travel."""
        at = np.flatnonzero(self.table)
        return self.__dict__ | {"table": (at.astype(np.int32), self.table[at])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        at, values = state["table"]
        self.table = np.zeros(1 << TABLE_BITS, np.float32)
        self.table[at] = values

    def worst(self, letters: Letters) -> np.ndarray:
        """Each text's largest response; 0 without letters."""
        out = np.zeros(letters.n)
        if len(letters.code):
            r = letters.responses(self.table)
            begin = np.flatnonzero(np.append(True, letters.text[1:] != letters.text[:-1]))
            out[letters.text[begin]] = np.maximum(np.maximum.reduceat(r, begin), 0)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.shift, -30, 30)))


def _linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias for the squared hinge loss, by Newton's method; both classes weigh the same."""
    sign, b = np.where(y > 0, 1.0, -1.0), np.append(x, np.ones((len(x), 1)), 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    pull = ridge * np.append(np.ones(x.shape[1]), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - sign * (b @ w)) ** 2).sum() + (pull * w * w).sum())

    w = np.zeros(b.shape[1])
    for _ in range(steps):
        gap = 1 - sign * (b @ w)
        own = gap > 0
        inside, scaled = b[own], (weight * sign * gap)[own]
        gradient = 2 * pull * w - 2 * scaled @ inside
        step = np.linalg.solve(2 * np.diag(pull) + 2 * (inside * weight[own][:, None]).T @ inside, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(texts: list[tuple[str, int]]) -> Machine:
    """A machine for labelled texts; without both classes, or any landmark, one that finds nothing."""
    toxic, clean = [t for t, y in texts if y], [t for t, y in texts if not y]
    if not toxic or not clean:
        return Machine()
    landmarks = choose_landmarks(toxic, clean)
    if not landmarks:
        return Machine()
    own = [features_of(x) for x in landmarks]
    norm = np.sqrt([max(1e-9, _value(f, f)) for f in own])
    gram = np.array([[_value(f, g) for g in own] for f in own]) / np.outer(norm, norm)
    values, vectors = np.linalg.eigh(gram)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    codes = sorted({c for f in own for c in f})
    index = np.zeros(1 << TABLE_BITS, np.int32)
    index[codes] = np.arange(1, len(codes) + 1)
    matrix = np.zeros((len(codes) + 1, len(landmarks)))
    for j, f in enumerate(own):
        for c, v in f.items():
            matrix[index[c], j] = v / norm[j]

    def folded(alpha: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << TABLE_BITS, np.float32)
        table[codes] = (matrix[1:] @ alpha).astype(np.float32)
        return table

    texts = toxic + clean
    y = np.append(np.ones(len(toxic)), np.zeros(len(clean)))
    machine = Machine(landmarks, folded(1 / norm))  # each landmark itself has a response of 1
    windows = lambda m, own: np.concatenate([_worst_windows(m, part, matrix, index) for part in _chunks(own)])
    # A toxic sentence stands for its window nearest to the toxic landmarks; one without any trace of them teaches nothing.
    positive = windows(machine, toxic)
    positive = positive[positive.sum(1) > 0]
    negative, bias = np.zeros((0, len(landmarks))), 0.0
    for _ in range(ROUNDS):
        negative = np.concatenate([negative, windows(machine, clean)])
        labels = np.append(np.zeros(len(negative)), np.ones(len(positive)))
        weights, bias = _linear_svm(np.concatenate([negative, positive]) @ whiten, labels)
        machine = Machine(landmarks, folded(whiten @ weights))
    margin = np.concatenate([machine.worst(Letters(part)) for part in _chunks(texts)]) + bias
    machine.scale, shift = platt(margin, y)
    machine.shift = shift + machine.scale * bias
    return machine


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the classes best, both weighing the same, by Newton's
    method with Platt's targets. The slope is not negative."""
    n = np.array([(y == 0).sum(), (y > 0).sum()])
    target = np.where(y > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0])
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * float(w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 2e-6 * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 2e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def _worst_windows(machine: Machine, texts: list[str], matrix: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Landmark kernel values of each text's window of the largest response; zeros without letters."""
    letters = Letters(texts)
    out = np.zeros((len(texts), matrix.shape[1]))
    if not len(letters.code):
        return out
    r = letters.responses(machine.table)
    begin = np.flatnonzero(np.append(True, letters.text[1:] != letters.text[:-1]))
    at = np.array([b + int(np.argmax(r[b:e])) for b, e in zip(begin, np.append(begin[1:], len(r)))])
    stop = np.searchsorted(letters.unit, letters.unit[at], "right")
    for d in range(WINDOW):
        ok = at + d < stop
        place = np.minimum(at + d, len(r) - 1)
        for code, inside, weight in letters.shapes_at(place):
            out[letters.text[begin]] += (weight * (ok & inside))[:, None] * matrix[index[code]]
    return out


def fit(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> Machine:
    """A machine fitted on at most DOCS_PER_CLASS whole texts of each label."""
    return train(samples.labelled_texts(documents, labels, "toxic", DOCS_PER_CLASS, held_out, BYTES))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts some at a time, with the number of the first; null counts as empty."""
    for piece in tk.pieces(column, 1 << 19):
        yield piece.first, [t or "" for t in column.slice(piece.first, piece.n).to_pylist()]


def score(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of ``documents``.

    A null or empty text, or one without letters, has the least score. Ids may be null or repeat; other
    columns are not read. Nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(machine)  # the filled cells of its table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids = tk.take(batch, "doc_id")
            for first, texts in _texts(tk.take(batch, "text")):
                p = m.probability(m.worst(Letters(texts)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for first, texts in _texts(tk.take(batch, "text")):
                yield batch.slice(first, len(texts)).filter(pa.array(m.probability(m.worst(Letters(texts))) < threshold))

    return documents.mapInArrow(tk.trimmed(run), documents.schema)

"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

A word is the image of its gap-weighted subsequences, a sentence the sum of its
words' images.  The kernel of two words is the square of their normalised
subsequence kernel; a sentence is known by its kernels with some landmark words
(the Nyström map), and a support vector machine is linear in that map, so its
value is a sum over words that workers remember.  Labels are those of whole
documents: a toxic document is learned from its most toxic sentence, which the
machine itself picks, and a document's score is that of its worst sentence.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _text, _tokens
from cellflow.llm._shared import doc_columns, hashed_sample

#: Letters of a word compared at once; a longer word is the sum of windows half as far apart.
WIDTH = 16
#: Length of the subsequences counted, and what each letter they span costs.
ORDER, DECAY = 3, 0.7
#: Words after which a sentence without an end is cut.
LONG = 64
MARKS = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTER = re.compile(r"[^\W\d_]")
#: Figures and signs that stand for letters inside a word.
SWAPPED = str.maketrans("013457@$!", "oieastasi")


def plain(word: str) -> str:
    """A word in lower case, without ASCII marks, figures and signs inside it turned back into letters."""
    word = word.lower().strip(".,;:!?\"'()")
    if word.isalpha():
        return word
    if LETTER.search(word):
        word = word[:1] + word[1:-1].translate(SWAPPED) + word[-1:]
    return MARKS.sub("", word)


def letters(words: list[str]) -> np.ndarray:
    """Code points ``(words, WIDTH)``, 0 beyond a word's end."""
    return np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH) if words else np.zeros((0, WIDTH), np.uint32)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each pair of rows, by dynamic programming over both words."""
    ns, nt = max(1, int((s != 0).sum(1).max(initial=1))), max(1, int((t != 0).sum(1).max(initial=1)))
    same = (s[:, :ns, None] == t[:, None, :nt]) & (s[:, :ns, None] != 0)
    inner = np.ones((ns + 1, nt + 1, len(s)), np.float32)
    value = np.zeros(len(s), np.float32)
    match = np.ascontiguousarray(same.transpose(1, 2, 0)).astype(np.float32)
    for order in range(1, ORDER + 1):
        following = np.zeros_like(inner)
        value[:] = 0
        for i in range(1, ns + 1):
            run = np.zeros(len(s), np.float32)
            for j in range(1, nt + 1):
                hit = match[i - 1, j - 1] * inner[i - 1, j - 1]
                run = DECAY * (run + DECAY * hit)
                following[i, j] = DECAY * following[i - 1, j] + run
                value += hit
        inner = following
    return value * DECAY**2


class Landmarks:
    """Kernels between any words and a few landmark words, all of them exact.

    Only subsequences that a landmark has count for a kernel, so a word is
    spread over those and their rows are summed; its norm comes from the
    dynamic program.
    """

    def __init__(self, words: list[str]):
        self.words, codes = words, letters(words)
        self.alphabet = np.unique(codes[codes != 0])
        found = [self._parts(codes[i : i + 1, : len(w)]) for i, w in enumerate(words)]
        self.parts = np.unique(np.concatenate([f[1] for f in found])) if found else np.zeros(0, np.int64)
        self.rows = np.zeros((len(self.parts), len(words)), np.float32)
        for i, (_, part, weight) in enumerate(found):
            np.add.at(self.rows[:, i], np.searchsorted(self.parts, part), weight)
        if words:
            self.rows /= np.sqrt(np.maximum(kernel(codes, codes), 1e-12))
        self.direct = None
        if len(self.alphabet) ** ORDER <= 1 << 22:
            self.direct = np.full(len(self.alphabet) ** ORDER, -1, np.int32)
            self.direct[self.parts] = np.arange(len(self.parts))

    def _parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, subsequence, weight)`` of words of one length, without subsequences that hold a letter of no landmark."""
        at = np.array(list(combinations(range(codes.shape[1]), ORDER)), np.int64).reshape(-1, ORDER)
        letter = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        letter = np.where(self.alphabet[letter] == codes, letter, -(len(self.alphabet) ** ORDER)).astype(np.int64)
        name = letter[:, at[:, 0]]
        for k in range(1, ORDER):
            name *= len(self.alphabet)
            name += letter[:, at[:, k]]
            np.maximum(name, -(len(self.alphabet) ** ORDER), out=name)
        flat = np.flatnonzero(name.ravel() >= 0)
        row, part = np.divmod(flat, len(at))
        return row, name.ravel()[flat], (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)[part]

    def _known(self, row: np.ndarray, part: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those whose subsequence a landmark has, with its place."""
        if self.direct is not None:
            place = self.direct[part]
            some = np.flatnonzero(place >= 0)
        else:
            place = np.minimum(np.searchsorted(self.parts, part), len(self.parts) - 1)
            some = np.flatnonzero(self.parts[place] == part)
        return row[some], place[some], weight[some]

    def compare(self, words: list[str], block: int = 2048, most: int = 30_000) -> np.ndarray:
        """``(words, landmarks)``: squares of normalised kernels, summed over a long word's windows."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        at, windows = [], []
        for i, word in enumerate(words):
            word = plain(word)
            if len(word) >= ORDER:
                for k in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2):
                    at.append(i)
                    windows.append(word[k : k + WIDTH])
        codes, owner = letters(windows), np.array(at, np.int64)
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        for size in np.unique(sizes[sizes >= ORDER]).tolist():
            own = np.flatnonzero(sizes == size)
            for a in range(0, len(own), block):
                some = own[a : a + block]
                row, place, weight = self._known(*self._parts(codes[some, :size]))
                if not len(row):
                    continue
                edge = np.flatnonzero(np.diff(row, prepend=-1))
                met = row[edge]
                values = np.empty((len(edge), len(self.words)), np.float32)
                for b in range(0, len(edge), max(1, most * len(edge) // len(row))):
                    c = min(len(edge), b + max(1, most * len(edge) // len(row)))
                    x, y = edge[b], edge[c] if c < len(edge) else len(row)
                    values[b:c] = np.add.reduceat(self.rows[place[x:y]] * weight[x:y, None], edge[b:c] - x, axis=0)
                values /= np.sqrt(np.maximum(kernel(codes[some[met]], codes[some[met]]), 1e-12))[:, None]
                np.minimum(values, 1, out=values)
                values *= values
                np.add.at(out, owner[some[met]], values)
        return out

    def root(self) -> np.ndarray:
        """The landmarks' inverse root kernel matrix: the Nyström map from kernels to features."""
        matrix = self.compare(self.words).astype(np.float64)
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        return (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def sentences_of(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The sentence that each word belongs to, numbered from 0: they end at . ! ? and line ends, and after ``LONG`` words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lines = np.cumsum(data == 10)
    last = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    new = np.ones(len(starts), bool)
    new[1:] = last[:-1] | (lines[starts[1:]] > lines[ends[:-1] - 1])
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    return np.cumsum(new | (place % LONG == 0)) - 1


def spelled(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, data: np.ndarray) -> list[tuple[int, str]]:
    """First word and letters of words spelled out: three or more single letters in a row, split by white space."""
    single = np.zeros(len(starts), bool)
    short = np.flatnonzero(ends - starts <= 4)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single[short] = heads[ends[short]] - heads[starts[short]] == 1
    turns = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
        while b - a >= ORDER:  # a run may go on in the next text
            stop = min(b, int(bounds[np.searchsorted(bounds, a, "right")]))
            if stop - a >= ORDER:
                out.append((a, b"".join(bytes(data[x:y]) for x, y in zip(starts[a:stop].tolist(), ends[a:stop].tolist(), strict=True)).decode("utf-8", "replace")))
            a = stop
    return out


def sentence_features(marks: Landmarks, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Kernels of all sentences with the landmarks, and each sentence's text."""
    hashes, starts, ends, bounds, data = _text.words_of(texts, _text.NOT_SPACE, False)
    sentence = sentences_of(starts, ends, data)
    if not len(starts):
        return np.zeros((0, len(marks.words)), np.float32), np.zeros(0, np.int64)
    _, back, words = _tokens.unseen(hashes, starts, ends, data)
    known, edge = marks.compare(words), np.flatnonzero(np.diff(sentence, prepend=-1))
    out = np.zeros((len(edge), len(marks.words)), np.float32)
    for a in range(0, len(edge), 4096):
        some = edge[a : a + 4096]
        stop = edge[a + 4096] if a + 4096 < len(edge) else len(back)
        out[a : a + 4096] = np.add.reduceat(known[back[some[0] : stop]], some - some[0], axis=0)
    if apart := spelled(starts, ends, bounds, data):
        np.add.at(out, sentence[[a for a, _ in apart]], marks.compare([w for _, w in apart]))
    return out, np.searchsorted(bounds, edge, "right") - 1


class Reader:
    """Values of whole texts; what words add is remembered by hash, in a table of fixed size that starts anew with other weights."""

    def __init__(self, words: list[str], weights: np.ndarray, bits: int = 20):
        self.marks, self.weights = Landmarks(words), weights.astype(np.float32)
        self.known = _tokens.Slots(bits, np.float32)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The largest sum of a sentence's words; texts without words have 0."""
        hashes, starts, ends, bounds, data = _text.words_of(texts, _text.NOT_SPACE, False)
        out = np.zeros(len(texts))
        if not len(starts):
            return out
        value, known = self.known.get(hashes)
        new = np.flatnonzero(~known)
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            distinct, back, words = _tokens.unseen(hashes[part], starts[part], ends[part], data)
            learned = self.marks.compare(words) @ self.weights
            self.known.put(distinct, learned)
            value[part] = learned[back]
        sentence = sentences_of(starts, ends, data)
        edge = np.flatnonzero(np.diff(sentence, prepend=-1))
        sums = np.add.reduceat(value.astype(np.float64), edge)
        if apart := spelled(starts, ends, bounds, data):
            np.add.at(sums, sentence[[a for a, _ in apart]], self.marks.compare([w for _, w in apart]) @ self.weights)
        full = np.flatnonzero(np.diff(bounds))
        out[full] = np.maximum.reduceat(sums, np.searchsorted(edge, bounds[full]))
        return out


_readers: dict[bytes, Reader] = {}


def reader_of(model: dict) -> Reader:
    """The worker's reader for this model; it keeps what it learned for later tasks."""
    mark = repr(model["words"]).encode() + model["beta"].tobytes()
    if mark not in _readers:
        _readers.clear()
        _readers[mark] = Reader(model["words"], model["beta"])
    return _readers[mark]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 0.3, rounds: int = 40, block: int = 8192) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps, on blocks of rows; the last weight is the bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        matrix, goal = ridge.copy(), np.zeros(len(w))
        for k in range(0, len(x), block):
            part = np.concatenate([x[k : k + block], np.ones((len(x[k : k + block]), 1))], 1, dtype=np.float64)
            own = sign[k : k + block]
            active = own * (part @ w) < 1
            part, own = part[active], own[active]
            matrix += 2 * cost * part.T @ part
            goal += 2 * cost * part.T @ own
        new = np.linalg.solve(matrix, goal)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def fit_scale(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that make margins probabilities, by Newton steps on the log loss."""
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a = a - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - goal))
    return a


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter put into each of its gaps in turn, with one in all of them, and with one letter doubled."""
    some = ["abcdefghiklmnoprstu"[k] for k in rng.integers(0, 19, len(word))]
    at = int(rng.integers(1, max(2, len(word))))
    each = [word[:k] + some[k] + word[k:] for k in range(1, len(word))]
    return [*each, "".join(c + x for c, x in zip(word, some, strict=True))[:-1], word[:at] + word[at - 1 :]]


def learn(marks: Landmarks, x: np.ndarray, doc: np.ndarray, toxic: np.ndarray, first: int, rounds: int = 4, beside: int = 12, seed: int = 3) -> dict:
    """Weights from sentences' kernels ``x``, their documents, and whether those are toxic; ``first`` landmarks speak for it.

    The sentence that stands for a toxic document is chosen anew in each round.
    From the second round on, the words that make a sentence toxic alone are
    learned in disguise too, each in ``beside`` sentences of documents that aren't.
    """
    rng, root = np.random.default_rng(seed), marks.root()
    image, value = x @ root.astype(np.float32), x[:, :first].max(1)
    calm = np.flatnonzero(~toxic)
    extra = np.zeros((0, x.shape[1]), np.float32)
    order = np.lexsort((value, doc))
    for _ in range(rounds):
        worst = order[np.flatnonzero(np.append(np.diff(doc[order]) != 0, True))]  # the highest value of each document
        worst = worst[toxic[worst]]
        rows = np.concatenate([image[worst], extra, image[calm]])
        truth = np.concatenate([np.ones(len(worst) + len(extra)), np.zeros(len(calm))])
        weights = fit_svm(rows, truth)
        value = image @ weights[:-1] + weights[-1]
        order = np.lexsort((value, doc))
        own = marks.compare(marks.words) @ root @ weights[:-1] + weights[-1]
        rude = [marks.words[i] for i in np.flatnonzero(own[:first] > 0.5).tolist()]
        shapes = [w for word in rude for w in disguised(word, rng)]
        if shapes and len(calm):
            extra = np.repeat(marks.compare(shapes) @ root.astype(np.float32), beside, 0) + image[rng.choice(calm, beside * len(shapes))]
    worst = order[np.flatnonzero(np.append(np.diff(doc[order]) != 0, True))]
    return {"words": marks.words, "beta": (root @ weights[:-1]), "bias": weights[-1], "scale": fit_scale(value[worst], toxic[worst])}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, n_landmarks: int = 96, per_text: int = 4) -> dict:
    """Learn from about ``sample`` labelled documents at most, chosen by hash of their id.

    Two landmarks in three are the words that speak most for label 1, the rest
    the most frequent ones in documents of label 0.  From each document the
    ``per_text`` sentences closest to a landmark of the first kind go to the
    driver, and as many evenly spaced ones, so neither many nor long texts do.
    A doc_id with several labels is toxic if one of them is 1; null labels
    don't count.
    """
    spark = docs.sparkSession
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = sorted((r.doc_id, r.toxic) for r in hashed_sample(chosen, sample, "doc_id").collect())  # about `sample` rows at most
    nothing = {"words": [], "beta": np.zeros(0), "bias": 0.0, "scale": np.array([0.0, -5.0])}
    if not rows:
        return nothing
    known = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    texts = docs.join(F.broadcast(known), "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("row"), "text")

    def count(batches):
        tallies: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for word in {plain(w) for w in text.split()}:
                    if 4 <= len(word) <= WIDTH:
                        tallies.setdefault(word, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tallies), pa.string()), *(pa.array([v[k] for v in tallies.values()], pa.int64()) for k in (0, 1))], ["word", "calm", "toxic"])

    words = texts.mapInArrow(count, "word string, calm bigint, toxic bigint").groupBy("word").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    calm, toxic = sum(t <= 0 for _, t in rows), sum(t > 0 for _, t in rows)
    if not toxic or not calm:
        return nothing
    rate, base = (F.col("toxic") + 0.2) / toxic, (F.col("calm") + 0.2) / calm
    worth = F.when((F.col("toxic") >= 2) & (rate > 4 * base), F.col("toxic") * F.log(rate / base))
    top = [r.word for r in words.where(worth.isNotNull()).orderBy(worth.desc(), "word").limit(2 * n_landmarks // 3).collect()]
    if not top:
        return nothing
    usual = [r.word for r in words.where(worth.isNull()).orderBy(F.desc("calm"), "word").limit(n_landmarks // 3).collect()]
    marks, first = Landmarks(top + usual), len(top)

    def read(batches):
        for batch in batches:
            for row, n in _text.slices(batch.column(2)):
                part = batch.slice(row, n)
                x, at = sentence_features(marks, part.column(2))
                order = np.lexsort((-x[:, :first].max(1, initial=0), at))
                bounds = np.searchsorted(at[order], np.arange(n + 1))
                keep = [order[a : a + per_text].tolist() + np.linspace(a, b - 1, min(per_text, b - a)).astype(int).tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a]
                rows = np.unique(np.array([i for k in keep for i in k], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[rows])), part.column(1).take(pa.array(at[rows])), pa.array([r.tobytes() for r in x[rows]], pa.binary())], ["toxic", "row", "x"])

    got = texts.mapInArrow(read, "toxic int, row bigint, x binary").toPandas()  # 2 * per_text rows of each sampled document at most
    got = got.sort_values(["row", "toxic", "x"])  # the order of rows from Spark isn't fixed
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(marks.words))
    y, rows_of = got["toxic"].to_numpy() > 0, got["row"].to_numpy()
    if not y.any() or y.all():
        return nothing
    del got
    return learn(marks, x, rows_of, y, first)


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for every whole text; empty and null texts score as texts without any cue."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        reader = reader_of(model) if model["words"] else None
        for batch in batches:
            texts = batch.column(1)
            margin = np.full(len(texts), float(model["bias"]))
            if reader:
                for row, n in _text.slices(texts):
                    margin[row : row + n] += reader.margins(texts.slice(row, n))
            p = 1 / (1 + np.exp(-np.clip(margin * model["scale"][0] + model["scale"][1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pc.cast(pa.array(p >= threshold), pa.int32())], ["doc_id", "score", "predicted"])

    return doc_columns(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = 12_000) -> DataFrame:
    """Scores of all documents, learned from labels of those whose ``crc32(doc_id) % modulus`` isn't ``held``.

    Each row gives one, repeated and null ids included; an empty table gives
    none; other columns are ignored.
    """
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    model = fit(doc_columns(docs), labels.where(~marked), sample)
    return score(docs, model).select("doc_id", marked.alias("held_out"), "score", "predicted")

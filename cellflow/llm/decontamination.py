"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A random walk over a window's words (after Chakraborty, Goldenberg and Koucky)
writes each word one or more times, by random bits shared between all windows,
so windows a few edits apart give outputs that differ in few places.  A
repetition samples a few places of the output; a window and an item that agree
on all of them are a candidate.  Candidates are verified by exact edit distance
in words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _text
from cellflow.llm._fold import without_ids
from cellflow.llm._shared import doc_columns

FOUND = "doc_id bigint, item_id bigint, edits int, item_words int, first_word bigint, last_word bigint"

#: Bytes of text read at a time; each slice has a fixed cost.
SLICE = 2_500_000


class Item:
    def __init__(self, item_id: int, words: np.ndarray, similarity: float):
        self.item_id, self.words, self.n = item_id, words, len(words)
        self.edits = int((1 - similarity) * self.n + 1e-9)
        #: An item with so many edits keeps a run of this many words somewhere.
        self.run = min(3, math.ceil((self.n - self.edits) / (self.edits + 1)))


class Walks:
    """CGK walks and sampled places of their outputs for windows of one size."""

    def __init__(self, n: int, embeddings: int, samples: int, places: int, seed: int = 23):
        rng = np.random.default_rng([seed, n])
        self.n, self.steps = n, 3 * n
        self.salts = rng.integers(1, 1 << 63, (embeddings, self.steps // 64 + 1), dtype=np.uint64)
        self.places = np.sort(rng.integers(0, min(self.steps, 2 * n), (embeddings, samples, places)), axis=2)
        self.weights = rng.integers(1, 1 << 63, (embeddings, samples, places), dtype=np.uint64) | np.uint64(1)

    def signatures(self, windows: np.ndarray) -> np.ndarray:
        """``(windows, repetitions)`` hashes of the sampled places; ``windows`` are word hashes, 0 past the end."""
        count = len(windows)
        padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], 1)
        rows, out = np.arange(count), []
        for salts, places, weights in zip(self.salts, self.places, self.weights, strict=True):
            bits = [_text.mix(padded ^ s) for s in salts]
            at = np.zeros(count, np.int64)
            walked = np.empty((int(places.max()) + 1, count), np.uint64)
            for step in range(len(walked)):
                walked[step] = padded[rows, at]
                moves = (bits[step // 64][rows, at] >> np.uint64(step % 64)) & np.uint64(1)
                at = np.minimum(at + moves.astype(np.int64), self.n)
            for p, w in zip(places, weights, strict=True):
                out.append(_text.mix((walked[p] * w[:, None]).sum(0, dtype=np.uint64)))
        return np.stack(out, 1)


def edit_distances(item: list[int], words: list[int], anchored: bool = False) -> list[int]:
    """Edits between the item and the closest run of words that ends at each place, by bit-parallel dynamic programming.

    With ``anchored`` the run starts at the first word.
    """
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, out = full, 0, len(item), []
    for w in words:
        same = masks.get(w, 0)
        x = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = (minus | ~(across | plus)) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = (down << 1) & full
        plus, minus = (down | ~(x | up)) & full, up & x
        out.append(score)
    return out


class Index:
    """Items by size, their signatures, and the runs of words that a window near an item must share with it."""

    def __init__(self, items: list[Item], recall: float, places: int = 2, agree: float = 0.4):
        self.items = items
        repetitions = math.ceil(math.log(1 - recall) / math.log(1 - agree**places))
        self.walks: dict[int, Walks] = {}
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({i.n for i in items}):
            walks = self.walks[n] = Walks(n, 4, math.ceil(repetitions / 4), places)
            own = [k for k, i in enumerate(items) if i.n == n]
            table = self.tables[n] = {}
            for k, row in zip(own, walks.signatures(np.stack([items[k].words for k in own])).tolist(), strict=True):
                for r, s in enumerate(row):
                    table.setdefault((r, s), []).append(k)
        for run in (1, 2, 3):
            found = sorted({(int(h), i.n, at) for i in items if i.run == run for at, h in enumerate(_text.combine(i.words, run).tolist())})
            if found:
                keys = np.array([f[0] for f in found], np.uint64)
                near = np.zeros(1 << 20, bool)
                near[keys >> np.uint64(44)] = True
                self.seeds[run] = (near, keys, np.array([f[1:] for f in found], np.int64))

    def windows(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``(size, text, start)`` of the item-sized windows that share a run of words with an item of that size.

        This leaves out no window within an item's edits: those keep a run of
        the item's words, moved by no more than the edits.
        """
        out = [np.zeros((0, 3), np.int64)]
        for run, (near, keys, origin) in self.seeds.items():
            grams = _text.combine(hashes, run)
            at = np.flatnonzero(near[grams >> np.uint64(44)])
            first, last = np.searchsorted(keys, grams[at]), np.searchsorted(keys, grams[at], "right")
            times = last - first
            at, slot = np.repeat(at, times), np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + run <= bounds[doc + 1]
            at, doc, size, offset = at[inside], doc[inside], origin[slot[inside], 0], origin[slot[inside], 1]
            for n in np.unique(size).tolist():
                m = size == n
                slack = max(i.edits for i in self.items if i.n == n)
                starts = (at[m] - offset[m])[:, None] + np.arange(-slack, slack + 1)[None, :]
                low, high = bounds[doc[m]], bounds[doc[m] + 1]
                starts = np.clip(starts, low[:, None], np.maximum(low, high - n)[:, None])
                out.append(np.unique(np.stack([np.full(starts.size, n), np.repeat(doc[m], 2 * slack + 1), starts.ravel()], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, edits, first word, last word)`` of each item in each text, at the place with fewest edits."""
        windows = self.windows(hashes, bounds)
        candidates: dict[tuple[int, int], list[int]] = {}
        edges = np.flatnonzero(np.diff(windows[:, 0], prepend=-1)) if len(windows) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(windows)), strict=False):
            n, table = int(windows[a, 0]), self.tables[int(windows[a, 0])]
            for c in range(a, b, 4096):
                part = windows[c : min(b, c + 4096)]
                places = part[:, 2][:, None] + np.arange(n)[None, :]
                ends = bounds[part[:, 1] + 1][:, None]
                words = np.where(places < ends, hashes[np.minimum(places, len(hashes) - 1)], np.uint64(0))
                for (_, doc, start), row in zip(part.tolist(), self.walks[n].signatures(words).tolist(), strict=True):
                    for key in enumerate(row):
                        for k in table.get(key, ()):
                            candidates.setdefault((doc, k), []).append(start)
        out = []
        for (doc, k), starts in candidates.items():
            item = self.items[k]
            best = None
            for start in sorted(set(starts)):
                low, high = max(int(bounds[doc]), start - item.edits), min(int(bounds[doc + 1]), start + item.n + item.edits)
                words = hashes[low:high].tolist()
                scores = edit_distances(item.words.tolist(), words)
                least = min(scores)
                if least <= item.edits and (best is None or least < best[0]):
                    end = scores.index(least)
                    back = edit_distances(item.words.tolist()[::-1], words[: end + 1][::-1], True)
                    best = (least, low + end - back.index(min(back)), low + end)
            if best:
                out.append((doc, k, best[0], best[1] - int(bounds[doc]), best[2] - int(bounds[doc])))
        return out


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, recall: float = 0.995, block_bytes: int = 4_000_000) -> DataFrame:
    """Each benchmark item that stands in a document, with up to ``1 - similarity`` of its words edited.

    One row for each document and item: the fewest edits of the windows that
    the hashing let through, counted exactly, and the first and last word of
    that place.  Words are ASCII letters and digits and anything beyond ASCII,
    A-Z lower-cased.  Items without words and null texts match nothing; repeated
    ids give a row each (repeated item_ids with the same text one), and null ids
    are kept as they are.  Benchmarks over ``block_bytes`` are broadcast in
    blocks of about that size, each with a pass of its own over the documents.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs)
    items = doc_columns(benchmark, "item_id").where("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
        texts = pa.array([r.text for r in rows], pa.string())
        hashes, _, _, bounds, _ = _text.words_of(texts, _text.ALNUM) if rows else (np.zeros(0, np.uint64), 0, 0, np.zeros(1, np.int64), 0)
        known = [Item(r.doc_id, hashes[bounds[i] : bounds[i + 1]], similarity) for i, r in enumerate(rows) if bounds[i + 1] > bounds[i]]
        sent = spark.sparkContext.broadcast((known, recall))

        def run(batches, sent=sent):
            index = Index(*sent.value)
            for batch in batches:
                names = batch.column(0)
                for row, n in _text.slices(batch.column(1), SLICE):
                    hashes, _, _, bounds, _ = _text.words_of(batch.column(1).slice(row, n), _text.ALNUM)
                    found = index.find(hashes, bounds)
                    if found:
                        part = names.slice(row, n).take(pa.array([f[0] for f in found]))
                        its = [index.items[f[1]] for f in found]
                        yield pa.RecordBatch.from_arrays([part, pa.array([i.item_id for i in its], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([i.n for i in its], pa.int32()), *(pa.array([f[c] for f in found], pa.int64()) for c in (3, 4))], [c.split()[0] for c in FOUND.split(", ")])

        part = docs.mapInArrow(run, FOUND)
        out = part if out is None else out.union(part)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with null doc_id stay."""
    return without_ids(docs, "doc_id", find_items(docs, benchmark, similarity).select("doc_id"))

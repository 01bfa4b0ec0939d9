"""License scans: base phrases, and a set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _text
from cellflow.llm._shared import doc_columns

#: Phrases that are looked for word by word, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences of public licenses and notices, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of whole words, as those of words inside texts."""
    if not words:
        return np.zeros(0, np.uint64)
    data, offsets = _text.raw_bytes(pa.array(words, pa.string()))
    return _text.span_hashes(_text.prefix_sums(data, _text.FOLDED), offsets[:-1], offsets[1:] - 1)


def read_words(texts: pa.Array):
    """Word hashes, each word's text and block (a line), and each text's first word (one more: the end)."""
    hashes, starts, ends, bounds, data = _text.words_of(texts, _text.ALNUM)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    return hashes, line, bounds


def token_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the given words stands in all texts; each task counts before anything is shuffled."""
    order = np.argsort(word_hashes(words))
    keys = word_hashes(words)[order]

    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for row, n in _text.slices(batch.column(0)):
                hashes, _, _ = read_words(batch.column(0).slice(row, n))
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                total += np.bincount(at[keys[at] == hashes], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word
    found = {words[r.word]: r.n for r in rows}
    return {w: found.get(w, 0) for w in words}


class Join:
    """Blocks against templates: containment of a template's token set in a block's of at least ``threshold``.

    Tokens are ordered by their frequency in all texts, rare ones first.  A
    template ``t`` must share ``need = ceil(threshold * |t|)`` tokens, so one of
    its first ``|t| - need + 1`` stands in the block: only those are indexed.
    A block with fewer tokens than ``need`` is out by length; a shared prefix
    token at position p of the template, with q tokens of the block from it on
    in the order, is out if ``1 + min(|t| - p - 1, q)`` falls short of what is
    still needed.  What is left is verified exactly.
    """

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], threshold: float):
        if len(frequency) > 1 << 16:
            raise ValueError("templates may have 65,536 different words at most")
        names = sorted(frequency, key=lambda w: (frequency[w], w))
        hashes = word_hashes(names)
        order = np.argsort(hashes)
        self.keys, self.ranks = hashes[order], order  # rank in the global order, by hash
        rank = {w: i for i, w in enumerate(names)}
        self.sets = [np.array(sorted({rank[w] for w in t.split()})) for t in templates]
        self.labels = list(templates.values())
        self.need = [int(np.ceil(threshold * len(t) - 1e-9)) for t in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, (tokens, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for p, token in enumerate(tokens[: len(tokens) - need + 1].tolist()):
                self.index.setdefault(token, []).append((k, p))
        self.first = np.zeros(len(names), bool)
        self.first[list(self.index)] = True

    def matches(self, hashes: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """``(block, template, containment)`` of the blocks that reach the threshold."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == hashes)
        pairs = np.unique((block[known].astype(np.int64) << 16) | self.ranks[at[known]])  # a block's tokens, distinct, in order
        blocks, tokens = pairs >> 16, pairs & 0xFFFF
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        stops = np.append(edges[1:], len(blocks))
        shortest = min(self.need, default=0)
        worth = np.add.reduceat(self.first[tokens].astype(np.int64), edges) > 0 if len(edges) else np.zeros(0, bool)
        for a, b in zip(edges[worth & (stops - edges >= shortest)].tolist(), stops[worth & (stops - edges >= shortest)].tolist(), strict=True):
            own, tried = tokens[a:b], set()
            for q, token in enumerate(own.tolist()):
                for k, p in self.index.get(token, ()):
                    size, need = len(self.sets[k]), self.need[k]
                    if k in tried or len(own) < need or 1 + min(size - p - 1, len(own) - q - 1) + min(p, q) < need:
                        continue
                    tried.add(k)
                    shared = len(np.intersect1d(own, self.sets[k], assume_unique=True))
                    if shared >= need:
                        yield int(blocks[a]), k, shared / size


def phrase_places(hashes: np.ndarray, bounds: np.ndarray, phrase: list[np.uint64]) -> np.ndarray:
    """Where the phrase's words stand one after another within one text."""
    n = len(phrase)
    if len(hashes) < n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[: len(hashes) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[hashes[at + k] == phrase[k]]
    return at[np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + n - 1, "right")]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """License labels of every whole text.

    Words are runs of ASCII letters and digits and anything beyond ASCII,
    A-Z lower-cased; blocks are lines.  Null and empty texts have no words and
    no labels; repeated doc_ids give a row each; other columns are ignored.
    ``score`` is the best containment of a template, 1 where a base phrase
    stands.  ``template_blocks`` counts blocks that meet a template.  The
    templates are a fixed list, so what is broadcast doesn't grow.
    """
    templates = TEMPLATES if templates is None else templates
    docs = doc_columns(docs)
    frequency = token_frequencies(docs, sorted({w for t in templates for w in t.split()})) if templates else {}
    sent = docs.sparkSession.sparkContext.broadcast((templates, frequency))
    labels = sorted(set(BASE.values()))

    def run(batches):
        join = Join(*sent.value, threshold)
        phrases = {p: list(word_hashes(p.split())) for p in BASE}
        for batch in batches:
            for row, n in _text.slices(batch.column(1)):
                hashes, line, bounds = read_words(batch.column(1).slice(row, n))
                n_base, score, blocks = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                found: list[set] = [set() for _ in range(n)]
                for phrase, label in BASE.items():
                    at = phrase_places(hashes, bounds, phrases[phrase])
                    doc = np.searchsorted(bounds, at, "right") - 1
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(first, doc, at - bounds[doc])
                    np.maximum.at(last, doc, at - bounds[doc])
                    for i in np.unique(doc).tolist():
                        found[i].add(label)
                score[n_base > 0] = 1.0
                base = [",".join(x for x in labels if x in f) for f in found]
                doc_of_line = np.searchsorted(bounds, np.searchsorted(line, np.arange(line[-1] + 1 if len(line) else 0)), "right") - 1
                met: set[int] = set()
                for block, k, share in join.matches(hashes, line):
                    doc = int(doc_of_line[block])
                    found[doc].add(join.labels[k])
                    score[doc] = max(score[doc], share)
                    if block not in met:
                        met.add(block)
                        blocks[doc] += 1
                none = n_base == 0
                columns = [batch.column(0).slice(row, n), pa.array(np.diff(bounds)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base), pa.array([",".join(sorted(f)) for f in found]), pa.array(score), pa.array(blocks)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_blocks"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, template_blocks bigint")

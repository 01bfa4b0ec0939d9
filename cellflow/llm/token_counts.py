"""Token counts by a map-side lookup in two tiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _text, _tokens
from cellflow.llm._shared import doc_columns

_caches: dict[str, _tokens.Slots] = {}


def frequent_chunks(docs: DataFrame, per_task: int = 4096, most: int = 1 << 15) -> DataFrame:
    """``(chunk, n)``: the most frequent pre-tokens of all texts, at most ``most`` rows.

    Every task counts all its texts and passes on its ``per_task`` most
    frequent pre-tokens; only those bounded summaries are shuffled.
    """

    def run(batches):
        keys, counts, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            column = batch.column(0)
            for row, n in _text.slices(column):
                data, offsets = _text.raw_bytes(column.slice(row, n))
                starts, ends = _tokens.word_chunks(data, offsets)
                hashes = _text.span_hashes(_text.prefix_sums(data, _text.PLAIN), starts, ends)
                found, first, times = np.unique(hashes, return_index=True, return_counts=True)
                if len(found) > 2 * per_task:
                    top = np.argpartition(-times, 2 * per_task)[: 2 * per_task]
                    found, first, times = found[top], first[top], times[top]
                raw = data.tobytes()
                words = np.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], object)
                keys, at, back = np.unique(np.concatenate([keys, found]), return_index=True, return_inverse=True)
                texts = np.concatenate([texts, words])[at]
                counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
                if len(keys) > 4 * per_task:
                    top = np.argpartition(-counts, 4 * per_task)[: 4 * per_task]
                    top.sort()
                    keys, counts, texts = keys[top], counts[top], texts[top]
        top = np.argsort(-counts, kind="stable")[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array(texts[top].tolist(), pa.string()), pa.array(counts[top])], ["chunk", "n"])

    kept = docs.select("text").mapInArrow(run, "chunk string, n bigint")
    return kept.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, cache_bits: int = 20, frequent: int = 1 << 15) -> DataFrame:
    """Tokens of each whole text, as the tokenizer's library counts them without added special tokens.

    The first tier is a broadcast table of at most ``frequent`` rows, whatever
    the input's size; the second a cache of ``2**cache_bits`` slots in each
    worker, in front of the tokenizer.  No pre-token is shuffled.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated doc_ids give a
    row each; other columns of ``docs`` are ignored.  Texts that hold a special
    string are encoded whole, as the library handles them by default.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs)
    chunks = [r.chunk for r in frequent_chunks(docs, most=frequent).select("chunk").collect()]  # at most `frequent` rows
    lens = [len(e.ids) for e in _tokens.tokenizer(tokenizer_path).encode_batch(chunks, add_special_tokens=False)]
    table = spark.sparkContext.broadcast((chunks, np.array(lens, np.int64)))
    specials = _tokens.special_strings(tokenizer_path)

    def first_tier() -> _tokens.Slots:
        words, counts = table.value
        slots = _tokens.Slots(18)
        if words:
            data, offsets = _text.raw_bytes(pa.array(words, pa.string()))
            hashes = _text.span_hashes(_text.prefix_sums(data, _text.PLAIN), offsets[:-1], offsets[1:] - 1)
            slots.put(hashes[::-1], counts[::-1])  # the most frequent last, so that it keeps its slot
        return slots

    def run(batches):
        top = first_tier()
        cache = _caches.setdefault(f"{tokenizer_path}/{cache_bits}", _tokens.Slots(cache_bits))
        for batch in batches:
            texts = batch.column(1)
            out = np.zeros(len(texts), np.int64)
            odd = _tokens.flagged(texts, specials)
            plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
            for row, n in _text.slices(plain):
                data, offsets = _text.raw_bytes(plain.slice(row, n))
                starts, ends = _tokens.word_chunks(data, offsets)
                if not len(starts):
                    continue
                hashes = _text.span_hashes(_text.prefix_sums(data, _text.PLAIN), starts, ends)
                counts, known = top.get(hashes)
                rest = np.flatnonzero(~known)
                counts[rest], known = cache.get(hashes[rest])
                rest = rest[~known]
                if len(rest):
                    distinct, back, words = _tokens.unseen(hashes[rest], starts[rest], ends[rest], data)
                    got = np.fromiter((len(e.ids) for e in _tokens.tokenizer(tokenizer_path).encode_batch(words, add_special_tokens=False)), np.int64, len(words))
                    cache.put(distinct, got)
                    counts[rest] = got[back]
                sums = np.concatenate([[0], np.cumsum(counts)])
                at = np.searchsorted(starts, offsets)
                out[row : row + n] = sums[at[1:]] - sums[at[:-1]]
            for i in np.flatnonzero(odd).tolist():
                out[i] = len(_tokens.tokenizer(tokenizer_path).encode(texts[i].as_py(), add_special_tokens=False).ids)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")



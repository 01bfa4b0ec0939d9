"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _text
from cellflow.llm._shared import doc_columns, fresh

#: Bytes read in one go; state starts anew at each such stretch.
STRETCH = 64
#: Mean probability that a document's language must reach to count as told.
LEAST = 0.4
#: Bytes whose positions count when a document's probabilities are pooled: letters and what lies beyond ASCII.
COUNTS = np.zeros(256, bool)
COUNTS[0x41:0x5B] = COUNTS[0x61:0x7B] = COUNTS[0x80:] = True


def gate(x: np.ndarray) -> np.ndarray:
    """A piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.25 * ((y > 0) & (y < 1))


def scan(weights: dict, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states ``(steps, hidden, rows)`` of one direction over ``codes (steps, rows)``."""
    h = weights["u"].shape[1]
    states = np.empty((codes.shape[0], h, codes.shape[1]), np.float32)
    state = np.zeros((h, codes.shape[1]), np.float32)
    seen, past = np.empty((3 * h, codes.shape[1]), np.float32), np.empty((3 * h, codes.shape[1]), np.float32)
    for step in range(codes.shape[0]):
        np.take(weights["w"], codes[step], axis=1, out=seen, mode="clip")
        np.matmul(weights["u"], state, out=past)
        gates = past[: 2 * h] + seen[: 2 * h]
        gate(gates)
        update, reset = gates[:h], gates[h:]
        new = reset * past[2 * h :]
        new += seen[2 * h :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((state, update, reset, past[2 * h :].copy(), new))
        next_state = states[step]
        np.subtract(state, new, out=next_state)
        next_state *= update
        next_state += new
        state = next_state
    return states


def scan_back(weights: dict, codes: np.ndarray, kept: list, slope: np.ndarray) -> dict:
    """Gradients of one direction by backpropagation through time, from those of its states."""
    h = weights["u"].shape[1]
    inputs = np.empty((codes.shape[0], 3 * h, codes.shape[1]), np.float32)
    by_u = np.zeros_like(weights["u"])
    carried = np.zeros_like(slope[0])
    for step in reversed(range(codes.shape[0])):
        before, update, reset, past, new = kept[step]
        d = slope[step] + carried
        d_new = d * (1 - update) * (1 - new**2)
        inputs[step] = np.concatenate([d * (before - new) * gate_slope(update), d_new * past * gate_slope(reset), d_new])
        recurrent = np.concatenate([inputs[step, : 2 * h], d_new * reset])
        by_u += recurrent @ before.T
        carried = d * update + weights["u"].T @ recurrent
    flat, where = inputs.transpose(1, 0, 2).reshape(3 * h, -1), codes.ravel()
    return {"u": by_u, "w": np.stack([np.bincount(where, row, 256) for row in flat]).astype(np.float32)}


def probabilities(model: dict, codes: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per position ``(steps, languages, rows)``, and the joined states they come from; ``codes (steps, rows)``."""
    ahead = scan(model["ahead"], codes, keep and keep[0])
    back = scan(model["back"], codes[::-1], keep and keep[1])[::-1]
    states = np.concatenate([ahead, back], 1)
    logits = np.matmul(model["out"]["v"], states)
    logits += model["out"]["c"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits, states


def train(stretches: np.ndarray, labels: np.ndarray, n_labels: int, hidden: int = 6, steps: int = 450, rows: int = 160, seed: int = 11) -> dict:
    """Fit by Adam on cross-entropy at every position; deterministic for given rows."""
    rng = np.random.default_rng(seed)

    def small(*shape: int, by: float = 0.3) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    model = {
        "ahead": {"w": small(3 * hidden, 256), "u": small(3 * hidden, hidden)},
        "back": {"w": small(3 * hidden, 256), "u": small(3 * hidden, hidden)},
        "out": {"v": small(n_labels, 2 * hidden), "c": np.zeros((n_labels, 1), np.float32)},
    }
    moments = {(part, k): [np.zeros_like(v), np.zeros_like(v)] for part in model for k, v in model[part].items()}
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(stretches), rows)
        codes, truth = stretches[pick].T, labels[pick]
        kept: tuple[list, list] = ([], [])
        p, states = probabilities(model, codes, kept)
        counted = COUNTS[codes][:, None, :]
        p[:, truth, np.arange(rows)] -= 1
        slope = (p * counted / max(1, counted.sum())).astype(np.float32)
        into, h = np.matmul(model["out"]["v"].T, slope), hidden
        grads = {
            "ahead": scan_back(model["ahead"], codes, kept[0], into[:, :h]),
            "back": scan_back(model["back"], codes[::-1], kept[1], into[::-1, h:]),
            "out": {"v": np.tensordot(slope, states, ((0, 2), (0, 2))), "c": slope.sum((0, 2))[:, None]},
        }
        size = np.sqrt(sum(float((g**2).sum()) for part in grads.values() for g in part.values()))
        rate = 0.02 * min(1, t / 20) * (0.1 + 0.9 * (1 - t / steps))
        for (part, k), (m, v) in moments.items():
            g = grads[part][k] * min(1, 1 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[part][k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def stretched(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in rows of ``STRETCH`` bytes, newline-padded, and each text's first row."""
    lens = np.diff(offsets)
    rows = np.concatenate([[0], np.cumsum(-(-lens // STRETCH))])
    codes = np.full(int(rows[-1]) * STRETCH, 10, np.uint8)
    codes[np.arange(len(data)) + np.repeat(rows[:-1] * STRETCH - offsets[:-1], lens)] = data
    return codes.reshape(-1, STRETCH), rows


def fit(docs: DataFrame, sample: int = 3000, per_text: int = 12) -> tuple[dict, list[str]]:
    """A network learned from about ``sample`` different labelled rows at most, chosen by hash of the whole row.

    ``docs`` needs doc_id, text and lang; rows without text or lang don't
    count, and rows alike in all three count once.  From each text up to
    ``per_text`` stretches are drawn, from anywhere in it; only they reach the
    driver, so neither many nor long texts do.
    """
    row = F.xxhash64("doc_id", "text", "lang")
    labelled = docs.where("lang IS NOT NULL AND text <> ''").select(row.alias("row"), "text", "lang")
    kinds = labelled.agg(F.approx_count_distinct("row", 0.02).alias("n")).first()["n"]
    if kinds > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(sample / kinds * (1 << 40)))

    def draw(batches):
        for batch in batches:
            for first, n in _text.slices(batch.column(1)):
                part = batch.slice(first, n)
                codes, starts = stretched(*_text.raw_bytes(part.column(1)))
                rows = part.column(0).to_pylist()
                picks = [np.random.default_rng(row & 0xFFFFFFFF).permutation(np.arange(a, b))[:per_text] for row, a, b in zip(rows, starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([codes[k].tobytes() for k in picks], pa.binary())], ["row", "lang", "codes"])

    drawn = labelled.mapInArrow(draw, "row bigint, lang string, codes binary").groupBy("row", "lang", "codes").agg(F.count(F.lit(1)).alias("copies"))
    rows = drawn.toPandas().sort_values(["row", "lang", "codes"])  # about `sample` rows at most
    langs = sorted(rows["lang"].unique())
    if not langs:
        return {}, []
    codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, STRETCH)
    label = np.repeat(rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), [len(c) // STRETCH for c in rows["codes"]])
    return train(codes, label, len(langs)), langs


def predicted(model: dict, langs: list[str], texts: pa.Array, batch_bytes: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Language and probability of each text: every position is labelled, and those with letters are averaged.

    ``und`` with 0 where the text is null or has no letter, or nothing was learned.
    """
    texts = pc.fill_null(texts, "")
    lettered = np.asarray(pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False), bool)
    pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if langs:
        for row, n in _text.slices(texts, batch_bytes):
            pooled = pool(model, texts.slice(row, n))
            pred[row : row + n] = np.array(langs, object)[pooled.argmax(1)]
            score[row : row + n] = np.clip(pooled.max(1), 0, 1)
    pred[~lettered], score[~lettered] = "und", 0.0
    return pred, score


def predictor(docs: DataFrame, model: dict, langs: list[str]):
    """A column function from texts to ``(lang_pred, score)``; only texts go to Python.

    The model is a few thousand numbers and travels with the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, langs))

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            pred, score = predicted(*sent.value, part)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return run.asNondeterministic()  # else it may be called twice for a row


def pool(model: dict, texts: pa.Array, most_rows: int = 2048) -> np.ndarray:
    """Mean probabilities ``(texts, languages)`` over the counted positions."""
    codes, first = stretched(*_text.raw_bytes(texts))
    sums, counts = np.zeros((len(codes), len(model["out"]["c"]))), np.zeros(len(codes))
    for a in range(0, len(codes), most_rows):
        part = np.ascontiguousarray(codes[a : a + most_rows].T)
        p, _ = probabilities(model, part)
        counted = COUNTS[part].astype(np.float32)
        sums[a : a + most_rows] = np.einsum("tcb,tb->bc", p, counted)
        counts[a : a + most_rows] = counted.sum(0)
    total = np.add.reduceat(sums, first[:-1], axis=0) if len(texts) else sums
    return total / np.maximum(np.add.reduceat(counts, first[:-1]), 1)[:, None]


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, sample: int = 3000) -> DataFrame:
    """Languages of all documents, learned from those whose ``crc32(doc_id) % modulus`` isn't ``held``.

    Each row gives one, repeated and null ids included; null and empty texts
    are ``und`` with score 0.  An empty table gives no rows; other columns are
    ignored.
    """
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    model, langs = fit(docs.where(~marked), sample)
    found = doc_columns(docs).withColumn("found", predictor(docs, model, langs)("text"))
    return found.select("doc_id", marked.alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, sample: int = 3000, least: float = LEAST) -> DataFrame:
    """``docs`` without the documents whose language can't be told, and ``lang`` filled in where it is null.

    A document goes if its text is null or without a letter, or if the network
    gives no language ``least`` on average over its letters.  Nothing learned
    (no labelled row) means no language can be told, but then only texts
    without letters go.  All other columns stay as they are.
    """
    model, langs = fit(docs, sample)
    (found,) = fresh(docs, "_found")
    known = docs.withColumn(found, predictor(docs, model, langs)("text"))
    pred, score = F.col(f"{found}.lang_pred"), F.col(f"{found}.score")
    told = (pred != "und") & (score >= least) if langs else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    lang = F.coalesce(F.col("lang"), F.when(pred != "und", pred))
    return known.where(told).select(*(lang.alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))

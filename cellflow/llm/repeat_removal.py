"""Removal of byte strings that stand in earlier documents, by suffix arrays over shared anchors.

Every window of ``width`` bytes has an anchor: the gram of ``GRAM`` bytes in it
whose hash is smallest.  Equal windows have equal anchors at equal places, so
windows are compared only among those of one anchor, and only anchors that two
documents share travel with their bytes.  There, the bytes around an anchor are
cut down to what another document has as well, equal strings become one, and a
suffix array of what is left finds the windows that are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _fold, _postings, _suffixes, _text
from cellflow.llm._shared import buckets, cut, doc_columns, fresh

GRAM = 24
#: Bytes of text whose grams are hashed at a time; some hundred bytes of arrays each.
SLICE = 600_000
#: Bytes of strings sorted in one suffix array.
ARRAY_BYTES = 100_000
#: Bytes of text for each bucket; buckets follow the input's size, so that none grows with it.
BUCKET_BYTES = 8_000_000
#: Rows of a hundred bytes that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000
_INDEX = np.uint64((1 << 30) - 1)
_PLACES = "place int, ids binary, marks binary, counts binary, starts binary, ends binary"
_CONTEXTS = "bucket int, keys binary, ids binary, marks binary, firsts binary, befores binary, lens binary, bytes binary"


def anchors(texts: pa.Array, width: int):
    """``(key, anchor, first, last)`` of the runs of windows with one anchor, each text's first run, and the bytes and starts of texts.

    Windows start at ``first`` to ``last``, the anchor's gram at ``anchor``.
    """
    data, offsets = _text.raw_bytes(texts)
    ends = offsets[1:] - 1
    many = width - GRAM + 1
    grams = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if grams < many:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(len(offsets), np.int64), data, offsets
    starts = np.arange(grams)
    hashes = _text.span_hashes(_text.prefix_sums(data, _text.PLAIN), starts, starts + GRAM)
    low = (hashes & ~_INDEX) | starts.astype(np.uint64)  # the leftmost of equal grams
    step = 1
    while 2 * step <= many:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < many:
        low = np.minimum(low[: len(low) - (many - step)], low[many - step :])
    chosen = (low & _INDEX).astype(np.int64)
    last_of = np.repeat(ends - width, np.diff(offsets))[: len(chosen)]
    windows = np.flatnonzero(np.arange(len(chosen)) <= last_of)
    text_of = np.repeat(np.arange(len(ends)), np.diff(offsets))[windows]
    at = chosen[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (text_of[1:] != text_of[:-1])
    edge = np.flatnonzero(new)
    stop = np.append(edge[1:], len(windows)) - 1 if len(edge) else edge
    return hashes[at[edge]], at[edge], windows[edge], windows[stop], np.searchsorted(text_of[edge], np.arange(len(ends) + 1)), data, offsets


def mark_of(sha: str) -> int:
    return int(sha[:16], 16)


def shared_anchors(docs: DataFrame, width: int, ways: int, places: int) -> DataFrame:
    """Packed ``(place, ids, marks, counts, keys)``: anchors that documents of different text share, by the place of the document."""

    def post(batches):
        packer, seen = _postings.Packer(ways), {}
        for batch in batches:
            names, shas, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            for row, n in _text.slices(texts, SLICE):
                keys, _, _, _, bounds, _, offsets = anchors(texts.slice(row, n), width)
                sizes = np.diff(offsets)
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    name, mark = names[row + i], mark_of(shas[row + i])
                    if name is not None and seen.get(mark, name + 1) > name:
                        seen[mark] = name
                        if packer.add(np.unique(keys[bounds[i] : bounds[i + 1]]), name, int(sizes[i]), mark):
                            yield packer.batch()
        if packer.table:
            yield packer.batch()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        key, doc, ids, _, marks = _postings.unpack(group)
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        both = same[1:] | same[:-1]
        key, doc = key[both], doc[both]
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        used, counts = np.unique(doc, return_counts=True)
        place = _fold.spread(ids[used], places)
        first = np.cumsum(counts) - counts
        rows = []
        for p in np.unique(place).tolist():
            mine = np.flatnonzero(place == p)
            index = np.repeat(first[mine] - (np.cumsum(counts[mine]) - counts[mine]), counts[mine]) + np.arange(counts[mine].sum())
            rows.append((p, ids[used[mine]].tobytes(), marks[used[mine]].tobytes(), counts[mine].astype("<u4").tobytes(), key[index].tobytes()))
        return pd.DataFrame(rows, columns=["place", "ids", "marks", "counts", "keys"])

    posted = docs.mapInArrow(post, _postings.SCHEMA)
    return posted.groupBy("bucket").applyInPandas(meet, "place int, ids binary, marks binary, counts binary, keys binary")


def placed(docs: DataFrame, rows: DataFrame, places: int) -> DataFrame:
    """Documents whose ids stand in packed ``rows`` (and few others), with their place."""
    docs = _fold.flagged(docs.select("doc_id", "text", "sha"), "doc_id", _fold.packed_bitmap(rows.select("ids")), "needed")
    return docs.where("needed").withColumn("place", _fold.spread_column("doc_id", places)).drop("needed")


def by_document(group: pd.DataFrame, *columns: tuple[str, type]) -> dict[tuple[int, int], list[np.ndarray]]:
    """Packed rows of a place as ``(id, mark): columns``."""
    if not len(group):
        return {}
    ids, marks, counts = (np.frombuffer(b"".join(group[c]), t) for c, t in (("ids", np.int64), ("marks", np.uint64), ("counts", "<u4")))
    values = [np.frombuffer(b"".join(group[c]), t) for c, t in columns]
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((owner, marks[owner], ids[owner]))
    owner, values = owner[order], [v[order] for v in values]
    new = np.ones(len(owner), bool)
    new[1:] = (ids[owner][1:] != ids[owner][:-1]) | (marks[owner][1:] != marks[owner][:-1])
    edge = np.flatnonzero(new)
    return {(int(ids[owner[a]]), int(marks[owner[a]])): [v[a:b] for v in values] for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(owner)], strict=True)}


def contexts(texts: DataFrame, keys: DataFrame, width: int, ways: int) -> DataFrame:
    """Packed ``(bucket, keys, ids, marks, firsts, befores, lens, bytes)``: for each shared anchor the bytes of its windows."""

    def run(docs: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        wanted = by_document(packed, ("keys", np.uint64))
        docs = docs[[(i, mark_of(s)) in wanted for i, s in zip(docs["doc_id"], docs["sha"], strict=True)]]
        out: list[tuple] = []
        texts = pa.array(docs["text"], pa.string())
        names, marks = docs["doc_id"].to_numpy(np.int64), np.array([mark_of(s) for s in docs["sha"]], np.uint64)
        for row, n in _text.slices(texts, SLICE):
            key, at, first, last, bounds, data, offsets = anchors(texts.slice(row, n), width)
            doc = np.repeat(np.arange(n), np.diff(bounds))
            mine = np.zeros(len(key), bool)
            for i in range(n):
                a, b = bounds[i], bounds[i + 1]
                mine[a:b] = np.isin(key[a:b] >> np.uint64(16) << np.uint64(16), wanted[int(names[row + i]), int(marks[row + i])][0])
            key, at, first, last, doc = key[mine], at[mine], first[mine], last[mine], doc[mine]
            bucket = (key >> np.uint64(16)) % np.uint64(ways)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(ways + 1))
            raw = data.tobytes()
            for b in np.flatnonzero(np.diff(edges)).tolist():
                k = order[edges[b] : edges[b + 1]]
                d = row + doc[k]
                body = b"".join([raw[x : y + width] for x, y in zip(first[k].tolist(), last[k].tolist(), strict=True)])
                out.append((b, key[k].tobytes(), names[d].tobytes(), marks[d].tobytes(), (first[k] - offsets[doc[k]]).tobytes(), (at[k] - first[k]).astype("<u1").tobytes(), (last[k] - first[k] + width).astype("<u1").tobytes(), body))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CONTEXTS.split(", ")])

    return texts.groupBy("place").cogroup(keys.groupBy("place")).applyInPandas(run, _CONTEXTS)


def prefix_lengths(key: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each row the bytes at the start of its side that another row of its key has too; 0 bytes end a side."""
    view = np.ascontiguousarray(sides).view(f"S{sides.shape[1]}").ravel()
    order = np.lexsort((view, key))
    a, b = order[:-1], order[1:]
    same = (sides[a] == sides[b]) & (sides[a] != 0)
    length = np.where(same.all(1), sides.shape[1], same.argmin(1))
    length[key[a] != key[b]] = 0
    out = np.zeros(len(key), np.int64)
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def repeats(group: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(id, mark, start, end)`` of the byte runs of one bucket whose windows stand in a document of smaller id."""
    key, ids, marks, firsts, before, lens = (np.frombuffer(b"".join(group[c]), t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("marks", np.uint64), ("firsts", np.int64), ("befores", "<u1"), ("lens", "<u1")))
    before, lens = before.astype(np.int64), lens.astype(np.int64)
    body, ends = b"".join(group["bytes"]), np.cumsum(lens)
    pieces = [body[b - n : b] for n, b in zip(lens.tolist(), ends.tolist(), strict=True)]
    classes: dict[tuple, int] = {}
    kind = np.fromiter((classes.setdefault(c, len(classes)) for c in zip(key.tolist(), before.tolist(), pieces, strict=True)), np.int64, len(key))
    least = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    # classes of one key, cut down to what another class of the key has too
    names = list(classes)
    own_key = np.array([c[0] for c in names], np.uint64)
    reach = 2 * width
    left, right = np.zeros((len(names), reach), np.uint8), np.zeros((len(names), reach), np.uint8)
    number = np.unique(own_key, return_inverse=True)[1]
    several = np.flatnonzero(np.bincount(number)[number] > 1)
    for i in several.tolist():
        _, b, piece = names[i]
        left[i, :b] = np.frombuffer(piece, np.uint8, b)[::-1]
        right[i, : len(piece) - b] = np.frombuffer(piece, np.uint8, len(piece) - b, b)
    earlier: dict[int, list[int]] = {}  # class: windows that stand in a smaller document
    if len(several):
        behind, ahead = prefix_lengths(own_key[several], left[several]), prefix_lengths(own_key[several], right[several])
        strings: dict[bytes, list[tuple[int, int]]] = {}
        for i, x, y in zip(several.tolist(), behind.tolist(), ahead.tolist(), strict=True):
            _, b, piece = names[i]
            if x + y >= width:
                strings.setdefault(piece[b - x : b + y], []).append((i, b - x))
        low_key = {s: min(int(own_key[i]) for i, _ in users) for s, users in strings.items()}
        blocks: list[list[bytes]] = [[]]
        held, last = 0, None
        for string in sorted(strings, key=low_key.__getitem__):
            now = low_key[string]
            if held > ARRAY_BYTES and now != last:
                blocks.append([])
                held = 0
            blocks[-1].append(string)
            held, last = held + len(string), now
        for block in blocks:
            runs = _suffixes.equal_windows(block, width) if block else []
            alone = {s for s in block if len(strings[s]) > 1}
            met = {(k, j) for run in runs for k, j in run}
            runs += [[(k, j)] for k, s in enumerate(block) if s in alone for j in range(len(s) - width + 1) if (k, j) not in met]
            for run in runs:
                users = [(i, shift + j) for k, j in run for i, shift in strings[block[k]]]
                low = min(least[i] for i, _ in users)
                for i, j in users:
                    if low < least[i]:
                        earlier.setdefault(i, []).append(j)
    out: list[tuple[int, int, int, int]] = []
    later = ids > least[kind]
    for r in np.flatnonzero(later).tolist():
        out.append((int(ids[r]), int(marks[r]), int(firsts[r]), int(firsts[r] + lens[r])))
    for r in np.flatnonzero(~later & np.isin(kind, np.fromiter(earlier, np.int64, len(earlier)))).tolist() if earlier else []:
        for j in earlier[int(kind[r])]:
            out.append((int(ids[r]), int(marks[r]), int(firsts[r]) + j, int(firsts[r]) + j + width))
    found = np.array(out, object).reshape(-1, 4)
    return found[:, 0].astype(np.int64), found[:, 1].astype(np.uint64), found[:, 2].astype(np.int64), found[:, 3].astype(np.int64)


def repeated_runs(docs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Packed removals by place, and the number of places.  ``docs``: doc_id, text, sha."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ways, places = buckets(spark, 1, size, BUCKET_BYTES), buckets(spark, 2, size, BUCKET_BYTES)
    keys = cut(shared_anchors(docs, width, ways, places))
    packed = contexts(placed(docs, keys, places), keys, width, places)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, marks, starts, ends = repeats(group, width)
        place = _fold.spread(ids, places)
        rows = []
        for p in np.unique(place).tolist():
            m = place == p
            rows.append((p, ids[m].tobytes(), marks[m].tobytes(), np.ones(m.sum(), "<u4").tobytes(), starts[m].tobytes(), ends[m].tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLACES.split(", ")])

    return cut(packed.groupBy("bucket").applyInPandas(run, _PLACES)), places


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], int, int]:
    """What is left of a text, the bytes removed, and the maximal runs removed."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = starts[new]
    last = ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return kept, int((last - first).sum()), len(first)


def _edited(docs: DataFrame, width: int, with_text: bool):
    """``(id, sha, n_removed, n_spans, kept_sha256[, kept])`` of the documents that lose bytes but for copies of whole texts."""
    removals, places = repeated_runs(docs, width)
    schema = "id bigint, sha string, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text

    def run(texts: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        spans = by_document(packed, ("starts", np.int64), ("ends", np.int64))
        rows = []
        for i, text, sha in zip(texts["doc_id"], texts["text"], texts["sha"], strict=True):
            if (own := spans.get((i, mark_of(sha)))) is not None:
                kept, removed, runs = kept_bytes(text.encode(), *own)
                body = b"".join(kept)
                rows.append((i, sha, removed, runs, hashlib.sha256(body).hexdigest(), *([body.decode("utf-8", "ignore")] * with_text)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).drop_duplicates(["id", "sha"])

    texts = placed(docs, removals, places).select("place", "doc_id", "text", "sha")
    return texts.groupBy("place").cogroup(removals.groupBy("place")).applyInPandas(run, schema)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


def _leads(base: DataFrame, width: int) -> DataFrame:
    """Texts that several rows have whole, with the smallest doc_id."""
    return base.where(f"n_bytes >= {width} AND doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("sha", "lead")


def measure_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """What each text loses when bytes covered by a ``width``-byte string of a document with smaller doc_id go.

    Texts are UTF-8 bytes; null and empty ones and those shorter than ``width``
    lose nothing.  Rows of equal doc_id take nothing from each other; rows with
    null doc_id lose and cover nothing.  An empty table gives no rows; other
    columns are ignored.
    """
    if not GRAM <= width < 128:
        raise ValueError(f"width must be {GRAM} to 127")
    docs = _marked(doc_columns(docs))
    base = cut(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"))
    edited = _edited(docs, width, False).withColumnRenamed("id", "doc_id")
    out = base.join(_leads(base, width), "sha", "left").join(edited, ["doc_id", "sha"], "left")
    copy = F.coalesce(F.col("lead") < F.col("doc_id"), F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with those bytes removed from their texts (of a cut character, the rest too); every row and every other column stays."""
    if not GRAM <= width < 128:
        raise ValueError(f"width must be {GRAM} to 127")
    sha, lead, whole, same, done, kept, may = fresh(docs, "_sha", "_lead", "_whole", "_id", "_edited", "_kept", "_may")
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    plain = _marked(doc_columns(docs))
    edited = cut(_edited(plain, width, True).select(F.col("id").alias(same), F.col("sha").alias(done), F.col("kept").alias(kept)))
    leads = _leads(plain.select("doc_id", F.octet_length("text").alias("n_bytes"), "sha"), width)
    leads = cut(leads.select(F.col("sha").alias(whole), F.col("lead").alias(lead)))
    if leads.count() <= BROADCAST_ROWS:
        leads = F.broadcast(leads)
    keyed = keyed.join(leads, F.col(sha) == F.col(whole), "left")
    # only texts that may have been edited are shuffled
    keyed = _fold.flagged(keyed, "doc_id", _fold.bitmap(edited.select(F.col(same).cast("long"))), may)
    stay = keyed.where(~F.col(may)).withColumn(kept, F.lit(None).cast("string"))
    other = keyed.where(F.col(may)).join(edited, (F.col("doc_id") == F.col(same)) & (F.col(sha) == F.col(done)), "left").drop(same, done)
    out = stay.unionByName(other)
    text = F.when(F.col(lead) < F.col("doc_id"), "").otherwise(F.coalesce(F.col(kept), F.col("text")))
    return out.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))

"""Jaccard self-join of documents' word n-grams by token-combination prefixes.

Shingles are ordered rare first.  Two sets of which the larger has ``s``
shingles share at least ``o = ceil(t * s)`` when their Jaccard is ``t``; then
their prefixes of ``|x| - o + k`` shingles share at least k.  Frequent shingles
are dealt into ``CLASSES`` classes by hash and prefixes extended to share
``k = CLASSES + 1``.  So a similar pair shares a rare shingle in its prefixes,
or k frequent ones, two of them in one class: rare shingles are indexed alone,
frequent ones as the pairs of each class.  Sets too small for k (``o < k``)
index their ordinary prefix alone as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellflow.llm import _fold, _graph, _postings, _text
from cellflow.llm._shared import buckets, cut, doc_columns

#: Classes of frequent shingles.
CLASSES = 8
#: Counters of shingles, and by how much a count must exceed the mean: so many of its deviations, and so many more.
COUNTER_BITS, DEVIATIONS, LEAST = 21, 6, 24
#: A key of up to so many documents gives all its pairs at once.
FEW = 3
#: Documents compared with one other in a group, and documents of a block whose sketches are compared.
BESIDE, TILE = 128, 2048
#: Keys of a bucket, about; buckets follow the number of keys, so that none grows with the input.
BUCKET = 700_000


def profile(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows from one pass: each document's set size, signature and sketch, and each task's shingle counters."""

    def run(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, many in _text.slices(texts):
                hashes, _, _, bounds, _ = _text.words_of(texts.slice(row, many), _text.NOT_SPACE)
                sizes, first, second, sets, cells = [], [], [], [], []
                for own in _text.shingles(hashes, bounds, n):
                    sizes.append(len(own))
                    first.append(int(_text.mix(own).sum(dtype=np.uint64)) - (1 << 63))
                    second.append(int(_text.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63))
                    sets.append(own)
                    cells.append(sketch(own))
                counters += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS).astype(np.int32)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": pd.array(names[row : row + many], "Int64"), "size": sizes, "first": first, "second": second, "sketch": cells, "part": pd.array([None] * many, "Int32"), "way": pd.array([None] * many, "Int32"), "data": [None] * many}), schema=PROFILE)
        made = _fold.parts(counters, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(made.reindex(columns=PROFILE.names), schema=PROFILE)

    return docs.mapInArrow(run, "doc_id bigint, size bigint, first bigint, second bigint, sketch binary, part int, way int, data binary")


PROFILE = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("sketch", pa.binary()), ("part", pa.int32()), ("way", pa.int32()), ("data", pa.binary())])


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall in each of 2**k cells by their low bits, with one to two of them a cell on average."""
    cells = 1 << max(3, (max(1, len(own)) - 1).bit_length() - 1)
    return np.minimum(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def may_link(size: int, cells: bytes, other_size: int, other_cells: bytes, percent: int) -> bool:
    """False only if the sets are surely below the threshold: they share no more than the smaller count in each cell."""
    x, y = np.frombuffer(cells, np.uint8), np.frombuffer(other_cells, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    shared = int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())
    return 100 * shared >= percent * (size + other_size - shared)


def promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that their sketches don't rule out."""
    a, b = (sketches.select(F.col("doc_id").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))

    @F.pandas_udf("boolean")
    def fits(size: pd.Series, cells: pd.Series, other_size: pd.Series, other_cells: pd.Series) -> pd.Series:
        return pd.Series([may_link(*v, percent) for v in zip(size, cells, other_size, other_cells, strict=True)], dtype=bool)

    return pairs.join(a, "a").join(b, "b").where(fits("a_size", "a_sketch", "b_size", "b_sketch")).select("a", "b").distinct()


def still_open(left: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different classes that share a run in ``left (run, id, size, class)`` and that sketches don't rule out.

    Runs go to their smallest document, where most runs of one group meet, so
    a pair is looked at about once.  Pairs exist as bits inside a task; only
    those that pass become rows.  A home with many documents is dealt out in
    pairs of blocks.
    """
    homes = left.groupBy("run").agg(F.min("id").alias("home"))
    rows = cut(left.join(homes, "run"))
    members = rows.select("home", "id", "size", "class").distinct()
    parts = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(parts, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("parts", "other")

    known = sketches.groupBy("doc_id", "size").agg(F.first("sketch").alias("sketch")).withColumnRenamed("doc_id", "id")
    runs = dealt(rows.select("home", "run", "id"))
    people = cut(dealt(members.join(known, ["id", "size"])))

    def run(runs: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        people = people.sort_values(["id", "size"]).reset_index(drop=True)
        low, high = (int(people[c].iloc[0]) for c in ("low", "high")) if len(people) else (0, 0)
        return pd.DataFrame(unlike(runs, people, low, high, percent), columns=["a", "b"]).astype("int64")

    keys = ["home", "low", "high"]
    return runs.groupBy(*keys).cogroup(people.groupBy(*keys)).applyInPandas(run, "a bigint, b bigint").distinct()


def unlike(runs: pd.DataFrame, people: pd.DataFrame, low: int, high: int, percent: int) -> np.ndarray:
    """``(a, b)`` of one pair of blocks."""
    ids, sizes, classes, block = (people[c].to_numpy() for c in ("id", "size", "class", "block"))
    first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
    met = np.zeros((len(first), len(second)), bool)
    at = np.searchsorted(ids, runs["id"].to_numpy())
    order = np.argsort(runs["run"].to_numpy(), kind="stable")
    edges = np.flatnonzero(np.diff(runs["run"].to_numpy()[order], prepend=runs["run"].min() - 1)) if len(runs) else []
    for members in np.split(at[order], edges[1:]) if len(edges) else []:
        members = np.unique(members)
        met[np.ix_(np.searchsorted(first, members[block[members] == low]), np.searchsorted(second, members[block[members] == high]))] = True
    i, j = np.nonzero(met)
    i, j = first[i], second[j]
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (classes[i] != classes[j]) & (100 * small >= percent * large)
    if low == high:
        keep &= i < j
    i, j = i[keep], j[keep]
    cells = np.array([len(c) for c in people["sketch"]])
    level = np.minimum(cells[i], cells[j])
    passed = np.zeros(len(i), bool)
    for width in np.unique(level).tolist():
        own = np.flatnonzero(cells >= width)
        place = np.zeros(len(cells), np.int64)
        place[own] = np.arange(len(own))
        table = np.stack([np.frombuffer(people["sketch"].iloc[k], np.uint8).reshape(-1, width).sum(0, dtype=np.uint16) for k in own.tolist()])
        mine = np.flatnonzero(level == width)
        for a in range(0, len(mine), max(1, 4_000_000 // width)):
            part = mine[a : a + max(1, 4_000_000 // width)]
            shared = np.minimum(table[place[i[part]]], table[place[j[part]]]).sum(1, dtype=np.int64)
            passed[part] = 100 * shared >= percent * (sizes[i[part]] + sizes[j[part]] - shared)
    i, j = ids[i[passed]], ids[j[passed]]
    return np.stack([np.minimum(i, j), np.maximum(i, j)], 1)


def keys_of(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of one ascending set; ``frequent`` marks hash prefixes."""
    size = len(own)
    least = -(-percent * size // 100)
    short, long = size - least + 1, min(size, size - least + CLASSES + 1)
    often = frequent[own >> np.uint64(64 - COUNTER_BITS)]
    if not often.any():
        return own[:long]
    rare, hot = own[~often], own[often]
    keys = [rare[:long]]
    hot = hot[: max(0, long - len(rare))]
    if least <= CLASSES:
        keys.append(hot[: max(0, short - len(rare))])
    classes = (hot >> np.uint64(7)) % np.uint64(CLASSES)
    for c in range(CLASSES):
        part = hot[classes == c]
        if len(part) > 1:
            i, j = np.triu_indices(len(part), 1)
            keys.append(_text.mix(part[i] * np.uint64(0x9E3779B97F4A7C15) ^ (part[j] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(keys)


def postings(docs: DataFrame, n: int, percent: int, frequent, ways: int) -> DataFrame:
    """Packed postings of all documents' keys; documents with equal sets go in once from each task."""

    def run(batches):
        hot = np.unpackbits(frequent.value).astype(bool)
        seen: set[tuple[int, int]] = set()
        packer = _postings.Packer(ways)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, many in _text.slices(texts):
                hashes, _, _, bounds, _ = _text.words_of(texts.slice(row, many), _text.NOT_SPACE)
                for name, own in zip(names[row : row + many], _text.shingles(hashes, bounds, n), strict=True):
                    if not len(own) or name is None:
                        continue
                    mark = int(_text.mix(own).sum(dtype=np.uint64))
                    if (len(own), mark) in seen:
                        continue
                    seen.add((len(own), mark))
                    if packer.add(keys_of(own, hot, percent), name, len(own), mark):
                        yield packer.batch()
        if packer.table:
            yield packer.batch()

    return docs.mapInArrow(run, _postings.SCHEMA)


def joined(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Candidates of one bucket: pairs ``(a, b)``, and as ``(key, id, size)`` in ``(run, a, b)`` the keys that more than ``FEW`` sets share.

    Of such a key all sets are paired with the first; the rest is settled when components are known.
    """
    key, kind, name, size, _ = _postings.unpack(group)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(key)))
    pairs = [np.zeros((0, 2), np.int64)]
    many = np.repeat(counts, counts)
    at = np.arange(len(key)) - np.repeat(starts, counts)
    first = np.repeat(kind[starts], counts)
    pairs.append(np.stack([first[at > 0], kind[at > 0]], 1))
    for gap in range(1, FEW):
        inner = np.flatnonzero((many <= FEW) & (at > 0) & (at + gap < many))
        pairs.append(np.stack([kind[inner], kind[inner + gap]], 1))
    pair = np.unique(np.concatenate(pairs), axis=0)
    low, high = np.minimum(size[pair[:, 0]], size[pair[:, 1]]), np.maximum(size[pair[:, 0]], size[pair[:, 1]])
    pair = pair[100 * low >= percent * high]
    out = [pd.DataFrame({"run": pd.array([None] * len(pair), "Int64"), "a": name[pair[:, 0]], "b": name[pair[:, 1]]})]
    large = np.flatnonzero(counts > FEW)
    sums = np.add.reduceat(_text.mix(kind.astype(np.uint64) + np.uint64(1)), starts) if len(key) else np.zeros(0, np.uint64)
    _, one = np.unique(sums[large], return_index=True)  # keys shared by the same sets count once
    chosen = np.zeros(len(starts), bool)
    chosen[large[one]] = True
    rows = np.repeat(chosen, counts)
    out.append(pd.DataFrame({"run": pd.array(key[rows].view(np.int64), "Int64"), "a": name[kind[rows]], "b": size[kind[rows]]}))
    return pd.concat(out)


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose texts' shingles reach the threshold, as ``(u, v)``.

    Only documents that stand in a pair are moved; one with many partners is compared with ``BESIDE`` of them at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BESIDE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    wanted = cut(dealt.select("a", "part", F.col("b").alias("id")).union(dealt.select("a", "part", F.col("a").alias("id")).distinct()))
    texts = _fold.flagged(docs, "doc_id", _fold.bitmap(wanted.select("id")), "needed").where("needed")
    gathered = wanted.join(texts, F.col("id") == F.col("doc_id")).select("a", "part", "id", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, _, _, bounds, _ = _text.words_of(pa.array(group["text"], pa.string()), _text.NOT_SPACE)
        a, ids = int(group["a"].iloc[0]), group["id"].to_numpy()
        sets = list(_text.shingles(hashes, bounds, n))
        found = set()
        for lead in (s for s, i in zip(sets, ids, strict=True) if i == a):
            for own, i in zip(sets, ids.tolist(), strict=True):
                if i != a and len(own) and len(lead):
                    at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    shared = int((lead[at] == own).sum())
                    if 100 * shared >= percent * (len(lead) + len(own) - shared):
                        found.add(i)
        return pd.DataFrame({"u": np.full(len(found), a), "v": np.array(sorted(found), np.int64)})

    return cut(gathered.groupBy("a", "part").applyInPandas(run, "u bigint, v bigint"))


def link_documents(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents that links of Jaccard ``percent / 100`` or more connect.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than ``n`` words is one shingle.  Null, empty and blank texts have no
    shingles and link with nothing.  Rows of equal doc_id are one node of the
    graph; each gives a row, as do rows with null doc_id, which link with nothing.
    An empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    docs = doc_columns(docs)
    profiles = cut(profile(docs, n))
    counters = _fold.fold(profiles.where("part IS NOT NULL"), "int32", "sum", 1 << COUNTER_BITS)
    usual = counters.mean()
    frequent = counters >= usual + DEVIATIONS * usual**0.5 + LEAST
    sent = spark.sparkContext.broadcast(np.packbits(frequent))
    rows = profiles.where("part IS NULL").select("doc_id", "size", "first", "second")
    filled = rows.where("size > 0 AND doc_id IS NOT NULL")
    equal = filled.groupBy("size", "first", "second").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = filled.join(equal, ["size", "first", "second"]).select(F.col("doc_id").alias("u"), "v").where("u <> v")

    amount = rows.agg((F.sum("size") * (100 - percent) / 100 + F.count(F.lit(1)) * CLASSES).alias("keys")).first()["keys"] or 0
    packed = postings(docs, n, percent, sent, buckets(spark, 1, amount, BUCKET))
    found = cut(packed.groupBy("bucket").applyInPandas(lambda g: joined(g, percent), "run bigint, a bigint, b bigint"))
    pairs = cut(found.where("run IS NULL").select("a", "b").distinct())
    sketches = profiles.where("part IS NULL AND size > 0 AND doc_id IS NOT NULL").select("doc_id", "size", "sketch")
    links = verified(docs, cut(promising(pairs, sketches, percent)), n, percent).union(copies)
    classes = _graph.components(links)
    runs = found.where("run IS NOT NULL").select("run", F.col("a").alias("id"), F.col("b").alias("size"))
    named = runs.join(classes, "id", "left").withColumn("class", F.coalesce("component_id", "id")).drop("component_id")
    open_runs = named.groupBy("run").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("run")
    left = cut(named.join(open_runs, "run"))
    if not left.isEmpty():
        more = still_open(left, sketches, percent).join(pairs, ["a", "b"], "left_anti")
        again = verified(docs, cut(more), n, percent)
        if not again.isEmpty():
            classes = _graph.components(links.union(again))
    out = rows.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id; rows with null doc_id stay."""
    others = link_documents(docs, n, percent).where("doc_id <> component_id").select("doc_id")
    return _fold.without_ids(docs, "doc_id", others)

"""Near-duplicate embeddings by a forest of random-projection trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm import _graph
from cellflow.llm._shared import cut, hashed_sample


class Forest:
    """Trees of random splits; a vector near a split goes to both sides.

    The overlap is half the typical projected distance of two vectors at the
    threshold.  A node is split while it is expected to hold more than ``leaf``
    of all vectors and a split makes it smaller; a tight cluster stays whole.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, trees: int = 5, leaf: int = 256, seed: int = 17):
        self.overlap = 0.5 * np.sqrt(2 * (1 - threshold) / max(1, sample.shape[1]))
        self.least = max(16, leaf * len(sample) / max(1, rows))
        rng = np.random.default_rng(seed)
        self.directions: list[np.ndarray] = []
        self.nodes: list[tuple[int, float, int, int]] = []  # direction, middle, left and right node; a leaf's direction is -1
        self.roots = [self._grow(sample, rng) for _ in range(trees)]
        self.axes = np.array(self.directions, np.float32) if self.directions else np.zeros((0, sample.shape[1]), np.float32)

    def _grow(self, part: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1))
        if len(part) > self.least:
            for _ in range(3):
                axis = rng.standard_normal(part.shape[1]).astype(np.float32)
                axis /= np.linalg.norm(axis)
                along = part @ axis
                middle = float(np.median(along))
                left, right = part[along <= middle + self.overlap], part[along >= middle - self.overlap]
                if max(len(left), len(right)) <= 0.85 * len(part):
                    self.directions.append(axis)
                    mine = len(self.directions) - 1
                    self.nodes[at] = (mine, middle, self._grow(left, rng), self._grow(right, rng))
                    break
        return at

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` pairs of unit vectors, for all trees."""
        rows, leaves = [], []
        todo = [(root, np.arange(len(unit))) for root in self.roots]
        while todo:
            node, part = todo.pop()
            axis, middle, left, right = self.nodes[node]
            if axis < 0:
                rows.append(part)
                leaves.append(np.full(len(part), node))
            elif len(part):
                along = unit[part] @ self.axes[axis]
                todo += [(left, part[along <= middle + self.overlap]), (right, part[along >= middle - self.overlap])]
        return np.concatenate(rows), np.concatenate(leaves)


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def stacked(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def places(vectors: DataFrame, forests) -> DataFrame:
    """A row of ``vectors (rep, copies, dim, embedding)`` for each leaf that the vector falls in."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                raw = np.array(part["embedding"].tolist(), np.float32).reshape(len(part), -1)
                row, leaf = forests.value[dim].leaves(units(raw).astype(np.float32))
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                yield pd.DataFrame({"dim": np.int32(dim), "leaf": leaf.astype(np.int32), "rep": rep[row], "copies": copies[row], "vector": [raw[i].tobytes() for i in row]})

    return vectors.mapInPandas(run, "dim int, leaf int, rep bigint, copies bigint, vector binary")


def compare(group: pd.DataFrame, forest: Forest, threshold: float, block: int = 512) -> pd.DataFrame:
    """Links within one tile of a leaf: per vector the other vectors linked, and an edge to the smallest of its component here.

    A pair that meets in several leaves counts in the first of them only.
    """
    group = group.drop_duplicates(["rep", "block"]).sort_values("rep")
    leaf, low, high = (int(group[c].iloc[0]) for c in ("leaf", "low", "high"))
    unit = units(stacked(group["vector"]))
    single = unit.astype(np.float32)
    blocks, copies = group["block"].to_numpy(), group["copies"].to_numpy()
    links = np.zeros(len(group), np.int64)
    root = np.arange(len(group))
    first, second = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    found = [(np.zeros(0, np.int64),) * 2]
    for a in range(0, len(first), block):
        for b in range(0, len(second), block):
            p, q = first[a : a + block], second[b : b + block]
            i, j = np.nonzero(single[p] @ single[q].T >= threshold - 1e-4)
            i, j = p[i], q[j]
            keep = i < j if low == high else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            for c in range(0, len(i), 32_768):  # exactly, in double precision
                p2, q2 = i[c : c + 32_768], j[c : c + 32_768]
                keep = np.einsum("ij,ij->i", unit[p2], unit[q2]) >= threshold
                found.append((p2[keep], q2[keep]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(i):
        return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    linked = np.unique(np.concatenate([i, j]))
    row, at = forest.leaves(single[linked])
    row, at = linked[row[at < leaf]], at[at < leaf]
    names, at = np.unique(at, return_inverse=True)
    sets = np.zeros((len(group), len(names) // 64 + 1), np.uint64)  # each vector's earlier leaves, a bit each
    np.bitwise_or.at(sets, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    for a in range(0, len(i), 200_000):
        p, q = i[a : a + 200_000], j[a : a + 200_000]
        new = ~(sets[p] & sets[q]).any(1)
        np.add.at(links, p[new], copies[q[new]])
        np.add.at(links, q[new], copies[p[new]])
    while True:  # the smaller root of each pair, until all agree
        small = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, small)
        np.minimum.at(root, j, small)
        root = root[root]
        if (root == before).all():
            break
    rep = group["rep"].to_numpy()
    used = (links > 0) | (root != np.arange(len(group)))
    return pd.DataFrame({"rep": rep[used], "links": links[used], "root": rep[root[used]]})


def deduplicate(embeddings: DataFrame, threshold: float = 0.95, trees: int = 5, leaf: int = 256, sample: int = 32_768, tile: int = 2048) -> DataFrame:
    """Near-duplicate classes of all vectors, by cosine in double precision.

    The forest is fitted on at most about ``sample`` vectors, chosen by hash;
    every vector is indexed.  Equal vectors are compared once and counted with
    their copies.  A leaf of more than ``tile`` vectors is dealt out in pairs of
    blocks, so no task holds more than two of them, and no pairs are emitted.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths never link.  Repeated
    vec_ids are rows of their own; one without vec_id has null component_id and
    kept, and is no one's representative unless it is alone.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)), F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))))
    valid = rows.where("embedding IS NOT NULL")
    kinds = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")))
    forests = {}
    for r in kinds.groupBy("dim").count().collect():  # one row for each length of vector
        own = kinds.where(F.col("dim") == r["dim"]).select("embedding")
        raw = hashed_sample(own, sample, "embedding").toPandas()["embedding"]
        forests[r["dim"]] = Forest(units(np.array(sorted(map(tuple, raw)), np.float32).reshape(-1, r["dim"])).astype(np.float32), r["count"], threshold, trees, leaf)
    sent = spark.sparkContext.broadcast(forests)
    placed = cut(places(kinds.select("rep", "copies", "dim", "embedding"), sent))
    large = placed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("dim", "leaf", F.ceil(F.col("n") / (tile // 2)).cast("int").alias("parts"))
    dealt = placed.join(large, ["dim", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return compare(group, sent.value[int(group["dim"].iloc[0])], threshold)

    found = cut(dealt.select("dim", "leaf", "low", "high", "block", "rep", "copies", "vector").groupBy("dim", "leaf", "low", "high").applyInPandas(run, "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = _graph.components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = kinds.join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(classes, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Element-wise folds of large fixed-size arrays made by tasks: counters and bitmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm._shared import cut, fresh

#: Bytes of an array that travel as one row.
PART = 1 << 16
SCHEMA = "part int, way int, data binary"
_OPERATIONS = {"sum": np.add, "or": np.bitwise_or}
#: Of the multiplicative congruence that spreads ids: a prime, and a multiplier whose products fit 63 bits.
_PRIME, _FACTOR = (1 << 31) - 1, 1_583_458_089


def spread(ids: np.ndarray, ways: int) -> np.ndarray:
    """Ids dealt out to ``ways`` numbers from 0 on, as ``spread_column`` does."""
    return np.mod(np.mod(np.mod(ids, _PRIME) * _FACTOR, _PRIME), ways)


def spread_column(name: str, ways: int):
    """``spread`` as an expression; null ids get 0."""
    mixed = F.pmod(F.pmod(F.coalesce(F.col(name), F.lit(0)), F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME))
    return F.pmod(mixed, F.lit(ways)).cast("int")


def parts(array: np.ndarray, way: int) -> pd.DataFrame:
    """Rows of an array, for ``fold``; ``way`` spreads the tasks over the first of its two levels."""
    raw = np.ascontiguousarray(array).tobytes()
    return pd.DataFrame({"part": np.arange(-(-len(raw) // PART), dtype=np.int32), "way": np.int32(way % 64), "data": [raw[i : i + PART] for i in range(0, len(raw), PART)]})


def fold(rows: DataFrame, dtype: str, operation: str, length: int) -> np.ndarray:
    """All tasks' arrays folded into one of ``length``, in two levels; the result has a fixed size and goes to the driver."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["data"].iloc[0], dtype).copy()
        for raw in group["data"].iloc[1:]:
            _OPERATIONS[operation](total, np.frombuffer(raw, dtype), out=total)
        return pd.DataFrame({"part": group["part"].iloc[:1], "way": group["way"].iloc[:1], "data": [total.tobytes()]})

    rows = rows.select("part", "way", "data")
    once = rows.groupBy("part", "way").applyInPandas(run, SCHEMA)
    twice = once.withColumn("way", F.lit(0)).groupBy("part", "way").applyInPandas(run, SCHEMA)
    out = np.zeros(length, dtype)
    size = PART // out.itemsize
    for r in twice.collect():  # as many rows as the array has parts
        out[r.part * size : r.part * size + size] = np.frombuffer(r.data, dtype)
    return out


#: Bits of one row of a bitmap, as Spark's bitmap functions have them.
ROW_BITS = 32_768
#: Bits of a bitmap of ids; over more ids than that it lets more through, and stays right.
FILTER_BITS = 1 << 24


def _spread_ids(ids: DataFrame) -> DataFrame:
    at = spread_column(ids.columns[0], FILTER_BITS)
    return ids.dropna().select(F.shiftright(at, 15).alias("part"), F.pmod(at, F.lit(ROW_BITS)).cast("long").alias("bit"))


def bitmap(ids: DataFrame) -> DataFrame:
    """``(part, bits)``, at most 512 rows of 4 KB, that tell most ids not in ``ids`` (one bigint column) from those in it."""
    return cut(_spread_ids(ids).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")))


def packed_bitmap(ids: DataFrame) -> DataFrame:
    """``bitmap`` of a binary column with many ids a row."""

    def run(frames):
        held = np.zeros(FILTER_BITS, bool)
        for frame in frames:
            held[spread(np.frombuffer(b"".join(frame.iloc[:, 0]), np.int64), FILTER_BITS)] = True
        rows = np.packbits(held, bitorder="little").reshape(-1, ROW_BITS // 8)
        some = np.flatnonzero(rows.any(1))
        yield pd.DataFrame({"part": some.astype(np.int32), "bits": [rows[i].tobytes() for i in some.tolist()]})

    return cut(ids.dropna().mapInPandas(run, "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")))


def flagged(docs: DataFrame, name: str, bits: DataFrame, flag: str) -> DataFrame:
    """``docs`` with a boolean ``flag``: true where id column ``name`` is in the bitmap, and seldom where it isn't; false for nulls."""
    part, row = fresh(docs.withColumn(flag, F.lit(True)), "_part", "_bits")
    at = spread_column(name, FILTER_BITS)
    inside = F.pmod(at, F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(row), F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col(name).isNotNull() & (F.getbit(byte, F.pmod(inside, F.lit(8))) == 1)
    joined = docs.join(F.broadcast(bits.toDF(part, row)), F.shiftright(at, 15) == F.col(part), "left")  # 2 MB at most
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(hit, F.lit(False)).alias(flag))


def without_ids(docs: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id column ``name`` is in ``ids`` (one bigint column).

    Rows that a bitmap of fixed size clears stay where they are; only the rest is joined.
    """
    gone, may = fresh(docs, "_gone", "_may")
    ids = cut(ids.toDF(gone).dropna().distinct())
    docs = flagged(docs, name, bitmap(ids), may)
    rest = docs.where(F.col(may)).join(ids, F.col(name) == F.col(gone), "left_anti")
    return docs.where(~F.col(may)).unionByName(rest).drop(may)

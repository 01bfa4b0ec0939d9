"""Best-fit packing of tokenized documents after dominance reduction.

Packing depends on lengths alone, and there are at most ``capacity`` of them.
So the packing problem is a histogram, whatever the number of documents: it is
reduced and packed by counts, which gives a plan of runs (so many pieces of a
length go to so many consecutive sequences at one offset).  Pieces look up
their place in the plan by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellflow.llm import _text, _tokens
from cellflow.llm._shared import buckets, cut, doc_columns

_pools: dict[str, _tokens.IdPool] = {}
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included.

    A document of more is cut into pieces of ``capacity`` ids, the first of
    which may be shorter.  Null and empty texts are the end id alone.
    """
    specials = _tokens.special_strings(tokenizer_path)

    def run(batches):
        pool = _pools.setdefault(tokenizer_path, _tokens.IdPool(tokenizer_path))
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            odd = _tokens.flagged(texts, specials) | (pool.encode.encoding is None)
            for row, n in _text.slices(texts):
                if odd[row : row + n].all():
                    data, offsets = _text.raw_bytes(pa.array([""] * n))
                else:
                    data, offsets = _text.raw_bytes(texts.slice(row, n))
                starts, ends = _tokens.spaced_chunks(data, offsets)
                hashes = _text.span_hashes(_text.prefix_sums(data, _text.PLAIN), starts, ends)
                ids, lens = pool.ids(hashes, starts, ends, data)
                sums = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, offsets)].tolist()
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(n):
                    if odd[row + i]:
                        own = np.array(_tokens.tokenizer(tokenizer_path).encode(texts[row + i].as_py(), add_special_tokens=False).ids + [end_id], np.uint32)
                    else:
                        own = np.append(ids[sums[i] : sums[i + 1]], np.uint32(end_id))
                    raw, total, start = memoryview(np.ascontiguousarray(own, "<u4")).cast("B"), len(own), 0
                    size, k = total % capacity or capacity, 0
                    while start < total:
                        for column, value in zip(out, (names[row + i], k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])), strict=True):
                            column.append(value)
                        start, size, k = start + size, capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_columns(docs).mapInArrow(run, PIECES)


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Sets that can be fixed for good, as ``(how many, lengths)``, and the counts that are left.

    For the longest piece: if no other fits beside it, it stands alone; if at
    most one fits, or one fills the sequence exactly, the longest that fits
    joins it; so does one at least as long as the longest pair, where no three
    fit.  Each of these sets dominates every other set with that piece.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[int, tuple[int, ...]]] = []
    found = True
    while found and left:
        found = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room, lengths = capacity - j, sorted(left)
                others = [k for k in lengths if k != j or left[j] > 1]
                fitting = others[: bisect_left(others, room + 1)]
                if not fitting:
                    times, chosen = left[j], (j,)
                else:
                    best = fitting[-1]
                    smallest: list[int] = []
                    for k in fitting:
                        smallest += [k] * min(3 - len(smallest), left[k] - (k == j))
                        if len(smallest) >= 3:
                            break
                    most = 1 + (len(smallest) > 1 and sum(smallest[:2]) <= room) + (len(smallest) > 2 and sum(smallest) <= room)
                    if best < room and most > 1 and not (most == 2 and best >= longest_pair(fitting, left, j, room)):
                        break
                    times, chosen = (left[j] // 2, (j, j)) if best == j else (min(left[j], left[best]), (j, best))
                for k in chosen:
                    left[k] -= times
                for k in set(chosen):
                    if not left[k]:
                        del left[k]
                fixed.append((times, chosen))
                found = True
    return fixed, left


def longest_pair(fitting: list[int], left: dict[int, int], j: int, room: int) -> int:
    most = 0
    for a in reversed(fitting):
        if 2 * a <= most:
            break
        at = bisect_left(fitting, min(a, room - a) + 1) - 1
        while at >= 0:
            b = fitting[at]
            if b < a or left[a] - (a == j) > 1:
                most = max(most, a + b)
                break
            at -= 1
    return most


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows ``(length, first rank, how many, first sequence, offset)`` and the number of sequences."""
    fixed, left = dominance_reduction(counts, capacity)
    plan: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(counts, 0)
    sequences = 0

    def place(length: int, times: int, first: int, offset: int) -> None:
        plan.append((length, ranks[length], times, first, offset))
        ranks[length] += times

    for times, chosen in fixed:
        offset = 0
        for length in chosen:
            place(length, times, sequences, offset)
            offset += length
        sequences += times
    room: dict[int, list[tuple[int, int]]] = {}  # space left: runs of sequences
    spaces: list[int] = []

    def keep(space: int, first: int, times: int) -> None:
        if space and times:
            if not room.setdefault(space, []):
                insort(spaces, space)
            room[space].append((first, times))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, times = room[space].pop()
                if not room[space]:
                    spaces.pop(at)
            else:
                space, first = capacity, sequences
                times = -(-todo // (capacity // length))
                sequences += times
            each = space // length
            full = min(times, todo // each)
            for k in range(each if full else 0):
                place(length, full, first, capacity - space + k * length)
            keep(space - each * length, first, full)
            todo -= full * each
            if full < times:
                rest = todo  # fewer than fill one more sequence
                for k in range(rest):
                    place(length, 1, first + full, capacity - space + k * length)
                keep(space - rest * length, first + full, 1 if rest else 0)
                skipped = full + (1 if rest else 0)
                keep(space, first + skipped, times - skipped)
                todo = 0
    return np.array(plan, np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``.

    The driver sees one count per length (at most ``capacity`` of them) and
    the plan made of them.  A piece's rank comes from two levels, so a length
    that most pieces share is spread over all tasks.
    """
    spark = pieces.sparkSession
    n = buckets(spark)
    pieces = cut(pieces).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = packing_plan(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])

    def run(batches):
        table = sent.value
        keys = (table[:, 0] << 44) | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).cast("long").alias("rank")).mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece.

    Null or empty texts are one piece of one id; repeated doc_ids are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)

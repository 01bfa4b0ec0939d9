"""Postings packed in binary columns: many 48-bit keys a row, with the documents they belong to.

A Spark row for each key would cost five times its bytes in the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

SCHEMA = "bucket int, keys binary, counts binary, ids binary, sizes binary, marks binary"
#: Postings and documents that a map task holds before it passes them on.
MOST, TABLE = 1_000_000, 60_000


class Packer:
    """Collects the keys of documents ``(id, size, mark)`` and deals them into ``ways`` buckets by key."""

    def __init__(self, ways: int):
        self.ways = ways
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.table, self.held = [], [], [], 0

    def add(self, keys: np.ndarray, doc_id: int, size: int, mark: int) -> bool:
        """True if it is time to pass on what is held."""
        self.keys.append(keys)
        self.counts.append(len(keys))
        self.table.append((doc_id, size, mark))
        self.held += len(keys)
        return self.held > MOST or len(self.table) > TABLE

    def batch(self) -> pa.RecordBatch:
        keys, rows = np.concatenate(self.keys), np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        ids, sizes, marks = zip(*self.table, strict=True)
        table = np.array(ids, np.int64), np.array(sizes, np.int32), np.array(marks, np.uint64)
        self.clear()
        at = ((keys >> np.uint64(16)) % np.uint64(self.ways)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(self.ways + 1))
        out: list[list] = [[] for _ in range(6)]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = order[edges[b] : edges[b + 1]]
            used, counts = np.unique(rows[part], return_counts=True)
            packed = np.ascontiguousarray(keys[part], "<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
            for column, v in zip(out, (b, packed.tobytes(), counts.astype("<u4").tobytes(), *(t[used].tobytes() for t in table)), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "keys", "counts", "ids", "sizes", "marks"])


def unpack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key`` and ``doc`` of each posting, ascending and without repeats; ``id``, ``size`` and ``mark`` of each doc.

    Documents of equal size and mark are one, with the smallest id; they are numbered by id.
    """
    wide = np.zeros((sum(map(len, group["keys"])) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b"".join(group["keys"]), np.uint8).reshape(-1, 6)
    key = wide.view("<u8").ravel()
    ids, sizes, marks, counts = (np.frombuffer(b"".join(group[c]), t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("marks", np.uint64), ("counts", "<u4")))
    order = np.lexsort((ids, sizes, marks))
    new = np.ones(len(ids), bool)
    new[1:] = (marks[order][1:] != marks[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    kind = np.empty(len(ids), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    by_id = np.argsort(ids[first], kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_id] = np.arange(len(first))
    doc = rank[kind[np.repeat(np.arange(len(ids)), counts)]]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = first[by_id]
    return key[fresh], doc[fresh], ids[first], sizes[first].astype(np.int64), marks[first]

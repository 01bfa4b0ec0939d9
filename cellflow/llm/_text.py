"""Vectorised words and hashes over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a single longer text is a slice of its own.
SLICE_BYTES = 600_000
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_SALT = np.random.default_rng(20250101).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two short tables whose products are ``base**i`` modulo 2**64: ``low[i % 4096] * high[i // 4096]``, for i up to n."""
    low = np.full(4097, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(n // 4096 + 1, low[4096], np.uint64)
    high[0] = 1
    return low[:4096], np.multiply.accumulate(high)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """``(first row, rows)`` of runs of rows of about ``most`` bytes."""
    lens = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lens)
    row = 0
    while row < len(lens):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
        yield row, stop - row
        row = stop


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, each followed by a newline, and each text's start (one more: the end)."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), *(pa.scalar(s, pa.large_string()) for s in ("", "\n")))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = ended.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes; the data must end with another byte."""
    word = is_word[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        turns = np.concatenate([[0], turns])
    return turns[0::2], turns[1::2]


def byte_table(fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z share those of a-z."""
    table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        table[65:91] = table[97:123]
    return table


FOLDED, PLAIN = byte_table(True), byte_table(False)


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    low, high = powers(_MULT, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    values = table[data]
    values *= (high[:, None] * low[None, :]).ravel()[: len(data)]
    np.cumsum(values, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between starts and ends, the same wherever they stand."""
    low, high = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * (low[starts & 4095] * high[starts >> 12]) + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array, is_word: np.ndarray, fold_case: bool = True):
    """Word hashes, their byte starts and ends, each text's first word (one more: the end), and the bytes."""
    data, offsets = raw_bytes(texts)
    starts, ends = spans(data, is_word)
    hashes = span_hashes(prefix_sums(data, FOLDED if fold_case else PLAIN), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets), data


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values: one for each start that has n left."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _SALT[0]
    for j in range(1, n):
        out += hashes[j : j + m] * _SALT[j]
    return mix(out + np.uint64(n))


#: Bytes that separate words in plain text: blank, tab, line ends.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM[0x41:0x5B] = True


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int = 5):
    """For each text in turn: the hashes of its n-word shingles, distinct and ascending."""
    every = combine(hashes, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            got = np.sort(every[a : b - n + 1])
            yield got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif b > a:
            yield combine(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)

"""Token ids and token counts by way of the distinct chunks of a text.

A chunk is a stretch of text that the tokenizer's own pre-tokenizer never
reaches across, so chunk results add up to the text's.  Chunks are known by a
64-bit hash of their bytes; memory is bounded, since a full slot is overwritten.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from cellflow.llm import _text

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer at ``path``, loaded once in each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def word_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without ASCII white space, for tokenizers that drop it."""
    return _text.spans(data, _text.NOT_SPACE)


def spaced_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White space with the run that follows it, for tokenizers that keep it.

    Text is cut only where ASCII white space follows something that isn't white
    space, be it ASCII or not; no pre-token of the byte-level pattern contains
    such a place.
    """
    space = ~_text.NOT_SPACE[data]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[1 : len(data)] = space[1:] & ~(space | wide_space_ends(data))[:-1]
    cuts[offsets] = True
    cuts[offsets[1:] - 1] = True  # the newline that ends each text is not part of it
    at = np.flatnonzero(cuts)
    starts, ends = at[:-1], at[1:]
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, offsets[1:] - 1)] = False
    return starts[own], ends[own]


def wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Marks the last bytes of white space beyond ASCII."""
    out = np.zeros(len(data), bool)
    for char in WHITE[6:]:
        code = char.encode()
        n = len(code)
        if len(data) >= n:
            hit = data[n - 1 :] == code[-1]
            for k in range(n - 1) if hit.any() else ():
                hit &= data[k : len(data) - n + 1 + k] == code[k]
            out[n - 1 :] |= hit
    return out


class Slots:
    """A direct-mapped table from 64-bit hashes to small numbers."""

    def __init__(self, bits: int, dtype: type = np.int64):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, dtype)

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = hashes >> self.shift
        self.keys[at] = hashes
        self.values[at] = values
        # of two hashes for a slot numpy keeps the last in both arrays

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = hashes >> self.shift
        return self.values[at], self.keys[at] == hashes


def unseen(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray):
    """The distinct hashes, where each of the given ones is among them, and their texts."""
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return distinct, back, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]


class Joined:
    """Encodes many chunks as one text, for byte-level BPE whose ids rise in merge order.

    The vocabulary is that of the tokenizer's own file; results are told apart
    again by the number of bytes that each id stands for.  ``encoding`` is None
    for a file of any other kind: its texts are left to the library, whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.encoding = None
        model, before = stored["model"], stored.get("pre_tokenizer") or {}
        plain = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True), stored.get("normalizer")) == ("ByteLevel", False, True, None)
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return
        vocabulary, added = model["vocab"], {t["content"] for t in stored["added_tokens"]}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        if any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 != len(ranks) or min(made, default=256) <= max(ranks[bytes([b])] for b in range(256)):
            return
        import tiktoken

        self.encoding = tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        inner = np.fromiter((t[0] in WHITE and t[-1] not in WHITE for t in texts), bool, len(texts))
        lens = np.zeros(len(texts), np.int64)
        joined = [t for t, ok in zip(texts, inner.tolist(), strict=True) if ok]
        ids = np.array(self.encoding.encode_ordinary("".join(joined)), np.uint32)
        ends = np.cumsum(self.sizes[ids]) if len(ids) else np.zeros(0, np.int64)
        stops = np.searchsorted(ends, np.cumsum([len(t.encode()) for t in joined])) + 1 if joined else np.zeros(0, np.int64)
        lens[inner] = np.diff(stops, prepend=0)
        alone = [self.encoding.encode_ordinary(t) for t, ok in zip(texts, inner.tolist(), strict=True) if not ok]
        lens[~inner] = [len(a) for a in alone]
        rows = np.repeat(np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)]), np.concatenate([lens[inner], lens[~inner]]))
        flat = np.concatenate([ids, np.array([i for a in alone for i in a], np.uint32)])
        return flat[np.argsort(rows, kind="stable")], lens


#: The pre-tokenizer pattern of byte-level BPE, and what Unicode calls white space, ASCII first.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class IdPool:
    """Ids of chunks, kept in one growing array until ``most`` ids are held."""

    def __init__(self, path: str, bits: int = 20, most: int = 4_000_000):
        self.path, self.bits, self.most = path, bits, most
        self.encode = Joined(path)
        self.reset()

    def reset(self) -> None:
        self.slots, self.pool, self.used = Slots(self.bits), np.zeros(1 << 20, np.uint32), 0

    def _store(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        at = self.used + np.cumsum(lens) - lens
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return (at << 32) | lens

    def ids(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and each chunk's number of them."""
        if self.used > self.most:
            self.reset()
        place, known = self.slots.get(hashes)
        new = np.flatnonzero(~known)
        if len(new):
            distinct, back, texts = unseen(hashes[new], starts[new], ends[new], data)
            got = self._store(*self.encode(texts))
            self.slots.put(distinct, got)
            place[new] = got[back]
        lens = place & 0xFFFFFFFF
        total = int(lens.sum())
        before = np.cumsum(lens) - lens
        where = np.repeat((place >> 32) - before, lens)
        where += np.arange(total)
        return self.pool[where], lens


def flagged(texts: pa.Array, strings: list[str]) -> np.ndarray:
    """Which texts contain one of the strings."""
    import pyarrow.compute as pc

    out = np.zeros(len(texts), bool)
    for s in strings:
        out |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False), bool)
    return out

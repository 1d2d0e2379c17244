"""Vectorised text helpers that run inside Spark tasks, on the buffers of Arrow string columns.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words can be cut on UTF-8 bytes.
Words are hashed by SipHash of their bytes under two keys; the hashes are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

CHUNK_BYTES = 1 << 21
U64 = np.uint64
#: Keys of the two word hashes, 16 characters each.
HASH_KEYS = ("barspark words 1", "barspark words 2")

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n codes from each place on (len(codes) - n + 1 places), built from hashes of 1, 2, 4, ... codes.

    Every step scrambles, so no sum runs over a whole gram: patterned texts collide no more often than others.
    """
    if len(codes) < n:
        return np.zeros(0, dtype=U64)
    part, size, out, done = codes, 1, None, 0
    while True:
        if n & size:
            out = part if out is None else _joined(out[: len(part) - done], part[done:])
            done += size
        if size * 2 > n:
            return out[: len(codes) - n + 1]
        part, size = _joined(part[:-size], part[size:]), size * 2


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        size = np.where(null, 0, np.diff(at))
        if (size != np.diff(at)).any():  # bytes under a null do not count
            raw = np.concatenate([raw[a : a + s] for a, s in zip(at[:-1], size)] or [raw[:0]])
            at = np.concatenate([[0], np.cumsum(size)])
    return raw, at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; a longer text stands alone."""
    raw, at = column_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def value_codes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings that lie side by side in ``data``, as numbers (equal strings, equal numbers), and the distinct strings."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)


def value_hashes(data: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """SipHash under two keys of each of the byte strings that lie side by side in ``data``: two independent 64-bit hashes."""
    code, distinct = value_codes(data, sizes)
    return [pd.util.hash_array(distinct, hash_key=key, categorize=False)[code] if len(code) else np.zeros(0, dtype=U64) for key in HASH_KEYS]


class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text (``first`` has one more entry)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        self.solid = solid = ~_SEP[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def hashes(self) -> list[np.ndarray]:
        """Two independent 64-bit hashes of each word's bytes."""
        return value_hashes(self.raw[self.solid], self.end - self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def gram_starts(words: Words, n: int) -> np.ndarray:
    """Indexes of the words at which n words of the same text begin."""
    last = np.repeat(words.first[1:], words.count)
    at = np.arange(len(last))
    return at[at + n <= last]


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in at least one of the half-open spans."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys

"""Words of Arrow text batches as numpy arrays.

Texts are read as their UTF-8 bytes. All separators used here are ASCII, so a
byte table decides exactly what a regular expression over code points would.
A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: [^\x20\x09-\x0D]
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALPHANUMERIC = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALPHANUMERIC[_low : _high + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of ``rows`` texts. ``first[r]`` to ``first[r + 1]`` are the words of row r."""

    data: np.ndarray  # bytes, lower-cased if asked
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``starts[i]:ends[i]``."""
    up, down = _powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, U64)
    prefix[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes with ``inside[byte]``; no run crosses a row's end."""
    data = LOWER[data] if lower else data
    offsets = offsets.astype(np.int64)
    member = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], member[:-1])) if len(member) else member
    after = np.concatenate((member[1:], [False])) if len(member) else member
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), span_hashes(data, starts, ends))


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    low = int(offsets[0]) if len(offsets) else 0
    high = int(offsets[-1]) if len(offsets) else 0
    return data[low:high], offsets - low


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that the texts of a slice have ``most`` bytes, or it has one row."""
    data, offsets = text_arrays(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``size``-word shingles of each row, and their row limits.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    counts = words.counts()
    factors = np.random.default_rng(size).integers(1, 1 << 63, size, dtype=np.uint64) * U64(2) + U64(1)
    long = np.flatnonzero(counts >= size)
    n = counts[long] - size + 1
    at = np.repeat(words.first[long] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else words.first[:0], n) + np.arange(n.sum())
    value = np.full(len(at), U64(size), U64)
    for k in range(size):
        value += words.hashes[at + k] * factors[k]
    rows = np.repeat(long, n)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = counts[short].astype(U64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] += words.hashes[words.first[short[has]] + k] * factors[k]
        value, rows = np.concatenate((value, whole)), np.concatenate((rows, short))
    value = mix(value)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(words.rows + 1))

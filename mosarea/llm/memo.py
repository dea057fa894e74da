"""Token ids of repeated text pieces, looked up instead of encoded again.

A piece is a byte range whose encoding does not depend on its neighbours; the
callers say why. Pieces are known by a 64-bit hash and kept in sorted arrays, so
that a whole slice of texts is answered by one search.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from mosarea.llm.words import U64

#: pieces kept by one worker; when full it starts again
MOST_PIECES = 1_500_000


class PieceMemo:
    """``encode`` gets new pieces as strings and returns their ids, piece by piece."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], keep_ids: bool = True, most: int = MOST_PIECES):
        self.encode, self.keep_ids, self.most = encode, keep_ids, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, U64)
        self.lengths = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.recent: list[tuple] = []

    def _merge(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.lengths = np.insert(self.lengths, at, lengths[order].astype(np.int32))
        if self.keep_ids:
            self.starts = np.insert(self.starts, at, starts[order])
            self.ids = np.concatenate((self.ids, ids))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Position of each piece in the memo; unknown pieces are encoded first."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            if len(self.keys) > self.most:
                self._clear()
                known[:] = False
            new = first[~known]
            raw = data.tobytes()
            texts = [raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            ids = self.encode(texts)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())) if self.keep_ids else self.ids
            self._merge(distinct[~known], lengths, flat)
            at = np.searchsorted(self.keys, distinct)
        return at[back]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after the other, and how many each piece has."""
        n = self.lengths[at].astype(np.int64)
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - n), n)
        return self.ids[places], n


#: memos that the tasks of one worker share
_SHARED: dict[object, PieceMemo] = {}


def shared_memo(key: object, make: Callable[[], PieceMemo]) -> PieceMemo:
    """The worker's memo for ``key``; kept from task to task until :func:`release_memos`."""
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def release_memos() -> None:
    """Let all shared memos go, and give what is free back to the system.

    A worker outlives its stage: tasks of other stages, which look no piece up, call this first.
    """
    if not _SHARED:
        return
    _SHARED.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim is not None:
        trim(0)

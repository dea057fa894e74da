"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of the benchmark (an item of fewer words is one
pattern). Patterns of one length share a shift table: for each block of two words,
how far the search may jump without passing an occurrence; a block in no pattern
jumps over a whole window. Where the shift is zero, the bucket of that suffix block
lists the patterns to try: first word hash, all word hashes, then the bytes.

The search moves all cursors of a slice of texts at once. Patterns are sent to the
executors' disks in blocks of at most ``block_windows``. Documents are read once, in one Arrow
step, and never shuffled: a worker takes a stretch of texts, splits it into words once, and
passes it through one block of patterns after the other, with one block in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mosarea.llm.maps import RESULT, map_texts, ragged
from mosarea.llm.words import ALPHANUMERIC, SLICE_BYTES, U64, Words, find_words

WINDOW = 13
#: most windows in the tables sent to every task at once; about 60 MB
BLOCK_WINDOWS = 200_000
#: bytes of text that pass a block of patterns before it is read again, where there are several
STRETCH_BYTES = 16 << 20
CURSOR_SPAN = 256

_A, _B = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Table:
    """Wu-Manber tables of the patterns of one length."""

    length: int
    bits: int
    shift: np.ndarray  # by block: words to jump
    bucket: np.ndarray  # by block: limits in `patterns` of those that end in it
    patterns: np.ndarray  # patterns x length word hashes, by suffix block
    texts: list[bytes]
    items: np.ndarray  # item numbers, pattern by pattern
    item_limits: np.ndarray


def _blocks(hashes: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Number of the block that ends at each word; blocks are two words, or one for one-word patterns."""
    both = hashes * _A
    if length > 1:
        both[1:] += (hashes[:-1] ^ (hashes[:-1] >> U64(29))) * _B
    return (both >> U64(64 - bits)).astype(np.int64)


def make_table(length: int, windows: dict[bytes, tuple[np.ndarray, set[int]]]) -> Table:
    texts = list(windows)
    patterns = np.array([windows[t][0] for t in texts], U64).reshape(len(texts), length)
    bits = int(np.clip(np.ceil(np.log2(max(2, patterns.size))) + 2, 12, 22))
    width = min(2, length)
    shift = np.full(1 << bits, length - width + 1, np.uint8)
    ends = np.stack([_blocks(p, length, bits) for p in patterns])[:, width - 1 :]
    for k in range(ends.shape[1]):
        np.minimum.at(shift, ends[:, k], np.uint8(ends.shape[1] - 1 - k))
    order = np.argsort(ends[:, -1], kind="stable")
    bucket = np.searchsorted(ends[order, -1], np.arange((1 << bits) + 1))
    owners = [sorted(windows[texts[k]][1]) for k in order]
    return Table(
        length,
        bits,
        shift,
        bucket,
        patterns[order],
        [texts[k] for k in order],
        np.array([i for o in owners for i in o], np.int64),
        np.concatenate(([0], np.cumsum([len(o) for o in owners]))),
    )


def occurrences(table: Table, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and pattern number of every occurrence."""
    m, counts = table.length, words.counts()
    rows = np.flatnonzero(counts >= m)
    none = np.empty(0, np.int64)
    if not len(rows):
        return none, none
    low, high = words.first[rows] + m - 1, words.first[rows + 1]
    n = -(-(high - low) // CURSOR_SPAN)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(low, n) + step * CURSOR_SPAN
    stop = np.minimum(at + CURSOR_SPAN, np.repeat(high, n))
    blocks = _blocks(words.hashes, m, table.bits)
    suspects = []
    while len(at):
        jump = table.shift[blocks[at]]
        zero = jump == 0
        if zero.any():
            suspects.append(at[zero])
        at = at + np.maximum(jump, 1)
        alive = at < stop
        at, stop = at[alive], stop[alive]
    if not suspects:
        return none, none
    ends = np.concatenate(suspects)
    first, last = table.bucket[blocks[ends]], table.bucket[blocks[ends] + 1]
    n = last - first
    begin = np.repeat(ends - m + 1, n)
    pattern = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    for k in range(m):
        same = words.hashes[begin + k] == table.patterns[pattern, k]
        begin, pattern = begin[same], pattern[same]
    sure = [
        b" ".join(words.data[words.starts[w] : words.ends[w]].tobytes() for w in range(b, b + m)) == table.texts[p]
        for b, p in zip(begin.tolist(), pattern.tolist())
    ]
    sure = np.array(sure, bool)
    return begin[sure], pattern[sure]


def _merge(spans: np.ndarray) -> np.ndarray:
    """Disjoint word ranges from overlapping (start, end) rows, sorted."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return np.stack((spans[new, 0], reach[last]), axis=1)


def _pattern_blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[tuple[list[str], list[Table]]]:
    """Item names and tables of at most ``most`` windows at a time; the driver holds one block."""
    names: dict[str, int] = {}
    windows: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    held = 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    for name, content in rows.toLocalIterator():
        raw = np.frombuffer(content.encode(), np.uint8)
        words = find_words(raw, np.array([0, len(raw)]), ALPHANUMERIC)
        count = len(words.hashes)
        length = min(window, count)
        parts = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        for k in range(count - length + 1 if count else 0):
            if held >= most:
                yield list(names), [make_table(n, w) for n, w in windows.items()]
                names, windows, held = {}, {}, 0
            mine = windows.setdefault(length, {})
            key = b" ".join(parts[k : k + length])
            if key not in mine:
                mine[key] = (words.hashes[k : k + length].copy(), set())
                held += 1
            mine[key][1].add(names.setdefault(name, len(names)))
    yield list(names), [make_table(n, w) for n, w in windows.items()]


class Hits:
    """Hit ranges and item names of a slice of texts, block of patterns by block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = find_words(data, offsets, ALPHANUMERIC)
        self.spans: dict[int, np.ndarray] = {}
        self.items: dict[int, set[str]] = {}

    def search(self, names: list[str], tables: list[Table]) -> None:
        new: dict[int, list[tuple[int, int]]] = {}
        for table in tables:
            begin, pattern = occurrences(table, self.words)
            rows = np.searchsorted(self.words.first, begin, "right") - 1
            for row, b, p in zip(rows.tolist(), begin.tolist(), pattern.tolist()):
                b -= int(self.words.first[row])
                new.setdefault(row, []).append((b, b + table.length))
                found = table.items[table.item_limits[p] : table.item_limits[p + 1]].tolist()
                self.items.setdefault(row, set()).update(names[i] for i in found)
        for row, spans in new.items():
            known = self.spans.get(row, np.empty((0, 2), np.int64))
            self.spans[row] = _merge(np.concatenate((known, np.array(spans, np.int64))))

    def columns(self) -> list[pa.Array]:
        rows = range(self.words.rows)
        found = [self.spans.get(r, np.empty((0, 2), np.int64)) for r in rows]
        limits = np.concatenate(([0], np.cumsum([2 * len(s) for s in found])))
        flat = np.concatenate([s.ravel() for s in found]) if found else np.empty(0, np.int64)
        items = [sorted(self.items.get(r, ())) for r in rows]
        return [pa.array(self.words.counts().astype(np.int64)), ragged(pa.array(flat.astype(np.int32)), limits), pa.array(items, pa.list_(pa.string()))]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Columns ``keep`` of the documents and ``__result``.

    ``__result`` has ``n_words``; ``hit_spans``, the word ranges inside occurrences,
    disjoint and in order, as start, end, start, end; ``item_ids``, the names of items
    found, sorted as strings. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text
    with A-Z lower-cased. Null or empty texts have no words and no hits; an item without words
    is never found; a null item id is the empty name; repeated items count once; repeated
    documents are judged each. An empty benchmark finds nothing.

    The benchmark passes the driver row by row, which holds one block of its patterns at a time;
    all blocks lie on the executors' disks until the result has been used.
    """
    keep = list(documents.columns if keep is None else keep)
    context = documents.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in _pattern_blocks(benchmark, item_id, item_text, window, block_windows)]
    several = len(sent) > 1

    def make():
        def run(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
            hits = Hits(data, offsets)
            for block in sent:
                hits.search(*block.value)
                if several and getattr(block, "_path", None):
                    vars(block).pop("_value", None)  # read from its file again for the next stretch
            return hits.columns()

        return run

    return map_texts(documents, text, FOUND, make, keep=keep, most=STRETCH_BYTES if several else SLICE_BYTES)


def n_hit(result: Column) -> Column:
    """Words inside at least one occurrence."""
    spans = result["hit_spans"]
    signed = F.transform(spans, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def contaminated(result: Column) -> Column:
    """At least one hit word, and hit words are at least a twentieth of all."""
    return (n_hit(result) > 0) & (n_hit(result) * 20 >= result["n_words"])

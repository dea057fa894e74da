"""Exact token counts of whole texts by overlapping chunks.

A text of up to ``chunk`` characters is encoded by the library at once. A longer one is
encoded in overlapping chunks with offsets. Two neighbours are spliced at a place that
both split at: from such a place on, the splitting reads the same characters in both, so
all tokens after it agree. The last split of the left chunk is not trusted, since its text
is cut off, and a chunk never ends inside what may become a special string. If no common
place is found, the overlap is doubled; if the whole left chunk has none, the chunk is.
What the right chunk has after the common place is the next left chunk, so that only
overlaps are encoded twice.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from mosarea.llm.maps import map_texts
from mosarea.llm.spans import row_texts

CHUNK_CHARS = 1024
OVERLAP_CHARS = 64

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "n_chunks", "n_widened")])


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _begins(encoding, k: int) -> bool:
    """Whether a split begins at token ``k``; a special token has no word and stands alone."""
    word = encoding.token_to_word(k)
    return word is None or k == 0 or word != encoding.token_to_word(k - 1)


def _last_common(left, base: int, first: int, end: int, right, back: int) -> tuple[int, int] | None:
    """Tokens of both chunks at the last place where both split: in the left one from the token ``first`` to the character ``end``.

    Read from the end, so that mostly one split is looked at. The last split of the left chunk is cut off and the first
    place of the right one is where it was cut: neither counts.
    """
    cut_off = True
    for k in range(len(left) - 1, first - 1, -1):
        if not _begins(left, k):
            continue
        place = base + left.token_to_chars(k)[0]
        if place >= end:
            continue
        if cut_off:
            cut_off = False
            continue
        if place <= back:
            break
        start = right.char_to_token(place - back)
        if start and right.token_to_chars(start)[0] == place - back and _begins(right, start):
            return k, start
    return None


def _begun(tail: str, special: list[str]) -> int:
    """Characters at the end of a chunk that may be the beginning of a special string."""
    return max((n for s in special if s[:1] in tail for n in range(1, min(len(s), len(tail) + 1)) if tail.endswith(s[:n])), default=0)


def count_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
    """Tokens of ``text``, chunks spliced and overlaps widened; encodes about ``chunk`` characters at once where alignment allows."""
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    longest = max(map(len, special), default=1)
    chunk = max(chunk, 4 * longest)

    def end(low: int, high: int) -> int:
        return len(text) if high >= len(text) else high - _begun(text[max(low, high - longest) : high], special)

    def encode(low: int, high: int):
        return tokenizer.encode(text[low:high], add_special_tokens=False)

    # tokens settled so far, characters settled (a common place) and its token in the left chunk
    total, low, token, chunks, widened = 0, 0, 0, 1, 0
    base, high = 0, end(0, chunk)
    left = encode(0, high)
    while high < len(text):
        width = overlap
        while True:
            back = max(high - width, low + 1)
            reach = end(back, high + chunk)
            right = encode(back, reach)
            common = _last_common(left, base, max(left.char_to_token(back - base) or 0, token + 1), high, right, back)
            if common or back == low + 1:
                break
            width *= 2
            widened += 1
        if common:
            settled, start = common
            total += settled - token
            low, token, base, high, left = base + left.token_to_chars(settled)[0], start, back, reach, right
            chunks += 1
        else:  # nothing to align in this chunk: read further
            chunk *= 2
            widened += 1
            base, token, high = low, 0, end(low, low + chunk)
            left = encode(low, high)
    return total + len(left) - token, chunks, widened


def counter(path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Function from a slice of texts to its byte and token counts, chunks and widened overlaps."""
    tokenizer = load_tokenizer(path)

    def run(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        texts = list(row_texts(data, offsets))
        found = np.ones((3, len(texts)), np.int64)
        found[2] = 0
        long = np.array([len(t) > chunk for t in texts], bool)
        short = np.flatnonzero(~long)
        found[0, short] = [len(e) for e in tokenizer.encode_batch_fast([texts[r] for r in short], add_special_tokens=False)]
        for row in np.flatnonzero(long):
            found[:, row] = count_spliced(tokenizer, texts[row], chunk, overlap)
        return [pa.array(c) for c in (np.diff(offsets).astype(np.int64), *found)]

    return run


def count_tokens(
    documents: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """Columns ``keep`` and ``__result`` with ``n_bytes`` (UTF-8), ``n_tokens``, ``n_chunks`` and ``n_widened``.

    ``path`` is a byte-level BPE tokenizer file, present on every executor. Counts are
    those of the library on the whole text, special strings inside texts taken as it
    does by default; ``n_chunks`` is 1 where nothing was spliced, ``n_widened`` counts overlaps and
    chunks that were doubled. Null is the empty text, with no bytes and no tokens. Rows are
    independent: repeated ids and ties play no part. No shuffle.
    """
    return map_texts(documents, text, COUNTS, lambda: counter(path, chunk, overlap), keep)

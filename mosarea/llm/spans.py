"""Spans found in whole texts: search by regular expression, digests and joins of spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, functions as F, types as T

#: (start, end, kind), code points, end exclusive
Span = tuple[int, int, str]

SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]
)


def row_texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
    raw = data.tobytes()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[low:high].decode()


def ordered(spans: Sequence[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by the listed order of kinds."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def join_spans(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of an array of spans, by start and then by the listed order of kinds."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])
    sortable = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(sortable), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

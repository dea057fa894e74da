"""Numpy functions over the texts of a DataFrame, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from mosarea.llm.memo import release_memos
from mosarea.llm.words import SLICE_BYTES, slices
from mosarea.session import ship_package

#: (text bytes, row offsets, batch of the input columns) -> one array per result field
TextFunction = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], Sequence[pa.Array]]

RESULT = "__result"


def map_texts(
    df: DataFrame,
    text: str,
    fields: T.StructType,
    make: Callable[[], TextFunction],
    keep: Sequence[str] | None = None,
    most: int = SLICE_BYTES,
    pieces: bool = False,
) -> DataFrame:
    """Columns ``keep`` (default: all) and one struct ``__result`` of ``fields``.

    ``make`` runs once per task and returns the function that sees whole texts,
    at most ``most`` bytes or one row at a time. Null texts come as empty ones. Memos of
    pieces that earlier tasks left in the worker go first, unless the function uses them (``pieces``).
    """
    ship_package(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    # plain names inside: those of the columns may hold dots or clash
    source = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(RESULT, fields)])
    width = len(keep)
    result_type = to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not pieces:
            release_memos()
        function = make()
        for batch in batches:
            for part, data, offsets in slices(batch, "__text", most):
                part = part.rename_columns([*keep, "__text"])
                arrays = [a.cast(result_type.field(k).type) if a.type != result_type.field(k).type else a for k, a in enumerate(function(data, offsets, part))]
                found = pa.StructArray.from_arrays(arrays, fields=list(result_type))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], found], names=schema.names)

    mapped = source.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], RESULT)


def ragged(values: pa.Array, limits: np.ndarray) -> pa.Array:
    """List array with row r = ``values[limits[r]:limits[r + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), values)

"""Column-set operations decided on the driver from schema names only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rename_by_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename old -> new; an unknown old name is an error."""
    missing = [old for old in names if old not in df.columns]
    if missing:
        raise ValueError(f"cannot rename absent columns {missing}")
    return df.withColumnsRenamed(dict(names))


def rename_by_function(df: DataFrame, function: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[function(name) for name in df.columns])


def snake_case(name: str) -> str:
    return name.lower().replace(" ", "_")


def rename_by_position(df: DataFrame, first: int, names: Sequence[str]) -> DataFrame:
    """Replace the names of consecutive columns starting at index ``first``."""
    columns = list(df.columns)
    if first < 0 or first + len(names) > len(columns):
        raise ValueError("more names than columns")
    columns[first : first + len(names)] = names
    return df.toDF(*columns)


def rename_by_pattern(df: DataFrame, *rules: tuple[str, str]) -> DataFrame:
    """Apply regular-expression rewrites, in order, to every column name."""

    def rewrite(name: str) -> str:
        for pattern, replacement in rules:
            name = re.sub(pattern, replacement, name)
        return name

    return rename_by_function(df, rewrite)


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefixes)]


def drop_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*with_prefix(df, *prefixes))


def shared_columns(left: DataFrame, right: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names present in both tables, in the order of ``left``."""
    excluded, other = set(exclude), set(right.columns)
    return [name for name in left.columns if name in other and name not in excluded]


def is_complete(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Whether a row has no null in ``columns`` (absent names are ignored) or in any column."""
    subset = list(df.columns) if columns is None else [c for c in columns if c in df.columns]
    complete = F.lit(True)
    for name in subset:
        complete = complete & F.col(f"`{name}`").isNotNull()
    return complete


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that are :func:`is_complete`."""
    return df.where(is_complete(df, columns))


def round_numeric(df: DataFrame, digits: int, keep: Sequence[str] = ()) -> DataFrame:
    """Round every floating column except ``keep``.

    Values are first cut to 9 decimals: a mean that ends in a 5 then rounds the
    same way in whatever order its terms were added.
    """
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.round(F.col(field.name), 9), digits).alias(field.name)
            if isinstance(field.dataType, floating) and field.name not in keep
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def quoted(name: str):
    """Column reference for names with dots, colons, plus or minus signs."""
    return F.col(f"`{name}`")

"""Null rules of survey tables that differ from SQL defaults.

A missing condition gives a missing result, membership is never missing, and a
plain mean or sum over a group with a missing value is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def member(column: Column, values: Sequence) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(column.isin(*values), F.lit(False))


def strict(aggregate: Column, *inputs: Column) -> Column:
    """``aggregate`` if every row of the group has all ``inputs``, else null."""
    complete = F.lit(True)
    for column in inputs:
        complete = complete & (F.count(column) == F.count(F.lit(1)))
    return F.when(complete, aggregate)


def strict_avg(column: Column) -> Column:
    return strict(F.avg(column), column)


def strict_sum(column: Column) -> Column:
    return strict(F.sum(column), column)


def weighted_mean(value: Column, weight: Column, skip_null_values: bool = True) -> Column:
    """Weighted mean; rows with a null value leave numerator and denominator."""
    if skip_null_values:
        used = F.when(value.isNotNull(), weight)
        missing_weight = F.count(F.when(value.isNotNull() & weight.isNull(), 1))
        return F.when(missing_weight == 0, F.sum(value * weight) / F.sum(used))
    return strict(F.sum(value * weight) / F.sum(weight), value, weight)


def strict_greatest(*columns: Column) -> Column:
    return F.when(_all_present(columns), F.greatest(*columns))


def strict_least(*columns: Column) -> Column:
    return F.when(_all_present(columns), F.least(*columns))


def _all_present(columns: Sequence[Column]) -> Column:
    present = F.lit(True)
    for column in columns:
        present = present & column.isNotNull()
    return present


def text_or_na(column: Column) -> Column:
    """Text of a column, with the two letters NA where it is missing."""
    return F.coalesce(column.cast("string"), F.lit("NA"))

"""Joins, grids, membership filters and join diagnostics.

No operator hints a broadcast: Spark broadcasts a side when its measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE measures it at run time)
and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mosarea.functions.columns import shared_columns


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    """Left equi join keeping one copy of the keys; ``null_safe`` keys match null to null."""
    if not null_safe:
        return left.join(right, list(keys), "left")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    conditions = [
        left[k].eqNullSafe(renamed[f"__r_{k}"]) if k in null_safe else left[k] == renamed[f"__r_{k}"] for k in keys
    ]
    joined = left.join(renamed, reduce(Column.__and__, conditions), "left")
    return joined.drop(*[f"__r_{k}" for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: Sequence[str] = ()) -> DataFrame:
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("no common columns")
    return left_join(left, right, keys, [k for k in null_safe if k in keys])


def keep_members(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``reference``.

    The reference shrinks to its distinct keys map-side before it moves.
    """
    return df.join(reference.select(key).distinct(), key, "left_semi")


def unmatched(left: DataFrame, right: DataFrame, key: str, left_tag: str, right_tag: str) -> DataFrame:
    """Keys found on one side only, tagged with the side."""
    only_left = left.select(key).distinct().join(right.select(key), key, "left_anti")
    only_right = right.select(key).distinct().join(left.select(key), key, "left_anti")
    return only_left.withColumn("side", F.lit(left_tag)).unionByName(
        only_right.withColumn("side", F.lit(right_tag))
    )


def apply_matched_names(df: DataFrame, matched: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """Replace ``name`` by the hand-matched spelling; names without a match become null."""
    pairs = matched.select(F.col(source).alias(name), F.col(target).alias("__matched"))
    return df.join(pairs, name, "left").withColumn(name, F.col("__matched")).drop("__matched")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that fan out a join, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_dup")).where(F.col("n_dup") > 1)


def level_grid(areas: DataFrame, area: str, levels: DataFrame) -> DataFrame:
    """Every area with every ``(var, level)`` pair.

    The pairs are a fixed small domain, so they travel as one array value and
    are exploded next to each area row.
    """
    domain = levels.select("var", "level").distinct().agg(F.collect_list(F.struct("var", "level"))).scalar()
    return (
        areas.select(area).distinct().select(area, F.explode(domain).alias("d")).select(area, "d.var", "d.level")
    )


def replicate_over(df: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    """Each row once per distinct value of a calendar-like dimension column."""
    values = dimension.agg(F.array_sort(F.collect_set(column))).scalar()
    return df.withColumn(column, F.explode(values))


def union_by_name(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

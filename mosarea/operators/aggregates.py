"""Grouped summaries, shares, stacked group-bys and global prefix sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosarea.functions.nulls import strict_avg, strict_sum


def stacked_groups(df: DataFrame, variables: Sequence[str], keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """``(var, level)`` summaries for a list of variables in one pass.

    One unpivot and one partially aggregated shuffle instead of a job per
    variable. Columns used by the aggregates must not be among ``variables``.
    """
    others = [c for c in df.columns if c not in variables]
    long = df.select(*[F.col(c) for c in others], *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(
        others, list(variables), "var", "level"
    )
    return long.groupBy(*keys, "var", "level").agg(*[column.alias(name) for name, column in aggregates.items()])


def share_of_total(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``value / sum(value)`` overall or inside groups.

    The overall total is a scalar subquery, not a window, so no task receives
    the whole table; group totals are a partial aggregate joined back.
    """
    if not by:
        return df.withColumn(name, F.col(value) / df.agg(strict_sum(F.col(value))).scalar())
    totals = df.groupBy(*by).agg(strict_sum(F.col(value)).alias("__total"))
    keys = list(by)
    joined = df.join(totals.withColumnsRenamed({k: f"__k_{k}" for k in keys}), _same(df, keys), "left")
    return joined.withColumn(name, F.col(value) / F.col("__total")).drop("__total", *[f"__k_{k}" for k in keys])


def _same(df: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(F.col(f"__k_{key}"))
    return condition


def prefixed_means(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Mean of every column whose name starts with one of the prefixes, nulls skipped."""
    names = [c for c in df.columns if c.startswith(tuple(prefixes))]
    return df.groupBy(*keys).agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names])


def exact_quantiles(value: str | Column, probabilities: Sequence[float]) -> Column:
    """Linear-interpolation quantiles as an array."""
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities]))


def score_histogram(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Counts of equal-width bins over [0, 1]; 1 belongs to the last bin."""
    bin_index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(bin_index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def change_check(before: DataFrame, after: DataFrame, key: str, weight: str) -> DataFrame:
    """Relative change of weight totals per key."""
    first = before.groupBy(key).agg(F.sum(weight).alias("weight_before"))
    second = after.groupBy(key).agg(F.sum(weight).alias("weight_after"))
    return first.join(second, key, "left").withColumn(
        "pct_change", (F.col("weight_after") - F.col("weight_before")) / F.col("weight_before")
    )


def error_by_group(df: DataFrame, key: str, actual: str, estimate: str, weight: str | None = None) -> DataFrame:
    """Raw and weighted means of actual and estimate with their differences."""
    a, e = F.col(actual), F.col(estimate)
    measures = {"act_raw": strict_avg(a), "est_raw": strict_avg(e)}
    if weight is not None:
        w = F.col(weight)
        measures["act_w"] = strict_sum(a * w) / strict_sum(w)
        measures["est_w"] = strict_sum(e * w) / strict_sum(w)
    out = df.groupBy(key).agg(*[c.alias(n) for n, c in measures.items()])
    out = out.withColumn("pred_error_raw", F.col("est_raw") - F.col("act_raw"))
    if weight is not None:
        out = out.withColumn("pred_error_w", F.col("est_w") - F.col("act_w"))
    return out


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """``(column, name)`` dimension: rank of the sorted distinct non-null values.

    Meant for calendar months, weeks and administrative areas, whose number is
    fixed by calendar and geography; the distinct step runs before the ranking,
    so the one ordered task sees only those values.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.withColumn(name, F.row_number().over(Window.orderBy(column)))


def tie_groups(df: DataFrame, keys: Sequence[str], value: str, **counts: Column) -> DataFrame:
    """One row per distinct value with counts: the unit on which ranks are computed."""
    return df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])


def value_buckets(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Increasing cut points that split the distinct values into even ranges."""
    probabilities = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, probabilities, 10000)).first()[0] or []
    return sorted(set(found))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below the value: a monotone function of it."""
    if not cuts:
        return F.lit(0)
    points = F.split(F.lit(",".join(repr(float(c)) for c in cuts)), ",").cast("array<double>")
    return F.size(F.filter(points, lambda p: p < value))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, str], buckets: int | None = None
) -> DataFrame:
    """Sum of each column over all rows of the group with a smaller ``order``.

    ``df`` holds one row per distinct ``order`` in a group. A window over a
    large group would run in one task; here the order is cut into value ranges,
    ranges are summed and offset against each other (a few rows), and the
    window only runs inside a range. There are two ranges per shuffle partition
    unless ``buckets`` says otherwise.
    """
    buckets = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = value_buckets(df, order, buckets)
    parts = df.withColumn("__bucket", bucket_of(F.col(order).cast("double"), cuts))
    sums = parts.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__sum_{c}") for c in totals])
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__bucket", *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in totals]
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(offsets, [*keys, "__bucket"])
    return joined.select(
        *df.columns,
        *[
            (F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name)
            for c, name in totals.items()
        ],
    )


def global_quantiles(
    counted: DataFrame, value: str, freq: str, probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles ``q`` of a large column, per group of ``keys`` if given.

    ``counted`` has one row per group and distinct value. Each quantile lies between two
    order statistics, found as the smallest value whose running count passes
    the position, so no task holds all values of a group.
    """
    ranked = running_totals(counted, list(keys), value, {freq: "__before"})
    totals = counted.groupBy(*keys).agg(F.sum(freq).alias("__n"))
    ranked = ranked.withColumn("__upto", F.col("__before") + F.col(freq))
    ranked = ranked.join(totals, list(keys)) if keys else ranked.withColumn("__n", totals.scalar())
    picks = []
    for p in probabilities:
        position = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(position)
        at = lambda index: F.min(F.when(F.col("__upto") > index, F.col(value)))
        lower, upper = at(low), at(F.least(low + 1, F.col("__n") - 1))
        fraction = F.max(position - low)
        picks.append(lower + fraction * (upper - lower))
    return ranked.groupBy(*keys).agg(F.array(*picks).alias("q"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, bounded: bool = False) -> DataFrame:
    """``df`` with the average-tie rank of ``value`` inside ``keys`` (nulls keep a null rank).

    ``bounded`` groups, such as the districts of one month, are ranked with a plain
    window. Otherwise counted distinct values are ranked by value ranges and joined back.
    """
    if bounded:
        order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        rank = F.rank().over(order) + (ties - 1) / 2.0
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))
    present = df.where(F.col(value).isNotNull())
    groups = tie_groups(present, keys, value, __ties=F.count(F.lit(1)))
    ranked = running_totals(groups, keys, value, {"__ties": "__below"})
    ranked = ranked.select(
        *keys, value, (F.col("__below") + (F.col("__ties") + 1) / 2.0).cast("double").alias(name)
    )
    return df.join(ranked, [*keys, value], "left")

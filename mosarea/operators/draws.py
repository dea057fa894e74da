"""Tables about posterior draws: parameter summary and trace table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mosarea.functions.nulls import text_or_na
from mosarea.operators.aggregates import exact_quantiles


def named_parameters(draws: DataFrame, params: Sequence[str], covariate_names: Sequence[str]) -> DataFrame:
    """Selected parameters with readable names; betas take the covariate names."""
    names = F.array(*[F.lit(n) for n in covariate_names])
    readable = (
        F.when(F.col("param") == "b0", F.lit("Intercept"))
        .when(F.col("param") == "betas", F.get(names, F.col("i") - 1))
        .otherwise(F.col("param"))
    )
    return draws.where(F.col("param").isin(*params)).withColumn("name", readable)


def parameter_summary(named: DataFrame, digits: int = 3) -> DataFrame:
    """Posterior mean and 95 % interval per parameter, rounded."""
    grouped = named.groupBy("name").agg(F.avg("value").alias("mean"), exact_quantiles("value", [0.025, 0.975]).alias("q"))
    return grouped.select(
        "name",
        F.round("mean", digits).alias("mean"),
        F.round(F.col("q")[0], digits).alias("q2_5"),
        F.round(F.col("q")[1], digits).alias("q97_5"),
    )


def trace_table(named: DataFrame) -> DataFrame:
    """``(chain, iteration, name, value)`` for trace plots."""
    return named.select("chain", "iteration", "name", "value")


def chain_summary(named: DataFrame) -> DataFrame:
    """Mean and standard deviation of each parameter in each chain."""
    return named.groupBy("name", text_or_na(F.col("chain")).alias("chain")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def interaction_arrays(draws: DataFrame, param: str = "psi") -> DataFrame:
    """``(draw, psi)`` with the matrix of each draw as one column-major array."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "i", "value")))
    return draws.where(F.col("param") == param).groupBy("draw").agg(ordered.alias("e")).select(
        "draw", F.col("e.value").alias(param)
    )

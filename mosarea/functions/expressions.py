"""Scalar expressions: text, dates, link functions, densities, keyed uniforms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, functions as F

from mosarea.functions.nulls import text_or_na


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def level_tag(level: float) -> str:
    """Coverage level as a column suffix: 0.8 -> '80'."""
    return f"{level * 100:g}"


def title_case(column: Column) -> Column:
    """First letter of every blank-separated word in upper case, rest lower."""
    return F.initcap(column)


def cell_label(*columns: Column) -> Column:
    """'a x b x c', missing parts shown as NA."""
    return F.concat_ws(" x ", *[text_or_na(c) for c in columns])


def month_label(column: Column) -> Column:
    return F.date_format(column, "MMMM yyyy")


def logistic(eta: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-eta))


def log1p_exp(eta: Column) -> Column:
    """log(1 + exp(eta)) without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def bernoulli_logit_log_mass(successes: Column, trials: Column, eta: Column) -> Column:
    """Log mass of ``successes`` out of ``trials`` Bernoulli draws, no multiplicity term."""
    return successes * eta - trials * log1p_exp(eta)


HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)


def normal_log_density(x: Column, mean: float | Column, sd: float | Column) -> Column:
    sd = F.lit(sd) if isinstance(sd, (int, float)) else sd
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd) - HALF_LOG_TWO_PI


def cauchy_log_density(x: Column, location: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - location) / scale
    return -F.log1p(z * z) - math.log(math.pi * scale)


def pc_precision_log_density(precision: Column, u: float = 1.0, alpha: float = 0.01) -> Column:
    """Penalised-complexity density of a precision with P(sd > u) = alpha (type-2 Gumbel)."""
    rate = -math.log(alpha) / u
    return math.log(rate / 2.0) - 1.5 * F.log(precision) - rate / F.sqrt(precision)


# Fixed values of the keyed generator: a prime modulus, one multiplier per key
# position, and the two round constants. x -> x^5 permutes residues of this prime.
UNIFORM_PRIME = 2147483647
UNIFORM_MULTIPLIERS = (48271, 69621, 16807, 39373, 30903)
UNIFORM_ROUNDS = (1013904223, 715225739)


def keyed_uniform(keys: Sequence[Column], seed: int = 1234) -> Column:
    """Uniform number in [0, 1) that depends only on integer keys and a seed.

    The same row always gets the same number, however the data are partitioned
    and however often a task is retried, which ``rand()`` cannot promise.
    """
    if len(keys) > len(UNIFORM_MULTIPLIERS):
        raise ValueError(f"at most {len(UNIFORM_MULTIPLIERS)} keys")
    prime = F.lit(UNIFORM_PRIME).cast("bigint")
    state = F.lit(seed).cast("bigint")
    for key, multiplier in zip(keys, UNIFORM_MULTIPLIERS):
        state = state + (F.abs(key.cast("bigint")) % prime) * F.lit(multiplier).cast("bigint")
    state = state % prime
    for constant in UNIFORM_ROUNDS:
        square = (state * state) % prime
        state = ((((square * square) % prime) * state) % prime + F.lit(constant).cast("bigint")) % prime
    return state.cast("double") / float(UNIFORM_PRIME)


def text_key(*columns: Column) -> Column:
    """Non-negative 32-bit integer key of text columns, stable across engines."""
    joined = F.concat_ws("|", *[text_or_na(c) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")

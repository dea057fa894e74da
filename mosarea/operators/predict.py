"""Posterior prediction and post-stratification over draws.

Draws are a key, never a loop. Draw tables are long ``(draw, param, i, j,
value)``; rows to score carry ``adm2_index``, ``month_idx`` (interviews only)
and covariates ``x1 .. xB``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosarea.functions.expressions import (
    UNIFORM_MULTIPLIERS,
    UNIFORM_PRIME,
    UNIFORM_ROUNDS,
    keyed_uniform,
    logistic,
)
from mosarea.functions.recode import interactions
from mosarea.session import cut_lineage, ship_package, written_table
from mosarea.sources.tables import settle_dimension

RESPONSES = ("pr", "binary", "binomial")
INTERACTIONS = ("adm1_index", "adm2_index")
RESULT_KEYS = ("adm2_index", "month_idx", "draw")


def coefficient_table(draws: DataFrame, n_covariates: int) -> DataFrame:
    """``(draw, b0, b1 .. bB)``, one row per draw."""
    value = lambda test: F.max(F.when(test, F.col("value")))
    return (
        draws.where(F.col("param").isin("b0", "betas"))
        .groupBy("draw")
        .agg(
            value(F.col("param") == "b0").alias("b0"),
            *[
                value((F.col("param") == "betas") & (F.col("i") == k)).alias(f"b{k}")
                for k in range(1, n_covariates + 1)
            ],
        )
    )


def coefficient_dimension(draws: DataFrame, n_covariates: int) -> DataFrame:
    """Coefficients settled as a dimension: one row per draw, joined by its measured size."""
    return settle_dimension(coefficient_table(draws, n_covariates))


def effect_table(draws: DataFrame, regions: DataFrame, interaction: str = "adm1_index") -> DataFrame:
    """``(adm2_index, month_idx, draw, effect)``: sum of area, month and interaction effects.

    Size is districts x months x draws, independent of the number of interviews.
    """
    if interaction not in INTERACTIONS:
        raise ValueError(f"interaction must be one of {INTERACTIONS}")
    total = lambda params, name: (
        draws.where(F.col("param").isin(*params)).groupBy("draw", "i").agg(F.sum("value").alias(name))
    )
    area = total(["phi", "theta"], "area").withColumnRenamed("i", "adm2_index")
    month = total(["nu", "xi"], "month").withColumnRenamed("i", "month_idx")
    psi = draws.where(F.col("param") == "psi").select(
        "draw", F.col("i").alias("month_idx"), F.col("j").alias("__place"), F.col("value").alias("psi")
    )
    places = regions.select("adm2_index", F.col(interaction).alias("__place")).distinct()
    return (
        psi.join(places, "__place")
        .join(area, ["draw", "adm2_index"])
        .join(month, ["draw", "month_idx"])
        .select("adm2_index", "month_idx", "draw", (F.col("area") + F.col("month") + F.col("psi")).alias("effect"))
    )


def packed_draws(
    draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index", months: DataFrame | None = None
) -> DataFrame:
    """``(adm2_index, draw, v, e, m)``: coefficients, and effects with their months, as arrays.

    The same effects as :func:`effect_table`, one row per district and draw. The numbers of a draw move once, to
    one row, and its districts are unfolded there: no join has a table that grows with the draws on both sides.
    """
    if interaction not in INTERACTIONS:
        raise ValueError(f"interaction must be one of {INTERACTIONS}")
    different = F.raise_error(F.lit("draws cover different months in nu, xi and psi"))
    param = F.col("param")
    timed, still = draws.where(param.isin("nu", "xi", "psi")), draws.where(param.isin("b0", "betas", "phi", "theta"))
    if months is None:
        chosen = draws.where(param.isin("nu", "xi", "psi", "b0", "betas", "phi", "theta"))
    else:
        chosen = still.unionByName(timed.join(months.select(F.col("month_idx").alias("i")).distinct(), "i", "left_semi"))
    kind = F.when(param.isin("nu", "xi"), "month").when(param.isin("phi", "theta"), "area").otherwise(param)
    # all groups below lie within a draw, so this is the only shuffle
    own = chosen.where("draw is not null").select("draw", kind.alias("kind"), "i", "j", "value").repartition("draw")
    number = F.when(F.col("kind").isin("month", "area"), F.sum("value")).otherwise(F.max("value"))
    twice = (F.col("kind") == "psi") & (F.count(F.lit(1)) > 1)
    numbers = own.groupBy("draw", "kind", "i", "j").agg(F.when(twice, different.cast("double")).otherwise(number).alias("value"))
    blocks = numbers.groupBy("draw", "kind", "j").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("a"))
    block = lambda name: F.first(F.when(F.col("kind") == name, F.col("a")), ignorenulls=True).alias(name)
    places_of = F.collect_list(F.when(F.col("kind") == "psi", F.struct("j", "a"))).alias("psi")
    whole = blocks.groupBy("draw").agg(*[block(name) for name in ("b0", "betas", "month", "area")], places_of)
    whole = whole.where("month is not null and area is not null and (b0 is not null or betas is not null)")
    beta = F.map_from_entries(F.filter("betas", lambda x: x["i"].isNotNull()))
    v = F.array(F.get("b0", F.lit(0))["value"], *[beta[k] for k in range(1, n_covariates + 1)])
    columns = [v.alias("v"), F.col("month.i").alias("m"), F.col("month.value").alias("month"), F.map_from_entries(F.filter("area", lambda x: x["i"].isNotNull())).alias("areas")]
    unfolded = whole.select("draw", *columns, F.explode("psi").alias("p"))
    unfolded = unfolded.select("draw", "v", "m", "month", "areas", F.col("p.j").alias("__place"), F.col("p.a.i").alias("pm"), F.col("p.a.value").alias("psi"))
    places = regions.select("adm2_index", F.col(interaction).alias("__place")).distinct()
    met = unfolded.join(F.broadcast(places), "__place").withColumn("area", F.col("areas")[F.col("adm2_index")]).where("area is not null")
    effect = F.transform(F.arrays_zip("month", "psi"), lambda x: F.col("area") + x["month"] + x["psi"])
    known = F.when(F.col("m") == F.col("pm"), effect).otherwise(different.cast("array<double>"))
    return met.select("adm2_index", "draw", "v", known.alias("e"), F.col("m").cast("array<int>").alias("m"))


def joined_draws(draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index") -> DataFrame:
    """``(adm2_index, draw, v, e, m)``: what :func:`effect_table` and :func:`coefficient_table` join, per district and draw.

    As :func:`packed_draws`, but for any draws: ``m`` and ``e`` have one entry per joined row. A month that is missing
    on one side has none, a repeated interaction has several, and nulls stay nulls.
    """
    if interaction not in INTERACTIONS:
        raise ValueError(f"interaction must be one of {INTERACTIONS}")
    param, place = F.col("param"), F.col("param") == "psi"
    kind = F.when(param.isin("nu", "xi"), "month").when(param.isin("phi", "theta"), "area").otherwise(param)
    chosen = draws.where(param.isin("nu", "xi", "psi", "b0", "betas", "phi", "theta") & F.col("draw").isNotNull())
    chosen = chosen.where((param.isin("b0", "betas") | F.col("i").isNotNull()) & (~place | F.col("j").isNotNull()))
    # all groups below lie within a draw, so this is the only shuffle
    own = chosen.select("draw", kind.alias("kind"), F.when(param != "b0", F.col("i")).alias("i"), F.when(place, F.col("j")).alias("j"), "value")
    number = F.when(F.col("kind").isin("month", "area"), F.sum("value")).otherwise(F.max("value")).alias("value")
    copies = F.collect_list(F.when(F.col("kind") == "psi", F.struct("value"))).alias("copies")
    numbers = own.repartition("draw").groupBy("draw", "kind", "i", "j").agg(number, F.count(F.lit(1)).alias("n"), copies)
    blocks = numbers.groupBy("draw", "kind", "j").agg(F.array_sort(F.collect_list(F.struct("i", "value", "n", "copies"))).alias("a"))
    block = lambda name: F.first(F.when(F.col("kind") == name, F.col("a")), ignorenulls=True).alias(name)
    places_of = F.collect_list(F.when(F.col("kind") == "psi", F.struct("j", "a"))).alias("psi")
    whole = blocks.groupBy("draw").agg(*[block(name) for name in ("b0", "betas", "month", "area")], places_of)
    whole = whole.where("month is not null and area is not null and (b0 is not null or betas is not null)")
    entries = lambda c: F.map_from_entries(F.transform(F.filter(c, lambda x: x["i"].isNotNull()), lambda x: F.struct(x["i"], x["value"])))
    beta = entries("betas")
    v = F.array(F.get("b0", F.lit(0))["value"], *[beta[k] for k in range(1, n_covariates + 1)])
    unfolded = whole.select("draw", v.alias("v"), "month", entries("area").alias("areas"), F.explode("psi").alias("p"))
    # mostly each month is there once on both sides
    plain = (F.col("month.i") == F.col("p.a.i")) & (F.array_max("p.a.n") == 1)
    once = F.transform(F.arrays_zip(F.col("month"), F.col("p.a").alias("a")), lambda x: F.struct(x["month"]["i"].alias("i"), x["month"]["value"].alias("t"), x["a"]["value"].alias("psi")))
    met = F.filter(F.col("p.a"), lambda x: F.map_contains_key(F.col("timed"), x["i"]))
    each = F.flatten(F.transform(met, lambda x: F.transform(x["copies"], lambda c: F.struct(x["i"].alias("i"), F.col("timed")[x["i"]].alias("t"), c["value"].alias("psi")))))
    unfolded = unfolded.withColumn("timed", F.when(~plain, entries("month")))
    unfolded = unfolded.select("draw", "v", "areas", F.col("p.j").alias("__place"), F.when(plain, once).otherwise(each).alias("s"))
    places = regions.select("adm2_index", F.col(interaction).alias("__place")).distinct()
    area = F.col("areas")[F.col("adm2_index")]
    found = unfolded.join(F.broadcast(places), "__place").where(F.map_contains_key("areas", F.col("adm2_index")))
    found = found.withColumn("area", area)
    effect = F.transform("s", lambda x: F.col("area") + x["t"] + x["psi"])
    return found.select("adm2_index", "draw", "v", effect.alias("e"), F.col("s.i").cast("array<int>").alias("m"))


def draw_count(draws: DataFrame) -> Column:
    """Number of draws, as a scalar."""
    return draws.agg(F.greatest(F.count_distinct("draw"), F.lit(1))).scalar()


@dataclass
class SettledDraws:
    """Draws packed and written once, for several estimates from the same draws; made by :func:`settle_draws`."""

    packed: DataFrame
    count: DataFrame
    n_covariates: int
    interaction: str

    def share(self, n_covariates: int, interaction: str) -> tuple[DataFrame, Column]:
        """What :func:`packed_draws` gives for the first ``n_covariates`` coefficients, and the number of draws."""
        if n_covariates > self.n_covariates or interaction != self.interaction:
            raise ValueError(f"the draws were settled with {self.n_covariates} coefficients and interaction {self.interaction}")
        return self.packed.withColumn("v", F.slice("v", 1, n_covariates + 1)), self.count.scalar()


def settle_draws(
    draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index", months: DataFrame | None = None
) -> SettledDraws:
    """Draws as the estimates below take them in place of the long table; with ``months`` rows of other months are an error."""
    packed = written_table(packed_draws(draws, n_covariates, regions, interaction, months))
    count = cut_lineage(draws.agg(F.greatest(F.count_distinct("draw"), F.lit(1)).alias("draws")))
    return SettledDraws(packed, count, n_covariates, interaction)


def _packed(
    draws: DataFrame | SettledDraws, n_covariates: int, regions: DataFrame, interaction: str, months: DataFrame | None = None
) -> tuple[DataFrame, Column]:
    if isinstance(draws, SettledDraws):
        if months is not None:
            raise ValueError("months are chosen when the draws are settled")
        return draws.share(n_covariates, interaction)
    return packed_draws(draws, n_covariates, regions, interaction, months), draw_count(draws)


def fixed_part(n_covariates: int) -> Column:
    eta = F.col("b0")
    for k in range(1, n_covariates + 1):
        eta = eta + F.col(f"x{k}") * F.col(f"b{k}")
    return eta


def linear_predictor(
    rows: DataFrame, draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index"
) -> DataFrame:
    """Each row with every draw and its ``eta``; covariates and coefficients are dropped."""
    dropped = [f"{s}{k}" for k in range(1, n_covariates + 1) for s in "xb"]
    joined = rows.join(effect_table(draws, regions, interaction), ["adm2_index", "month_idx"]).join(
        coefficient_dimension(draws, n_covariates), "draw"
    )
    return joined.withColumn("eta", fixed_part(n_covariates) + F.col("effect")).drop("b0", "effect", *dropped)


def predict_units(
    rows: DataFrame, draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index", summary: bool = False
) -> DataFrame:
    """Unit-level probability ``p`` of each row under each draw.

    With ``summary`` each row comes once, not once per draw: with the number ``n`` of its probabilities that are not null, their
    ``total``, and the lowest and highest (``low``, ``high``).
    """
    if summary:
        return _summarised_units(rows, draws, n_covariates, regions, interaction)
    eta = linear_predictor(rows, draws, n_covariates, regions, interaction)
    return eta.withColumn("p", logistic(F.col("eta"))).drop("eta")


def _summarised_units(rows: DataFrame, draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str) -> DataFrame:
    """Every combination of answers meets every draw once, and the rows take what was found for theirs."""
    names = [f"x{k}" for k in range(1, n_covariates + 1)]
    unknown = reduce(lambda one, c: one | F.col(c).isNull(), names, F.lit(False))
    x = F.array(*[F.when(unknown, 0.0).otherwise(F.col(c).cast("double")) for c in names]).cast("array<double>")
    kind = F.when(unknown, NO_COVARIATE).otherwise(COMPLETE)
    keys = ["adm2_index", "__t", "__kind", "__x"]
    own = rows.where("adm2_index is not null and month_idx is not null")
    own = own.withColumns({"__t": F.col("month_idx").cast("int"), "__kind": kind, "__x": x}).drop(*names)
    # written, so that the numbers stay the same
    patterns = cut_lineage(own.select(*keys).distinct()).withColumn("k", F.monotonically_increasing_id())
    scored = patterns.select("adm2_index", F.col("__t").alias("t"), "k", F.lit(0.0).alias("w"), F.col("__x").alias("x"), F.col("__kind").alias("kind"))
    joined = joined_draws(draws, n_covariates, regions, interaction)
    schema = "k bigint, n bigint, total double, low double, high double"
    parts = meet_draws(scored, joined, draw_count(draws), n_covariates, UnitSums, schema, read_joined_draws)
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    kept = [f"`{c}`" for c in rows.columns if c not in names]
    return own.join(patterns.join(found, "k").drop("k"), keys).select(*kept, "n", "total", "low", "high")


def aggregate_draws(
    units: DataFrame, response: str = "pr", key: str = "unit_key", weight: str | None = None, seed: int = 1234
) -> DataFrame:
    """District-month prevalence per draw from unit probabilities.

    ``pr``: weighted mean probability. ``binary``: also ``prev2`` from 0/1
    outcomes drawn with a keyed uniform. ``binomial``: mean of drawn counts over
    whole-number weights.
    """
    if response not in RESPONSES:
        raise ValueError(f"response must be one of {RESPONSES}")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    p = F.col("p")
    keys = [F.col(key), F.col("month_idx"), F.col("draw")]
    if response == "binomial":
        return _binomial(units, w, p, keys, seed)
    if response == "binary":
        hit = F.when(keyed_uniform(keys, seed) < p, 1.0).otherwise(0.0)
        return _weighted(units.withColumn("__y", hit), w, prev=p, prev2=F.col("__y"))
    return _weighted(units, w, prev=p)


def _weighted(units: DataFrame, w: Column, **values: Column) -> DataFrame:
    return units.groupBy(*RESULT_KEYS).agg(*[(F.sum(w * v) / F.sum(w)).alias(n) for n, v in values.items()])


def _binomial(units: DataFrame, w: Column, p: Column, keys: Sequence[Column], seed: int) -> DataFrame:
    """Weighted mean of Binomial(w, p) / w, that is all successes over all trials.

    Trials are counted inside the row; a weight that is not a whole number is an error.
    """
    whole = F.when(w == F.floor(w), w.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("binomial weight is not a whole number: "), w.cast("string")))
    )
    trials = units.where(w > 0).withColumns({"__w": whole, "__p": p})
    hit = lambda trial: F.when(keyed_uniform([*keys, trial], seed) < F.col("__p"), 1.0).otherwise(0.0)
    hits = F.aggregate(F.sequence(F.lit(1), F.col("__w")), F.lit(0.0), lambda sum_, trial: sum_ + hit(trial))
    return trials.withColumn("__hits", hits).groupBy(*RESULT_KEYS).agg((F.sum("__hits") / F.sum("__w")).alias("prev"))


# ------------------------------------------------------------------ estimates
def mr_estimate(
    interviews: DataFrame,
    draws: DataFrame,
    n_covariates: int,
    regions: DataFrame,
    response: str = "binary",
    weight: str | None = None,
    interaction: str = "adm1_index",
    key: str = "unit_key",
    seed: int = 1234,
) -> DataFrame:
    """Regression estimate: mean prediction over the interviewed households."""
    units = predict_units(interviews, draws, n_covariates, regions, interaction)
    return aggregate_draws(units, response, key, weight, seed)


def mrp_estimate(
    cells: DataFrame,
    draws: DataFrame,
    n_covariates: int,
    regions: DataFrame,
    response: str = "binary",
    weight: str = "pop_weight",
    interaction: str = "adm1_index",
    key: str = "unit_key",
    seed: int = 1234,
) -> DataFrame:
    """Post-stratified estimate: every cell in every month under every draw.

    The result is that of joining every cell with every draw of its district and :func:`aggregate_draws`: a month that a draw
    does not have is not scored, null predictors add their weight alone, and a month that is there twice is an error.
    The joined rows are scored where they meet and never written.
    """
    if response not in RESPONSES:
        raise ValueError(f"response must be one of {RESPONSES}")
    w = F.col(weight).cast("double")
    x = [F.col(f"x{k}").cast("double") for k in range(1, n_covariates + 1)]
    unknown = reduce(lambda one, c: one | c.isNull(), x, F.lit(False))
    kind = F.when(w.isNull(), NO_WEIGHT).when(unknown, NO_COVARIATE).when(F.col(key).isNull(), NO_KEY).otherwise(COMPLETE)
    rows = cells.where(F.col("adm2_index").isNotNull() & ((w > 0) if response == "binomial" else F.lit(True))).select(
        "adm2_index",
        F.lit(0).alias("t"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")).alias("k"),
        F.coalesce(w, F.lit(0.0)).alias("w"),
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in x]).cast("array<double>").alias("x"),
        kind.alias("kind"),
    )
    joined = joined_draws(draws, n_covariates, regions, interaction)
    make = lambda met: JoinedPrevalenceSums(met, response, seed)
    sums = meet_draws(cut_lineage(rows), joined, draw_count(draws), n_covariates, make, SUMS, read_joined_draws)
    return _ratios(sums, response)


def mrp_estimate_blocks(
    cells: DataFrame,
    draws: DataFrame | SettledDraws,
    n_covariates: int,
    regions: DataFrame,
    response: str = "binary",
    weight: str = "pop_weight",
    interaction: str = "adm1_index",
    key: str = "unit_key",
    seed: int = 1234,
    months: DataFrame | None = None,
) -> DataFrame:
    """Same numbers as :func:`mrp_estimate` for large frames and many draws.

    With ``months`` (a table of ``month_idx``) only those are scored.
    """
    packed, n_draws = _packed(draws, n_covariates, regions, interaction, months)
    return _estimate(cells, packed, n_draws, n_covariates, response, F.col(weight), key, None, seed)


def mr_estimate_blocks(
    interviews: DataFrame,
    draws: DataFrame | SettledDraws,
    n_covariates: int,
    regions: DataFrame,
    response: str = "binary",
    weight: str | None = None,
    interaction: str = "adm1_index",
    key: str = "unit_key",
    seed: int = 1234,
) -> DataFrame:
    """Same numbers as :func:`mr_estimate` for many interviews and draws."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    packed, n_draws = _packed(draws, n_covariates, regions, interaction)
    return _estimate(interviews, packed, n_draws, n_covariates, response, w, key, "month_idx", seed)


#: kinds of rows: their probability counts, or an outcome drawn for each of them
PATTERN, DRAWN = 1, 2
SUMS = "adm2_index int, month_idx int, draw int, wp double, wy double, w double"


def _estimate(
    rows: DataFrame,
    packed: DataFrame,
    n_draws: Column,
    n_covariates: int,
    response: str,
    weight: Column,
    key: str,
    month: str | None,
    seed: int,
) -> DataFrame:
    """Weighted sums per district, month and draw.

    With ``month`` each row counts in its own month only, without it in every month. Probabilities
    depend on a row's answers alone: ``prev`` is scored on the pattern cube, which has a row
    per combination of answers however many rows there are. Drawn outcomes (``prev2`` of
    ``binary``, ``prev`` of ``binomial``) have a number per row and draw.
    """
    if response not in RESPONSES:
        raise ValueError(f"response must be one of {RESPONSES}")
    # read for the cube, for counts and for scoring: written once instead of derived every time
    unit = cut_lineage(score_rows(rows, n_covariates, weight, F.col(key), month))
    cube = pattern_cube(unit)
    met = {"pr": cube, "binary": cube.unionByName(unit.withColumn("kind", F.lit(DRAWN))), "binomial": unit.where("w > 0").withColumn("kind", F.lit(DRAWN))}
    make = lambda pair: PrevalenceSums(pair, response, month is not None, seed)
    sums = meet_draws(met[response], packed, n_draws, n_covariates, make, SUMS)
    return _ratios(sums, response)


def _ratios(sums: DataFrame, response: str) -> DataFrame:
    total = sums.groupBy(*RESULT_KEYS).agg(*[F.sum(c).alias(c) for c in ("wp", "wy", "w")])
    ratio = lambda c, name: (F.col(c) / F.col("w")).alias(name)
    columns = {"pr": [ratio("wp", "prev")], "binary": [ratio("wp", "prev"), ratio("wy", "prev2")], "binomial": [ratio("wy", "prev")]}
    return total.select(*RESULT_KEYS, *columns[response])


def pattern_cube(unit: DataFrame) -> DataFrame:
    """Weight of every combination of district, month and covariates, as rows to score."""
    cube = unit.groupBy("adm2_index", "t", "x").agg(F.sum("w").alias("w"))
    return cube.select("adm2_index", "t", F.lit(0).cast("bigint").alias("k"), "w", "x", F.lit(PATTERN).alias("kind"))


def score_rows(rows: DataFrame, n_covariates: int, weight: Column, number: Column, month: str | None) -> DataFrame:
    """``(adm2_index, t, k, w, x)``: month, whole number, weight and covariates of each row."""
    x = [F.col(f"x{k}").cast("double") for k in range(1, n_covariates + 1)]
    own_month = F.lit(0) if month is None else F.col(month)
    return rows.select(
        "adm2_index",
        own_month.cast("int").alias("t"),
        number.cast("bigint").alias("k"),
        weight.cast("double").alias("w"),
        F.array(*x).cast("array<double>").alias("x"),
    )


#: rows of a district that one task sees, at least; memory does not depend on it
GROUP_ROWS = 200_000
#: bytes of a moved draw over those of a moved row: numbers of a draw differ, covariates repeat and compress
DRAW_WEIGHT = 16
#: cells of rows x draws that are worked on at once: they fit a processor's cache
CELLS = 1 << 16


def meet_draws(rows: DataFrame, packed: DataFrame, n_draws: Column, n_covariates: int, make, schema: str, read=None) -> DataFrame:
    """What ``make(district's draws)`` gathers from the rows of its district; ``packed`` is from :func:`packed_draws`.

    Draws from :func:`joined_draws` are read by :func:`read_joined_draws`.

    Draws go to rows: a share of a district's draws is sent to each group of its rows, comes first there and stays
    in memory; the rows stream past it, sorted by month. A district is split by rows, by draws or by both,
    whichever moves less: few rows go to many shares of the draws, many rows meet all draws in groups of their own. A
    district with a third of all rows is only more groups. ``rows`` are those of
    :func:`score_rows`, with a column ``kind`` if there are several; they are read twice, once to count them. Those
    of a district without draws meet nothing. ``make`` returns an object with ``add(rows, kind)`` and
    ``finish()``, which gives record batches.
    """
    ship_package(rows.sparkSession)
    if "kind" not in rows.columns:
        rows = rows.withColumn("kind", F.lit(PATTERN))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("adm2_index").agg(F.count(F.lit(1)).alias("n"))
    even = F.lit(4.0 * partitions) / counts.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    n = F.col("n")
    wanted = F.ceil(F.greatest(n / GROUP_ROWS, F.least(even, n)))
    shares = F.ceil(F.sqrt(wanted * F.col("draws") / n * DRAW_WEIGHT))
    shares = F.greatest(F.least(shares, wanted, F.col("draws")), F.lit(1)).cast("int")
    # one row per district, so that the rows are not shuffled to meet it
    split = counts.select("adm2_index", "n", n_draws.alias("draws")).withColumn("shares", shares)
    groups = F.ceil(F.greatest(n / GROUP_ROWS, F.ceil(wanted / F.col("shares")))).cast("int")
    split = F.broadcast(split.select("adm2_index", "shares", groups.alias("groups")))
    # the hash of the row itself: a repeated task deals the rows out alike
    part = F.pmod(F.xxhash64("kind", "t", "k", "w", "x"), F.col("groups")).cast("int") * F.col("shares")
    no_numbers, no_months = F.array().cast("array<double>"), F.array().cast("array<int>")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own_rows = rows.join(split, "adm2_index").select("*", every("shares").alias("share")).select(
        "adm2_index", (part + F.col("share")).alias("part"), "kind", "t", "k", "w", F.col("x").alias("v"), no_numbers.alias("e"), no_months.alias("m")
    )
    own_draws = packed.join(split, "adm2_index").select("*", every("groups").alias("group")).select(
        "adm2_index",
        (F.col("group") * F.col("shares") + F.pmod(F.xxhash64("draw"), F.col("shares"))).cast("int").alias("part"),
        F.lit(0).alias("kind"),
        F.col("draw").cast("int").alias("t"),
        F.lit(0).cast("bigint").alias("k"),
        F.lit(0.0).alias("w"),
        "v",
        "e",
        "m",
    )
    both = own_draws.unionByName(own_rows).repartition(partitions, "adm2_index", "part")
    return both.sortWithinPartitions("adm2_index", "part", "kind", "t").mapInArrow(_stream(n_covariates, make, read or read_draws), schema)


@dataclass
class DistrictDraws:
    """All draws of a district: effects draws x months, coefficients draws x (1 + covariates)."""

    area: int
    draws: np.ndarray
    months: np.ndarray
    effects: np.ndarray
    betas: np.ndarray

    def month_positions(self, months: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.months, months), len(self.months) - 1)
        unknown = months[self.months[at] != months]
        if len(unknown):
            raise ValueError(f"the draws of district {self.area} have no effect for month {int(unknown[0])}")
        return at


@dataclass
class RowBlock:
    """Rows of one district, ascending by month."""

    months: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray
    x: np.ndarray

    def pieces(self, n_draws: int) -> Iterator[tuple[RowBlock, slice]]:
        """Parts of rows beside parts of the draws, ``CELLS`` cells at most or one row and draw."""
        height = max(1, min(len(self.months), CELLS // 64))
        width = max(1, CELLS // height)
        for a in range(0, len(self.months), height):
            part = RowBlock(*(v[a : a + height] for v in (self.months, self.numbers, self.weights, self.x)))
            for d in range(0, n_draws, width):
                yield part, slice(d, min(d + width, n_draws))


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def read_draws(parts: Sequence[pa.RecordBatch], n_covariates: int) -> DistrictDraws:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    area = batch.column("adm2_index")[0].as_py()
    if len(np.unique(batch.column("m").value_lengths().to_numpy())) > 1:
        raise ValueError(f"draws of district {area} cover different months")
    months = _lists(batch, "m")
    if np.any(months != months[0]):
        raise ValueError(f"draws of district {area} cover different months")
    draws = batch.column("t").to_numpy().astype(np.int64)
    return DistrictDraws(area, draws, months[0].astype(np.int64), _lists(batch, "e"), _lists(batch, "v").reshape(len(draws), n_covariates + 1))


@dataclass
class JoinedDraws(DistrictDraws):
    """Draws of a district that need not cover the same months; one that has a month twice comes twice.

    ``state`` is draws x months, none if all of it is ``VALUE``.
    """

    state: np.ndarray | None = None


#: what a draw has in a month: no joined row, one whose predictor is null, or a number
ABSENT, NULL, VALUE = 0, 1, 2


def read_joined_draws(parts: Sequence[pa.RecordBatch], n_covariates: int) -> JoinedDraws:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    area, draws = batch.column("adm2_index")[0].as_py(), batch.column("t").to_numpy().astype(np.int64)
    filled = lambda name: batch.column(name).flatten().fill_null(0).to_numpy(zero_copy_only=False)
    null = lambda name: batch.column(name).flatten().is_null().to_numpy(zero_copy_only=False)
    lengths = batch.column("m").value_lengths().to_numpy()
    betas = filled("v").reshape(len(draws), n_covariates + 1)
    of_month, effects = filled("m").astype(np.int64), filled("e")
    lost, nothing = null("v").reshape(betas.shape).any(axis=1), null("e")
    months = np.unique(of_month)
    if not lost.any() and not nothing.any() and np.array_equal(of_month, np.tile(months, len(draws))) and (lengths == len(months)).all():
        return JoinedDraws(area, draws, months, effects.reshape(len(draws), -1), betas)
    row, at = np.repeat(np.arange(len(draws)), lengths), np.searchsorted(months, of_month)
    order = np.lexsort((at, row))
    row, at, effects, nothing = row[order], at[order], effects[order], nothing[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])))[: len(row)]
    begin = np.flatnonzero(new)
    copy = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    copies = int(copy.max(initial=0)) + 1
    known, state = np.zeros((len(draws) * copies, len(months))), np.zeros((len(draws) * copies, len(months)), np.int8)
    known[row * copies + copy, at] = effects
    state[row * copies + copy, at] = np.where(nothing | lost[row], NULL, VALUE)
    return JoinedDraws(area, np.repeat(draws, copies), months, known, np.repeat(betas, copies, axis=0), state)


def _stream(n_covariates: int, make, read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, draws, work = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("adm2_index", "part", "kind")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                own, kind = tuple(keys[start, :2]), keys[start, 2]
                if own != group:
                    if work is not None:
                        yield from work.finish()
                    group, draws, work = own, [], None
                piece = batch.slice(start, end - start)
                if kind == 0:
                    draws.append(piece)
                    continue
                if work is None and draws:
                    work, draws = make(read(draws, n_covariates)), []
                if work is not None:
                    column = lambda name: piece.column(name).to_numpy(zero_copy_only=False)
                    x = _lists(piece, "v")
                    work.add(RowBlock(column("t").astype(np.int64), column("k"), column("w"), x), kind)
        if work is not None:
            yield from work.finish()

    return run


# The rounds of the keyed generator on arrays. Residues are kept below 2^31 + 1, so that products fit.
def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Twice ``x = (x mod 2^31) + floor(x / 2^31)`` in place: congruent by the Mersenne prime 2^31 - 1."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, UNIFORM_PRIME, out=x)
        np.add(x, spare, out=x)


def uniform_matrix(
    keys: np.ndarray, month: int | np.ndarray, draws: np.ndarray, seed: int, trial: np.ndarray | None = None
) -> np.ndarray:
    """Array form of :func:`keyed_uniform` for the keys (unit, month, draw), and the trial if given."""
    a, b, c, d = UNIFORM_MULTIPLIERS[:4]
    rows = (np.abs(keys) % UNIFORM_PRIME) * a + seed + month * b
    if trial is not None:
        rows = rows + trial * d
    state = rows[:, None] + ((np.abs(draws) % UNIFORM_PRIME) * c)[None, :]
    spare, square = np.empty_like(state), np.empty_like(state)
    _fold(state, spare)
    for constant in UNIFORM_ROUNDS:
        np.multiply(state, state, out=square)
        _fold(square, spare)
        np.multiply(square, square, out=square)
        _fold(square, spare)
        np.multiply(state, square, out=state)
        _fold(state, spare)
        np.add(state, constant, out=state)
        _fold(state, spare)
    state[state == UNIFORM_PRIME] = 0
    return state / float(UNIFORM_PRIME)


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``x``, and which of them each row is."""
    x = np.ascontiguousarray(x)
    if not x.shape[1]:
        return x[:1], np.zeros(len(x), np.int64)
    whole = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return x[first], of


#: rows of a group that are scored together: the more, the more of them share their answers
HELD_ROWS = 1 << 16
#: draws of one pass over held rows, and rows of a step in it
PASS_DRAWS, PASS_ROWS = 64, 512
#: exponentials of less than this, up or down, are multiplied; larger ones are taken of the sum
FACTOR_BOUND = 300.0


class HeldRows:
    """Rows of a group that wait until there are ``HELD_ROWS`` of a kind, or no more; ``score(rows, kind)`` is called with them."""

    def __init__(self, score):
        self.score, self.held = score, {}

    def add(self, rows: RowBlock, kind: int) -> None:
        held = self.held.setdefault(kind, [])
        held.append(rows)
        if sum(len(r.months) for r in held) >= HELD_ROWS:
            self._give(kind)

    def finish(self) -> None:
        for kind in list(self.held):
            self._give(kind)

    def _give(self, kind: int) -> None:
        held = self.held.pop(kind)
        self.score(RowBlock(*(np.concatenate(v) for v in zip(*((r.months, r.numbers, r.weights, r.x) for r in held)))), kind)


def factors(d: DistrictDraws, answers: np.ndarray, own: slice, sign: float) -> tuple[np.ndarray, np.ndarray] | None:
    """``exp(sign * eta)`` of any row is the product of a row of the first (by answers) and one of the second (by month).

    Each has a column per draw. None if an exponent is too large for a product, or no number.
    """
    base, effects = answers @ d.betas[own, 1:].T + d.betas[own, 0], d.effects[own].T
    if not all(np.abs(part).max(initial=0.0) < FACTOR_BOUND for part in (base, effects)):
        return None
    return np.exp(sign * base), np.exp(sign * effects)


def draw_passes(n_draws: int) -> Iterator[slice]:
    for a in range(0, n_draws, PASS_DRAWS):
        yield slice(a, min(a + PASS_DRAWS, n_draws))


def probabilities(eta: np.ndarray) -> np.ndarray:
    np.negative(eta, out=eta)
    np.exp(eta, out=eta)
    np.add(eta, 1.0, out=eta)
    return np.divide(1.0, eta, out=eta)


class PrevalenceSums:
    """Sums of weight times probability (``wp``) over patterns, and of drawn outcomes (``wy``) over rows, per month and draw."""

    def __init__(self, draws: DistrictDraws, response: str, own_month: bool, seed: int):
        self.draws, self.response, self.own_month, self.seed = draws, response, own_month, seed
        shape = len(draws.months), len(draws.draws)
        self.sums = {PATTERN: np.zeros(shape), DRAWN: np.zeros(shape)}
        self.weight, self.seen = np.zeros(shape[0]), np.zeros(shape[0], bool)

    def add(self, rows: RowBlock, kind: int) -> None:
        d, sums = self.draws, self.sums[kind]
        if self.response == "binomial":
            whole = rows.weights == np.floor(rows.weights)
            if not whole.all():
                raise ValueError(f"binomial weight is not a whole number: {rows.weights[~whole][0]}")
        at = d.month_positions(rows.months) if self.own_month else slice(None)
        self.seen[at] = True
        if kind == PATTERN or self.response == "binomial":  # each weight once
            if self.own_month:
                np.add.at(self.weight, at, rows.weights)
            else:
                self.weight += rows.weights.sum()
        for part, own in rows.pieces(len(d.draws)):
            base = part.x @ d.betas[own, 1:].T + d.betas[own, 0]
            if self.own_month:
                at = d.month_positions(part.months)
                values = self._values(part, base + d.effects[own].T[at], part.months, own, kind)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                sums[at[first], own] += np.add.reduceat(values, first, axis=0)
            else:
                for k, month in enumerate(d.months):
                    sums[k, own] += self._values(part, base + d.effects[own, k], month, own, kind).sum(axis=0)

    def _values(self, part: RowBlock, eta: np.ndarray, month: int | np.ndarray, own: slice, kind: int) -> np.ndarray:
        p, draws, w = probabilities(eta), self.draws.draws[own], part.weights[:, None]
        if kind == PATTERN:
            return w * p
        if self.response == "binary":
            return w * (uniform_matrix(part.numbers, month, draws, self.seed) < p)
        return self._hits(part, p, month, draws)

    def _hits(self, part: RowBlock, p: np.ndarray, month: int | np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Successes of each row's trials, one trial of all rows at a time: trials are never laid out."""
        out, trials = np.zeros(p.shape), part.weights.astype(np.int64)
        month = np.broadcast_to(month, trials.shape)
        for trial in range(1, int(trials.max(initial=0)) + 1):
            alive = np.flatnonzero(trials >= trial)
            out[alive] += uniform_matrix(part.numbers[alive], month[alive], draws, self.seed, np.full(len(alive), trial)) < p[alive]
        return out

    def finish(self) -> Iterator[pa.RecordBatch]:
        d, n = self.draws, len(self.draws.draws)
        for k in np.flatnonzero(self.seen):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, d.area, np.int32)),
                    pa.array(np.full(n, d.months[k], np.int32)),
                    pa.array(d.draws.astype(np.int32)),
                    pa.array(self.sums[PATTERN][k]),
                    pa.array(self.sums[DRAWN][k]),
                    pa.array(np.full(n, self.weight[k])),
                ],
                names=["adm2_index", "month_idx", "draw", "wp", "wy", "w"],
            )


#: kinds of cells: complete, without a key (no outcome is drawn), without a predictor or without a weight
COMPLETE, NO_KEY, NO_COVARIATE, NO_WEIGHT = 1, 2, 3, 4


class JoinedPrevalenceSums(PrevalenceSums):
    """Sums over cells that count in every month their draws have; both sums come from one pass over the cells."""

    def __init__(self, draws: JoinedDraws, response: str, seed: int):
        if len(np.unique(draws.draws)) < len(draws.draws):
            raise ValueError(f"a draw of district {draws.area} has a month twice")
        self.draws, self.response, self.seed = draws, response, seed
        shape = len(draws.months), len(draws.draws)
        self.wp, self.wy = (np.zeros(shape) if used else None for used in (response != "binomial", response != "pr"))
        self.weight, self.weighed, self.scored = 0.0, False, False

    def add(self, rows: RowBlock, kind: int) -> None:
        d = self.draws
        if kind == NO_WEIGHT:
            return
        if self.response == "binomial":
            whole = rows.weights == np.floor(rows.weights)
            if not whole.all():
                raise ValueError(f"binomial weight is not a whole number: {rows.weights[~whole][0]}")
        self.weight, self.weighed = self.weight + rows.weights.sum(), True
        if kind == NO_COVARIATE:
            return
        self.scored = True
        for part, own in rows.pieces(len(d.draws)):
            base = part.x @ d.betas[own, 1:].T + d.betas[own, 0]
            for k, month in enumerate(d.months):
                p = probabilities(base + d.effects[own, k])
                if self.wp is not None:
                    self.wp[k, own] += part.weights @ p
                if self.wy is None or kind == NO_KEY:
                    continue
                if self.response == "binomial":
                    self.wy[k, own] += self._hits(part, p, month, d.draws[own]).sum(axis=0)
                else:
                    self.wy[k, own] += part.weights @ (uniform_matrix(part.numbers, month, d.draws[own], self.seed) < p)

    def finish(self) -> Iterator[pa.RecordBatch]:
        d = self.draws
        for k, month in enumerate(d.months):
            state = np.full(len(d.draws), VALUE) if d.state is None else d.state[:, k]
            met = state != ABSENT
            known, n = state[met] == VALUE, int(met.sum())
            wp = np.zeros(n) if self.wp is None else self.wp[k, met]
            wy = np.zeros(n) if self.wy is None else np.where(known, self.wy[k, met], 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, d.area, np.int32)),
                    pa.array(np.full(n, month, np.int32)),
                    pa.array(d.draws[met].astype(np.int32)),
                    pa.array(wp, mask=~known | (not self.scored)),
                    pa.array(wy),
                    pa.array(np.full(n, self.weight), mask=np.full(n, not self.weighed)),
                ],
                names=["adm2_index", "month_idx", "draw", "wp", "wy", "w"],
            )


class UnitSums:
    """Number, total, lowest and highest of the probabilities of each row."""

    def __init__(self, draws: JoinedDraws):
        self.draws, self.found = draws, []
        self.rows = HeldRows(self._score)

    def add(self, rows: RowBlock, kind: int) -> None:
        met = np.isin(rows.months, self.draws.months)
        self.rows.add(RowBlock(*(v[met] for v in (rows.months, rows.numbers, rows.weights, rows.x))), kind)

    def _score(self, rows: RowBlock, kind: int) -> None:
        d, size = self.draws, len(rows.months)
        n, total, seen = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, bool)
        low, high = np.full(size, np.nan), np.full(size, -np.inf)
        if size and d.state is None:
            seen[:] = True
        if size and kind == COMPLETE and d.state is None:
            self._score_factors(rows, n, total, low, high)
        elif size and d.state is not None:
            self._score_known(rows, kind, slice(0, len(d.draws)), n, total, seen, low, high)
        none = n[seen] == 0
        arrays = [pa.array(rows.numbers[seen]), pa.array(n[seen]), *[pa.array(v[seen], mask=none) for v in (total, low, high)]]
        self.found.append(pa.RecordBatch.from_arrays(arrays, names=["k", "n", "total", "low", "high"]))

    def _score_factors(self, rows: RowBlock, n, total, low, high) -> None:
        """Draws that have every month: ``1 + exp(-eta)`` is one product and one sum."""
        d = self.draws
        at, (answers, of) = d.month_positions(rows.months), distinct_rows(rows.x)
        for own in draw_passes(len(d.draws)):
            parts = factors(d, answers, own, -1.0)
            if parts is None:
                self._score_known(rows, COMPLETE, own, n, total, np.ones(len(n), bool), low, high)
                continue
            n += own.stop - own.start
            for a in range(0, len(n), PASS_ROWS):
                step = slice(a, a + PASS_ROWS)
                over = np.take(parts[0], of[step], axis=0)
                over *= np.take(parts[1], at[step], axis=0)
                over += 1.0
                low[step] = np.fmin(low[step], 1.0 / over.max(axis=1))
                high[step] = np.maximum(high[step], 1.0 / over.min(axis=1))
                total[step] += np.divide(1.0, over, out=over).sum(axis=1)

    def _score_known(self, rows: RowBlock, kind: int, draws: slice, n, total, seen, low, high) -> None:
        """Any draws, as they come."""
        d, height = self.draws, CELLS // 64
        for a in range(0, len(n), height):
            step = slice(a, a + height)
            part = RowBlock(*(v[step] for v in (rows.months, rows.numbers, rows.weights, rows.x)))
            at = d.month_positions(part.months)
            for b in range(draws.start, draws.stop, PASS_DRAWS):
                own = slice(b, min(b + PASS_DRAWS, draws.stop))
                state = None if d.state is None else d.state[own].T[at]
                seen[step] |= True if state is None else (state != ABSENT).any(axis=1)
                if kind != COMPLETE:
                    continue
                p = probabilities(part.x @ d.betas[own, 1:].T + d.betas[own, 0] + d.effects[own].T[at])
                least, most = p, p
                if state is None:
                    n[step] += p.shape[1]
                else:
                    known = state == VALUE
                    n[step] += known.sum(axis=1)
                    p, least, most = (np.where(known, p, other) for other in (0.0, np.nan, -np.inf))
                total[step] += p.sum(axis=1)
                low[step] = np.fmin(low[step], np.fmin.reduce(least, axis=1))
                high[step] = np.maximum(high[step], most.max(axis=1))

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.rows.finish()
        yield from self.found


def as_face_to_face(interviews: DataFrame, switch: str, variables: Sequence[str]) -> DataFrame:
    """Counterfactual design: the mode switch set to 1 and its products rebuilt."""
    return interactions(interviews.withColumn(switch, F.lit(1)), switch, variables)

"""Model tables: domains, complete cases, indices, dummies, interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mosarea.functions.columns import complete_cases, quoted, shared_columns
from mosarea.functions.recode import (
    EDUCATION_LEVELS,
    MODALITY_LEVELS,
    SEX_LEVELS,
    SIZE_LEVELS,
    TOILET_LEVELS,
    WATER_LEVELS,
    in_domain,
    interactions,
    one_hot,
    poor_flag,
    scaled_score,
    yes_flag,
)
from mosarea.operators.aggregates import dense_index
from mosarea.operators.joins import keep_members, union_by_name

# Domains of the covariates and order of the coefficients.
DOMAINS = {
    "modality": MODALITY_LEVELS,
    "hhh_sex": SEX_LEVELS,
    "hh_size_bucket": SIZE_LEVELS,
    "hhh_edu": EDUCATION_LEVELS,
    "h_water_source_2way": WATER_LEVELS,
    "h_toilet_type_2way": TOILET_LEVELS,
}
MAIN_COVARIATES = (
    "hhh_sex_F",
    "hh_size_bucket_3-4",
    "hh_size_bucket_5-6",
    "hh_size_bucket_7+",
    "hhh_edu_primary",
    "hhh_edu_secondary",
    "hhh_edu_higher",
    "h_water_source_2way_improved",
    "h_toilet_type_2way_improved",
)
MODES = ("phone_only", "joint")
SWITCH = "modality_f2f"


def covariates(mode: str) -> list[str]:
    """Coefficient names in model order for the phone-only or the joint model."""
    if mode == "phone_only":
        return ["p_cell", *MAIN_COVARIATES]
    if mode == "joint":
        return ["p_cell", SWITCH, *MAIN_COVARIATES, *[f"{SWITCH}:{v}" for v in MAIN_COVARIATES]]
    raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def phone_table(survey: DataFrame, scores: DataFrame, model: str, surveyed: DataFrame) -> DataFrame:
    """Phone interviews of surveyed districts with ownership score and model tag.

    A respondent with several scores fans out, as the join says.
    """
    kept = keep_members(survey.dropDuplicates(), surveyed, "adm2_name")
    return (
        kept.join(scores.dropDuplicates(), "respondent_id", "left")
        .withColumns({"model": F.lit(model), "modality": F.lit("rtm"), "h_cell": F.lit("yes")})
        .where(F.col("fcs").isNotNull())
    )


def face_table(survey: DataFrame, like: DataFrame, model: str = "joint") -> DataFrame:
    """Face-to-face interviews with the columns they share with the phone table."""
    names = [n for n in shared_columns(survey, like) if n not in ("modality", "model", "p_cell")]
    return (
        survey.select(*names)
        .withColumns({"modality": F.lit("f2f"), "p_cell": yes_flag(F.col("h_cell")).cast("double"), "model": F.lit(model)})
        .where(F.col("fcs").isNotNull())
    )


def stack_surveys(*tables: DataFrame) -> DataFrame:
    return union_by_name(*tables)


def _enforce_domains(df: DataFrame) -> DataFrame:
    return complete_cases(
        df.withColumns({n: in_domain(F.col(n), levels) for n, levels in DOMAINS.items() if n in df.columns}),
        [*DOMAINS, "p_cell"],
    )


def _with_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    index = regions.select("adm2_name", "adm2_index", "adm1_index")
    return df.join(index, "adm2_name", "left")


def observation_design(df: DataFrame, regions: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Interview rows ready for the model.

    Month indices count the months of all interviews before incomplete rows are
    dropped; pass ``months`` to reuse an index table.
    """
    months = dense_index(df, "obs_month", "month_idx") if months is None else months
    rows = df.withColumns({"fcs_scaled": scaled_score(F.col("fcs")), "poor": poor_flag(F.col("fcs"))})
    rows = _enforce_domains(rows.join(months, "obs_month", "left"))
    return interactions(one_hot(_with_regions(rows, regions), DOMAINS), SWITCH, MAIN_COVARIATES)


def frame_design(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Frame cells of indexed districts ready for scoring."""
    rows = _with_regions(_enforce_domains(cells), regions)
    return interactions(one_hot(rows, DOMAINS), SWITCH, MAIN_COVARIATES)


def numbered_covariates(design: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` plus covariates as ``x1 .. xB`` doubles in coefficient order."""
    return design.select(*keep, *[quoted(n).cast("double").alias(f"x{k}") for k, n in enumerate(names, 1)])


def patterns(design: DataFrame, names: Sequence[str], keys: Sequence[str], outcome: str = "poor") -> DataFrame:
    """Identical rows of the likelihood as ``(keys, x1..xB, n, y)``: lossless, and bounded
    by the number of answer combinations instead of interviews."""
    rows = numbered_covariates(design, names, [*keys, F.col(outcome).cast("int").alias("__y")])
    return rows.groupBy(*keys, *[f"x{k}" for k in range(1, len(names) + 1)]).agg(
        F.count("__y").alias("n"), F.sum("__y").alias("y")
    )

"""Recoding of survey answers: one rule table, one generic expression builder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mosarea.functions.nulls import if_else, member

KEEP = "keep the source value"
MISSING = None


@dataclass(frozen=True)
class Recode:
    """``target`` = label of the first case whose codes hold ``source``, else ``otherwise``."""

    target: str
    source: str
    cases: tuple[tuple[str, tuple], ...]
    otherwise: str | None = MISSING
    trim: bool = False

    def column(self) -> Column:
        source = F.col(self.source)
        probe = F.trim(source) if self.trim else source
        expression = None
        for label, codes in self.cases:
            hit = member(probe, codes)
            expression = F.when(hit, F.lit(label)) if expression is None else expression.when(hit, F.lit(label))
        if self.otherwise == KEEP:
            return expression.otherwise(source)
        if self.otherwise is MISSING:
            return expression
        return expression.otherwise(F.lit(self.otherwise))


# ---------------------------------------------------------------------------
# Code lists and labels of the recodes.
# ---------------------------------------------------------------------------
EDUCATION_LEVELS = ("preprimary/other", "primary", "secondary", "higher")
SIZE_LEVELS = ("1-2", "3-4", "5-6", "7+")
WATER_LEVELS = ("other", "improved")
TOILET_LEVELS = ("unimproved", "improved")
SEX_LEVELS = ("F", "M")
MODALITY_LEVELS = ("f2f", "rtm")
POOR_THRESHOLD = 28
SCORE_MAXIMUM = 112

WATER_TWO_WAY = Recode("h_water_source_2way", "h_water_source", (("improved", ("protected", "piped")),), "other")
EDUCATION_THREE_WAY = Recode(
    "hhh_edu_3way", "hhh_edu", (("primary or less", ("preprimary/other", "primary")),), KEEP
)
EDUCATION_FOUR_WAY = Recode("hhh_edu_4way", "hhh_edu", EDUCATION_THREE_WAY.cases, KEEP)

DHS_RECODES = (
    Recode("urbanicity", "hv025", (("urban", (1,)),), "rural"),
    Recode(
        "urbanicity_detailed",
        "hv026",
        (("capital, large city", (0,)), ("small city", (1,)), ("town", (2,)), ("countryside", (3,))),
        "rural",
    ),
    Recode("hhh_edu", "hv106", (("higher", (3,)), ("secondary", (2,)), ("primary", (1,))), "preprimary/other"),
    Recode(
        "h_water_source",
        "hv201",
        (("piped", (10, 11, 12, 13, 14)), ("protected", (21, 31, 41))),
        "unprotected/other",
    ),
    WATER_TWO_WAY,
    Recode(
        "h_toilet_type",
        "hv205",
        (
            ("modernWaterCloset", (10, 11, 12, 13, 14, 15)),
            ("ventilatedBuildInLatrine", (21,)),
            ("pitLatrineWithSlab", (22,)),
            ("pitLatrineWithNoSlab", (23,)),
            ("none", (31,)),
            ("bucket", (42,)),
            ("other", (96,)),
        ),
    ),
    Recode(
        "h_toilet_type_3way",
        "h_toilet_type",
        (
            ("improved", ("modernWaterCloset", "ventilatedBuildInLatrine", "pitLatrineWithSlab")),
            ("unimproved", ("pitLatrineWithNoSlab", "none", "bucket")),
            ("other", ("other",)),
        ),
    ),
    Recode("h_toilet_type_2way", "h_toilet_type_3way", (("improved", ("improved",)),), "unimproved"),
    Recode("h_cooking_fuel", "hv226", (("clean", (1, 2, 3, 4, 5)),), "other"),
    Recode("h_cell", "hv243a", (("yes", (1,)),), "no"),
)

MICS_PERSON_RECODES = (
    Recode("hhh_sex", "sex_raw", (("M", (1,)),), "F"),
    Recode(
        "hhh_edu",
        "ED5A",
        (
            ("preprimary/other", (0, 98, 99)),
            ("primary", (1,)),
            ("secondary", (2, 3, 4, 5, 6)),
            ("higher", (7, 8, 9, 10)),
        ),
        "preprimary/other",
    ),
    EDUCATION_THREE_WAY,
)

MICS_HOUSEHOLD_RECODES = (
    Recode("h_landline", "h_landline", (("yes", (1,)), ("no", (2,)))),
    Recode("h_radio", "h_radio", (("yes", (1,)),), "no"),
    Recode("h_electricity", "h_electricity", (("yes", (1, 2)), ("no", (3,)))),
    Recode("h_tv", "h_tv", (("yes", (1,)),), "no"),
    Recode("h_computer", "h_computer", (("yes", (1,)), ("no", (2,)))),
    Recode("h_cell", "h_cell", (("yes", (1,)),), "no"),
    Recode("h_internet", "h_internet", (("yes", (1,)),), "no"),
    Recode(
        "h_toilet_type",
        "WS11",
        (
            ("modernWaterCloset", (11, 12, 13, 14, 18)),
            ("ventilatedBuildInLatrine", (21,)),
            ("outdoorsLatrineHole", (22, 23)),
        ),
        "other",
    ),
    Recode(
        "h_toilet_type_3way",
        "h_toilet_type",
        (
            ("unimproved", ("outdoorsLatrineHole",)),
            ("improved", ("ventilatedBuildInLatrine", "modernWaterCloset")),
        ),
        "other",
    ),
    Recode(
        "h_toilet_type_2way",
        "h_toilet_type",
        (("improved", ("ventilatedBuildInLatrine", "modernWaterCloset")),),
        "unimproved",
    ),
    Recode(
        "h_water_source",
        "WS1",
        (("piped", (11, 12, 13, 14)), ("protected", (21, 31, 41))),
        "unprotected/other",
    ),
    WATER_TWO_WAY,
    Recode("h_cooking_fuel", "EU4", (("clean", (1, 2, 3)),), "other"),
)

FACE_TO_FACE_WATER = Recode(
    "h_water_source",
    "h_water_source_raw",
    (
        (
            "piped",
            (
                "Piped into dwelling",
                "Piped into neighbour",
                "Piped into public tap or standpipe",
                "Piped into yard or plot",
            ),
        ),
        (
            "unprotected/other",
            (
                "Other",
                "Unprotected spring",
                "Unprotected well",
                "Sand abstraction",
                "Surface water (river, dam, lake, pond, stream, canal, irrigation channel)",
            ),
        ),
    ),
    "protected",
    trim=True,
)

CENSUS_FUEL = Recode("h_cooking_fuel", "h_cooking_fuel_raw", (("clean", ("clean",)),), "other")
CENSUS_TOILET = Recode(
    "h_toilet_type",
    "h_toilet_type_raw",
    (("modernWaterCloset", ("flush",)), ("ventilatedBuildInLatrine", ("ventilatedLatrine",))),
    KEEP,
)
CENSUS_TOILET_IMPROVED = ("flush", "ventilatedLatrine", "pitLatrineSlab", "composting")
CENSUS_TOILET_THREE_WAY = Recode(
    "h_toilet_type_3way",
    "h_toilet_type_raw",
    (
        ("improved", CENSUS_TOILET_IMPROVED),
        ("unimproved", ("pitLatrineNoSlab", "bucket", "none")),
        ("other", ("other",)),
    ),
)
CENSUS_TOILET_TWO_WAY = Recode(
    "h_toilet_type_2way", "h_toilet_type_raw", (("improved", CENSUS_TOILET_IMPROVED),), "unimproved"
)
DISTRICT_RENAMES = {"Shurugwi Urban": "Shurugwi Town"}
# ------------------------------ end of fixed values ------------------------


def recode(df: DataFrame, *rules: Recode) -> DataFrame:
    """Apply rules in order; a rule may read the target of an earlier one."""
    for rule in rules:
        df = df.withColumn(rule.target, rule.column())
    return df


def rename_values(column: Column, names: Mapping[str, str]) -> Column:
    expression = column
    for old, new in names.items():
        expression = F.when(column == old, F.lit(new)).otherwise(expression)
    return expression


def size_bucket(size: Column) -> Column:
    """Household size class; a missing size falls into the open class."""
    return (
        F.when(size <= 2, "1-2").when(size <= 4, "3-4").when(size <= 6, "5-6").otherwise("7+")
    )


def sex_from_code(code: Column) -> Column:
    """1 -> M, other -> F, missing stays missing."""
    return if_else(code == 1, F.lit("M"), F.lit("F"))


def in_domain(column: Column, levels: Sequence[str]) -> Column:
    """Value if it is one of the ordered levels, else null."""
    return F.when(column.isin(*levels), column)


def level_order(column: Column, levels: Sequence[str]) -> Column:
    """1-based position in the ordered level list, null for unknown values."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), column)
    return F.when(position > 0, position.cast("int"))


def poor_flag(score: Column, threshold: float = POOR_THRESHOLD) -> Column:
    return score < threshold


def scaled_score(score: Column) -> Column:
    return score / float(SCORE_MAXIMUM)


def yes_flag(column: Column) -> Column:
    """yes -> 1, any other answer -> 0, missing -> null."""
    return (column == "yes").cast("int")


def one_hot(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 column ``<name>_<level>`` for every level of every fixed domain."""
    dummies = {
        f"{name}_{level}": (F.col(name) == level).cast("int")
        for name, levels in domains.items()
        for level in levels
    }
    return df.withColumns(dummies)


def interactions(df: DataFrame, switch: str, variables: Sequence[str]) -> DataFrame:
    """Product columns ``<switch>:<variable>``."""
    return df.withColumns({f"{switch}:{v}": F.col(switch) * F.col(f"`{v}`") for v in variables})


def decode_labels(df: DataFrame, labels: DataFrame, columns: Sequence[str], lower: Sequence[str] = ()) -> DataFrame:
    """Replace integer codes by labels of the ``(variable, code, label)`` dimension.

    The dimension holds one row per answer option; its measured size decides
    whether the join is a broadcast.
    """
    for name in columns:
        one = labels.where(F.col("variable") == name).select(
            F.col("code").alias(name), F.col("label").alias("__label")
        )
        text = F.lower("__label") if name in lower else F.col("__label")
        df = df.join(one, name, "left").withColumn(name, text).drop("__label")
    return df

"""Household tables from person-level and household-level survey files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from mosarea.functions.columns import rename_by_function, rename_by_map, snake_case
from mosarea.functions.expressions import cell_label, title_case
from mosarea.functions.recode import (
    DHS_RECODES,
    DISTRICT_RENAMES,
    MICS_HOUSEHOLD_RECODES,
    MICS_PERSON_RECODES,
    decode_labels,
    recode,
    rename_values,
    sex_from_code,
    size_bucket,
)

# ---------------------------------------------------------------------------
# Column names of the two survey programmes and output layouts.
# ---------------------------------------------------------------------------
DHS_NAMES = {
    "hv219": "hhh_sex",
    "hv220": "hhh_age",
    "hv009": "hh_size",
    "hv221": "h_phone",
    "hv014": "h_num_child_under_5",
    "hv005": "hh_weight",
}
DHS_COLUMNS = (
    "hhid", "adm1_name", "adm2_name", "hh_size", "hh_size_bucket", "h_cooking_fuel", "h_water_source",
    "h_water_source_2way", "h_toilet_type", "h_toilet_type_3way", "h_toilet_type_2way", "hhh_sex", "hhh_age",
    "hhh_edu", "h_phone", "h_cell", "urbanicity", "urbanicity_detailed", "h_num_child_under_5", "hh_weight",
    "hv226", "hv201", "hv205", "hv106",
)
MICS_PERSON_NAMES = {"HL6": "age", "HL4": "sex_raw", "HH6": "urbanicity", "HH7": "adm1_name"}
MICS_PERSON_COLUMNS = (
    "HH1", "HH2", "HL1", "age", "sex_raw", "ED5A", "urbanicity", "hhh_edu", "hhh_edu_3way", "hhh_sex", "adm1_name",
)
MICS_HOUSEHOLD_NAMES = {
    "HH15": "h_interview_language",
    "HC1A": "h_religion",
    "HH48": "hh_size",
    "HC7A": "h_landline",
    "HC7B": "h_radio",
    "HC8": "h_electricity",
    "HC9A": "h_tv",
    "HC11": "h_computer",
    "HC12": "h_cell",
    "HC13": "h_internet",
    "hhweight": "weight_hh",
}
MICS_HOUSEHOLD_COLUMNS = (
    "HH1", "HH2", "h_interview_language", "h_landline", "h_radio", "h_electricity", "h_tv", "h_computer", "h_cell",
    "h_internet", "h_toilet_type", "h_toilet_type_3way", "h_toilet_type_2way", "h_water_source",
    "h_water_source_2way", "h_cooking_fuel", "hh_size", "hh_size_bucket", "weight_hh", "EU4", "WS1", "WS11",
)
HEAD = 1
# ------------------------------ end of fixed values ------------------------


def dhs_households(persons: DataFrame, district_renames: Mapping[str, str] = DISTRICT_RENAMES) -> DataFrame:
    """One row per household head with harmonised answers.

    ``persons`` carries the survey codes plus ``adm1_name`` and ``adm2_name``
    from the cluster join.
    """
    heads = persons.where(F.col("hv101") == HEAD)
    table = rename_by_map(recode(heads, *DHS_RECODES), DHS_NAMES)
    table = table.withColumns(
        {
            "adm1_name": title_case(F.col("adm1_name")),
            "adm2_name": rename_values(F.col("adm2_name"), district_renames),
            "hhh_sex": sex_from_code(F.col("hhh_sex")),
            "hh_size_bucket": size_bucket(F.col("hh_size")),
        }
    )
    return table.select(*DHS_COLUMNS).distinct()


def mics_heads(persons: DataFrame, labels: DataFrame) -> DataFrame:
    heads = rename_by_map(persons.where(F.col("HL1") == HEAD), MICS_PERSON_NAMES)
    heads = recode(heads, *MICS_PERSON_RECODES)
    heads = decode_labels(heads, labels, ["urbanicity", "adm1_name"], lower=["urbanicity"])
    return heads.select(*MICS_PERSON_COLUMNS)


def mics_homes(households: DataFrame, labels: DataFrame) -> DataFrame:
    homes = rename_by_map(households, MICS_HOUSEHOLD_NAMES)
    homes = recode(homes, *MICS_HOUSEHOLD_RECODES).withColumn("hh_size_bucket", size_bucket(F.col("hh_size")))
    homes = decode_labels(homes, labels, ["h_interview_language"])
    return homes.select(*MICS_HOUSEHOLD_COLUMNS)


def mics_households(persons: DataFrame, households: DataFrame, labels: DataFrame) -> DataFrame:
    """Households with their head, zero-weight households left out."""
    homes = mics_homes(households, labels).where(F.col("weight_hh") != 0)
    joined = homes.join(mics_heads(persons, labels), ["HH1", "HH2"], "left")
    return joined.withColumn(
        "hhh_adm1_by_edu_by_sex", cell_label(F.col("adm1_name"), F.col("hhh_edu"), F.col("hhh_sex"))
    )


def census_districts(sheet: DataFrame) -> DataFrame:
    """District totals and household-weighted mean size from ward rows, total row left out.

    Column headers come in title case with blanks.
    """
    wards = rename_by_function(sheet, snake_case).where(F.col("ward") != "Total")
    weighted = F.sum(F.col("total_households") * F.col("average_household_size")) / F.sum("total_households")
    return wards.groupBy(F.col("districts").alias("adm2_name")).agg(
        weighted.alias("average_household_size"),
        F.sum("total_households").alias("total_households"),
        F.sum("total_population").alias("total_population"),
    )

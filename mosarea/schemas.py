"""Explicit schemas of the input tables and intermediate tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    """Nullable fields from 'name type, name type'; a name may hold blanks."""
    fields = [part.strip().rsplit(" ", 1) for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


PHONE_SURVEY = _schema(
    "respondent_id string, operator_id string, adm0_code int, adm1_code int, adm2_code int, "
    "adm1_name string, adm2_name string, obs_date date, obs_week string, obs_month date, fcs double, "
    "sample_source string, hhh_sex string, hhh_edu string, hh_size int, hh_size_bucket string, "
    "h_water_source string, h_water_source_raw string, h_water_source_2way string, "
    "h_toilet_type_raw string, h_toilet_type_2way string"
)
FACE_TO_FACE_SURVEY = _schema(
    "household_id string, adm1_name string, adm2_name string, obs_date date, obs_month date, fcs double, "
    "fcs_raw double, hhh_sex string, hhh_edu string, hh_size int, hh_size_bucket string, "
    "h_water_source_raw string, h_water_source_2way string, h_toilet_type_3way string, "
    "h_toilet_type_2way string, h_cell string"
)
POPULATION_SHARES = _schema(
    "ADM1_NAME_Survey string, ADM2_NAME_Survey string, Pop double, HHHEduGrp_noSchool double, "
    "HHHEduGrp_primary double, HHHEduGrp_secondary double, HHHEduGrp_higher double"
)
CENSUS_SHEET = _schema(
    "Districts string, Ward string, Total Households double, Total Population double, "
    "Average Household Size double"
)
LABELS = _schema("variable string, code int, label string")
MARGINS = _schema("margin string, var string, level string, freq double")
LONG_DRAWS = _schema("chain int, iteration int, draw int, param string, i int, j int, value double")
PREVALENCE = _schema("adm2_index int, month_idx int, draw int, prev double, prev2 double")
DISTRICTS = T.StructType(
    [
        T.StructField("adm1_name", T.StringType()),
        T.StructField("adm2_name", T.StringType()),
        T.StructField("ring", T.ArrayType(_schema("x double, y double"))),
    ]
)

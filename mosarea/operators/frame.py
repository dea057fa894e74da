"""Post-stratification frames: cells, margins, missing strata, completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosarea.functions.nulls import strict_sum
from mosarea.functions.recode import (
    CENSUS_FUEL,
    CENSUS_TOILET,
    CENSUS_TOILET_THREE_WAY,
    CENSUS_TOILET_TWO_WAY,
    WATER_TWO_WAY,
    Recode,
    yes_flag,
)
from mosarea.operators.aggregates import share_of_total, stacked_groups
from mosarea.operators.joins import level_grid
from mosarea.sources.tables import local_table

# ---------------------------------------------------------------------------
# Cell keys, weight scale, census margins.
# ---------------------------------------------------------------------------
CELL_KEYS = (
    "adm1_name",
    "adm2_name",
    "h_water_source_2way",
    "hh_size_bucket",
    "h_cooking_fuel",
    "h_toilet_type_3way",
    "h_toilet_type_2way",
    "hhh_sex",
    "hhh_edu",
    "h_cell",
)
STRATA_VARIABLES = (
    "h_water_source_2way",
    "h_toilet_type_2way",
    "hhh_sex",
    "hhh_edu",
    "hh_size_bucket",
    "h_cooking_fuel",
    "h_cell",
)
MODEL_CELL_KEYS = (
    "popframe_source",
    "adm1_name",
    "adm2_name",
    "hhh_edu",
    "hhh_sex",
    "h_toilet_type_2way",
    "h_water_source_2way",
    "hh_size_bucket",
    "h_cell",
)
WEIGHT_SCALE = 100000.0
FILLER_WEIGHT = 0.01
COUNT_FRAME_SCALE = 1000.0

CENSUS_COUNTS = {
    "h_cooking_fuel_raw": {"firewood": 2318724, "none": 4630, "solid": 19496, "clean": 1477601},
    "h_toilet_type_raw": {
        "flush": 1458267,
        "ventilatedLatrine": 596998,
        "pitLatrineSlab": 689586,
        "pitLatrineNoSlab": 261179,
        "composting": 25566,
        "bucket": 21561,
        "none": 759992,
        "other": 10337,
    },
    "h_water_source": {
        "piped": 0.296 + 0.045 + 0.004,
        "protected": 0.242 + 0.19,
        "unprotected/other": 0.222,
    },
    "hhh_sex": {"M": 0.606, "F": 1 - 0.606},
    "h_internet": {"yes": 0.343, "no": 0.657},
    "h_cell": {"yes": 0.874, "no": 1 - 0.874},
    "h_computer_laptop": {"yes": 0.113, "no": 1 - 0.113},
    "h_landline": {"yes": 0.029, "no": 1 - 0.029},
    "h_radio": {"yes": 0.362, "no": 1 - 0.362},
    "h_tv": {"yes": 0.326, "no": 1 - 0.326},
}
# ------------------------------ end of fixed values ------------------------

DERIVED_MARGINS: tuple[tuple[str, Recode], ...] = (
    ("h_cooking_fuel_raw", CENSUS_FUEL),
    ("h_toilet_type_raw", CENSUS_TOILET),
    ("h_toilet_type_raw", CENSUS_TOILET_THREE_WAY),
    ("h_toilet_type_raw", CENSUS_TOILET_TWO_WAY),
    ("h_water_source", WATER_TWO_WAY),
)


def census_margins(spark: SparkSession) -> DataFrame:
    """Published margins as ``(margin, var, level, freq)``, raw and regrouped."""
    rows = [(m, m, level, float(freq)) for m, levels in CENSUS_COUNTS.items() for level, freq in levels.items()]
    raw = local_table(spark, rows, "margin string, var string, level string, freq double")
    out = raw
    for source, rule in DERIVED_MARGINS:
        grouped = (
            raw.where(F.col("margin") == source)
            .withColumn(rule.source, F.col("level"))
            .withColumn("level", rule.column())
            .groupBy("level")
            .agg(F.sum("freq").alias("freq"))
        )
        out = out.unionByName(
            grouped.select(F.lit(rule.target).alias("margin"), F.lit(rule.target).alias("var"), "level", "freq")
        )
    return out


def district_margin(matched: DataFrame, households: str = "total_households") -> DataFrame:
    """Census households per district under the survey spelling."""
    return matched.select("adm1_name", F.col("adm2_name_svy").alias("adm2_name"), F.col(households).alias("freq"))


def margin(
    df: DataFrame, variables: Sequence[str], weight: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Normalised distribution of one or more variables in any weighted or plain table."""
    rows = df if where is None else df.where(where)
    total = F.count(F.lit(1)).cast("double") if weight is None else strict_sum(weight)
    grouped = rows.groupBy(*variables).agg(total.alias("freq"))
    return share_of_total(grouped, "freq", "freq")


def frame_cells(microdata: DataFrame, keys: Sequence[str] = CELL_KEYS, weight: str = "hh_weight") -> DataFrame:
    """Cells with summed survey weight, scaled and floored at one."""
    scaled = strict_sum(F.col(weight)) / WEIGHT_SCALE
    return (
        microdata.groupBy(*keys)
        .agg(scaled.alias("pop_weight"))
        .withColumn("pop_weight", F.when(F.col("pop_weight") < 1, 1.0).otherwise(F.col("pop_weight")))
    )


def missing_strata(frame: DataFrame, variables: Sequence[str] = STRATA_VARIABLES, area: str = "adm2_name") -> DataFrame:
    """``(area, var, level)`` combinations of the frame's own levels without a cell."""
    present = stacked_groups(frame.select(area, *variables), variables, [area], n=F.count(F.lit(1))).drop("n")
    grid = level_grid(frame, area, present)
    return grid.join(
        present,
        (grid[area].eqNullSafe(present[area])) & (grid["var"] == present["var"]) & grid["level"].eqNullSafe(present["level"]),
        "left_anti",
    )


def complete_strata(
    frame: DataFrame, missing: DataFrame, variables: Sequence[str] = STRATA_VARIABLES, area: str = "adm2_name"
) -> DataFrame:
    """Add filler cells for missing strata.

    Each missing ``(area, var, level)`` copies the area's original cells of
    another level with that level set and a small weight. Copies are made from
    the original frame only, equal rows are merged.
    """
    gaps = missing.select(F.col(area).alias("__area"), F.col("var").alias("__var"), F.col("level").alias("__level"))
    current = F.lit(None).cast("string")
    for v in variables:
        current = F.when(F.col("__var") == v, F.col(v)).otherwise(current)
    copies = frame.join(gaps, frame[area] == gaps["__area"]).where(current != F.col("__level"))
    copies = copies.withColumns(
        {
            **{v: F.when(F.col("__var") == v, F.col("__level")).otherwise(F.col(v)) for v in variables},
            "pop_weight": F.lit(FILLER_WEIGHT),
        }
    ).select(frame.columns)
    return frame.unionByName(copies).distinct()


def count_frame(survey: DataFrame, district_shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of a face-to-face survey weighted by the district's census share.

    ``keys`` start with the two area columns. Cell counts are aggregated first,
    so the district totals are summed from cells, not from interviews again.
    """
    cells = survey.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("adm1_name", "adm2_name").agg(F.sum("n").alias("n_adm2"))
    shares = share_of_total(district_shares, "freq", "prop_adm2")
    return (
        cells.join(totals, ["adm1_name", "adm2_name"], "left")
        .join(shares.select("adm1_name", "adm2_name", "prop_adm2"), ["adm1_name", "adm2_name"], "left")
        .withColumn("prop_cell_byadm2", F.col("n") / F.col("n_adm2"))
        .withColumn("pop_weight_byadm2", F.col("n"))
        .withColumn("pop_weight", F.col("prop_cell_byadm2") * F.col("prop_adm2") * COUNT_FRAME_SCALE)
    )


def model_cells(*frames: tuple[str, DataFrame]) -> DataFrame:
    """Stack ``(source name, frame)`` pairs and collapse to the variables a model uses."""
    stacked = None
    for source, frame in frames:
        one = frame.withColumn("popframe_source", F.lit(source)).select(*MODEL_CELL_KEYS, "pop_weight")
        stacked = one if stacked is None else stacked.unionByName(one)
    return (
        stacked.groupBy(*MODEL_CELL_KEYS)
        .agg(strict_sum(F.col("pop_weight")).alias("pop_weight"))
        .withColumn("p_cell", yes_flag(F.col("h_cell")))
        .withColumn("modality", F.lit("f2f"))
    )

"""Demographic weights and direct district-month estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from mosarea.functions.expressions import title_case
from mosarea.functions.nulls import member, weighted_mean
from mosarea.functions.recode import EDUCATION_LEVELS, in_domain, poor_flag
from mosarea.sources.tables import settle_dimension

# Share columns of the population sheet -> education level
SHARE_COLUMNS = {
    "HHHEduGrp_noSchool": "preprimary/other",
    "HHHEduGrp_primary": "primary",
    "HHHEduGrp_secondary": "secondary",
    "HHHEduGrp_higher": "higher",
}
PHONE_SOURCES = ("RDD", "GeoPoll")


def population_shares(sheet: DataFrame, shares: Mapping[str, str] = SHARE_COLUMNS) -> DataFrame:
    """``(adm1_name, hhh_edu, prop_pop)`` from the wide sheet with one row per district."""
    wide = (
        sheet.select(title_case(F.col("ADM1_NAME_Survey")).alias("adm1_name"), *shares)
        .withColumnsRenamed(dict(shares))
        .distinct()
    )
    return wide.unpivot("adm1_name", list(shares.values()), "hhh_edu", "prop_pop")


def sample_shares(survey: DataFrame, dedupe: bool = False) -> DataFrame:
    """Share of each education level among the interviews of a province and month.

    The window runs over counted cells, of which there are as many as
    months x provinces x levels, not over interviews.
    """
    rows = survey.dropDuplicates() if dedupe else survey
    cells = (
        rows.withColumn("hhh_edu", in_domain(F.col("hhh_edu"), EDUCATION_LEVELS))
        .groupBy("obs_month", "adm1_name", "hhh_edu")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    province_month = Window.partitionBy("obs_month", "adm1_name")
    return cells.select(
        "obs_month", "adm1_name", "hhh_edu", (F.col("n") / F.sum("n").over(province_month)).alias("prop_sample")
    )


def demographic_weights(survey: DataFrame, shares: DataFrame, dedupe: bool = False) -> DataFrame:
    """Population share over sample share per month, province and education level."""
    return (
        sample_shares(survey, dedupe)
        .join(shares, ["adm1_name", "hhh_edu"], "left")
        .select("obs_month", "adm1_name", "hhh_edu", (F.col("prop_pop") / F.col("prop_sample")).alias("dmg_weight_ust"))
    )


def phone_interviews(model_table: DataFrame, sources: Sequence[str] = PHONE_SOURCES) -> DataFrame:
    return model_table.where(member(F.col("sample_source"), sources))


def attach_weights(interviews: DataFrame, weights: DataFrame) -> DataFrame:
    return interviews.join(weights, ["obs_month", "adm1_name", "hhh_edu"], "left")


def normalised_weights(weighted: DataFrame) -> DataFrame:
    """Interviews with ``dmg_weight_norm`` adding to 1 in every district and month.

    The totals come from a partial aggregate, one row per district and month,
    settled and joined back: a window would sort all interviews of a busy
    district-month in one task.
    """
    w = F.col("dmg_weight_ust")
    totals = weighted.groupBy("adm2_name", "obs_month").agg(
        F.when(F.count(w) == F.count(F.lit(1)), F.sum(w)).alias("__total")
    )
    return (
        weighted.join(settle_dimension(totals), ["adm2_name", "obs_month"], "left")
        .withColumn("dmg_weight_norm", w / F.col("__total"))
        .drop("__total")
    )


def direct_weighted(weighted: DataFrame, outcome: str = "poor") -> DataFrame:
    """Weighted prevalence, standard error and Kish effective size per district-month.

    With weights normalised in the district-month, the sum of squares is
    sum(w^2) / sum(w)^2, so a single aggregation over raw weights is enough.
    """
    w = F.col("dmg_weight_ust")
    y = F.col(outcome).cast("double")
    complete = F.count(w) == F.count(F.lit(1))
    grouped = weighted.groupBy("adm1_name", "adm2_name", "obs_month").agg(
        F.when(complete, weighted_mean(y, w)).alias("y_est"),
        F.when(complete, F.sum(w * w) / (F.sum(w) * F.sum(w))).alias("__w2"),
    )
    return grouped.select(
        "adm1_name",
        "adm2_name",
        "obs_month",
        "y_est",
        F.sqrt(F.col("y_est") * (1 - F.col("y_est")) * F.col("__w2")).alias("y_est_se"),
        (1.0 / F.col("__w2")).alias("n_w"),
    )


def direct_unweighted(interviews: DataFrame, score: str = "fcs") -> DataFrame:
    """Face-to-face prevalence: mean over present scores, size counts all interviews."""
    poor = poor_flag(F.col(score)).cast("double")
    return (
        interviews.groupBy("adm1_name", "adm2_name", "obs_month")
        .agg(F.avg(poor).alias("f2f_est"), F.count(F.lit(1)).alias("n"))
        .withColumn("f2f_est_se", F.sqrt(F.col("f2f_est") * (1 - F.col("f2f_est")) / F.col("n")))
    )

"""Phone-ownership model: weighted logistic regression on main effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F


def fit_logistic(df: DataFrame, outcome: str, covariates: Sequence[str], weight: str | None = None) -> PipelineModel:
    """Maximum-likelihood logistic fit; the alphabetically first level is the baseline.

    Rows without an outcome, a covariate or a weight are left out.
    """
    needed = [outcome, *covariates] + ([weight] if weight else [])
    rows = df.select(*needed).dropna().withColumn(outcome, F.col(outcome).cast("double"))
    formula = RFormula(
        formula=f"{outcome} ~ {' + '.join(covariates)}",
        featuresCol="__features",
        labelCol="__label",
        stringIndexerOrderType="alphabetDesc",
        handleInvalid="error",
    )
    regression = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="__features", labelCol="__label",
        predictionCol="p_cell", tol=1e-10, maxIter=50,
    )
    if weight:
        regression = regression.setWeightCol(weight)
    return Pipeline(stages=[formula, regression]).fit(rows)


def score_logistic(model: PipelineModel, df: DataFrame, covariates: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``key`` and ``p_cell``; a row with a missing covariate gets a null score."""
    complete = F.lit(True)
    for name in covariates:
        complete = complete & F.col(name).isNotNull()
    rows = df.select(*dict.fromkeys([*key, *covariates]))
    scored = model.transform(rows.where(complete)).select(*key, "p_cell")
    return scored.unionByName(rows.where(~complete).select(*key, F.lit(None).cast("double").alias("p_cell")))


def null_predictions(df: DataFrame, score: str = "p_cell") -> DataFrame:
    """Number of rows and of rows without a score."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(score).isNull(), 1)).alias("n_null"))

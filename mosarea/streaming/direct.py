"""Face-to-face direct estimate as new interviews arrive.

Same numbers as :func:`mosarea.operators.weights.direct_unweighted`; the state
is one row per district and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosarea.functions.recode import poor_flag


def direct_unweighted_stream(interviews: DataFrame, score: str = "fcs", date: str = "obs_date", delay: str = "62 days") -> DataFrame:
    """Prevalence, size and standard error per district and month.

    ``delay`` is how late an interview may arrive; in append mode a month is
    emitted once it is closed, in update mode each time it changes.
    """
    poor = poor_flag(F.col(score)).cast("double")
    stamped = interviews.withColumn("__at", F.to_timestamp(F.col(date))).withWatermark("__at", delay)
    month = F.to_date(F.date_trunc("month", F.col("__at")))
    grouped = (
        stamped.withColumn("obs_month", month)
        .groupBy("adm1_name", "adm2_name", "obs_month")
        .agg(F.avg(poor).alias("f2f_est"), F.count(F.lit(1)).alias("n"))
    )
    return grouped.withColumn("f2f_est_se", F.sqrt(F.col("f2f_est") * (1 - F.col("f2f_est")) / F.col("n")))

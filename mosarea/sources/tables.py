"""CSV, JSON and Parquet sources and sinks; every reader takes an explicit schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from mosarea.session import cut_lineage


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    null_values: Sequence[str] = ("NA",),
) -> DataFrame:
    """CSV with header. Empty cells and ``null_values`` are missing; no inference pass."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path if isinstance(path, str) else list(path))
    )
    columns = []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        value = F.when(~F.trim(text).isin("", *null_values), text)
        columns.append(value.try_cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def unparsable_cells(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, null_values: Sequence[str] = ("NA",)
) -> DataFrame:
    """One row with, per column, the number of cells that are not missing and do not parse."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_csv(spark, path, as_text, null_values)
    counts = [
        F.count(F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), 1)).alias(f.name)
        for f in schema.fields
    ]
    return raw.agg(*counts)


def cast_dates(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Turn text columns into DATE by a pattern per column; unparsable text becomes null."""
    return df.withColumns(
        {name: F.to_date(F.try_to_timestamp(F.col(name), F.lit(pattern))) for name, pattern in formats.items()}
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, NA for missing; one file per task, never one task for all."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Typed intermediate between steps.

    Rows are clustered by the partition columns first, so that each folder gets
    few files; AQE splits a hot month over several writers.
    """
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_margins(margins: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Margins once as JSON lines and once as a typed table."""
    margins.write.mode(mode).json(f"{folder}/json")
    margins.write.mode(mode).parquet(f"{folder}/parquet")


def write_prevalence(df: DataFrame, path: str, model: str, method: str, mode: str = "errorifexists") -> None:
    """Per-draw prevalence, long, one folder per model, method and month."""
    tagged = df.withColumns({"model": F.lit(model), "method": F.lit(method)})
    write_table(tagged, path, ("model", "method", "month_idx"), mode)


def prevalence_wide(df: DataFrame, value: str, draws: Sequence[int]) -> DataFrame:
    """One column per draw, for exchange with tools that want a matrix."""
    return (
        df.groupBy("adm2_index", "month_idx")
        .pivot("draw", list(draws))
        .agg(F.first(value))
        .withColumnsRenamed({str(d): f"V{k + 1}" for k, d in enumerate(draws)})
    )


def prevalence_long(df: DataFrame, value: str = "prev") -> DataFrame:
    """Inverse of :func:`prevalence_wide`."""
    names = [c for c in df.columns if c.startswith("V")]
    return df.unpivot(["adm2_index", "month_idx"], names, "column", value).select(
        "adm2_index", "month_idx", F.expr("cast(substring(column, 2) as int)").alias("draw"), value
    )


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small constant table (answer lists, margin levels) as a local relation.

    Going through Arrow keeps the rows in the plan with a known size, so joins
    with it broadcast without a hint and no Python worker is started.
    """
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(values), type=to_arrow_type(f.dataType)) for f, values in zip(fields, columns)]
    return spark.createDataFrame(pa.table(arrays, names=[f.name for f in fields]))


def settle_dimension(df: DataFrame) -> DataFrame:
    """Write a table that is read again to the shared folder, and measure it on the way.

    Within the session's broadcast limit the written table is sent to the joins that
    use it; a larger one meets them by shuffle. Nothing passes the driver.
    """
    measure = Observation()
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    written = cut_lineage(df.observe(measure, F.coalesce(size, F.lit(0)).alias("bytes")))
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(written) if measure.get["bytes"] <= limit else written

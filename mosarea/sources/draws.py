"""Posterior draws: one CSV per chain in, one long Parquet table out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from mosarea.operators.aggregates import dense_index
from mosarea.session import cut_lineage
from mosarea.sources.tables import local_table

# Fixed pattern: a column is name, name.i or name.i.j
DRAW_COLUMN = r"^([A-Za-z_0-9]+?)(?:\.(\d+))?(?:\.(\d+))?$"


def read_chains(spark: SparkSession, path: str, columns: list[str], warmup: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long draws ``(chain, iteration, draw, param, i, j, value)`` of all chain files under a path.

    ``columns`` is the header of the files, which may have ``#`` comment lines. Chains are numbered
    by file name, iterations by the place of the line in its file, see
    :func:`number_in_file_order`; warm-up iterations are dropped. Chains must be of equal length.
    """
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in columns])
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    names = [n for n in columns if not n.endswith("__") and (not keep or re.match(DRAW_COLUMN, n).group(1) in keep)]
    safe = {name: f"c{k}" for k, name in enumerate(names)}
    rows = number_in_file_order(rows, "iteration", "chain").select("chain", "iteration", *[F.col(f"`{n}`").alias(s) for n, s in safe.items()])
    long = rows.where(F.col("iteration") > warmup).unpivot(["chain", "iteration"], list(safe.values()), "column", "value")
    described = local_table(spark, [(s, *parse_draw_column(n)) for n, s in safe.items()], "column string, param string, i int, j int")
    kept = long.join(described, "column").withColumn("iteration", (F.col("iteration") - warmup).cast("int"))
    lengths = kept.groupBy("chain").agg(F.max("iteration").alias("n"))
    length = lengths.agg(F.when(F.min("n").eqNullSafe(F.max("n")), F.max("n")).otherwise(F.raise_error(F.lit("chains of different length")).cast("int"))).scalar()
    draw = ((F.col("chain") - 1) * length + F.col("iteration")).cast("int")
    return kept.select("chain", "iteration", draw.alias("draw"), "param", "i", "j", "value")


def read_chain_csv(
    spark: SparkSession, path: str, chain: int, columns: list[str], warmup: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Long draws of one chain file as :func:`read_chains` has them, under the given chain number."""
    return read_chains(spark, path, columns, warmup, keep).withColumn("chain", F.lit(chain)).drop("draw")


def parse_draw_column(name: str) -> tuple[str, int | None, int | None]:
    found = re.match(DRAW_COLUMN, name)
    if not found:
        raise ValueError(f"not a draw column: {name}")
    param, i, j = found.groups()
    return param, int(i) if i else None, int(j) if j else None


def number_in_file_order(df: DataFrame, name: str, file_number: str | None = None) -> DataFrame:
    """1-based row number in each file of a file source, and the rank of the file's path.

    The order is that of the file, whichever task reads which part: parts are known by path and
    first byte, rows by their place in the part. Rows are written once, so that
    both readings agree; counts per part (one row per file split) are summed in order.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    placed = cut_lineage(marked.withColumn("__id", F.monotonically_increasing_id()))
    parts = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "__file", "__start", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift")
    )
    numbered = placed.join(offsets, ["__file", "__start"]).withColumn(name, F.col("__id") + F.col("__shift"))
    if file_number is not None:
        numbered = numbered.join(dense_index(parts, "__file", file_number), "__file")
    return numbered.drop("__file", "__start", "__id", "__shift")


def combine_chains(*chains: DataFrame) -> DataFrame:
    """One table over chains with a running draw number: chain blocks of equal length."""
    combined = chains[0]
    for chain in chains[1:]:
        combined = combined.unionByName(chain)
    length = combined.agg(F.max("iteration")).scalar()
    return combined.withColumn(
        "draw", ((F.col("chain") - 1) * length + F.col("iteration")).cast("int")
    ).select("chain", "iteration", "draw", "param", "i", "j", "value")


def without_warmup(draws: DataFrame, warmup: int) -> DataFrame:
    """Drop the first ``warmup`` iterations of a long draws table."""
    return draws.where(F.col("iteration") > warmup)

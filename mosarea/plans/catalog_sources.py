"""Sources and sinks: whole tables written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from mosarea.operators import aggregates as A
from mosarea.plans import views as V
from mosarea.plans.catalog_basic import FRAME_ROWS_SQL, frame_rows
from mosarea.plans.registry import R, query, r, rounded
from mosarea.plans.views import with_views
from mosarea.session import shared_folder
from mosarea.sources import draws as Sd, tables as Tb


def fresh_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string"


@query("s1_s6_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def s1_s6(spark, sf):
    """CSV with header and NA for missing, written by many tasks and read with an explicit schema."""
    path = fresh_path(spark, "csv")
    segment = F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    Tb.write_csv(V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", segment.alias("c_mktsegment")), path)
    return Tb.read_csv(spark, path, T.StructType.fromDDL(CUSTOMER))


@query(
    "s1_unparsable_cells",
    "SELECT CAST(count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) AS BIGINT) AS o_totalprice, CAST(0 AS BIGINT) AS o_orderkey FROM orders",
)
def s1_unparsable(spark, sf):
    """Cells that are neither missing nor parsable, counted per column."""
    path = fresh_path(spark, "csv")
    price = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/k")).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string"))
    Tb.write_csv(V.table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")), path)
    return Tb.unparsable_cells(spark, path, T.StructType.fromDDL("o_orderkey bigint, o_totalprice double"))


@query("s2_date_patterns", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, TRUE AS unparsed FROM orders")
def s2(spark, sf):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = V.table(spark, sf, "orders").select("o_orderkey", day.alias("day"), F.concat(F.lit("x"), day).alias("bad"))
    return Tb.cast_dates(text, {"day": "dd/MM/yyyy", "bad": "dd/MM/yyyy"}).select("o_orderkey", "day", F.col("bad").isNull().alias("unparsed"))


MARGIN_VARIABLES = ("h_cooking_fuel", "h_toilet_type_2way", "h_toilet_type_3way", "h_water_source_2way", "hhh_sex", "hhh_edu", "h_cell", "hh_size_bucket", "adm1_name", "adm2_name")
MARGINS_SQL = " UNION ALL ".join(f"SELECT '{v}' AS var, {v} AS level, sum(hh_weight) AS w FROM frame_rows GROUP BY 2" for v in MARGIN_VARIABLES)


@query(
    "s5_margin_files",
    with_views(f"SELECT var, level, {R('w / sum(w) OVER (PARTITION BY var)')} AS freq FROM ({MARGINS_SQL})", "v_frame_src", frame_rows=FRAME_ROWS_SQL),
)
def s5(spark, sf):
    """Margins of all frame variables as JSON lines and as a typed table; both must say the same."""
    path = fresh_path(spark, "margins")
    rows = frame_rows(spark, sf).select(*MARGIN_VARIABLES, F.col("hh_weight").cast("double").alias("w"))
    weighed = A.stacked_groups(rows, list(MARGIN_VARIABLES), [], w=F.sum("w"))
    Tb.write_margins(rounded(A.share_of_total(weighed, "w", "freq", by=["var"]).select("var", "level", "freq")), path)
    typed = Tb.read_table(spark, f"{path}/parquet")
    lines = spark.read.schema(typed.schema).json(f"{path}/json")
    same = (typed["var"] == lines["var"]) & typed["level"].eqNullSafe(lines["level"]) & (typed["freq"] == lines["freq"])
    return typed.join(lines, same, "left_semi").select("var", "level", "freq")


CHAINS, WARMUP = 2, 3
CHAIN_COLUMNS = ["lp__", "b0", "betas.1", "betas.2", "psi.1.1", "psi.2.1"]
CHAIN_VALUES = {"lp__": "-s_suppkey", "b0": "s_acctbal", "betas.1": "s_nationkey", "betas.2": "s_suppkey * 0.5", "psi.1.1": "s_acctbal - s_nationkey", "psi.2.1": "s_suppkey + 0.25"}
CHAIN_CELLS_SQL = " UNION ALL ".join(
    f"SELECT chain, pos, '{n.split('.')[0]}' AS param, {', '.join([*n.split('.')[1:], 'NULL', 'NULL'][:2])}, CAST({v} AS DOUBLE) AS value FROM lines" for n, v in CHAIN_VALUES.items() if n != "lp__"
)


@query(
    "s8_posterior_draws",
    f"""WITH lines AS (SELECT *, CAST(s_suppkey % {CHAINS} + 1 AS INT) AS chain, row_number() OVER (PARTITION BY s_suppkey % {CHAINS} ORDER BY s_suppkey) - {WARMUP} AS pos FROM supplier),
    lengths AS (SELECT max(pos) AS n FROM lines)
    SELECT chain, CAST(pos AS INT) AS iteration, CAST((chain - 1) * n + pos AS INT) AS draw, param, i, j, value FROM ({CHAIN_CELLS_SQL}) AS c(chain, pos, param, i, j, value), lengths WHERE pos > 0""",
)
def s8(spark, sf):
    """One CSV file per chain, one line per iteration, read in file order without the warm-up."""
    path = fresh_path(spark, "chains")
    supplier = V.table(spark, sf, "supplier")
    columns = [F.expr(CHAIN_VALUES[n]).cast("double").alias(n) for n in CHAIN_COLUMNS]
    for chain in range(CHAINS):
        own = supplier.where(F.col("s_suppkey") % CHAINS == chain).orderBy("s_suppkey").select(*columns).coalesce(1)
        own.write.option("header", True).csv(f"{path}/chain-{chain + 1}")
    return Sd.read_chains(spark, f"{path}/chain-*", CHAIN_COLUMNS, WARMUP)


@query("s7_typed_table", with_views("SELECT household_id, adm2_name, obs_month, fcs FROM v_households", "v_households"))
def s7(spark, sf):
    """Typed intermediate, one folder per month."""
    path = fresh_path(spark, "table")
    Tb.write_table(V.households(spark, sf).select("household_id", "adm2_name", "obs_month", "fcs"), path, ["obs_month"])
    return Tb.read_table(spark, path).select("household_id", "adm2_name", F.col("obs_month").cast("date").alias("obs_month"), "fcs")


@query(
    "s9_prevalence_files",
    """SELECT CAST(l_suppkey % 25 AS INT) AS adm2_index, CAST(l_suppkey % 12 AS INT) AS month_idx, CAST(l_linenumber AS INT) AS draw,
    (round(avg(CAST(l_discount AS DOUBLE)), 9) + CAST(0 AS DOUBLE)) AS prev, 'phone_only' AS model, 'mr' AS method FROM lineitem GROUP BY 1, 2, 3""",
)
def s9(spark, sf):
    """Prevalence per draw, one folder per model, method and month."""
    path = fresh_path(spark, "prevalence")
    keys = [(F.col("l_suppkey") % 25).cast("int").alias("adm2_index"), (F.col("l_suppkey") % 12).cast("int").alias("month_idx"), F.col("l_linenumber").cast("int").alias("draw")]
    made = V.table(spark, sf, "lineitem").groupBy(*keys).agg(r(F.avg(F.col("l_discount").cast("double"))).alias("prev"))
    Tb.write_prevalence(made, path, "phone_only", "mr")
    return Tb.read_table(spark, path).select("adm2_index", "month_idx", "draw", "prev", "model", "method")

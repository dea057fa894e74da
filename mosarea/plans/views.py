"""Survey-shaped views of the supplied star schema, as DataFrames and as SQL.

Every view covers whole tables, so its size follows the data: interviews come
from orders, frame households from customers, persons from order lines,
posterior draws from suppliers, districts and provinces from nations and
regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosarea.functions.expressions import UNIFORM_MULTIPLIERS, UNIFORM_PRIME, UNIFORM_ROUNDS
from mosarea.sources.tables import local_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Districts with their provinces, sent to the joins: Spark takes the join of the two small tables for a large one,
    and would deal all interviews out by district and back."""
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return F.broadcast(
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("r_name").alias("adm1_name"), F.col("n_name").alias("adm2_name")
        )
    )


def _choose(column: Column, pairs: dict, other=None) -> Column:
    expression = None
    for key, value in pairs.items():
        test = column == key
        expression = F.when(test, F.lit(value)) if expression is None else expression.when(test, F.lit(value))
    return expression.otherwise(other) if other is not None else expression


# Face-to-face interviews from this day on are the second round; models are fitted on the first.
SECOND_ROUND = "1998-01-01"
FIRST_ROUND_SQL = f"(modality = 'f2f' AND obs_date < DATE '{SECOND_ROUND}')"


def first_round() -> Column:
    return (F.col("modality") == "f2f") & (F.col("obs_date") < F.lit(SECOND_ROUND).cast("date"))


def second_round() -> Column:
    return (F.col("modality") == "f2f") & (F.col("obs_date") >= F.lit(SECOND_ROUND).cast("date"))


def households(spark: SparkSession, sf: str) -> DataFrame:
    """One interview per order."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(_places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fcs = F.when(key % 97 == 0, F.lit(None)).otherwise(F.floor(F.col("o_totalprice") / 500000 * 112).cast("int"))
    low = F.when(key % 10 == 0, F.lit(None)).otherwise(F.lit("primary"))
    return joined.select(
        key.alias("household_id"),
        cust.alias("respondent_id"),
        "adm1_name",
        "adm2_name",
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("obs_month"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("obs_week"),
        F.to_date("o_orderdate").alias("obs_date"),
        fcs.alias("fcs"),
        _choose(
            F.col("o_orderpriority"),
            {
                "1-URGENT": "higher",
                "2-HIGH": "secondary",
                "3-MEDIUM": "primary",
                "4-NOT SPECIFIED": "preprimary/other",
            },
            low,
        ).alias("hhh_edu"),
        F.when(cust % 2 == 0, "F").otherwise("M").alias("hhh_sex"),
        (cust % 9 + 1).cast("int").alias("hh_size"),
        _choose(
            F.col("c_mktsegment"),
            {"AUTOMOBILE": "piped", "BUILDING": "protected", "MACHINERY": "protected"},
            F.lit("unprotected/other"),
        ).alias("h_water_source"),
        F.when(key % 7 < 4, "improved").otherwise("unimproved").alias("h_toilet_type_2way"),
        F.when(F.col("c_acctbal") > 1000, "yes").otherwise("no").alias("h_cell"),
        F.when(F.col("o_orderstatus") == "P", "f2f").otherwise("rtm").alias("modality"),
        _choose(F.col("o_orderstatus"), {"F": "RDD", "O": "GeoPoll"}).alias("sample_source"),
    )


HOUSEHOLDS_SQL = """
SELECT o.o_orderkey AS household_id, o.o_custkey AS respondent_id, r.r_name AS adm1_name, n.n_name AS adm2_name,
  CAST(date_trunc('month', o.o_orderdate) AS DATE) AS obs_month, CAST(date_trunc('week', o.o_orderdate) AS DATE) AS obs_week,
  CAST(o.o_orderdate AS DATE) AS obs_date,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 500000 * 112) AS INT) END AS fcs,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'higher' WHEN '2-HIGH' THEN 'secondary' WHEN '3-MEDIUM' THEN 'primary'
       WHEN '4-NOT SPECIFIED' THEN 'preprimary/other'
       ELSE CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE 'primary' END END AS hhh_edu,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS hhh_sex, CAST(o.o_custkey % 9 + 1 AS INT) AS hh_size,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'piped' WHEN 'BUILDING' THEN 'protected' WHEN 'MACHINERY' THEN 'protected'
       ELSE 'unprotected/other' END AS h_water_source,
  CASE WHEN o.o_orderkey % 7 < 4 THEN 'improved' ELSE 'unimproved' END AS h_toilet_type_2way,
  CASE WHEN c.c_acctbal > 1000 THEN 'yes' ELSE 'no' END AS h_cell,
  CASE WHEN o.o_orderstatus = 'P' THEN 'f2f' ELSE 'rtm' END AS modality,
  CASE o.o_orderstatus WHEN 'F' THEN 'RDD' WHEN 'O' THEN 'GeoPoll' END AS sample_source
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def frame_source(spark: SparkSession, sf: str) -> DataFrame:
    """Frame household per customer with survey codes."""
    c = table(spark, sf, "customer")
    joined = c.join(_places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return joined.select(
        k.alias("hhid"),
        "adm1_name",
        "adm2_name",
        (k % 9 + 1).cast("int").alias("hv009"),
        (k % 4).cast("int").alias("hv106"),
        _choose(
            F.col("c_mktsegment"), {"AUTOMOBILE": 11, "BUILDING": 21, "MACHINERY": 31, "FURNITURE": 32}, F.lit(96)
        ).alias("hv201"),
        _choose(k % 7, {0: 11, 1: 21, 2: 22, 3: 23, 4: 31, 5: 42}, F.lit(96)).alias("hv205"),
        (k % 2 + 1).cast("int").alias("hv219"),
        (k % 8 + 1).cast("int").alias("hv226"),
        F.when(F.col("c_acctbal") > 1000, 1).otherwise(0).alias("hv243a"),
        F.floor(F.abs("c_acctbal") * 1000).cast("bigint").alias("hv005"),
    )


FRAME_SOURCE_SQL = """
SELECT c.c_custkey AS hhid, r.r_name AS adm1_name, n.n_name AS adm2_name,
  CAST(c.c_custkey % 9 + 1 AS INT) AS hv009, CAST(c.c_custkey % 4 AS INT) AS hv106,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 11 WHEN 'BUILDING' THEN 21 WHEN 'MACHINERY' THEN 31 WHEN 'FURNITURE' THEN 32 ELSE 96 END AS hv201,
  CASE c.c_custkey % 7 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 22 WHEN 3 THEN 23 WHEN 4 THEN 31 WHEN 5 THEN 42 ELSE 96 END AS hv205,
  CAST(c.c_custkey % 2 + 1 AS INT) AS hv219, CAST(c.c_custkey % 8 + 1 AS INT) AS hv226,
  CASE WHEN c.c_acctbal > 1000 THEN 1 ELSE 0 END AS hv243a, CAST(floor(abs(c.c_acctbal) * 1000) AS BIGINT) AS hv005
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def dhs_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Person file: order lines as household members, line 1 the head."""
    l = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    joined = (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(_places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    h, p = F.col("l_orderkey"), F.col("l_partkey")
    return joined.select(
        F.concat(F.lit("H"), h.cast("string")).alias("hhid"),
        F.col("l_linenumber").alias("hv101"),
        F.lower("adm1_name").alias("adm1_name"),
        "adm2_name",
        (h % 9 + 1).cast("int").alias("hv009"),
        (h % 3).cast("int").alias("hv014"),
        (h % 2 + 1).cast("int").alias("hv025"),
        (h % 5).cast("int").alias("hv026"),
        _null_every(p % 6, 5).cast("int").alias("hv106"),
        F.element_at(F.array(*[F.lit(v) for v in (11, 14, 21, 31, 32, 41, 96)]), (p % 7 + 1).cast("int")).alias("hv201"),
        F.element_at(F.array(*[F.lit(v) for v in (10, 21, 22, 23, 31, 42, 96, 99)]), (p % 8 + 1).cast("int")).alias("hv205"),
        _null_every(F.col("l_suppkey") % 3, 0).cast("int").alias("hv219"),
        F.col("l_quantity").cast("int").alias("hv220"),
        (h % 2).cast("int").alias("hv221"),
        (p % 9 + 1).cast("int").alias("hv226"),
        _null_every(h % 3, 2).cast("int").alias("hv243a"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("hv005"),
    )


def _null_every(value: Column, hole: int) -> Column:
    return F.when(value != hole, value)


DHS_PERSONS_SQL = """
SELECT concat('H', CAST(l.l_orderkey AS VARCHAR)) AS hhid, l.l_linenumber AS hv101, lower(r.r_name) AS adm1_name,
  n.n_name AS adm2_name, CAST(l.l_orderkey % 9 + 1 AS INT) AS hv009, CAST(l.l_orderkey % 3 AS INT) AS hv014,
  CAST(l.l_orderkey % 2 + 1 AS INT) AS hv025, CAST(l.l_orderkey % 5 AS INT) AS hv026,
  CAST(nullif(l.l_partkey % 6, 5) AS INT) AS hv106,
  CASE l.l_partkey % 7 WHEN 0 THEN 11 WHEN 1 THEN 14 WHEN 2 THEN 21 WHEN 3 THEN 31 WHEN 4 THEN 32 WHEN 5 THEN 41 ELSE 96 END AS hv201,
  CASE l.l_partkey % 8 WHEN 0 THEN 10 WHEN 1 THEN 21 WHEN 2 THEN 22 WHEN 3 THEN 23 WHEN 4 THEN 31 WHEN 5 THEN 42 WHEN 6 THEN 96 ELSE 99 END AS hv205,
  CAST(nullif(l.l_suppkey % 3, 0) AS INT) AS hv219, CAST(l.l_quantity AS INT) AS hv220, CAST(l.l_orderkey % 2 AS INT) AS hv221,
  CAST(l.l_partkey % 9 + 1 AS INT) AS hv226, CAST(nullif(l.l_orderkey % 3, 2) AS INT) AS hv243a,
  CAST(floor(o.o_totalprice) AS BIGINT) AS hv005
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def mics_persons(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return l.select(
        (F.col("l_orderkey") % 25).cast("int").alias("HH1"),
        F.col("l_orderkey").alias("HH2"),
        F.col("l_linenumber").alias("HL1"),
        (s % 2 + 1).cast("int").alias("HL4"),
        F.col("l_quantity").cast("int").alias("HL6"),
        (F.col("l_orderkey") % 2 + 1).cast("int").alias("HH6"),
        (F.col("l_orderkey") % 25 % 5).cast("int").alias("HH7"),
        F.when(p % 13 == 11, 98).when(p % 13 != 12, p % 13).cast("int").alias("ED5A"),
        (p % 4).cast("int").alias("ED5B"),
    )


MICS_PERSONS_SQL = """
SELECT CAST(l_orderkey % 25 AS INT) AS HH1, l_orderkey AS HH2, l_linenumber AS HL1, CAST(l_suppkey % 2 + 1 AS INT) AS HL4,
  CAST(l_quantity AS INT) AS HL6, CAST(l_orderkey % 2 + 1 AS INT) AS HH6, CAST(l_orderkey % 25 % 5 AS INT) AS HH7,
  CAST(CASE WHEN l_partkey % 13 = 11 THEN 98 WHEN l_partkey % 13 <> 12 THEN l_partkey % 13 END AS INT) AS ED5A,
  CAST(l_partkey % 4 AS INT) AS ED5B
FROM lineitem
"""


def mics_household_file(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = lambda value: value.cast("int")
    return o.select(
        code(k % 25).alias("HH1"),
        k.alias("HH2"),
        code(c % 3 + 1).alias("HH15"),
        code(c % 9 + 1).alias("HH48"),
        code(c % 5).alias("HC1A"),
        code(k % 3 + 1).alias("HC7A"),
        code(c % 2 + 1).alias("HC7B"),
        code(k % 4 + 1).alias("HC8"),
        code(_null_every(c % 3, 0)).alias("HC9A"),
        code(c % 4).alias("HC11"),
        code(k % 2 + 1).alias("HC12"),
        code(k % 5).alias("HC13"),
        code(k % 21 + 11).alias("WS1"),
        code(c % 14 + 11).alias("WS11"),
        code(k % 6 + 1).alias("EU4"),
        F.when(k % 50 == 0, 0.0).otherwise(F.col("o_totalprice") / 100000).alias("hhweight"),
    )


MICS_HOUSEHOLD_FILE_SQL = """
SELECT CAST(o_orderkey % 25 AS INT) AS HH1, o_orderkey AS HH2, CAST(o_custkey % 3 + 1 AS INT) AS HH15,
  CAST(o_custkey % 9 + 1 AS INT) AS HH48, CAST(o_custkey % 5 AS INT) AS HC1A, CAST(o_orderkey % 3 + 1 AS INT) AS HC7A,
  CAST(o_custkey % 2 + 1 AS INT) AS HC7B, CAST(o_orderkey % 4 + 1 AS INT) AS HC8, CAST(nullif(o_custkey % 3, 0) AS INT) AS HC9A,
  CAST(o_custkey % 4 AS INT) AS HC11, CAST(o_orderkey % 2 + 1 AS INT) AS HC12, CAST(o_orderkey % 5 AS INT) AS HC13,
  CAST(o_orderkey % 21 + 11 AS INT) AS WS1, CAST(o_custkey % 14 + 11 AS INT) AS WS11, CAST(o_orderkey % 6 + 1 AS INT) AS EU4,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 100000 END AS hhweight
FROM orders
"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Code labels: provinces from the region table plus two short answer lists."""
    region = table(spark, sf, "region").select(
        F.lit("adm1_name").alias("variable"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("label")
    )
    answers = local_table(
        spark,
        [
            ("urbanicity", 1, "Urban"),
            ("urbanicity", 2, "Rural"),
            ("h_interview_language", 1, "English"),
            ("h_interview_language", 2, "Shona"),
        ],
        "variable string, code int, label string",
    )
    return region.unionByName(answers)


LABELS_SQL = """
SELECT 'adm1_name' AS variable, r_regionkey AS code, r_name AS label FROM region
UNION ALL VALUES ('urbanicity', 1, 'Urban'), ('urbanicity', 2, 'Rural'),
  ('h_interview_language', 1, 'English'), ('h_interview_language', 2, 'Shona')
"""


def census_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Ward rows per district plus a total row, headers in title case with blanks."""
    c = table(spark, sf, "customer").join(
        _places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )
    size = (F.col("c_custkey") % 9 + 1).cast("double")
    measures = (
        F.count(F.lit(1)).cast("double").alias("Total Households"),
        F.sum(size).alias("Total Population"),
        F.avg(size).alias("Average Household Size"),
    )
    ward = F.concat(F.lit("Ward "), (F.col("c_custkey") % 10 + 1).cast("string"))
    wards = c.groupBy(F.col("adm2_name").alias("Districts"), ward.alias("Ward")).agg(*measures)
    totals = c.groupBy(F.col("adm2_name").alias("Districts")).agg(*measures).withColumn("Ward", F.lit("Total"))
    return wards.unionByName(totals)


CENSUS_SHEET_SQL = """
SELECT n.n_name AS districts, concat('Ward ', CAST(c_custkey % 10 + 1 AS VARCHAR)) AS ward,
  CAST(count(*) AS DOUBLE) AS total_households, sum(CAST(c_custkey % 9 + 1 AS DOUBLE)) AS total_population,
  avg(CAST(c_custkey % 9 + 1 AS DOUBLE)) AS average_household_size
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2
UNION ALL
SELECT n.n_name, 'Total', CAST(count(*) AS DOUBLE), sum(CAST(c_custkey % 9 + 1 AS DOUBLE)), avg(CAST(c_custkey % 9 + 1 AS DOUBLE))
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1
"""


def matched_names(spark: SparkSession, sf: str) -> DataFrame:
    """District households under census and survey spelling."""
    c = table(spark, sf, "customer").join(_places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        c.groupBy("adm1_name", "adm2_name")
        .agg(F.count(F.lit(1)).cast("double").alias("total_households"))
        .select(
            "adm1_name",
            F.col("adm2_name").alias("adm2_name_svy"),
            F.upper(F.concat("adm2_name", F.lit(" rural"))).alias("adm2_cen"),
            "total_households",
        )
    )


MATCHED_NAMES_SQL = """
SELECT r.r_name AS adm1_name, n.n_name AS adm2_name_svy, upper(concat(n.n_name, ' rural')) AS adm2_cen,
  CAST(count(*) AS DOUBLE) AS total_households
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
"""


def population_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """One row per district, education shares of its province repeated."""
    c = table(spark, sf, "customer").join(_places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    shares = c.groupBy("adm1_name").agg(
        share(k % 10 < 1).alias("HHHEduGrp_noSchool"),
        share((k % 10 >= 1) & (k % 10 < 4)).alias("HHHEduGrp_primary"),
        share((k % 10 >= 4) & (k % 10 < 8)).alias("HHHEduGrp_secondary"),
        share(k % 10 >= 8).alias("HHHEduGrp_higher"),
    )
    people = c.groupBy("adm1_name", "adm2_name").agg(F.sum((k % 9 + 1).cast("double")).alias("Pop"))
    return people.join(shares, "adm1_name").select(
        F.col("adm1_name").alias("ADM1_NAME_Survey"),
        F.col("adm2_name").alias("ADM2_NAME_Survey"),
        "Pop",
        "HHHEduGrp_noSchool",
        "HHHEduGrp_primary",
        "HHHEduGrp_secondary",
        "HHHEduGrp_higher",
    )


def TITLE(expression: str) -> str:
    """SQL text of a title case over blank-separated words."""
    return (
        f"array_to_string(list_transform(string_split(lower({expression}), ' '), "
        "lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ')"
    )


POPULATION_SHARES_SQL = f"""
SELECT adm1_name, e.hhh_edu, CASE e.hhh_edu WHEN 'preprimary/other' THEN s0 WHEN 'primary' THEN s1 WHEN 'secondary' THEN s2 ELSE s3 END AS prop_pop
FROM (SELECT {TITLE('r.r_name')} AS adm1_name,
    avg(CASE WHEN c_custkey % 10 < 1 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s0,
    avg(CASE WHEN c_custkey % 10 >= 1 AND c_custkey % 10 < 4 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s1,
    avg(CASE WHEN c_custkey % 10 >= 4 AND c_custkey % 10 < 8 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s2,
    avg(CASE WHEN c_custkey % 10 >= 8 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s3
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1) p
CROSS JOIN (VALUES ('preprimary/other'), ('primary'), ('secondary'), ('higher')) AS e(hhh_edu)
"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One point per customer in a 5.5 x 5.5 square: a border strip lies outside all districts."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("pt"),
        ((k * 7919 % 1100) / 200.0 + 0.001).cast("double").alias("x"),
        ((k * 104729 % 1100) / 200.0 + 0.001).cast("double").alias("y"),
    )


POINTS_SQL = """
SELECT c_custkey AS pt, CAST((c_custkey * 7919 % 1100) / 200.0 + 0.001 AS DOUBLE) AS x,
  CAST((c_custkey * 104729 % 1100) / 200.0 + 0.001 AS DOUBLE) AS y FROM customer
"""


def districts(spark: SparkSession, sf: str) -> DataFrame:
    """District k as the unit square at (k % 5, k / 5), ring left open."""
    n = F.col("n_nationkey")
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return _places(spark, sf).select(
        n.alias("adm2_index"),
        "adm1_name",
        "adm2_name",
        F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"),
    )


DISTRICT_EDGES_SQL = """
SELECT n_nationkey AS adm2_index, e.k, CAST(n_nationkey % 5 + e.x1 AS DOUBLE) AS x1, CAST(floor(n_nationkey / 5) + e.y1 AS DOUBLE) AS y1,
  CAST(n_nationkey % 5 + e.x2 AS DOUBLE) AS x2, CAST(floor(n_nationkey / 5) + e.y2 AS DOUBLE) AS y2
FROM nation CROSS JOIN (SELECT 1 AS k, 0 AS x1, 0 AS y1, 1 AS x2, 0 AS y2 UNION ALL SELECT 2, 1, 0, 1, 1
  UNION ALL SELECT 3, 1, 1, 0, 1 UNION ALL SELECT 4, 0, 1, 0, 0) e
"""


def ringed_districts(spark: SparkSession, sf: str) -> DataFrame:
    """The same squares with rings: every fifth district lies in two parts, the second in a hole of its neighbour."""
    n = F.col("n_nationkey")
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    square = lambda low, high: [(low, low), (high, low), (high, high), (low, high)]
    ring = lambda shift, corners: F.array(*[F.struct((x + shift + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])
    hole = square(0.25, 0.75)
    rings = F.when(n % 5 == 0, F.array(ring(0, square(0, 1)), ring(1, hole))).when(n % 5 == 1, F.array(ring(0, square(0, 1)), ring(0, hole)))
    rings = rings.otherwise(F.array(ring(0, square(0, 1))))
    return _places(spark, sf).select(n.alias("adm2_index"), "adm1_name", "adm2_name", F.posexplode(rings).alias("p", "ring")).withColumn(
        "ring_no", F.col("p") + 1
    )


RING_EDGES_SQL = """
SELECT n_nationkey AS adm2_index, r.ring_no, CAST(n_nationkey % 5 + r.shift + r.low + e.x1 * r.size AS DOUBLE) AS x1, CAST(floor(n_nationkey / 5) + r.low + e.y1 * r.size AS DOUBLE) AS y1,
  CAST(n_nationkey % 5 + r.shift + r.low + e.x2 * r.size AS DOUBLE) AS x2, CAST(floor(n_nationkey / 5) + r.low + e.y2 * r.size AS DOUBLE) AS y2
FROM nation JOIN (VALUES (-1, 1, 0, 0::DOUBLE, 1::DOUBLE), (0, 2, 1, 0.25::DOUBLE, 0.5::DOUBLE), (1, 2, 0, 0.25::DOUBLE, 0.5::DOUBLE)) AS r(rest, ring_no, shift, low, size)
  ON r.rest = -1 OR r.rest = n_nationkey % 5
CROSS JOIN (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) AS e(x1, y1, x2, y2)
"""


def cell_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Phone-ownership score per respondent."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("respondent_id"), ((k % 50) / 100.0 + 0.5).cast("double").alias("p_cell")
    )


CELL_SCORES_SQL = "SELECT c_custkey AS respondent_id, CAST((c_custkey % 50) / 100.0 + 0.5 AS DOUBLE) AS p_cell FROM customer"


# --- keyed uniforms as SQL text, in steps so that no expression is repeated ---
def UNIFORM_SQL(source: str, keys: list[str], name: str, seed: int = 1234) -> str:
    """``source`` (a FROM item with an alias) plus a uniform column ``name``."""
    p = UNIFORM_PRIME
    start = " + ".join(
        [str(seed)] + [f"(abs(CAST({k} AS BIGINT)) % {p}) * {m}" for k, m in zip(keys, UNIFORM_MULTIPLIERS)]
    )
    inner = f"SELECT *, ({start}) % {p} AS s0 FROM {source}"
    for step, constant in enumerate(UNIFORM_ROUNDS):
        inner = f"SELECT *, (s{step} * s{step}) % {p} AS q{step} FROM ({inner})"
        inner = f"SELECT *, ((((q{step} * q{step}) % {p}) * s{step}) % {p} + {constant}) % {p} AS s{step + 1} FROM ({inner})"
    drop = ", ".join(c for i in range(len(UNIFORM_ROUNDS)) for c in (f"s{i}", f"q{i}"))
    last = f"s{len(UNIFORM_ROUNDS)}"
    return f"(SELECT * EXCLUDE ({drop}, {last}), CAST({last} AS DOUBLE) / {p}.0::DOUBLE AS {name} FROM ({inner}))"


SQL_VIEWS = {
    "v_households": HOUSEHOLDS_SQL,
    "v_frame_src": FRAME_SOURCE_SQL,
    "v_dhs_persons": DHS_PERSONS_SQL,
    "v_mics_persons": MICS_PERSONS_SQL,
    "v_mics_households": MICS_HOUSEHOLD_FILE_SQL,
    "v_labels": LABELS_SQL,
    "v_census_sheet": CENSUS_SHEET_SQL,
    "v_matched": MATCHED_NAMES_SQL,
    "v_pop_shares": POPULATION_SHARES_SQL,
    "v_points": POINTS_SQL,
    "v_edges": DISTRICT_EDGES_SQL,
    "v_ring_edges": RING_EDGES_SQL,
    "v_scores": CELL_SCORES_SQL,
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """Prefix ``body`` with the named views and further common table expressions."""
    parts = [f"{n} AS ({SQL_VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {body.strip()}"

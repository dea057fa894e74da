"""Projections, recodes, joins, aggregates, windows, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from mosarea.functions import columns as C, expressions as X, nulls as N, recode as Rc
from mosarea.operators import aggregates as A, frame as Fr, joins as J, microdata as Mi, weights as Wt
from mosarea.operators.intervals import interval_columns, keep_interval
from mosarea.plans import views as V
from mosarea.plans.registry import R, query, r, rounded
from mosarea.plans.views import TITLE, UNIFORM_SQL, with_views
from mosarea.session import cut_lineage

FACE_WATER_TEXTS = [
    "Piped into dwelling",
    " Piped into yard or plot",
    "Piped into yard or plot",
    "Borehole",
    "Protected well",
    "Other",
    "Unprotected spring",
    "Sand abstraction",
]


def _face_water(spark, sf):
    """Face-to-face water answers as text, one row per order line."""
    texts = F.array(*[F.lit(t) for t in FACE_WATER_TEXTS])
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.get(texts, (F.col("l_partkey") % 9).cast("int")).alias("h_water_source_raw"),
    )


FACE_WATER_SQL = (
    "SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 "
    + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(FACE_WATER_TEXTS))
    + " END AS h_water_source_raw FROM lineitem"
)


# ------------------------------------------------------------------ sources
@query(
    "s3_label_decode",
    with_views(
        """SELECT HH2, HL1, lower(u.label) AS urbanicity, a.label AS adm1_name FROM v_mics_persons p
        LEFT JOIN v_labels u ON u.variable = 'urbanicity' AND u.code = p.HH6
        LEFT JOIN v_labels a ON a.variable = 'adm1_name' AND a.code = p.HH7""",
        "v_mics_persons",
        "v_labels",
    ),
)
def s3(spark, sf):
    persons = V.mics_persons(spark, sf).withColumnsRenamed({"HH6": "urbanicity", "HH7": "adm1_name"})
    decoded = Rc.decode_labels(persons, V.labels(spark, sf), ["urbanicity", "adm1_name"], lower=["urbanicity"])
    return decoded.select("HH2", "HL1", "urbanicity", "adm1_name")


CENSUS_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS margin, '{level}' AS level, CAST({freq!r} AS DOUBLE) AS freq"
    for m, levels in Fr.CENSUS_COUNTS.items()
    for level, freq in levels.items()
)
CENSUS_GROUPED_SQL = """
SELECT 'h_cooking_fuel' AS margin, CASE WHEN level = 'clean' THEN 'clean' ELSE 'other' END AS level, sum(freq) AS freq FROM census WHERE margin = 'h_cooking_fuel_raw' GROUP BY 1, 2
UNION ALL SELECT 'h_toilet_type_2way', CASE WHEN level IN ('flush', 'ventilatedLatrine', 'pitLatrineSlab', 'composting') THEN 'improved' ELSE 'unimproved' END, sum(freq) FROM census WHERE margin = 'h_toilet_type_raw' GROUP BY 1, 2
UNION ALL SELECT 'h_toilet_type_3way', CASE WHEN level IN ('flush', 'ventilatedLatrine', 'pitLatrineSlab', 'composting') THEN 'improved' WHEN level = 'other' THEN 'other' ELSE 'unimproved' END, sum(freq) FROM census WHERE margin = 'h_toilet_type_raw' GROUP BY 1, 2
UNION ALL SELECT 'h_water_source_2way', CASE WHEN level = 'unprotected/other' THEN 'other' ELSE 'improved' END, sum(freq) FROM census WHERE margin = 'h_water_source' GROUP BY 1, 2
UNION ALL SELECT margin, level, freq FROM census WHERE margin IN ('hhh_sex', 'h_cell')
"""

FRAME_ROWS_SQL = """
SELECT hhid, adm1_name, adm2_name, hv005 AS hh_weight,
  CASE WHEN hv201 BETWEEN 10 AND 14 OR hv201 IN (21, 31, 41) THEN 'improved' ELSE 'other' END AS h_water_source_2way,
  CASE WHEN hv009 <= 2 THEN '1-2' WHEN hv009 <= 4 THEN '3-4' WHEN hv009 <= 6 THEN '5-6' ELSE '7+' END AS hh_size_bucket,
  CASE WHEN hv226 BETWEEN 1 AND 5 THEN 'clean' ELSE 'other' END AS h_cooking_fuel,
  CASE WHEN hv205 BETWEEN 10 AND 15 OR hv205 IN (21, 22) THEN 'improved' WHEN hv205 IN (23, 31, 42) THEN 'unimproved' WHEN hv205 = 96 THEN 'other' END AS h_toilet_type_3way,
  CASE WHEN hv205 BETWEEN 10 AND 15 OR hv205 IN (21, 22) THEN 'improved' ELSE 'unimproved' END AS h_toilet_type_2way,
  CASE WHEN hv219 IS NULL THEN NULL WHEN hv219 = 1 THEN 'M' ELSE 'F' END AS hhh_sex,
  CASE hv106 WHEN 3 THEN 'higher' WHEN 2 THEN 'secondary' WHEN 1 THEN 'primary' ELSE 'preprimary/other' END AS hhh_edu,
  CASE WHEN hv243a = 1 THEN 'yes' ELSE 'no' END AS h_cell
FROM v_frame_src
"""


def frame_rows(spark, sf):
    """Frame households with harmonised answers."""
    source = V.frame_source(spark, sf)
    needed = [rule for rule in Rc.DHS_RECODES if not rule.target.startswith("urbanicity")]
    return (
        Rc.recode(source, *needed)
        .withColumns({"hhh_sex": Rc.sex_from_code(F.col("hv219")), "hh_size_bucket": Rc.size_bucket(F.col("hv009"))})
        .select("hhid", *Fr.CELL_KEYS, F.col("hv005").alias("hh_weight"))
    )


@query(
    "s4_census_margins_vs_frame",
    with_views(
        f"""SELECT c.margin AS var, c.level, {R('c.freq / sum(c.freq) OVER (PARTITION BY c.margin)')} AS census_share,
        {R('f.w / sum(f.w) OVER (PARTITION BY c.margin)')} AS frame_share
        FROM grouped c LEFT JOIN (
          SELECT 'h_cooking_fuel' AS margin, h_cooking_fuel AS level, sum(hh_weight) AS w FROM frame_rows GROUP BY 1, 2
          UNION ALL SELECT 'h_toilet_type_2way', h_toilet_type_2way, sum(hh_weight) FROM frame_rows GROUP BY 1, 2
          UNION ALL SELECT 'h_toilet_type_3way', h_toilet_type_3way, sum(hh_weight) FROM frame_rows GROUP BY 1, 2
          UNION ALL SELECT 'h_water_source_2way', h_water_source_2way, sum(hh_weight) FROM frame_rows GROUP BY 1, 2
          UNION ALL SELECT 'hhh_sex', hhh_sex, sum(hh_weight) FROM frame_rows GROUP BY 1, 2
          UNION ALL SELECT 'h_cell', h_cell, sum(hh_weight) FROM frame_rows GROUP BY 1, 2) f
        ON f.margin = c.margin AND f.level = c.level""",
        "v_frame_src",
        frame_rows=FRAME_ROWS_SQL,
        census=CENSUS_SQL,
        grouped=CENSUS_GROUPED_SQL,
    ),
)
def s4(spark, sf):
    variables = ["h_cooking_fuel", "h_toilet_type_2way", "h_toilet_type_3way", "h_water_source_2way", "hhh_sex", "h_cell"]
    census = Fr.census_margins(spark).where(F.col("var").isin(variables)).select("var", "level", "freq")
    census = A.share_of_total(census, "freq", "census_share", by=["var"]).drop("freq")
    rows = frame_rows(spark, sf)
    weighed = A.stacked_groups(
        rows.select(*variables, F.col("hh_weight").cast("double").alias("w")), variables, [], w=F.sum("w")
    )
    achieved = A.share_of_total(weighed, "w", "frame_share", by=["var"]).drop("w")
    return rounded(census.join(achieved, ["var", "level"], "left").select("var", "level", "census_share", "frame_share"))


# -------------------------------------------------------------- projections
@query(
    "p1_rename_map",
    with_views(
        "SELECT HH1, HH2, HH48 AS hh_size, HC12 AS h_cell, HC13 AS h_internet, hhweight AS weight_hh FROM v_mics_households",
        "v_mics_households",
    ),
)
def p1(spark, sf):
    renamed = C.rename_by_map(V.mics_household_file(spark, sf), Mi.MICS_HOUSEHOLD_NAMES)
    return renamed.select("HH1", "HH2", "hh_size", "h_cell", "h_internet", "weight_hh")


@query(
    "p2_rename_function",
    with_views(f"SELECT districts, ward, total_households, {R('average_household_size')} AS average_household_size FROM v_census_sheet", "v_census_sheet"),
)
def p2(spark, sf):
    sheet = C.rename_by_function(V.census_sheet(spark, sf), C.snake_case)
    return rounded(sheet.select("districts", "ward", "total_households", "average_household_size"))


@query(
    "p3_rename_position",
    with_views(
        f"""SELECT DISTINCT adm1_name, {R("max(CASE WHEN hhh_edu = 'preprimary/other' THEN prop_pop END) OVER (PARTITION BY adm1_name)")} AS "preprimary/other",
        {R("max(CASE WHEN hhh_edu = 'higher' THEN prop_pop END) OVER (PARTITION BY adm1_name)")} AS higher FROM v_pop_shares""",
        "v_pop_shares",
    ),
)
def p3(spark, sf):
    sheet = V.population_sheet(spark, sf).select(
        X.title_case(F.col("ADM1_NAME_Survey")).alias("adm1_name"), *Wt.SHARE_COLUMNS
    )
    named = C.rename_by_position(sheet, 1, list(Wt.SHARE_COLUMNS.values())).distinct()
    return rounded(named.select("adm1_name", "`preprimary/other`", "higher"))


@query(
    "p5_select_drop_prefix",
    with_views(
        "SELECT household_id, adm1_name, adm2_name, obs_month, fcs, hhh_edu, hhh_sex, modality, sample_source FROM v_households",
        "v_households",
    ),
)
def p5(spark, sf):
    table = V.households(spark, sf).drop("respondent_id", "obs_date", "obs_week", "hh_size")
    return C.drop_prefixed(table, "h_")


@query(
    "p6_shared_columns",
    with_views("SELECT hhh_edu, hhh_sex, hh_size, h_water_source, h_cell FROM v_households", "v_households"),
)
def p6(spark, sf):
    phone = V.households(spark, sf)
    mics = Mi.mics_households(V.mics_persons(spark, sf), V.mics_household_file(spark, sf), V.labels(spark, sf))
    names = C.shared_columns(phone, mics, exclude=("hh_size_bucket", "h_toilet_type_2way", "adm1_name"))
    return phone.select(*sorted(names))


@query(
    "p7_filters",
    with_views(
        """SELECT household_id, adm2_name, obs_date, fcs FROM v_households WHERE modality = 'rtm' AND fcs IS NOT NULL
        AND hh_size BETWEEN 2 AND 7 AND sample_source IN ('RDD', 'GeoPoll') AND obs_date >= DATE '1996-01-01'""",
        "v_households",
    ),
)
def p7(spark, sf):
    h = V.households(spark, sf)
    return Wt.phone_interviews(
        h.where((F.col("modality") == "rtm") & F.col("fcs").isNotNull() & F.col("hh_size").between(2, 7))
    ).where(F.col("obs_date") >= F.lit("1996-01-01").cast("date")).select("household_id", "adm2_name", "obs_date", "fcs")


@query(
    "p8_membership_filter",
    with_views(
        """SELECT household_id, adm2_name FROM v_households WHERE modality = 'rtm' AND respondent_id IN
        (SELECT respondent_id FROM v_households WHERE modality = 'f2f')""",
        "v_households",
    ),
)
def p8(spark, sf):
    h = V.households(spark, sf)
    visited = h.where(F.col("modality") == "f2f")
    return J.keep_members(h.where(F.col("modality") == "rtm"), visited, "respondent_id").select("household_id", "adm2_name")


@query(
    "p9_complete_cases",
    with_views(
        """SELECT adm1_name, CAST(count(*) AS BIGINT) AS n_all, CAST(count(CASE WHEN hhh_edu IS NOT NULL AND fcs IS NOT NULL THEN 1 END) AS BIGINT) AS n_complete,
        CAST(count(CASE WHEN hhh_edu IS NOT NULL AND fcs IS NOT NULL AND sample_source IS NOT NULL THEN 1 END) AS BIGINT) AS n_complete_all FROM v_households GROUP BY 1""",
        "v_households",
    ),
)
def p9(spark, sf):
    h = V.households(spark, sf)
    some = C.is_complete(h, ["hhh_edu", "fcs", "a_column_that_is_absent"])
    return h.groupBy("adm1_name").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(F.when(some, 1)).alias("n_complete"),
        F.count(F.when(C.is_complete(h), 1)).alias("n_complete_all"),
    )


@query(
    "p10_ordered_domain",
    with_views(
        """SELECT household_id, CASE WHEN hhh_edu IN ('primary', 'secondary', 'higher') THEN hhh_edu END AS hhh_edu,
        CASE hhh_edu WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 WHEN 'higher' THEN 3 END AS ord FROM v_households""",
        "v_households",
    ),
)
def p10(spark, sf):
    levels = Rc.EDUCATION_LEVELS[1:]
    edu = F.col("hhh_edu")
    return V.households(spark, sf).select(
        "household_id", Rc.in_domain(edu, levels).alias("hhh_edu"), Rc.level_order(edu, levels).alias("ord")
    )


@query(
    "p11_tag_columns",
    with_views(
        """SELECT household_id, 'mobile-phone' AS model, 1 AS "group", 'yes' AS h_cell FROM v_households WHERE modality = 'rtm'
        UNION ALL SELECT household_id, 'joint', NULL, h_cell FROM v_households WHERE modality = 'f2f'""",
        "v_households",
    ),
)
def p11(spark, sf):
    h = V.households(spark, sf).select("household_id", "modality", "h_cell")
    phone = h.where(F.col("modality") == "rtm").withColumns(
        {"model": F.lit("mobile-phone"), "group": F.lit(1), "h_cell": F.lit("yes")}
    )
    face = h.where(F.col("modality") == "f2f").withColumn("model", F.lit("joint"))
    return J.union_by_name(phone, face).drop("modality")


@query(
    "p12_recode_dhs",
    with_views(
        """SELECT hhid, hv101, CASE WHEN hv025 = 1 THEN 'urban' ELSE 'rural' END AS urbanicity,
        CASE hv026 WHEN 0 THEN 'capital, large city' WHEN 1 THEN 'small city' WHEN 2 THEN 'town' WHEN 3 THEN 'countryside' ELSE 'rural' END AS urbanicity_detailed,
        CASE hv106 WHEN 3 THEN 'higher' WHEN 2 THEN 'secondary' WHEN 1 THEN 'primary' ELSE 'preprimary/other' END AS hhh_edu,
        CASE WHEN hv201 BETWEEN 10 AND 14 THEN 'piped' WHEN hv201 IN (21, 31, 41) THEN 'protected' ELSE 'unprotected/other' END AS h_water_source,
        CASE WHEN hv201 BETWEEN 10 AND 14 OR hv201 IN (21, 31, 41) THEN 'improved' ELSE 'other' END AS h_water_source_2way,
        CASE WHEN hv205 BETWEEN 10 AND 15 THEN 'modernWaterCloset' WHEN hv205 = 21 THEN 'ventilatedBuildInLatrine' WHEN hv205 = 22 THEN 'pitLatrineWithSlab'
          WHEN hv205 = 23 THEN 'pitLatrineWithNoSlab' WHEN hv205 = 31 THEN 'none' WHEN hv205 = 42 THEN 'bucket' WHEN hv205 = 96 THEN 'other' END AS h_toilet_type,
        CASE WHEN hv205 BETWEEN 10 AND 15 OR hv205 IN (21, 22) THEN 'improved' WHEN hv205 IN (23, 31, 42) THEN 'unimproved' WHEN hv205 = 96 THEN 'other' END AS h_toilet_type_3way,
        CASE WHEN hv205 BETWEEN 10 AND 15 OR hv205 IN (21, 22) THEN 'improved' ELSE 'unimproved' END AS h_toilet_type_2way,
        CASE WHEN hv226 BETWEEN 1 AND 5 THEN 'clean' ELSE 'other' END AS h_cooking_fuel,
        CASE WHEN hv243a = 1 THEN 'yes' ELSE 'no' END AS h_cell,
        CASE WHEN hv219 IS NULL THEN NULL WHEN hv219 = 1 THEN 'M' ELSE 'F' END AS hhh_sex FROM v_dhs_persons""",
        "v_dhs_persons",
    ),
)
def p12(spark, sf):
    coded = Rc.recode(V.dhs_persons(spark, sf), *Rc.DHS_RECODES)
    return coded.withColumn("hhh_sex", Rc.sex_from_code(F.col("hv219"))).select(
        "hhid", "hv101", *[rule.target for rule in Rc.DHS_RECODES], "hhh_sex"
    )


@query(
    "p12_recode_f2f_water",
    with_views(
        """SELECT l_orderkey, l_linenumber, CASE WHEN trim(h_water_source_raw) IN ('Piped into dwelling', 'Piped into neighbour', 'Piped into public tap or standpipe', 'Piped into yard or plot') THEN 'piped'
        WHEN trim(h_water_source_raw) IN ('Other', 'Unprotected spring', 'Unprotected well', 'Sand abstraction') THEN 'unprotected/other' ELSE 'protected' END AS h_water_source FROM texts""",
        texts=FACE_WATER_SQL,
    ),
)
def p12_water(spark, sf):
    return Rc.recode(_face_water(spark, sf), Rc.FACE_TO_FACE_WATER).drop("h_water_source_raw")


@query(
    "p12_education_groups",
    with_views(
        """SELECT household_id, CASE WHEN hhh_edu IN ('preprimary/other', 'primary') THEN 'primary or less' ELSE hhh_edu END AS hhh_edu_3way,
        CASE WHEN hhh_edu IN ('preprimary/other', 'primary') THEN 'primary or less' ELSE hhh_edu END AS hhh_edu_4way FROM v_households""",
        "v_households",
    ),
)
def p12_edu(spark, sf):
    h = V.households(spark, sf)
    return Rc.recode(h, Rc.EDUCATION_THREE_WAY, Rc.EDUCATION_FOUR_WAY).select("household_id", "hhh_edu_3way", "hhh_edu_4way")


SIZE_SQL = "CASE WHEN {0} <= 2 THEN '1-2' WHEN {0} <= 4 THEN '3-4' WHEN {0} <= 6 THEN '5-6' ELSE '7+' END"


@query(
    "p13_size_bucket",
    with_views(f"SELECT household_id, {SIZE_SQL.format('CASE WHEN fcs IS NOT NULL THEN hh_size END')} AS hh_size_bucket FROM v_households", "v_households"),
)
def p13(spark, sf):
    return V.households(spark, sf).select(
        "household_id", Rc.size_bucket(F.when(F.col("fcs").isNotNull(), F.col("hh_size"))).alias("hh_size_bucket")
    )


@query(
    "p14_outcome",
    with_views(f"SELECT household_id, CAST(fcs < 28 AS INT) AS poor, {R('CAST(fcs AS DOUBLE) / 112')} AS fcs_scaled FROM v_households", "v_households"),
)
def p14(spark, sf):
    return V.households(spark, sf).select(
        "household_id", Rc.poor_flag(F.col("fcs")).cast("int").alias("poor"), r(Rc.scaled_score(F.col("fcs"))).alias("fcs_scaled")
    )


@query(
    "p15_phone_flag",
    with_views("SELECT household_id, CAST(h_cell = 'yes' AS INT) AS p_cell FROM v_households", "v_households"),
)
def p15(spark, sf):
    return V.households(spark, sf).select("household_id", Rc.yes_flag(F.col("h_cell")).alias("p_cell"))


DUMMY_SQL = ", ".join(
    f"""CAST({n} = '{level}' AS INT) AS "{n}_{level}\""""
    for n, levels in (("hhh_sex", Rc.SEX_LEVELS), ("hhh_edu", Rc.EDUCATION_LEVELS), ("modality", Rc.MODALITY_LEVELS))
    for level in levels
)


@query("p16_one_hot", with_views(f"SELECT household_id, {DUMMY_SQL} FROM v_households", "v_households"))
def p16(spark, sf):
    domains = {"hhh_sex": Rc.SEX_LEVELS, "hhh_edu": Rc.EDUCATION_LEVELS, "modality": Rc.MODALITY_LEVELS}
    return Rc.one_hot(V.households(spark, sf).select("household_id", *domains), domains).drop(*domains)


@query(
    "p17_interactions",
    with_views(
        """SELECT household_id, CAST(modality = 'f2f' AND hhh_sex = 'F' AS INT) AS "modality_f2f:hhh_sex_F",
        CAST(modality = 'f2f' AS INT) * CAST(hhh_edu = 'higher' AS INT) AS "modality_f2f:hhh_edu_higher" FROM v_households""",
        "v_households",
    ),
)
def p17(spark, sf):
    domains = {"hhh_sex": Rc.SEX_LEVELS, "hhh_edu": Rc.EDUCATION_LEVELS, "modality": Rc.MODALITY_LEVELS}
    coded = Rc.one_hot(V.households(spark, sf), domains)
    crossed = Rc.interactions(coded, "modality_f2f", ["hhh_sex_F", "hhh_edu_higher"])
    return crossed.select("household_id", *[C.quoted(n) for n in crossed.columns if ":" in n])


@query(
    "p18_cell_label",
    with_views(
        "SELECT household_id, concat(adm1_name, ' x ', coalesce(hhh_edu, 'NA'), ' x ', hhh_sex) AS cell FROM v_households",
        "v_households",
    ),
)
def p18(spark, sf):
    return V.households(spark, sf).select(
        "household_id", X.cell_label(F.col("adm1_name"), F.col("hhh_edu"), F.col("hhh_sex")).alias("cell")
    )


@query(
    "p20_round_relabel",
    with_views(
        f"""SELECT CASE modality WHEN 'rtm' THEN 'phone' ELSE 'face-to-face' END AS method, adm1_name,
        {R('avg(CAST(fcs AS DOUBLE))', 3)} AS mean_fcs, {R('stddev_samp(CAST(fcs AS DOUBLE))', 3)} AS sd_fcs FROM v_households GROUP BY 1, 2""",
        "v_households",
    ),
)
def p20(spark, sf):
    score = F.col("fcs").cast("double")
    table = V.households(spark, sf).groupBy("modality", "adm1_name").agg(
        F.avg(score).alias("mean_fcs"), F.stddev_samp(score).alias("sd_fcs")
    )
    method = Rc.rename_values(F.col("modality"), {"rtm": "phone", "f2f": "face-to-face"})
    return C.round_numeric(table.select(method.alias("method"), "adm1_name", "mean_fcs", "sd_fcs"), 3)


@query(
    "p21_source_flag",
    with_views("SELECT household_id, CAST(sample_source = 'RDD' AS INT) AS rdd_flag FROM v_households", "v_households"),
)
def p21(spark, sf):
    return V.households(spark, sf).select("household_id", (F.col("sample_source") == "RDD").cast("int").alias("rdd_flag"))


# -------------------------------------------------------------------- joins
@query(
    "j1_left_one_key",
    with_views("SELECT household_id, respondent_id, p_cell FROM v_households LEFT JOIN v_scores USING (respondent_id)", "v_households", "v_scores"),
)
def j1(spark, sf):
    joined = J.left_join(V.households(spark, sf), V.cell_scores(spark, sf), ["respondent_id"])
    return joined.select("household_id", "respondent_id", "p_cell")


@query(
    "j2_left_natural_null_safe",
    with_views(
        f"""SELECT h.household_id, h.hhh_edu, c.n, {R('c.mean_size')} AS mean_size FROM v_households h LEFT JOIN
        (SELECT adm1_name, hhh_edu, CAST(count(*) AS BIGINT) AS n, avg(CAST(hh_size AS DOUBLE)) AS mean_size FROM v_households GROUP BY 1, 2) c
        ON h.adm1_name = c.adm1_name AND h.hhh_edu IS NOT DISTINCT FROM c.hhh_edu""",
        "v_households",
    ),
)
def j2(spark, sf):
    h = V.households(spark, sf).select("household_id", "adm1_name", "hhh_edu", "hh_size")
    cells = h.groupBy("adm1_name", "hhh_edu").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hh_size").cast("double")).alias("mean_size")
    )
    joined = J.natural_left_join(h.drop("hh_size"), cells, null_safe=["hhh_edu"])
    return rounded(joined.select("household_id", "hhh_edu", "n", "mean_size"))


@query(
    "j3_full_outer",
    with_views(
        """SELECT adm2_name, obs_month, a.n_phone, b.n_face FROM
        (SELECT adm2_name, obs_month, CAST(count(*) AS BIGINT) AS n_phone FROM v_households WHERE modality = 'rtm' GROUP BY 1, 2) a FULL JOIN
        (SELECT adm2_name, obs_month, CAST(count(*) AS BIGINT) AS n_face FROM v_households WHERE modality = 'f2f' GROUP BY 1, 2) b USING (adm2_name, obs_month)""",
        "v_households",
    ),
)
def j3(spark, sf):
    h = V.households(spark, sf)
    count = lambda mode, name: h.where(F.col("modality") == mode).groupBy("adm2_name", "obs_month").agg(
        F.count(F.lit(1)).alias(name)
    )
    return count("rtm", "n_phone").join(count("f2f", "n_face"), ["adm2_name", "obs_month"], "full")


@query(
    "j4_join_fan_out",
    with_views("SELECT respondent_id, CAST(count(*) AS BIGINT) AS n_dup FROM v_households GROUP BY 1 HAVING count(*) > 1", "v_households"),
)
def j4(spark, sf):
    return J.duplicate_keys(V.households(spark, sf), "respondent_id")


@query(
    "j5_area_level_grid",
    with_views(
        """SELECT a.adm2_name, l.var, l.level FROM (SELECT DISTINCT adm2_name FROM v_households) a CROSS JOIN
        (SELECT DISTINCT 'hhh_edu' AS var, hhh_edu AS level FROM v_households UNION SELECT DISTINCT 'hhh_sex', hhh_sex FROM v_households) l""",
        "v_households",
    ),
)
def j5(spark, sf):
    h = V.households(spark, sf)
    present = A.stacked_groups(h.select("adm2_name", "hhh_edu", "hhh_sex"), ["hhh_edu", "hhh_sex"], ["adm2_name"], n=F.count(F.lit(1)))
    return J.level_grid(h, "adm2_name", present)


@query(
    "j6_replicate_months",
    with_views(
        """SELECT c.adm2_name, c.hhh_sex, c.n, m.obs_month FROM (SELECT adm2_name, hhh_sex, CAST(count(*) AS BIGINT) AS n FROM v_households GROUP BY 1, 2) c
        CROSS JOIN (SELECT DISTINCT obs_month FROM v_households) m""",
        "v_households",
    ),
)
def j6(spark, sf):
    h = V.households(spark, sf)
    cells = h.groupBy("adm2_name", "hhh_sex").agg(F.count(F.lit(1)).alias("n"))
    return J.replicate_over(cells, h, "obs_month")


@query(
    "j9_unmatched_names",
    with_views(
        """SELECT adm2_name, 'survey' AS side FROM (SELECT DISTINCT adm2_name FROM v_households) WHERE adm2_name NOT IN (SELECT adm2 FROM census)
        UNION ALL SELECT adm2, 'census' FROM census WHERE adm2 NOT IN (SELECT adm2_name FROM v_households)""",
        "v_households",
        census="SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN upper(concat(n_name, ' rural')) ELSE n_name END AS adm2 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
    ),
)
def j9(spark, sf):
    survey = V.households(spark, sf).select("adm2_name")
    nation = V.table(spark, sf, "nation")
    spelled = F.when(F.col("n_nationkey") % 5 == 0, F.upper(F.concat("n_name", F.lit(" rural")))).otherwise(F.col("n_name"))
    census = V.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        spelled.alias("adm2_name")
    )
    return J.unmatched(survey, census, "adm2_name", "survey", "census")


@query(
    "j9_matched_names",
    with_views(
        """SELECT adm2_name_svy AS adm2_name, total_households AS freq, adm1_name FROM v_matched""",
        "v_matched",
    ),
)
def j9_matched(spark, sf):
    matched = V.matched_names(spark, sf)
    census = matched.select("adm1_name", F.col("adm2_cen").alias("adm2_name"), F.col("total_households").alias("freq"))
    return J.apply_matched_names(census, matched, "adm2_name", "adm2_cen", "adm2_name_svy")


# --------------------------------------------------------------- aggregates
@query(
    "a1_contingency",
    with_views("SELECT hhh_edu, h_water_source, CAST(count(*) AS BIGINT) AS n FROM v_households GROUP BY 1, 2", "v_households"),
)
def a1(spark, sf):
    return V.households(spark, sf).groupBy("hhh_edu", "h_water_source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a2_sum_per_key",
    with_views(
        f"SELECT hh_size_bucket, {R('sum(weight_hh)', 6)} AS weight_hh FROM (SELECT {SIZE_SQL.format('HH48')} AS hh_size_bucket, hhweight AS weight_hh FROM v_mics_households) GROUP BY 1",
        "v_mics_households",
    ),
)
def a2(spark, sf):
    homes = Mi.mics_homes(V.mics_household_file(spark, sf), V.labels(spark, sf))
    return rounded(homes.groupBy("hh_size_bucket").agg(F.sum("weight_hh").alias("weight_hh")), 6)


@query(
    "a3_census_district_means",
    with_views(
        f"""SELECT districts AS adm2_name, {R('sum(total_households * average_household_size) / sum(total_households)')} AS average_household_size,
        {R('sum(total_households)')} AS total_households, {R('sum(total_population)')} AS total_population FROM v_census_sheet WHERE ward <> 'Total' GROUP BY 1""",
        "v_census_sheet",
    ),
)
def a3(spark, sf):
    return rounded(Mi.census_districts(V.census_sheet(spark, sf)))


@query(
    "a4_error_by_province",
    with_views(
        f"""SELECT adm1_name, {R('a')} AS act_raw, {R('e')} AS est_raw, {R('aw')} AS act_w, {R('ew')} AS est_w, {R('e - a')} AS pred_error_raw, {R('ew - aw')} AS pred_error_w
        FROM (SELECT adm1_name, avg(cell) AS a, avg(p_cell) AS e, sum(cell * w) / sum(w) AS aw, sum(p_cell * w) / sum(w) AS ew FROM
          (SELECT adm1_name, CASE WHEN h_cell = 'yes' THEN CAST(1 AS DOUBLE) ELSE 0 END AS cell, CAST(hh_size AS DOUBLE) AS w, p_cell FROM v_households JOIN v_scores USING (respondent_id)) GROUP BY 1)""",
        "v_households",
        "v_scores",
    ),
)
def a4(spark, sf):
    h = J.left_join(V.households(spark, sf), V.cell_scores(spark, sf), ["respondent_id"]).withColumns(
        {"cell": Rc.yes_flag(F.col("h_cell")).cast("double"), "w": F.col("hh_size").cast("double")}
    )
    return rounded(A.error_by_group(h, "adm1_name", "cell", "p_cell", "w"))


@query(
    "a6_weighted_share",
    with_views(
        f"""SELECT adm1_name, {R('sum(CASE WHEN fcs IS NOT NULL THEN w * poor END) / sum(CASE WHEN fcs IS NOT NULL THEN w END)')} AS share, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT adm1_name, fcs, CASE WHEN fcs < 28 THEN CAST(1 AS DOUBLE) ELSE 0 END AS poor, CAST(hh_size AS DOUBLE) AS w FROM v_households) GROUP BY 1""",
        "v_households",
    ),
)
def a6(spark, sf):
    h = V.households(spark, sf)
    share = N.weighted_mean(Rc.poor_flag(F.col("fcs")).cast("double"), F.col("hh_size").cast("double"))
    return rounded(h.groupBy("adm1_name").agg(share.alias("share"), F.count(F.lit(1)).alias("n")))


@query(
    "a7_design_effect",
    with_views(
        f"""SELECT hhh_edu, {R('1 + var_samp(w)')} AS deff, {R('avg(w)')} AS avg_weight, {R('sum(w)', 6)} AS poll FROM
        (SELECT hhh_edu, CAST(hh_size AS DOUBLE) / 5 AS w FROM v_households) GROUP BY 1""",
        "v_households",
    ),
)
def a7(spark, sf):
    w = F.col("hh_size").cast("double") / 5
    grouped = V.households(spark, sf).groupBy("hhh_edu").agg(
        r(1 + F.var_samp(w)).alias("deff"), r(F.avg(w)).alias("avg_weight"), r(F.sum(w), 6).alias("poll")
    )
    return grouped


@query(
    "a8_prefixed_means",
    with_views(
        f"""SELECT adm1_name, {R('avg(CAST(fcs AS DOUBLE))')} AS m_fcs, {R('avg(CAST(hh_size AS DOUBLE))')} AS m_size FROM v_households GROUP BY 1""",
        "v_households",
    ),
)
def a8(spark, sf):
    h = V.households(spark, sf).select("adm1_name", F.col("fcs").alias("m_fcs"), F.col("hh_size").alias("m_size"), "hhh_sex")
    return rounded(A.prefixed_means(h, ["adm1_name"], ["m_"]))


@query(
    "a9_distinct",
    with_views(
        """SELECT adm1_name, CAST(count(DISTINCT adm2_name) AS BIGINT) AS n_adm2, CAST(count(DISTINCT obs_month) AS BIGINT) AS n_months,
        CAST(count(DISTINCT concat(adm2_name, CAST(obs_month AS VARCHAR), coalesce(hhh_edu, ''))) AS BIGINT) AS n_rows FROM v_households GROUP BY 1""",
        "v_households",
    ),
)
def a9(spark, sf):
    h = V.households(spark, sf).select("adm1_name", "adm2_name", "obs_month", "hhh_edu").distinct()
    return h.groupBy("adm1_name").agg(
        F.countDistinct("adm2_name").alias("n_adm2"),
        F.countDistinct("obs_month").alias("n_months"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query("a10_unpivot", with_views(f"SELECT adm1_name, hhh_edu, {R('prop_pop')} AS prop_pop FROM v_pop_shares", "v_pop_shares"))
def a10(spark, sf):
    return rounded(Wt.population_shares(V.population_sheet(spark, sf)))


@query(
    "a11_exact_quantiles",
    with_views(
        f"""SELECT adm2_name, {R('quantile_cont(x, 0.025)')} AS q025, {R('quantile_cont(x, 0.5)')} AS q500, {R('quantile_cont(x, 0.975)')} AS q975
        FROM (SELECT adm2_name, CAST(o_totalprice AS DOUBLE) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT n_nationkey, n_name AS adm2_name FROM nation) ON c_nationkey = n_nationkey) GROUP BY 1""",
    ).removeprefix("WITH  "),
)
def a11(spark, sf):
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = cut_lineage(o.groupBy(F.col("n_name").alias("adm2_name"), "o_totalprice").agg(F.count(F.lit(1)).alias("n")))
    q = A.global_quantiles(counted, "o_totalprice", "n", [0.025, 0.5, 0.975], ["adm2_name"])
    return q.select("adm2_name", *[r(F.col("q")[k]).alias(n) for k, n in enumerate(["q025", "q500", "q975"])])


STACK_SQL = " UNION ALL ".join(
    f"SELECT adm1_name, '{v}' AS var, {v} AS level, CAST(count(*) AS BIGINT) AS n, sum(CAST(hh_size AS BIGINT)) AS people FROM v_households GROUP BY 1, 3"
    for v in ("hhh_edu", "hhh_sex", "h_water_source", "h_cell")
)


@query("a12_stacked_groups", with_views(f"SELECT adm1_name, var, level, n, CAST(people AS BIGINT) AS people FROM ({STACK_SQL})", "v_households"))
def a12(spark, sf):
    variables = ["hhh_edu", "hhh_sex", "h_water_source", "h_cell"]
    h = V.households(spark, sf).select("adm1_name", "hh_size", *variables)
    return A.stacked_groups(h, variables, ["adm1_name"], n=F.count(F.lit(1)), people=F.sum("hh_size"))


@query(
    "a14_score_histogram",
    with_views(
        "SELECT CAST(least(floor(p_cell * 20), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM v_households JOIN v_scores USING (respondent_id) GROUP BY 1",
        "v_households",
        "v_scores",
    ),
)
def a14(spark, sf):
    return A.score_histogram(J.left_join(V.households(spark, sf), V.cell_scores(spark, sf), ["respondent_id"]), "p_cell", 20)


# ------------------------------------------------------------------ windows
@query(
    "w1_share_of_total",
    with_views(
        f"""SELECT adm1_name, hhh_edu, {R('n / sum(n) OVER ()')} AS share_all, {R('n / sum(n) OVER (PARTITION BY adm1_name)')} AS share_in_group
        FROM (SELECT adm1_name, hhh_edu, CAST(count(*) AS DOUBLE) AS n FROM v_households GROUP BY 1, 2)""",
        "v_households",
    ),
)
def w1(spark, sf):
    counts = V.households(spark, sf).groupBy("adm1_name", "hhh_edu").agg(F.count(F.lit(1)).cast("double").alias("n"))
    shared = A.share_of_total(A.share_of_total(counts, "n", "share_all"), "n", "share_in_group", by=["adm1_name"])
    return rounded(shared.drop("n"))


@query(
    "w3_dense_index",
    with_views(
        """SELECT household_id, CAST(dense_rank() OVER (ORDER BY obs_month) AS INT) AS month_idx, CAST(dense_rank() OVER (ORDER BY obs_week) AS INT) AS week_idx,
        CAST(dense_rank() OVER (ORDER BY adm1_name) AS INT) AS adm1_index, CAST(dense_rank() OVER (ORDER BY adm2_name) AS INT) AS adm2_index FROM v_households""",
        "v_households",
    ),
)
def w3(spark, sf):
    h = V.households(spark, sf).select("household_id", "obs_month", "obs_week", "adm1_name", "adm2_name")
    indexed = h
    for column, name in (
        ("obs_month", "month_idx"),
        ("obs_week", "week_idx"),
        ("adm1_name", "adm1_index"),
        ("adm2_name", "adm2_index"),
    ):
        indexed = indexed.join(A.dense_index(h, column, name), column, "left")
    return indexed.select("household_id", "month_idx", "week_idx", "adm1_index", "adm2_index")


@query(
    "w4_average_rank",
    with_views(
        f"SELECT household_id, {R('rank() OVER (PARTITION BY adm1_name ORDER BY fcs) + (count(*) OVER (PARTITION BY adm1_name, fcs) - 1) / 2.0')} AS rank_avg FROM v_households WHERE fcs IS NOT NULL",
        "v_households",
    ),
)
def w4(spark, sf):
    h = V.households(spark, sf).where(F.col("fcs").isNotNull()).select("household_id", "adm1_name", "fcs")
    return rounded(A.average_ranks(h, ["adm1_name"], "fcs", "rank_avg").select("household_id", "rank_avg"))


@query(
    "w5_previous_period_difference",
    with_views(
        f"""SELECT adm2_name, obs_month, {R('m - lag(m) OVER (PARTITION BY adm2_name ORDER BY obs_month)')} AS step FROM
        (SELECT adm2_name, obs_month, avg(CAST(fcs AS DOUBLE)) AS m FROM v_households GROUP BY 1, 2)""",
        "v_households",
    ),
)
def w5(spark, sf):
    monthly = V.households(spark, sf).groupBy("adm2_name", "obs_month").agg(F.avg(F.col("fcs").cast("double")).alias("m"))
    previous = F.lag("m").over(Window.partitionBy("adm2_name").orderBy("obs_month"))
    return rounded(monthly.select("adm2_name", "obs_month", (F.col("m") - previous).alias("step")))


@query(
    "w6_group_size_beside_detail",
    with_views(
        f"""SELECT obs_month, adm1_name, hhh_edu, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY obs_month, adm1_name) AS BIGINT) AS n_group,
        {R('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY obs_month, adm1_name)')} AS prop FROM v_households GROUP BY 1, 2, 3""",
        "v_households",
    ),
)
def w6(spark, sf):
    cells = V.households(spark, sf).groupBy("obs_month", "adm1_name", "hhh_edu").agg(F.count(F.lit(1)).alias("n"))
    group = F.sum("n").over(Window.partitionBy("obs_month", "adm1_name"))
    return rounded(cells.withColumn("n_group", group).withColumn("prop", F.col("n") / F.col("n_group")))


# ------------------------------------------------------- sort, top-k, union
@query(
    "o1_order_by_expression",
    with_views(
        f"""SELECT adm2_name, hhh_sex, {R('d')} AS diff, CAST(row_number() OVER (ORDER BY -abs({R('d')}), adm2_name, hhh_sex) AS INT) AS pos FROM
        (SELECT adm2_name, hhh_sex, avg(CAST(fcs AS DOUBLE)) - 50 AS d FROM v_households GROUP BY 1, 2)""",
        "v_households",
    ),
)
def o1(spark, sf):
    table = V.households(spark, sf).groupBy("adm2_name", "hhh_sex").agg(r(F.avg(F.col("fcs").cast("double")) - 50).alias("diff"))
    order = [-F.abs(F.col("diff")), F.col("adm2_name"), F.col("hhh_sex")]
    # districts x sexes rows: the position is only shown so that the order can be compared
    return table.withColumn("pos", F.row_number().over(Window.orderBy(*order))).orderBy("pos")


@query(
    "o2_level_order",
    with_views(
        """SELECT hhh_edu, CASE hhh_edu WHEN 'preprimary/other' THEN 1 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 WHEN 'higher' THEN 4 END AS ord, CAST(count(*) AS BIGINT) AS n
        FROM v_households GROUP BY 1 ORDER BY 2""",
        "v_households",
    ),
)
def o2(spark, sf):
    counts = V.households(spark, sf).groupBy("hhh_edu").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ord", Rc.level_order(F.col("hhh_edu"), Rc.EDUCATION_LEVELS)).orderBy("ord")


@query(
    "o3_top_rows",
    with_views("SELECT respondent_id, CAST(count(*) AS BIGINT) AS n FROM v_households GROUP BY 1 ORDER BY n DESC, respondent_id LIMIT 100", "v_households"),
)
def o3(spark, sf):
    counts = V.households(spark, sf).groupBy("respondent_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "respondent_id").limit(100)


@query(
    "u1_union_by_name",
    with_views(
        """SELECT household_id, adm2_name, fcs, sample_source, NULL AS h_cell FROM v_households WHERE modality = 'rtm'
        UNION ALL SELECT household_id, adm2_name, fcs, NULL, h_cell FROM v_households WHERE modality = 'f2f'""",
        "v_households",
    ),
)
def u1(spark, sf):
    h = V.households(spark, sf)
    phone = h.where(F.col("modality") == "rtm").select("household_id", "adm2_name", "fcs", "sample_source")
    face = h.where(F.col("modality") == "f2f").select("household_id", "adm2_name", "fcs", "h_cell")
    return J.union_by_name(phone, face)


# ------------------------------------------------------------------ scalars
@query(
    "c1_title_case",
    with_views(
        f"SELECT hhid, hv101, lower(adm1_name) AS low, {TITLE('adm1_name')} AS title, {TITLE('concat(adm1_name, chr(32), adm2_name)')} AS both_names FROM v_dhs_persons",
        "v_dhs_persons",
    ),
)
def c1(spark, sf):
    p = V.dhs_persons(spark, sf)
    return p.select(
        "hhid",
        "hv101",
        F.lower("adm1_name").alias("low"),
        X.title_case(F.col("adm1_name")).alias("title"),
        X.title_case(F.concat_ws(" ", "adm1_name", "adm2_name")).alias("both_names"),
    )


@query(
    "c2_regex_replace",
    with_views("SELECT districts, ward, regexp_replace(ward, 'Ward ', '', 'g') AS ward_no FROM v_census_sheet", "v_census_sheet"),
)
def c2(spark, sf):
    sheet = C.rename_by_function(V.census_sheet(spark, sf), C.snake_case)
    return sheet.select("districts", "ward", F.regexp_replace("ward", "Ward ", "").alias("ward_no"))


@query(
    "c3_concat_na",
    with_views("SELECT household_id, concat(coalesce(sample_source, 'NA'), ' ', modality) AS type_model FROM v_households", "v_households"),
)
def c3(spark, sf):
    return V.households(spark, sf).select(
        "household_id", F.concat_ws(" ", N.text_or_na(F.col("sample_source")), N.text_or_na(F.col("modality"))).alias("type_model")
    )


@query(
    "c5_dates",
    with_views(
        """SELECT household_id, obs_month, strftime(obs_month, '%B %Y') AS label, obs_month IN (DATE '1997-05-01', DATE '1998-05-01') AS of_interest,
        CASE WHEN obs_month = DATE '1997-05-01' THEN 'first' ELSE 'second' END AS which FROM v_households""",
        "v_households",
    ),
)
def c5(spark, sf):
    stamp = F.to_date(F.date_format("obs_date", "yyyy-MM-01"), "yyyy-MM-dd")
    months = [F.lit(d).cast("date") for d in ("1997-05-01", "1998-05-01")]
    return V.households(spark, sf).select(
        "household_id",
        stamp.alias("obs_month"),
        X.month_label(stamp).alias("label"),
        stamp.isin(*months).alias("of_interest"),
        F.when(stamp == months[0], "first").otherwise("second").alias("which"),
    )


@query(
    "c7_arithmetic",
    with_views(
        f"""SELECT household_id, {R('sqrt(x)')} AS root, {R('abs(x - 50)')} AS gap, {R('exp(x / 50)')} AS ex, {R('ln(x + 1)')} AS lg, {R('power(x / 10, 2)')} AS sq, {R('x / 7', 3)} AS r3
        FROM (SELECT household_id, CAST(fcs AS DOUBLE) AS x FROM v_households)""",
        "v_households",
    ),
)
def c7(spark, sf):
    x = F.col("fcs").cast("double")
    return V.households(spark, sf).select(
        "household_id",
        r(F.sqrt(x)).alias("root"),
        r(F.abs(x - 50)).alias("gap"),
        r(F.exp(x / 50)).alias("ex"),
        r(F.log(x + 1)).alias("lg"),
        r(F.pow(x / 10, F.lit(2))).alias("sq"),
        r(x / 7, 3).alias("r3"),
    )


@query(
    "c8_row_max_min",
    with_views(
        """SELECT household_id, CASE WHEN fcs IS NOT NULL THEN greatest(fcs, hh_size * 10) END AS hi, CASE WHEN fcs IS NOT NULL THEN least(fcs, hh_size * 10) END AS lo FROM v_households""",
        "v_households",
    ),
)
def c8(spark, sf):
    a, b = F.col("fcs"), F.col("hh_size") * 10
    return V.households(spark, sf).select("household_id", N.strict_greatest(a, b).alias("hi"), N.strict_least(a, b).alias("lo"))


@query(
    "c10_logistic",
    with_views(
        f"""SELECT household_id, {R('1 / (1 + exp(-x))')} AS p, {R('y * x - (greatest(x, 0) + ln(1 + exp(-abs(x))))')} AS log_mass
        FROM (SELECT household_id, CAST(fcs AS DOUBLE) / 10 - 5 AS x, CASE WHEN h_cell = 'yes' THEN 1 ELSE 0 END AS y FROM v_households)""",
        "v_households",
    ),
)
def c10(spark, sf):
    x = F.col("fcs").cast("double") / 10 - 5
    y = Rc.yes_flag(F.col("h_cell")).cast("double")
    return V.households(spark, sf).select(
        "household_id", r(X.logistic(x)).alias("p"), r(X.bernoulli_logit_log_mass(y, F.lit(1.0), x)).alias("log_mass")
    )


@query(
    "c11_log_densities",
    with_views(
        f"""SELECT household_id, {R('-0.5 * power((x - 1) / 2.5, 2) - ln(2.5) - 0.5 * ln(2 * pi())')} AS log_normal,
        {R('-ln(pi()) - ln(1 + x * x)')} AS log_cauchy, {R('-ln(2) - 1.5 * ln(t) + ln(-ln(0.01)) + ln(0.01) / sqrt(t)')} AS log_pc
        FROM (SELECT household_id, CAST(fcs AS DOUBLE) / 10 - 5 AS x, CAST(hh_size AS DOUBLE) AS t FROM v_households)""",
        "v_households",
    ),
)
def c11(spark, sf):
    x = F.col("fcs").cast("double") / 10 - 5
    return V.households(spark, sf).select(
        "household_id",
        r(X.normal_log_density(x, 1.0, 2.5)).alias("log_normal"),
        r(X.cauchy_log_density(x)).alias("log_cauchy"),
        r(X.pc_precision_log_density(F.col("hh_size").cast("double"))).alias("log_pc"),
    )


@query(
    "c12_keyed_bernoulli",
    with_views(
        f"""SELECT household_id, {R('u')} AS u, CAST(u < p_cell AS INT) AS y FROM
        {UNIFORM_SQL('(SELECT household_id, respondent_id, p_cell FROM v_households JOIN v_scores USING (respondent_id))', ['household_id', 'respondent_id'], 'u')}""",
        "v_households",
        "v_scores",
    ),
)
def c12(spark, sf):
    scored = J.left_join(V.households(spark, sf), V.cell_scores(spark, sf), ["respondent_id"])
    drawn = scored.select(
        "household_id", "p_cell", X.keyed_uniform([F.col("household_id"), F.col("respondent_id")]).alias("u")
    )
    return drawn.select("household_id", r("u").alias("u"), (F.col("u") < F.col("p_cell")).cast("int").alias("y"))


@query(
    "c13_null_rules",
    with_views(
        """SELECT household_id, CASE WHEN fcs IS NULL THEN NULL WHEN fcs < 28 THEN 'poor' ELSE 'not poor' END AS if_else,
        CASE WHEN fcs < 28 THEN 'poor' WHEN TRUE THEN 'rest' END AS first_match, coalesce(sample_source IN ('RDD', 'GeoPoll'), FALSE) AS member,
        NOT coalesce(sample_source IN ('RDD'), FALSE) AS not_member, fcs IS NULL AS missing FROM v_households""",
        "v_households",
    ),
)
def c13(spark, sf):
    poor, source = F.col("fcs") < 28, F.col("sample_source")
    return V.households(spark, sf).select(
        "household_id",
        N.if_else(poor, F.lit("poor"), F.lit("not poor")).alias("if_else"),
        F.when(poor, "poor").otherwise("rest").alias("first_match"),
        N.member(source, ["RDD", "GeoPoll"]).alias("member"),
        (~N.member(source, ["RDD"])).alias("not_member"),
        F.col("fcs").isNull().alias("missing"),
    )


@query(
    "c9_p19_p4_interval_columns",
    with_views(
        f"""SELECT adm2_name, {R('e')} AS y_est, {R('e - 1.2815515655446004 * s')} AS wald_low80, {R('e + 1.2815515655446004 * s')} AS wald_high80,
        {R('e - 1.6448536269514722 * s')} AS wald_low90, {R('e + 1.6448536269514722 * s')} AS wald_high90,
        {R('e - 1.959963984540054 * s')} AS wald_low95, {R('e + 1.959963984540054 * s')} AS wald_high95 FROM
        (SELECT adm2_name, avg(p) AS e, sqrt(avg(p) * (1 - avg(p)) / count(*)) AS s FROM (SELECT adm2_name, CASE WHEN fcs < 28 THEN CAST(1 AS DOUBLE) WHEN fcs >= 28 THEN 0 END AS p FROM v_households) GROUP BY 1)""",
        "v_households",
    ),
)
def c9(spark, sf):
    p = Rc.poor_flag(F.col("fcs")).cast("double")
    table = V.households(spark, sf).groupBy("adm2_name").agg(F.avg(p).alias("y_est"), F.count(F.lit(1)).alias("n"))
    table = table.withColumn("se", F.sqrt(F.col("y_est") * (1 - F.col("y_est")) / F.col("n")))
    wide = interval_columns(table, "y_est", "se", "n")
    kept = keep_interval(wide, "wald", drop=["se", "n"])
    names = {n: f"wald_{n}" for n in kept.columns if n.startswith(("low", "high"))}
    return rounded(kept.withColumnsRenamed(names))

"""Draw summaries, ownership model checks, validation metrics, plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosarea.functions import recode as Rc
from mosarea.operators import aggregates as A, design as De, draws as Dr, glm, hierarchical as H, intervals as I, joins as J, logposterior as Lp
from mosarea.operators import plotdata as Pl, predict as Pr, validation as Va
from mosarea.plans import views as V
from mosarea.plans.catalog_frame import (
    DIRECT_SQL,
    FACE_SQL,
    FRAME_CTE,
    MICS_SQL,
    NEIGHBOURS_SQL,
    PHONE_ROWS_SQL,
    WEIGHTS_SQL,
    Z,
    face_direct,
    mics_table,
    phone_wilson,
    wilson_sql,
)
from mosarea.plans.catalog_model import (
    D_VIEWS,
    MODEL_CTE,
    N_JOINT,
    N_PHONE,
    PATTERNS_SQL,
    PHONE_INTERVIEWS,
    RANKED_SQL,
    SWITCHED_SQL,
    Study,
    cell_design_sql,
    eta_sql,
    prevalence_sql,
    units_sql,
)
from mosarea.plans.registry import R, query, r, rounded
from mosarea.plans.views import TITLE, with_views
from mosarea.session import cut_lineage
from mosarea.sources.tables import local_table, settle_dimension

QUANTILES = [p for level in I.COVERAGE_LEVELS for p in I.tail_probabilities(level)]
BOUNDS = [f"{side}{I.level_tag(level)}" for level in I.COVERAGE_LEVELS for side in ("low", "high")]


def summary_sql(prevalence: str, value: str = "prev2", rounding: bool = True) -> str:
    wrap = (lambda t: R(t, 6)) if rounding else (lambda t: t)
    bounds = ", ".join(f"{wrap(f'quantile_cont({value}, {p!r})')} AS {n}" for p, n in zip(QUANTILES, BOUNDS))
    return f"""SELECT {TITLE('pl.adm1_name')} AS adm1_name, pl.adm2_name, m.obs_month, {wrap(f'avg({value})')} AS y_est, {bounds} FROM ({prevalence}) q
      JOIN months m ON m.month_idx = q.month_idx JOIN places pl ON pl.adm2_index = q.adm2_index GROUP BY 1, 2, 3"""


def summarise(st: Study, prevalence, value="prev2"):
    named = I.attach_names(I.summarise_draws(prevalence, value), st.months, st.regions)
    return named.withColumn("adm1_name", F.initcap("adm1_name"))


def mr_phone_only(st):
    return Pr.mr_estimate_blocks(st.scoring_rows("phone_only"), st.posterior(), N_PHONE, st.regions)


MR_UNITS = units_sql(PHONE_INTERVIEWS.format("phone_only"), N_PHONE)


@query(
    "i1_summarise_draws",
    with_views(summary_sql(prevalence_sql("units")), *D_VIEWS, **MODEL_CTE, units=MR_UNITS),
)
def i1(spark, sf):
    st = Study(spark, sf)
    return rounded(summarise(st, mr_phone_only(st)), 6)


# ------------------------------------------------------ estimators side by side
VALIDATION_MONTHS = ("1997-05-01", "1998-05-01")


def seven_estimators(st):
    """Direct, regression and post-stratified estimates of the validation months; no other month is scored.

    The draws are packed once for all models, and each scored estimate, districts x months rows, is written as a job
    of its own: one plan of all of them would fill the driver, whatever the number of rows.
    """
    months = settle_dimension(Va.validation_months(st.months, VALIDATION_MONTHS))
    draws = Pr.settle_draws(st.posterior(), N_JOINT, st.regions, months=months)

    def mr(rows, n):
        rows = rows.join(months.select("month_idx"), "month_idx", "left_semi")
        return cut_lineage(summarise(st, Pr.mr_estimate_blocks(rows, draws, n, st.regions)))

    def mrp(source, mode, n):
        return cut_lineage(summarise(st, Pr.mrp_estimate_blocks(st.frame_rows(source, mode), draws, n, st.regions)))

    return {
        ("Direct (mobile-phone)", ""): Va.validation_months(phone_wilson(st.spark, st.sf), VALIDATION_MONTHS),
        ("MR", "mobile-phone-only"): mr(st.scoring_rows("phone_only"), N_PHONE),
        ("MRP (dhs)", "mobile-phone-only"): mrp("dhs", "phone_only", N_PHONE),
        ("MR-modalityPhone", "joint"): mr(st.scoring_rows(), N_JOINT),
        ("MR-modalityF2F", "joint"): mr(st.counterfactual_rows(), N_JOINT),
        ("MRP (dhs)", "joint"): mrp("dhs", "joint", N_JOINT),
        ("MRP (f2f)", "joint"): mrp("f2f", "joint", N_JOINT),
    }


def truth_table(spark, sf):
    wide = I.interval_columns(face_direct(spark, sf), "f2f_est", "f2f_est_se", "n", prefix="f2f_")
    return I.keep_interval(wide, "wilson", drop=["n", "f2f_est_se"], prefix="f2f_")


def _wilson_plain(p: str, n: str, prefix: str) -> str:
    """Wilson columns without rounding."""
    return ", ".join(f"{wilson_sql(p, n, z, side)} AS {prefix}{side}{tag}" for tag, z in Z.items() for side in ("low", "high"))


EST_COLUMNS = f"adm1_name, adm2_name, obs_month, y_est, {', '.join(BOUNDS)}"
MONTHS_SQL = "(DATE '1997-05-01', DATE '1998-05-01')"
SEVEN = {
    ("Direct (mobile-phone)", ""): "est_direct",
    ("MR", "mobile-phone-only"): "est_mr",
    ("MRP (dhs)", "mobile-phone-only"): "est_mrp",
    ("MR-modalityPhone", "joint"): "est_mrj",
    ("MR-modalityF2F", "joint"): "est_cf",
    ("MRP (dhs)", "joint"): "est_mrpj",
    ("MRP (f2f)", "joint"): "est_mrpf",
}
STACKED_SQL = " UNION ALL ".join(
    f"SELECT {EST_COLUMNS}, '{kind}' AS type, '{model}' AS model, '{kind} {model}' AS type_model FROM {table} WHERE obs_month IN {MONTHS_SQL}"
    for (kind, model), table in SEVEN.items()
)
IN_MONTHS = f"WHERE month_idx IN (SELECT month_idx FROM months WHERE obs_month IN {MONTHS_SQL})"


def _seven_sql() -> dict[str, str]:
    """Units and estimates of the models that the first three do not cover."""
    ctes = {**FRAME_CTE, "mrj_units": units_sql(PHONE_INTERVIEWS.format("joint"), N_JOINT)}
    ctes["est_mrj"] = summary_sql(prevalence_sql("mrj_units"), rounding=False)
    for name, source, mode, n in (("mrp", "dhs", "phone_only", N_PHONE), ("mrpj", "dhs", "joint", N_JOINT), ("mrpf", "f2f", "joint", N_JOINT)):
        ctes[f"{name}_cells"] = f"SELECT * FROM ({cell_design_sql(source, mode)}) {IN_MONTHS}"
        ctes[f"{name}_units"] = units_sql(f"{name}_cells", n)
        ctes[f"est_{name}"] = summary_sql(prevalence_sql(f"{name}_units", "pop_weight", "cell_key"), rounding=False)
    return ctes


SEVEN_CTE = _seven_sql()
VALID_VIEWS = ("v_households", "v_scores", "v_pop_shares", "v_frame_src", "v_matched")
VALID_CTE = {
    **MODEL_CTE,
    "weights": WEIGHTS_SQL,
    "phone": PHONE_ROWS_SQL,
    "direct": DIRECT_SQL,
    "face": FACE_SQL,
    "truth": f"SELECT adm1_name, adm2_name, obs_month, f2f_est, {_wilson_plain('f2f_est', 'n', 'f2f_')} FROM face",
    "mr_units": MR_UNITS,
    "cf_units": units_sql(SWITCHED_SQL, N_JOINT),
    "est_direct": f"SELECT adm1_name, adm2_name, obs_month, y_est, {_wilson_plain('y_est', 'n_w', '')} FROM direct",
    "est_mr": summary_sql(prevalence_sql("mr_units"), rounding=False),
    "est_cf": summary_sql(prevalence_sql("cf_units"), rounding=False),
    **SEVEN_CTE,
    "stacked": STACKED_SQL,
    "combined": "SELECT s.*, t.* EXCLUDE (adm1_name, adm2_name, obs_month) FROM stacked s LEFT JOIN truth t ON t.adm1_name = s.adm1_name AND t.adm2_name = s.adm2_name AND t.obs_month = s.obs_month",
    "compared": "SELECT *, y_est - f2f_est AS bias, abs(y_est - f2f_est) AS abserror, power(y_est - f2f_est, 2) AS sqerror, "
    + ", ".join(
        f"high{t} - low{t} AS ci_length{t}, CASE WHEN f2f_low{t} IS NULL OR low{t} IS NULL THEN NULL WHEN greatest(f2f_high{t}, high{t}) - least(f2f_low{t}, low{t}) < (f2f_high{t} - f2f_low{t}) + (high{t} - low{t}) THEN 1 ELSE 0 END AS coverage{t}"
        for t in ("80", "90", "95")
    )
    + " FROM combined",
    "ranked": """SELECT *, CASE WHEN y_est IS NOT NULL THEN rank() OVER (PARTITION BY type_model, obs_month ORDER BY ky) + (count(*) OVER (PARTITION BY type_model, obs_month, ky) - 1) / 2.0 END AS ry,
      CASE WHEN f2f_est IS NOT NULL THEN rank() OVER (PARTITION BY type_model, obs_month ORDER BY kt) + (count(*) OVER (PARTITION BY type_model, obs_month, kt) - 1) / 2.0 END AS rt
      FROM (SELECT *, round(y_est, 12) AS ky, round(f2f_est, 12) AS kt FROM compared)""",
}


def combined(spark, sf):
    """Estimators beside the truth, written once: districts x months x estimators rows."""
    st = Study(spark, sf)
    return cut_lineage(Va.attach_truth(Va.stack_estimators(seven_estimators(st)), truth_table(spark, sf)))


def compared(spark, sf):
    return Va.interval_comparison(combined(spark, sf))


def valid(body: str) -> str:
    return with_views(body, *VALID_VIEWS, **VALID_CTE)


@query(
    "v1_stack_seven_estimators",
    valid(
        "SELECT adm1_name, adm2_name, obs_month, type, model, type_model, "
        + ", ".join(f"{R(c, 6)} AS {c}" for c in ("y_est", *BOUNDS, "f2f_est"))
        + " FROM combined"
    ),
)
def v1(spark, sf):
    both = combined(spark, sf).select(*Va.PLACE, "type", "model", "type_model", "y_est", *BOUNDS, "f2f_est")
    return rounded(both, 6)


ROW_SHOWN = ["bias", "abserror", "sqerror"] + [f"{m}{t}" for t in ("80", "90", "95") for m in ("ci_length", "coverage")]


@query(
    "v2_v4_interval_overlap_and_errors",
    valid("SELECT type_model, adm2_name, obs_month, " + ", ".join(f"{R(c, 6)} AS {c}" if not c.startswith("coverage") else f"CAST({c} AS INT) AS {c}" for c in ROW_SHOWN) + " FROM compared"),
)
def v2(spark, sf):
    return rounded(compared(spark, sf).select("type_model", "adm2_name", "obs_month", *ROW_SHOWN), 6)


@query(
    "v3_interval_metrics",
    valid(
        "SELECT type_model, type, model, obs_month, "
        + ", ".join(
            f"{R(f'avg(ci_length{t})', 6)} AS ci_length{t}, {R(f'avg(coverage{t})', 6)} AS coverage{t}, {R(f'avg(coverage{t}) - {q}', 6)} AS coverage_deviation{t}"
            for t, q in (("80", 0.8), ("90", 0.9), ("95", 0.95))
        )
        + " FROM compared GROUP BY 1, 2, 3, 4"
    ),
)
def v3(spark, sf):
    return rounded(Va.interval_metrics(compared(spark, sf)), 6)


def _corr(x: str, y: str, rows: str) -> str:
    full = f"count({x}) = count(*) AND count({y}) = count(*)"
    return f"CASE WHEN {full} THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


METRICS_SQL = f"""SELECT type_model, type, model, obs_month, {_corr('y_est', 'f2f_est', '')} AS pearson, {_corr('ry', 'rt', '')} AS spearman,
  2 * covar_pop(y_est, f2f_est) / nullif(var_pop(y_est) FILTER (f2f_est IS NOT NULL) + var_pop(f2f_est) FILTER (y_est IS NOT NULL) + power(avg(y_est) FILTER (f2f_est IS NOT NULL) - avg(f2f_est) FILTER (y_est IS NOT NULL), 2), 0) AS ccc,
  CASE WHEN count(bias) = count(*) THEN avg(bias) END AS bias, CASE WHEN count(bias) = count(*) THEN avg(abserror) END AS MAE, CASE WHEN count(bias) = count(*) THEN sqrt(avg(sqerror)) END AS rMSE
  FROM ranked GROUP BY 1, 2, 3, 4"""
METRIC_NAMES = ("pearson", "spearman", "ccc", "bias", "MAE", "rMSE")


@query(
    "v4_v5_v6_v7_error_metrics",
    valid("SELECT type_model, type, model, obs_month, " + ", ".join(f"{R(m, 6)} AS {m}" for m in METRIC_NAMES) + f" FROM ({METRICS_SQL})"),
)
def v4(spark, sf):
    return rounded(Va.error_metrics(compared(spark, sf)), 6)


LABEL_SQL = "CASE type_model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Va.TYPE_MODEL_LABELS.items()) + " ELSE type_model END"
TABLE_SQL = f"""SELECT {LABEL_SQL} AS type_model, strftime(obs_month, '%Y %b') AS month, obs_month, model, type, {', '.join(f'{R(R(m), 3)} AS {m}' for m in METRIC_NAMES)},
  {', '.join(f"(SELECT {R(R(f'avg({m}{t})'), 3)} FROM compared c WHERE c.type_model = k.type_model AND c.obs_month = k.obs_month) AS {m}{t}" for t in ('80', '90') for m in ('coverage', 'ci_length'))}
  FROM ({METRICS_SQL}) k"""


def metric_table(spark, sf):
    rows = compared(spark, sf)
    return Va.metric_table(Va.error_metrics(rows), Va.interval_metrics(rows))


@query("v8_metric_table", valid(f"SELECT * FROM ({TABLE_SQL}) ORDER BY obs_month, model, type"))
def v8(spark, sf):
    return rounded(metric_table(spark, sf), 3)


@query(
    "v8_long_metric_table",
    with_views(
        " UNION ALL ".join(
            f"SELECT month, type_model, '{m}' AS metric, {m} AS value FROM t WHERE type_model IN {Va.LONG_TABLE_MODELS}" for m in Va.LONG_TABLE_METRICS
        ),
        *VALID_VIEWS,
        **VALID_CTE,
        t=TABLE_SQL,
    ),
)
def v8_long(spark, sf):
    return rounded(Va.long_metric_table(metric_table(spark, sf)), 3)


# ------------------------------------------------------------- ownership model
def scored_households(spark, sf):
    h = J.left_join(V.households(spark, sf), V.cell_scores(spark, sf), ["respondent_id"])
    # a score with many distinct values: household size and score shift it
    return h.withColumns(
        {
            "cell": Rc.yes_flag(F.col("h_cell")),
            "p_cell": (F.col("p_cell") * 0.9 + F.col("household_id") % 97 / 1000.0).cast("double"),
        }
    )


SCORED_SQL = "SELECT CASE WHEN h_cell = 'yes' THEN 1 ELSE 0 END AS cell, adm1_name, p_cell * 0.9::DOUBLE + (household_id % 97) / 1000.0::DOUBLE AS p_cell FROM v_households JOIN v_scores USING (respondent_id)"


@query(
    "v9_roc_auc",
    with_views(
        f"""SELECT {R('(sum(CASE WHEN cell = 1 THEN rk END) - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auc, n1 AS n_cases, n0 AS n_controls FROM
        (SELECT cell, rank() OVER (ORDER BY p_cell) + (count(*) OVER (PARTITION BY p_cell) - 1) / 2.0::DOUBLE AS rk, CAST(sum(cell) OVER () AS DOUBLE) AS n1, CAST(sum(1 - cell) OVER () AS DOUBLE) AS n0 FROM scored) GROUP BY n1, n0""",
        "v_households",
        "v_scores",
        scored=SCORED_SQL,
    ),
)
def v9(spark, sf):
    return rounded(Va.roc_auc(scored_households(spark, sf), "cell", "p_cell"))


@query(
    "v10_decile_calibration",
    with_views(
        f"""SELECT CAST(greatest(list_count(list_filter(b, lambda q: q < p_cell)), 1) AS INT) AS bin, {R('avg(p_cell)')} AS model, {R('avg(CAST(cell AS DOUBLE))')} AS actual, CAST(count(*) AS BIGINT) AS n FROM scored,
        (SELECT quantile_cont(p_cell, [{', '.join(repr(k / 10) for k in range(11))}]) AS b FROM scored) GROUP BY 1""",
        "v_households",
        "v_scores",
        scored=SCORED_SQL,
    ),
)
def v10(spark, sf):
    return rounded(Va.decile_calibration(scored_households(spark, sf), "cell", "p_cell"))


OWNERSHIP = ("hhh_edu", "hhh_sex", "hh_size", "h_water_source", "adm1_name")


def ownership_model(spark, sf):
    homes = mics_table(spark, sf).withColumn("cell", Rc.yes_flag(F.col("h_cell")))
    homes = cut_lineage(homes.select("cell", "weight_hh", "HH2", *OWNERSHIP))
    return homes, glm.fit_logistic(homes, "cell", OWNERSHIP, "weight_hh")


@query("m2_weighted_logistic_scores")
def m2(spark, sf):
    _, model = ownership_model(spark, sf)
    phone = V.households(spark, sf).where(F.col("modality") == "rtm")
    return rounded(glm.score_logistic(model, phone, OWNERSHIP, ["household_id", "respondent_id"]))


ANSWERS = ("hhh_edu", "hhh_sex", "h_water_source", "adm1_name")
HOMES_SQL = f"SELECT * FROM ({MICS_SQL.strip()}) WHERE h_cell IN ('yes', 'no') AND " + " AND ".join(f"{v} IS NOT NULL" for v in ("hhh_edu", "hhh_sex", "hh_size", "h_water_source", "adm1_name"))
SCORE_TERMS_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{v}' AS var, {v} AS level, CAST(0 AS DOUBLE) AS score FROM homes" for v in ANSWERS)


@query(
    "m2_score_equations",
    with_views(f"{SCORE_TERMS_SQL} UNION ALL SELECT 'hh_size', 'all', CAST(0 AS DOUBLE)", "v_mics_persons", "v_mics_households", "v_labels", homes=HOMES_SQL),
)
def m2_score(spark, sf):
    """First-order conditions of the weighted fit: the weighted residual of every answer, and of the size, is 0."""
    homes, model = ownership_model(spark, sf)
    scored = model.transform(homes.select("cell", "weight_hh", *OWNERSHIP).dropna().withColumn("cell", F.col("cell").cast("double")))
    residual = F.col("weight_hh") * (F.col("cell") - F.col("p_cell"))
    scored = scored.withColumns({"wr": residual, "wrx": residual * F.col("hh_size")}).select("wr", "wrx", "weight_hh", *ANSWERS)
    terms = A.stacked_groups(scored, ANSWERS, [], s=F.sum("wr"), w=F.sum("weight_hh")).select("var", "level", "s", "w")
    size = scored.agg(F.lit("hh_size").alias("var"), F.lit("all").alias("level"), F.sum("wrx").alias("s"), F.sum("weight_hh").alias("w"))
    return terms.unionByName(size).select("var", "level", r(F.col("s") / F.col("w"), 6).alias("score"))


@query(
    "m9_null_scores",
    with_views(
        "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN hhh_edu IS NULL OR fcs IS NULL THEN 1 END) AS BIGINT) AS n_null FROM v_households",
        "v_households",
    ),
)
def m9(spark, sf):
    scored = scored_households(spark, sf)
    missing = F.col("hhh_edu").isNull() | F.col("fcs").isNull()
    return glm.null_predictions(scored.withColumn("p_cell", F.when(~missing, F.col("p_cell"))))


# ------------------------------------------------------------------ plot tables
@query(
    "t1_scatter",
    valid(f"SELECT type_model, strftime(obs_month, '%B %Y') AS month, adm2_name, {R('y_est', 6)} AS y_est, {R('f2f_est', 6)} AS f2f_est FROM combined"),
)
def t1(spark, sf):
    return rounded(Pl.scatter_table(combined(spark, sf)), 6)


RING_SQL = "(SELECT DISTINCT n_name AS adm2_name, n_nationkey AS area FROM nation)"


@query(
    "t2_map_values",
    valid(
        f"""SELECT type_model, adm2_name, strftime(obs_month, '%B %Y') AS month, {R('y_est', 6)} AS y_est, {R('low90', 6)} AS low90, area AS adm2_index FROM
        (SELECT type_model, adm2_name, obs_month, y_est, low90 FROM stacked UNION ALL SELECT 'Direct (f2f) ', adm2_name, obs_month, f2f_est, f2f_low90 FROM truth)
        LEFT JOIN {RING_SQL} USING (adm2_name) WHERE obs_month IN {MONTHS_SQL}"""
    ),
)
def t2(spark, sf):
    stacked = Va.stack_estimators(seven_estimators(Study(spark, sf)))
    table = Pl.map_table(stacked, truth_table(spark, sf), V.districts(spark, sf), VALIDATION_MONTHS)
    return rounded(table.select("type_model", "adm2_name", "month", "y_est", "low90", "adm2_index"), 6)


@query(
    "t3_interval_length_map",
    valid(
        f"""SELECT type_model, adm2_name, strftime(obs_month, '%B %Y') AS month, {R('l80 * 100', 5)} AS ci_length80, {R('l90 * 100', 5)} AS ci_length90, {R('l95 * 100', 5)} AS ci_length95, area AS adm2_index FROM
        (SELECT type_model, adm2_name, obs_month, ci_length80 AS l80, ci_length90 AS l90, ci_length95 AS l95 FROM compared UNION ALL
         SELECT 'Direct (f2f) ', adm2_name, obs_month, f2f_high80 - f2f_low80, f2f_high90 - f2f_low90, f2f_high95 - f2f_low95 FROM truth)
        LEFT JOIN {RING_SQL} USING (adm2_name) WHERE obs_month IN {MONTHS_SQL}"""
    ),
)
def t3(spark, sf):
    table = Pl.interval_length_table(compared(spark, sf), truth_table(spark, sf), V.districts(spark, sf), VALIDATION_MONTHS)
    return rounded(table.select("type_model", "adm2_name", "month", "ci_length80", "ci_length90", "ci_length95", "adm2_index"), 5)


# ------------------------------------------------------------- fitted models
RI_NAMES = ("hh_size", *[f"hhh_edu_{v}" for v in Rc.EDUCATION_LEVELS if v != "higher"], "h_water_source_protected", "h_water_source_unprotected/other", "h_toilet_type_2way_unimproved", "hhh_sex_M")


def ownership_design(h):
    """Dummies of the random-intercept model; the first level in the alphabet is the baseline."""
    return Rc.one_hot(
        h,
        {
            "hhh_edu": Rc.EDUCATION_LEVELS,
            "h_water_source": ("piped", "protected", "unprotected/other"),
            "h_toilet_type_2way": Rc.TOILET_LEVELS,
            "hhh_sex": Rc.SEX_LEVELS,
        },
    )


@query("m3_random_intercept_scores")
def m3(spark, sf):
    h = V.households(spark, sf)
    _, fit = random_intercept_model(h)
    phone = h.where(F.col("modality") == "rtm")
    answered = F.col("hhh_edu").isNotNull()
    scored = H.score_random_intercept(fit, ownership_design(phone.where(answered)), RI_NAMES, "adm2_name")
    # an interview without education keeps its row, without a score
    unscored = phone.where(~answered).withColumn("p_cell", F.lit(None).cast("double"))
    columns = ["household_id", "respondent_id", "p_cell"]
    return rounded(scored.select(columns).unionByName(unscored.select(columns)), 5)


def random_intercept_model(h):
    """Face-to-face interviews with education, and the model of phone ownership fitted on them."""
    face = h.where(V.first_round() & F.col("hhh_edu").isNotNull())
    face = ownership_design(face).withColumn("cell", Rc.yes_flag(F.col("h_cell")))
    fit = H.fit_random_intercept(face, RI_NAMES, "cell", "adm2_name")
    if not fit.converged:
        raise RuntimeError("the random-intercept model did not converge")
    return face, fit


@query(
    "m3_area_score_equations",
    with_views(
        f"SELECT DISTINCT adm2_name, CAST(0 AS DOUBLE) AS score FROM v_households WHERE {V.FIRST_ROUND_SQL} AND hhh_edu IS NOT NULL AND h_cell IS NOT NULL",
        "v_households",
    ),
)
def m3_score(spark, sf):
    """First-order condition of every area effect at the fit: residual sum less effect over variance."""
    face, fit = random_intercept_model(V.households(spark, sf))
    scored = H.score_random_intercept(fit, face, RI_NAMES, "adm2_name")
    pull = local_table(spark, [(a, float(u / fit.sigma**2)) for a, u in zip(fit.areas, fit.effects)], "adm2_name string, pull double")
    sums = scored.groupBy("adm2_name").agg(F.sum(F.col("cell") - F.col("p_cell")).alias("residual")).join(pull, "adm2_name")
    return sums.select("adm2_name", r(F.col("residual") - F.col("pull"), 4).alias("score"))


TERMS_SQL = "', '".join(("intercept", *RI_NAMES, "log_sigma"))


@query("m3_score_equations", f"SELECT unnest(['{TERMS_SQL}']) AS term, CAST(0 AS DOUBLE) AS score FROM (SELECT count(*) FROM orders)")
def m3_score_all(spark, sf):
    """First-order condition of every coefficient and of the standard deviation, per interview and per area."""
    face, fit = random_intercept_model(V.households(spark, sf))
    scores = H.random_intercept_scores(fit, face, RI_NAMES, "cell", "adm2_name")
    size = F.when(F.col("term") == "log_sigma", F.lit(len(fit.areas))).otherwise(face.agg(F.count(F.lit(1))).scalar())
    return scores.select("term", r(F.col("score") / size, 5).alias("score"))


GRADIENT_CTE = {
    **MODEL_CTE,
    "patterns": PATTERNS_SQL,
    "nb": NEIGHBOURS_SQL,
    "ranked": RANKED_SQL,
    "resid": f"SELECT rows.*, e.draw, y - n / (1 + exp(-({eta_sql(N_JOINT)}))) AS r FROM patterns rows JOIN effects e ON e.adm2_index = rows.adm2_index AND e.month_idx = rows.month_idx JOIN coefs c ON c.draw = e.draw",
    "scaled": "SELECT d.*, s.value * s.value AS s2 FROM draws d JOIN draws s ON s.draw = d.draw AND s.param = concat('sigma_', d.param)",
    "sides": """SELECT x.adm2_index AS one, y.adm2_index AS two FROM (SELECT DISTINCT least(node1, node2) AS a, greatest(node1, node2) AS b FROM nb) JOIN ranked x ON x.k = a JOIN ranked y ON y.k = b
      UNION ALL SELECT y.adm2_index, x.adm2_index FROM (SELECT DISTINCT least(node1, node2) AS a, greatest(node1, node2) AS b FROM nb) JOIN ranked x ON x.k = a JOIN ranked y ON y.k = b""",
    "terms": f"""SELECT draw, 'b0' AS param, NULL::INT AS i, NULL::INT AS j, r AS v FROM resid
      UNION ALL SELECT draw, unnest(['phi', 'theta']), adm2_index, NULL, r FROM resid
      UNION ALL SELECT draw, unnest(['nu', 'xi']), month_idx, NULL, r FROM resid
      UNION ALL SELECT draw, 'psi', month_idx, adm1_index, r FROM resid
      UNION ALL SELECT draw, 'betas', CAST(unnest(range(1, {N_JOINT + 1})) AS INT), NULL, unnest([{', '.join(f'sum(x{k} * r)' for k in range(1, N_JOINT + 1))}]) FROM resid GROUP BY draw
      UNION ALL SELECT draw, param, i, j, -value / 25 FROM draws WHERE param IN ('b0', 'betas')
      UNION ALL SELECT draw, param, i, j, -value / s2 FROM scaled WHERE param IN ('theta', 'xi', 'psi')
      UNION ALL SELECT draw, param, i, j, -sum(value) OVER block / power(CASE param WHEN 'phi' THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END * count(*) OVER block, 2) / s2
        FROM scaled WHERE param IN ('phi', 'nu') WINDOW block AS (PARTITION BY draw, param)
      UNION ALL SELECT a.draw, a.param, a.i, a.j, (b.value - a.value) / a.s2 FROM scaled a JOIN sides ON sides.one = a.i JOIN scaled b ON b.draw = a.draw AND b.param = 'phi' AND b.i = sides.two WHERE a.param = 'phi'
      UNION ALL SELECT draw, param, i, j, (coalesce(lag(value) OVER steps, 0) - value + coalesce(lead(value) OVER steps - value, 0)) / s2 FROM scaled WHERE param = 'nu' WINDOW steps AS (PARTITION BY draw ORDER BY i)""",
}


@query(
    "m6_log_posterior_gradient",
    with_views(f"SELECT draw, param, i, j, {R('sum(v)', 6)} AS gradient FROM terms GROUP BY ALL", *D_VIEWS, "v_edges", **GRADIENT_CTE),
)
def m6_gradient(spark, sf):
    """Gradient of the log posterior in every parameter, at every keyed draw."""
    st = Study(spark, sf)
    return rounded(Lp.log_posterior_gradient(st.patterns(), st.posterior(), st.neighbour_edges(), N_JOINT, st.regions), 6)


def fitted(spark, sf, mode="phone_only"):
    st = Study(spark, sf)
    n = len(De.covariates(mode))
    fit = H.fit_hierarchical(st.patterns(mode), st.regions, st.neighbour_edges(), n, st.months.count())
    if not fit.converged:
        raise RuntimeError("the hierarchical model did not converge")
    return st, fit


PARAMETERS_SQL = f"""SELECT 'b0' AS param, NULL::INT AS i, NULL::INT AS j UNION ALL SELECT 'betas', CAST(unnest(range(1, {N_PHONE + 1})) AS INT), NULL
  UNION ALL SELECT unnest(['phi', 'theta']), CAST(a.range AS INT), NULL FROM range(1, (SELECT ns + 1 FROM dims)::BIGINT) a
  UNION ALL SELECT unnest(['nu', 'xi']), CAST(t.range AS INT), NULL FROM range(1, (SELECT nt + 1 FROM dims)::BIGINT) t
  UNION ALL SELECT 'psi', CAST(t.range AS INT), CAST(p.range AS INT) FROM range(1, (SELECT nt + 1 FROM dims)::BIGINT) t, range(1, (SELECT nr + 1 FROM dims)::BIGINT) p"""


@query(
    "m6_mode_score_equations",
    with_views("SELECT *, CAST(0 AS DOUBLE) AS gradient FROM parameters", *D_VIEWS, **MODEL_CTE, parameters=PARAMETERS_SQL),
)
def m6_score(spark, sf):
    """First-order condition of every parameter at the fitted mode, recomputed from the patterns."""
    st, fit = fitted(spark, sf)
    mode = cut_lineage(fit.mode_draws(spark))
    gradient = Lp.log_posterior_gradient(st.patterns("phone_only"), mode, st.neighbour_edges(), N_PHONE, st.regions)
    return gradient.select("param", "i", "j", r("gradient", 4).alias("gradient"))


@query(
    "m6_mode_log_posterior",
    with_views(
        f"SELECT (SELECT count(*) FROM parameters) + {len(Lp.SIGMAS)} AS n_parameters, CAST(0 AS DOUBLE) AS log_lik_gap, CAST(0 AS DOUBLE) AS log_prior_gap",
        *D_VIEWS, **MODEL_CTE, parameters=PARAMETERS_SQL,
    ),
)
def m6_at_mode(spark, sf):
    """The log posterior that the fit reports, against the one that its mode has as a draw."""
    st, fit = fitted(spark, sf)
    mode = cut_lineage(fit.mode_draws(spark))
    found = Lp.log_posterior(st.patterns("phone_only"), mode, st.neighbour_edges(), N_PHONE, st.regions)
    n = mode.agg(F.count("*")).scalar()
    gap = lambda name, reported: r(F.col(name) - F.lit(float(reported)), 5).alias(f"{name}_gap")
    return found.select(n.alias("n_parameters"), gap("log_lik", fit.log_lik), gap("log_prior", fit.log_prior))


@query("m6_hierarchical_posterior_summary")
def m6(spark, sf):
    st, fit = fitted(spark, sf)
    draws = H.draw_posterior(spark, fit)
    return Dr.parameter_summary(
        Dr.named_parameters(draws, ("b0", "betas", *Lp.SIGMAS), De.covariates("phone_only"))
    )


@query("m6_fitted_mrp_estimate")
def m6_mrp(spark, sf):
    """Whole chain: fit, draw, post-stratify the frame, summarise."""
    st, fit = fitted(spark, sf)
    draws = cut_lineage(H.draw_posterior(spark, fit))
    cells = st.frame_rows("dhs", "phone_only")
    return rounded(summarise(st, Pr.mrp_estimate_blocks(cells, draws, N_PHONE, st.regions)), 6)

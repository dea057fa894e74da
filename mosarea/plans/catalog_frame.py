"""Direct estimates, frames, raking, microdata builders, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosarea.functions import recode as Rc
from mosarea.operators import aggregates as A, frame as Fr, geo as G, intervals as I, joins as J, microdata as Mi, raking as Rk, weights as Wt
from mosarea.plans import views as V
from mosarea.plans.catalog_basic import CENSUS_GROUPED_SQL, CENSUS_SQL, FRAME_ROWS_SQL, SIZE_SQL, frame_rows
from mosarea.plans.registry import R, query, r, rounded
from mosarea.plans.views import with_views
from mosarea.session import cut_lineage
from mosarea.sources.tables import settle_dimension


# -------------------------------------------------- weights, direct estimates
def analysis_rows(spark, sf):
    """Interviews with a score and education, outcome added."""
    h = V.households(spark, sf).withColumn("adm1_name", F.initcap("adm1_name"))
    return h.where(F.col("fcs").isNotNull() & F.col("hhh_edu").isNotNull()).withColumn("poor", Rc.poor_flag(F.col("fcs")))


def survey_weights(spark, sf):
    h = V.households(spark, sf).withColumn("adm1_name", F.initcap("adm1_name"))
    phone = h.where(F.col("modality") == "rtm")
    # months x provinces x education levels: settled so that interviews are not shuffled to meet it
    return settle_dimension(Wt.demographic_weights(phone, Wt.population_shares(V.population_sheet(spark, sf))))


WEIGHTS_SQL = f"""
SELECT s.obs_month, s.adm1_name, s.hhh_edu, p.prop_pop / (s.n / s.n_all) AS dmg_weight_ust FROM
  (SELECT obs_month, {V.TITLE('adm1_name')} AS adm1_name, hhh_edu, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY obs_month, adm1_name) AS DOUBLE) AS n_all
   FROM v_households WHERE modality = 'rtm' GROUP BY obs_month, v_households.adm1_name, hhh_edu) s
  LEFT JOIN v_pop_shares p ON p.adm1_name = s.adm1_name AND p.hhh_edu = s.hhh_edu
"""
PHONE_ROWS_SQL = """
SELECT h.household_id, w.adm1_name, h.adm2_name, h.obs_month, h.hhh_edu, CASE WHEN fcs < 28 THEN CAST(1 AS DOUBLE) ELSE 0 END AS poor, w.dmg_weight_ust
FROM v_households h LEFT JOIN weights w ON w.obs_month = h.obs_month AND lower(w.adm1_name) = lower(h.adm1_name) AND w.hhh_edu = h.hhh_edu
WHERE h.fcs IS NOT NULL AND h.hhh_edu IS NOT NULL AND h.sample_source IN ('RDD', 'GeoPoll')
"""
B_VIEWS = ("v_households", "v_pop_shares")


@query(
    "b1_demographic_weights",
    with_views(f"SELECT obs_month, adm1_name, hhh_edu, {R('dmg_weight_ust')} AS dmg_weight_ust FROM weights", *B_VIEWS, weights=WEIGHTS_SQL),
)
def b1(spark, sf):
    return rounded(survey_weights(spark, sf))


def phone_rows(spark, sf):
    return Wt.attach_weights(Wt.phone_interviews(analysis_rows(spark, sf)), survey_weights(spark, sf))


@query(
    "b2_w2_normalised_weights",
    with_views(
        f"SELECT household_id, {R('dmg_weight_ust / sum(dmg_weight_ust) OVER (PARTITION BY adm2_name, obs_month)')} AS dmg_weight_norm FROM phone",
        *B_VIEWS,
        weights=WEIGHTS_SQL,
        phone=PHONE_ROWS_SQL,
    ),
)
def b2(spark, sf):
    return rounded(Wt.normalised_weights(phone_rows(spark, sf)).select("household_id", "dmg_weight_norm"))


DIRECT_SQL = """
SELECT adm1_name, adm2_name, obs_month, y_est, sqrt(greatest(y_est * (1 - y_est) * w2, 0)) AS y_est_se, 1 / w2 AS n_w FROM
  (SELECT adm1_name, adm2_name, obs_month, sum(v * poor) / sum(v) AS y_est, sum(v * v) AS w2 FROM
    (SELECT *, dmg_weight_ust / sum(dmg_weight_ust) OVER (PARTITION BY adm2_name, obs_month) AS v FROM phone) GROUP BY 1, 2, 3)
"""


@query(
    "b3_a6_direct_phone",
    with_views(
        f"SELECT adm1_name, adm2_name, obs_month, {R('y_est')} AS y_est, {R('y_est_se', 6)} AS y_est_se, {R('n_w')} AS n_w FROM direct",
        *B_VIEWS,
        weights=WEIGHTS_SQL,
        phone=PHONE_ROWS_SQL,
        direct=DIRECT_SQL,
    ),
)
def b3(spark, sf):
    direct = Wt.direct_weighted(phone_rows(spark, sf))
    return rounded(direct.withColumn("y_est_se", r("y_est_se", 6)))


FACE_SQL = f"""
SELECT adm1_name, adm2_name, obs_month, f2f_est, n, sqrt(f2f_est * (1 - f2f_est) / n) AS f2f_est_se FROM
  (SELECT {V.TITLE('adm1_name')} AS adm1_name, adm2_name, obs_month,
    avg(CASE WHEN fcs < 28 THEN CAST(1 AS DOUBLE) WHEN fcs >= 28 THEN CAST(0 AS DOUBLE) END) AS f2f_est, CAST(count(*) AS BIGINT) AS n
   FROM v_households WHERE modality = 'f2f' GROUP BY 1, 2, 3)
"""


def face_direct(spark, sf):
    """Direct estimate of both face-to-face rounds, stacked."""
    h = V.households(spark, sf).withColumn("adm1_name", F.initcap("adm1_name"))
    first, second = (h.where(k).select("adm1_name", "adm2_name", "obs_month", "fcs") for k in (V.first_round(), V.second_round()))
    return Wt.direct_unweighted(J.union_by_name(first, second))


@query(
    "b4_direct_f2f",
    with_views(
        f"SELECT adm1_name, adm2_name, obs_month, {R('f2f_est')} AS f2f_est, n, {R('f2f_est_se')} AS f2f_est_se FROM face",
        "v_households",
        face=FACE_SQL,
    ),
)
def b4(spark, sf):
    return rounded(face_direct(spark, sf))


Z = {"80": 1.2815515655446004, "90": 1.6448536269514722, "95": 1.959963984540054}


def wilson_sql(p: str, n: str, z: float, side: str) -> str:
    sign = "-" if side == "low" else "+"
    ends = f"WHEN {p} = 0 THEN 0 WHEN {p} = 1 THEN {n} / ({n} + {z * z!r})" if side == "low" else (
        f"WHEN {p} = 0 THEN {z * z!r} / ({n} + {z * z!r}) WHEN {p} = 1 THEN 1"
    )
    body = f"({p} + {z * z!r} / (2 * {n}) {sign} {z!r} / (2 * {n}) * sqrt(4 * {n} * {p} * (1 - {p}) + {z * z!r})) / (1 + {z * z!r} / {n})"
    return f"CASE WHEN {p} IS NULL THEN NULL {ends} ELSE {body} END"


def interval_sql(p: str, se: str, n: str, prefix: str, kinds=("wald", "wilson"), names=None) -> str:
    parts = []
    for tag, z in Z.items():
        for side in ("low", "high"):
            sign = "-" if side == "low" else "+"
            for kind in kinds:
                text = f"{p} {sign} {z!r} * {se}" if kind == "wald" else wilson_sql(p, n, z, side)
                name = f"{prefix}{kind}_{side}{tag}" if names is None else f"{prefix}{side}{tag}"
                parts.append(f"{R(text, 6)} AS {name}")
    return ", ".join(parts)


@query(
    "i2_i3_intervals_f2f",
    with_views(
        f"SELECT adm1_name, adm2_name, obs_month, n, {interval_sql('f2f_est', 'f2f_est_se', 'n', 'f2f_')} FROM face",
        "v_households",
        face=FACE_SQL,
    ),
)
def i2(spark, sf):
    wide = I.interval_columns(face_direct(spark, sf), "f2f_est", "f2f_est_se", "n", prefix="f2f_")
    return rounded(wide.drop("f2f_est", "f2f_est_se"), 6)


def phone_wilson(spark, sf):
    wide = I.interval_columns(Wt.direct_weighted(phone_rows(spark, sf)), "y_est", "y_est_se", "n_w")
    return I.keep_interval(wide, "wilson", drop=["n_w", "y_est_se"])


@query(
    "i4_i5_wilson_phone",
    with_views(
        f"SELECT adm1_name, adm2_name, obs_month, {R('y_est', 6)} AS y_est, {interval_sql('y_est', 'y_est_se', 'n_w', '', ('wilson',), names='plain')} FROM direct",
        *B_VIEWS,
        weights=WEIGHTS_SQL,
        phone=PHONE_ROWS_SQL,
        direct=DIRECT_SQL,
    ),
)
def i4(spark, sf):
    return rounded(phone_wilson(spark, sf), 6)


# --------------------------------------------------------------------- frames
CELLS_SQL = f"""
SELECT {', '.join(Fr.CELL_KEYS)}, CASE WHEN sum(hh_weight) / CAST(100000 AS DOUBLE) < 1 THEN CAST(1 AS DOUBLE) ELSE sum(hh_weight) / CAST(100000 AS DOUBLE) END AS pop_weight
FROM frame_rows GROUP BY {', '.join(Fr.CELL_KEYS)}
"""


def cells(spark, sf):
    """Frame cells, written once for the steps that read them again."""
    return cut_lineage(Fr.frame_cells(frame_rows(spark, sf)))


@query(
    "f1_a5_frame_cells",
    with_views(f"SELECT {', '.join(Fr.CELL_KEYS)}, {R('pop_weight')} AS pop_weight FROM cells", "v_frame_src", frame_rows=FRAME_ROWS_SQL, cells=CELLS_SQL),
)
def f1(spark, sf):
    return rounded(Fr.frame_cells(frame_rows(spark, sf)))


MARGIN_KEYS = ("h_toilet_type_2way", "h_water_source_2way", "h_cell", "h_cooking_fuel", "hhh_sex")


@query(
    "f2_margins_any_table",
    with_views(
        f"""SELECT 'households' AS src, hhh_sex, h_cell, {R('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS freq FROM v_households GROUP BY 2, 3
        UNION ALL SELECT 'rdd', hhh_sex, h_cell, {R('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} FROM v_households WHERE sample_source = 'RDD' GROUP BY 2, 3
        UNION ALL SELECT 'frame', hhh_sex, h_cell, {R('sum(hh_weight) / sum(sum(hh_weight)) OVER ()')} FROM frame_rows GROUP BY 2, 3""",
        "v_households",
        "v_frame_src",
        frame_rows=FRAME_ROWS_SQL,
    ),
)
def f2(spark, sf):
    h = V.households(spark, sf)
    parts = {
        "households": Fr.margin(h, ["hhh_sex", "h_cell"]),
        "rdd": Fr.margin(h, ["hhh_sex", "h_cell"], where=F.col("sample_source") == "RDD"),
        "frame": Fr.margin(frame_rows(spark, sf), ["hhh_sex", "h_cell"], weight=F.col("hh_weight").cast("double")),
    }
    stacked = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("src"), "hhh_sex", "h_cell", "freq")
        stacked = one if stacked is None else stacked.unionByName(one)
    return rounded(stacked)


def gappy_cells(spark, sf):
    """Cells of a survey whose answers leave strata empty: a third of the districts report neither higher education nor homes without a phone.

    All rows count, under the next answer. Written once: the completion steps read the cells several times.
    """
    gap = F.substring("adm2_name", -1, 1).isin("1", "4", "7")
    answers = {
        "hhh_edu": F.when(gap & (F.col("hhh_edu") == "higher"), "secondary").otherwise(F.col("hhh_edu")),
        "h_cell": F.when(gap & (F.col("h_cell") == "no"), "yes").otherwise(F.col("h_cell")),
    }
    return cut_lineage(Fr.frame_cells(frame_rows(spark, sf).withColumns(answers)))


GAPPY_SQL = """SELECT * REPLACE (CASE WHEN substr(adm2_name, -1) IN ('1', '4', '7') AND hhh_edu = 'higher' THEN 'secondary' ELSE hhh_edu END AS hhh_edu,
  CASE WHEN substr(adm2_name, -1) IN ('1', '4', '7') AND h_cell = 'no' THEN 'yes' ELSE h_cell END AS h_cell) FROM frame_rows"""
PRESENT_SQL = " UNION ALL ".join(f"SELECT DISTINCT adm2_name, '{v}' AS var, {v} AS level FROM cells" for v in Fr.STRATA_VARIABLES)
MISSING_SQL = """
SELECT a.adm2_name, l.var, l.level FROM (SELECT DISTINCT adm2_name FROM cells) a CROSS JOIN (SELECT DISTINCT var, level FROM present) l
EXCEPT SELECT adm2_name, var, level FROM present
"""
GAP_CTE = {"frame_rows": FRAME_ROWS_SQL, "gappy": GAPPY_SQL, "cells": CELLS_SQL.replace("FROM frame_rows", "FROM gappy"), "present": PRESENT_SQL, "missing": MISSING_SQL}


@query("f3_missing_strata", with_views("SELECT adm2_name, var, level FROM missing", "v_frame_src", **GAP_CTE))
def f3(spark, sf):
    return Fr.missing_strata(gappy_cells(spark, sf))


def _copies_sql() -> str:
    columns = [
        f"CASE WHEN m.var = '{k}' THEN m.level ELSE c.{k} END AS {k}" if k in Fr.STRATA_VARIABLES else f"c.{k}"
        for k in Fr.CELL_KEYS
    ]
    differs = " OR ".join(f"(m.var = '{v}' AND c.{v} <> m.level)" for v in Fr.STRATA_VARIABLES)
    return f"SELECT {', '.join(columns)}, CAST(0.01 AS DOUBLE) AS pop_weight FROM cells c JOIN missing m ON c.adm2_name = m.adm2_name WHERE {differs}"


COMPLETE_SQL = f"SELECT DISTINCT * FROM (SELECT {', '.join(Fr.CELL_KEYS)}, pop_weight FROM cells UNION ALL {_copies_sql()})"


def completed(spark, sf):
    frame = gappy_cells(spark, sf)
    return Fr.complete_strata(frame, Fr.missing_strata(frame))


@query(
    "f4_complete_strata",
    with_views(f"SELECT {', '.join(Fr.CELL_KEYS)}, {R('pop_weight')} AS pop_weight FROM complete", "v_frame_src", **GAP_CTE, complete=COMPLETE_SQL),
)
def f4(spark, sf):
    return rounded(completed(spark, sf))


@query(
    "f5_recheck_strata",
    with_views(
        """SELECT var, CAST(count(*) AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after FROM missing GROUP BY 1""",
        "v_frame_src",
        **GAP_CTE,
    ),
)
def f5(spark, sf):
    frame = gappy_cells(spark, sf)
    missing = cut_lineage(Fr.missing_strata(frame))
    before = missing.groupBy("var").agg(F.count(F.lit(1)).alias("n_before"))
    after = Fr.missing_strata(Fr.complete_strata(frame, missing)).groupBy("var").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "var", "left").select("var", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


@query(
    "a13_change_check",
    with_views(
        f"""SELECT adm1_name, {R('b', 6)} AS weight_before, {R('a', 6)} AS weight_after, {R('(a - b) / b')} AS pct_change FROM
        (SELECT adm1_name, sum(pop_weight) AS b FROM cells GROUP BY 1) JOIN (SELECT adm1_name, sum(pop_weight) AS a FROM complete GROUP BY 1) USING (adm1_name)""",
        "v_frame_src",
        **GAP_CTE,
        complete=COMPLETE_SQL,
    ),
)
def a13(spark, sf):
    frame = gappy_cells(spark, sf)
    check = A.change_check(frame, Fr.complete_strata(frame, Fr.missing_strata(frame)), "adm1_name", "pop_weight")
    return check.select("adm1_name", r("weight_before", 6).alias("weight_before"), r("weight_after", 6).alias("weight_after"), r("pct_change").alias("pct_change"))


# --------------------------------------------------------------------- raking
def rake_margins(spark, sf) -> list[Rk.Margin]:
    census = Fr.census_margins(spark)
    area = settle_dimension(Fr.district_margin(V.matched_names(spark, sf)))
    out = [Rk.Margin(("adm1_name", "adm2_name"), area)]
    for variables in Rk.RAKE_VARIABLES[1:]:
        name = variables[0]
        out.append(Rk.Margin(variables, census.where(F.col("var") == name).select(F.col("level").alias(name), "freq")))
    return out


RAKE_CTE = {"census": CENSUS_SQL, "grouped": CENSUS_GROUPED_SQL}


def sweeps_sql(sweeps: int = 2, start: str = "cells") -> dict[str, str]:
    """Sweeps unrolled: each half sweep scales by target share over current share."""
    ctes = {"area": "SELECT adm1_name, adm2_name_svy AS adm2_name, total_households / sum(total_households) OVER () AS t FROM v_matched"}
    previous, columns = start, ", ".join(Fr.CELL_KEYS)
    total = f"(SELECT sum(pop_weight) FROM {start})"
    step = 0
    for _ in range(sweeps):
        for variables in Rk.RAKE_VARIABLES:
            step += 1
            name = f"k{step}"
            if len(variables) == 2:
                target = "(SELECT t FROM area WHERE area.adm1_name = p.adm1_name AND area.adm2_name = p.adm2_name)"
            else:
                target = f"(SELECT freq / sum(freq) OVER () FROM grouped g WHERE g.margin = '{variables[0]}' AND g.level = p.{variables[0]})"
                ctes.setdefault(
                    f"t_{variables[0]}", f"SELECT level, freq / sum(freq) OVER () AS t FROM grouped WHERE margin = '{variables[0]}'"
                )
                target = f"(SELECT t FROM t_{variables[0]} g WHERE g.level = p.{variables[0]})"
            ctes[name] = (
                f"SELECT {columns}, pop_weight * {target} * {total} / sum(pop_weight) OVER (PARTITION BY {', '.join(variables)}) AS pop_weight FROM {previous} p"
            )
            previous = name
    ctes["raked"] = f"SELECT {columns}, pop_weight / avg(pop_weight) OVER () AS pop_weight FROM {previous}"
    return ctes


def converged_sql(sweeps: int = 150) -> dict[str, str]:
    """The completed frame raked by recursion until nothing changes in 12 decimals."""
    columns = ", ".join(Fr.CELL_KEYS)
    ctes = {k: v for k, v in sweeps_sql(1).items() if k == "area" or k.startswith("t_")}
    joins, weight = "JOIN area a ON a.adm1_name = c.adm1_name AND a.adm2_name = c.adm2_name", "pop_weight"
    targets = ["a.t AS t1"]
    for k, variables in enumerate(Rk.RAKE_VARIABLES[1:], 2):
        joins += f" JOIN t_{variables[0]} g{k} ON g{k}.level = c.{variables[0]}"
        targets.append(f"g{k}.t AS t{k}")
    kept = f"{columns}, total, " + ", ".join(f"t{k}" for k in range(1, len(targets) + 1))
    ctes["aimed"] = f"SELECT c.*, sum(c.pop_weight) OVER () AS total, {', '.join(targets)} FROM complete c {joins}"
    inner = "(SELECT * FROM sweep WHERE step < {n})".format(n=sweeps)
    for k, variables in enumerate(Rk.RAKE_VARIABLES, 1):
        step = "step + 1 AS step" if k == len(Rk.RAKE_VARIABLES) else "step"
        inner = f"(SELECT {step}, {kept}, {weight} * t{k} * total / sum({weight}) OVER (PARTITION BY {', '.join(variables)}) AS pop_weight FROM {inner})"
    ctes["raked"] = f"""SELECT {columns}, pop_weight / avg(pop_weight) OVER () AS pop_weight FROM (
      WITH RECURSIVE sweep AS (SELECT 0 AS step, {kept}, pop_weight FROM aimed UNION ALL SELECT * FROM {inner})
      SELECT * FROM sweep) WHERE step = {sweeps}"""
    return ctes


# The completed frame raked to convergence.
RAKED_CTE = {
    "frame_rows": FRAME_ROWS_SQL,
    "cells": CELLS_SQL,
    "present": PRESENT_SQL,
    "missing": MISSING_SQL,
    "complete": COMPLETE_SQL,
    **RAKE_CTE,
    **converged_sql(),
}


@query(
    "f6_rake_two_sweeps",
    with_views(
        f"SELECT {', '.join(Fr.CELL_KEYS)}, {R('pop_weight', 6)} AS pop_weight FROM raked",
        "v_frame_src",
        "v_matched",
        frame_rows=FRAME_ROWS_SQL,
        cells=CELLS_SQL,
        **RAKE_CTE,
        **sweeps_sql(),
    ),
)
def f6_two(spark, sf):
    done = Rk.rake(cells(spark, sf), rake_margins(spark, sf), solver="sweeps", max_sweeps=2, unfinished=True)
    return rounded(done.weighted, 6)


def raked_frame(spark, sf):
    """All districts of the census, missing strata completed, raked to convergence."""
    frame = cells(spark, sf)
    full = Fr.complete_strata(frame, Fr.missing_strata(frame))
    return Rk.rake(full, rake_margins(spark, sf)).weighted


@query(
    "f6_rake_converged",
    with_views(
        f"SELECT {', '.join(Fr.CELL_KEYS)}, {R('pop_weight', 6)} AS pop_weight FROM raked",
        "v_frame_src",
        "v_matched",
        **RAKED_CTE,
    ),
)
def f6(spark, sf):
    return rounded(raked_frame(spark, sf).select(*Fr.CELL_KEYS, "pop_weight"), 6)


RAKED_SHARES_SQL = " UNION ALL ".join(
    [f"SELECT '{v}' AS var, level, {R('t / sum(t) OVER ()', 7)} AS share FROM t_{v}" for v in MARGIN_KEYS]
    + [f"SELECT 'adm2_name', adm2_name, {R('t / sum(t) OVER ()', 7)} FROM area", "SELECT 'all', 'mean weight', CAST(1 AS DOUBLE)"]
)


@query("f6_converged_shares", with_views(RAKED_SHARES_SQL, "v_frame_src", "v_matched", frame_rows=FRAME_ROWS_SQL, cells=CELLS_SQL, **RAKE_CTE, **sweeps_sql()))
def f6_shares(spark, sf):
    """First-order conditions of raking: the shares that the converged frame reaches are the targets."""
    frame = cut_lineage(raked_frame(spark, sf).select("adm2_name", "pop_weight", *MARGIN_KEYS))
    found = A.stacked_groups(frame, ["adm2_name", *MARGIN_KEYS], [], w=F.sum("pop_weight"))
    total = frame.agg(F.sum("pop_weight")).scalar()
    shares = found.select("var", "level", r(F.col("w") / total, 7).alias("share"))
    mean = frame.agg(F.lit("all").alias("var"), F.lit("mean weight").alias("level"), r(F.avg("pop_weight"), 7).alias("share"))
    return shares.unionByName(mean)


CHECK_SQL = f"""
SELECT a.var, a.level, {R('a.deff', 6)} AS deff, {R('a.avg_weight', 6)} AS avg_weight, {R('a.poll', 6)} AS poll, {R('t.pop', 6)} AS pop, {R('t.pop - a.poll', 6)} AS diff FROM
 ({' UNION ALL '.join(f"SELECT '{v}' AS var, {v} AS level, 1 + var_samp(pop_weight) AS deff, avg(pop_weight) AS avg_weight, sum(pop_weight) / sum(sum(pop_weight)) OVER () AS poll FROM raked GROUP BY 2" for v in ('adm1_name', 'adm2_name', *MARGIN_KEYS))}) a
 FULL JOIN ({' UNION ALL '.join(f"SELECT '{v}' AS var, level, t AS pop FROM t_{v}" for v in MARGIN_KEYS)}
   UNION ALL SELECT 'adm1_name', adm1_name, sum(t) FROM area GROUP BY 2 UNION ALL SELECT 'adm2_name', adm2_name, t FROM area) t ON a.var = t.var AND a.level = t.level
"""


@query(
    "f7_raking_check",
    with_views(CHECK_SQL, "v_frame_src", "v_matched", **RAKED_CTE),
)
def f7(spark, sf):
    return rounded(Rk.raking_check(cut_lineage(raked_frame(spark, sf)), rake_margins(spark, sf)), 6)


FACE_KEYS = ("adm1_name", "adm2_name", "hh_size_bucket", "h_water_source_2way", "h_toilet_type_2way", "hhh_sex", "hhh_edu", "h_cell")
FACE_ROWS_SQL = f"""
SELECT adm1_name, adm2_name, {SIZE_SQL.format('hh_size')} AS hh_size_bucket, CASE WHEN h_water_source IN ('protected', 'piped') THEN 'improved' ELSE 'other' END AS h_water_source_2way,
  h_toilet_type_2way, hhh_sex, hhh_edu, h_cell FROM v_households WHERE {V.FIRST_ROUND_SQL}
"""
COUNT_FRAME_SQL = f"""
SELECT {', '.join('c.' + k for k in FACE_KEYS)}, n, n_adm2, prop_adm2, n / n_adm2 * prop_adm2 * 1000 AS pop_weight FROM
  (SELECT {', '.join(FACE_KEYS)}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY adm1_name, adm2_name) AS DOUBLE) AS n_adm2 FROM face_rows GROUP BY {', '.join(FACE_KEYS)}) c
  LEFT JOIN (SELECT adm1_name, adm2_name_svy, total_households / sum(total_households) OVER () AS prop_adm2 FROM v_matched) m ON m.adm1_name = c.adm1_name AND m.adm2_name_svy = c.adm2_name
"""


def face_frame(spark, sf):
    h = V.households(spark, sf).where(V.first_round())
    rows = Rc.recode(h, Rc.WATER_TWO_WAY).withColumn("hh_size_bucket", Rc.size_bucket(F.col("hh_size")))
    return Fr.count_frame(rows, Fr.district_margin(V.matched_names(spark, sf)), FACE_KEYS)


@query(
    "f8_count_frame",
    with_views(
        f"SELECT {', '.join(FACE_KEYS)}, CAST(n AS BIGINT) AS n, CAST(n_adm2 AS BIGINT) AS n_adm2, {R('prop_adm2')} AS prop_adm2, {R('pop_weight')} AS pop_weight FROM count_frame",
        "v_households",
        "v_matched",
        face_rows=FACE_ROWS_SQL,
        count_frame=COUNT_FRAME_SQL,
    ),
)
def f8(spark, sf):
    return rounded(face_frame(spark, sf).select(*FACE_KEYS, "n", "n_adm2", "prop_adm2", "pop_weight"))


MODEL_CELLS_SQL = f"""
SELECT {', '.join(Fr.MODEL_CELL_KEYS)}, sum(pop_weight) AS pop_weight, CAST(h_cell = 'yes' AS INT) AS p_cell, 'f2f' AS modality FROM
 (SELECT 'dhs' AS popframe_source, {', '.join(Fr.MODEL_CELL_KEYS[1:])}, pop_weight FROM raked
  UNION ALL SELECT 'f2f', {', '.join(Fr.MODEL_CELL_KEYS[1:])}, n FROM count_frame) GROUP BY ALL
"""
FRAME_CTE = {
    **RAKED_CTE,
    "face_rows": FACE_ROWS_SQL,
    "count_frame": COUNT_FRAME_SQL,
    "model_cells": MODEL_CELLS_SQL,
}


def model_frame(spark, sf):
    counted = face_frame(spark, sf).withColumn("pop_weight", F.col("n").cast("double"))
    return Fr.model_cells(("dhs", raked_frame(spark, sf)), ("f2f", counted))


@query(
    "f9_combined_frame",
    with_views(
        f"SELECT {', '.join(Fr.MODEL_CELL_KEYS)}, {R('pop_weight', 6)} AS pop_weight, p_cell, modality FROM model_cells",
        "v_frame_src",
        "v_households",
        "v_matched",
        **FRAME_CTE,
    ),
)
def f9(spark, sf):
    return rounded(model_frame(spark, sf), 6)


# ----------------------------------------------------------------- microdata
DHS_ROWS_SQL = f"""
SELECT DISTINCT hhid, {V.TITLE('adm1_name')} AS adm1_name, adm2_name, hv009 AS hh_size, {SIZE_SQL.format('hv009')} AS hh_size_bucket,
  CASE WHEN hv226 BETWEEN 1 AND 5 THEN 'clean' ELSE 'other' END AS h_cooking_fuel,
  CASE WHEN hv201 BETWEEN 10 AND 14 THEN 'piped' WHEN hv201 IN (21, 31, 41) THEN 'protected' ELSE 'unprotected/other' END AS h_water_source,
  CASE WHEN hv205 BETWEEN 10 AND 15 OR hv205 IN (21, 22) THEN 'improved' ELSE 'unimproved' END AS h_toilet_type_2way,
  CASE WHEN hv219 = 1 THEN 'M' WHEN hv219 IS NOT NULL THEN 'F' END AS hhh_sex, hv220 AS hhh_age,
  CASE hv106 WHEN 3 THEN 'higher' WHEN 2 THEN 'secondary' WHEN 1 THEN 'primary' ELSE 'preprimary/other' END AS hhh_edu,
  CASE WHEN hv243a = 1 THEN 'yes' ELSE 'no' END AS h_cell, hv221 AS h_phone, hv014 AS h_num_child_under_5, hv005 AS hh_weight, hv226, hv201, hv205, hv106
FROM v_dhs_persons WHERE hv101 = 1
"""
DHS_SHOWN = (
    "hhid adm1_name adm2_name hh_size hh_size_bucket h_cooking_fuel h_water_source h_toilet_type_2way hhh_sex hhh_age "
    "hhh_edu h_cell h_phone h_num_child_under_5 hh_weight hv226 hv201 hv205 hv106"
).split()


@query("f10_dhs_households", with_views(f"SELECT * FROM ({DHS_ROWS_SQL.strip()})", "v_dhs_persons"))
def f10(spark, sf):
    return Mi.dhs_households(V.dhs_persons(spark, sf)).select(*DHS_SHOWN)


MICS_SQL = f"""
SELECT h.HH1, h.HH2, l.label AS h_interview_language, h.hh_size, {SIZE_SQL.format('h.hh_size')} AS hh_size_bucket,
  CASE HC7A WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS h_landline, CASE WHEN HC7B = 1 THEN 'yes' ELSE 'no' END AS h_radio,
  CASE WHEN HC8 IN (1, 2) THEN 'yes' WHEN HC8 = 3 THEN 'no' END AS h_electricity, CASE WHEN HC9A = 1 THEN 'yes' ELSE 'no' END AS h_tv,
  CASE HC11 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END AS h_computer, CASE WHEN HC12 = 1 THEN 'yes' ELSE 'no' END AS h_cell, CASE WHEN HC13 = 1 THEN 'yes' ELSE 'no' END AS h_internet,
  CASE WHEN WS11 IN (11, 12, 13, 14, 18) THEN 'modernWaterCloset' WHEN WS11 = 21 THEN 'ventilatedBuildInLatrine' WHEN WS11 IN (22, 23) THEN 'outdoorsLatrineHole' ELSE 'other' END AS h_toilet_type,
  CASE WHEN WS11 IN (22, 23) THEN 'unimproved' WHEN WS11 IN (11, 12, 13, 14, 18, 21) THEN 'improved' ELSE 'other' END AS h_toilet_type_3way,
  CASE WHEN WS11 IN (11, 12, 13, 14, 18, 21) THEN 'improved' ELSE 'unimproved' END AS h_toilet_type_2way,
  CASE WHEN WS1 IN (11, 12, 13, 14) THEN 'piped' WHEN WS1 IN (21, 31, 41) THEN 'protected' ELSE 'unprotected/other' END AS h_water_source,
  CASE WHEN WS1 IN (11, 12, 13, 14, 21, 31, 41) THEN 'improved' ELSE 'other' END AS h_water_source_2way,
  CASE WHEN EU4 IN (1, 2, 3) THEN 'clean' ELSE 'other' END AS h_cooking_fuel, h.weight_hh,
  p.HL1, p.age, p.hhh_edu, CASE WHEN p.hhh_edu IN ('preprimary/other', 'primary') THEN 'primary or less' ELSE p.hhh_edu END AS hhh_edu_3way, p.hhh_sex, p.urbanicity, p.adm1_name,
  concat(coalesce(p.adm1_name, 'NA'), ' x ', coalesce(p.hhh_edu, 'NA'), ' x ', coalesce(p.hhh_sex, 'NA')) AS hhh_adm1_by_edu_by_sex
FROM (SELECT *, HH48 AS hh_size, hhweight AS weight_hh FROM v_mics_households) h
LEFT JOIN v_labels l ON l.variable = 'h_interview_language' AND l.code = h.HH15
LEFT JOIN (SELECT HH1, HH2, HL1, HL6 AS age, CASE WHEN HL4 = 1 THEN 'M' ELSE 'F' END AS hhh_sex,
    CASE WHEN ED5A = 1 THEN 'primary' WHEN ED5A BETWEEN 2 AND 6 THEN 'secondary' WHEN ED5A BETWEEN 7 AND 10 THEN 'higher' ELSE 'preprimary/other' END AS hhh_edu,
    lower(u.label) AS urbanicity, a.label AS adm1_name
  FROM v_mics_persons m LEFT JOIN v_labels u ON u.variable = 'urbanicity' AND u.code = m.HH6 LEFT JOIN v_labels a ON a.variable = 'adm1_name' AND a.code = m.HH7
  WHERE HL1 = 1) p ON p.HH1 = h.HH1 AND p.HH2 = h.HH2
WHERE h.weight_hh <> 0
"""


def mics_table(spark, sf):
    return Mi.mics_households(V.mics_persons(spark, sf), V.mics_household_file(spark, sf), V.labels(spark, sf))


@query("f11_mics_households", with_views(f"SELECT * FROM ({MICS_SQL.strip()})", "v_mics_persons", "v_mics_households", "v_labels"))
def f11(spark, sf):
    return mics_table(spark, sf).drop("EU4", "WS1", "WS11", "sex_raw", "ED5A")


# ------------------------------------------------------------------- geometry
def edges(spark, sf):
    return G.ring_edges(V.districts(spark, sf))


@query(
    "g1_j8_point_in_polygon",
    with_views(
        """SELECT p.pt, q.adm2_index FROM v_points p LEFT JOIN (
          SELECT pt, adm2_index FROM v_points, v_edges WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
          GROUP BY pt, adm2_index HAVING count(*) % 2 = 1) q ON q.pt = p.pt""",
        "v_points",
        "v_edges",
    ),
)
def g1(spark, sf):
    return G.assign_points(V.points(spark, sf), edges(spark, sf), "x", "y").select("pt", "adm2_index")


@query(
    "g1_points_in_rings",
    with_views(
        """SELECT p.pt, q.adm2_index FROM v_points p LEFT JOIN (
          SELECT pt, adm2_index FROM v_points, v_ring_edges WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
          GROUP BY pt, adm2_index HAVING count(*) % 2 = 1) q ON q.pt = p.pt""",
        "v_points",
        "v_ring_edges",
    ),
)
def g1_rings(spark, sf):
    """Districts with holes and with two parts, one of them inside another district."""
    rings = G.ring_edges(V.ringed_districts(spark, sf))
    return G.assign_points(V.points(spark, sf), rings, "x", "y").select("pt", "adm2_index")


# The hole of a district is one of its rings that lies in another; its area and moments count against it.
RING_SUMS_SQL = "SELECT adm2_index, ring_no, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM v_ring_edges GROUP BY 1, 2"


@query(
    "g2_ring_centroids",
    with_views(
        f"""SELECT adm2_index, {R('sum(s * mx) / (3 * sum(s * a))')} AS lon, {R('sum(s * my) / (3 * sum(s * a))')} AS lat, n FROM
        (SELECT *, CASE WHEN ring_no = 2 AND adm2_index % 5 = 1 THEN -1 ELSE 1 END AS s FROM ({RING_SUMS_SQL})) JOIN counts USING (adm2_index) GROUP BY adm2_index, n""",
        "v_ring_edges",
        counts="SELECT n_nationkey AS adm2_index, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
)
def g2_rings(spark, sf):
    found = G.centroids(G.ring_edges(V.ringed_districts(spark, sf)))
    return rounded(found.join(district_counts(spark, sf), "adm2_index").select("adm2_index", "lon", "lat", "n"))


# Geometry-only operators are joined to interviews or points, so that the
# registered query still grows with the data.
@query(
    "g2_centroid_distance",
    with_views(
        f"""SELECT c.adm2_index, {R('c.lon')} AS lon, {R('c.lat')} AS lat, CAST(count(*) AS BIGINT) AS n, {R('avg(sqrt(power(x - lon, 2) + power(y - lat, 2)))')} AS mean_distance FROM
        (SELECT adm2_index, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lon, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lat FROM v_edges GROUP BY 1) c
        JOIN v_points ON c.adm2_index = CAST(floor(x) AS INT) + 5 * CAST(floor(y) AS INT) AND x < 5 AND y < 5 GROUP BY 1, c.lon, c.lat""",
        "v_points",
        "v_edges",
    ),
)
def g2(spark, sf):
    e = edges(spark, sf)
    placed = G.assign_points(V.points(spark, sf), e, "x", "y").where(F.col("adm2_index").isNotNull())
    near = placed.join(G.centroids(e), "adm2_index")
    distance = F.sqrt(F.pow(F.col("x") - F.col("lon"), F.lit(2)) + F.pow(F.col("y") - F.col("lat"), F.lit(2)))
    return rounded(near.groupBy("adm2_index", "lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("mean_distance")))


NEIGHBOURS_SQL = """
SELECT DISTINCT a.adm2_index AS node1, b.adm2_index AS node2 FROM (SELECT DISTINCT adm2_index, x1, y1 FROM v_edges) a
JOIN (SELECT DISTINCT adm2_index, x1, y1 FROM v_edges) b ON a.x1 = b.x1 AND a.y1 = b.y1 AND a.adm2_index <> b.adm2_index
"""
DISTRICT_COUNTS_SQL = "SELECT n_nationkey AS adm2_index, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def district_counts(spark, sf):
    return V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("adm2_index")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g3_contiguity",
    with_views(
        "SELECT node1 AS adm2_index, CAST(count(*) AS BIGINT) AS n_neighbours, CAST(sum(n) AS BIGINT) AS n_around FROM nb JOIN counts ON counts.adm2_index = nb.node2 GROUP BY 1",
        "v_edges",
        nb=NEIGHBOURS_SQL,
        counts=DISTRICT_COUNTS_SQL,
    ),
)
def g3(spark, sf):
    pairs = G.contiguity(edges(spark, sf))
    around = pairs.join(district_counts(spark, sf).withColumnRenamed("adm2_index", "node2"), "node2")
    return around.groupBy(F.col("node1").alias("adm2_index")).agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.sum("n").alias("n_around")
    )


@query(
    "g4_undirected_edges",
    with_views(
        "SELECT node1, node2, a.n AS n1, b.n AS n2 FROM nb JOIN counts a ON a.adm2_index = node1 JOIN counts b ON b.adm2_index = node2 WHERE node1 < node2",
        "v_edges",
        nb=NEIGHBOURS_SQL,
        counts=DISTRICT_COUNTS_SQL,
    ),
)
def g4(spark, sf):
    pairs = G.undirected_edges(G.contiguity(edges(spark, sf)))
    counts = district_counts(spark, sf)
    side = lambda k: counts.select(F.col("adm2_index").alias(f"node{k}"), F.col("n").alias(f"n{k}"))
    return pairs.join(side(1), "node1").join(side(2), "node2").select("node1", "node2", "n1", "n2")


@query(
    "g5_icar_quadratic_form",
    with_views(
        f"SELECT node1 AS \"row\", {R('count(*) * a.n - sum(b.n)')} AS q_n FROM nb JOIN counts a ON a.adm2_index = node1 JOIN counts b ON b.adm2_index = node2 GROUP BY 1, a.n",
        "v_edges",
        nb=NEIGHBOURS_SQL,
        counts=DISTRICT_COUNTS_SQL,
    ),
)
def g5(spark, sf):
    structure = G.icar_structure(G.contiguity(edges(spark, sf)))
    counts = district_counts(spark, sf).withColumnRenamed("adm2_index", "col")
    return rounded(structure.join(counts, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("n")).alias("q_n")))


@query(
    "g6_region_index",
    with_views(
        """SELECT adm1_name, adm2_name, CAST(dense_rank() OVER (ORDER BY adm2_name) AS INT) AS adm2_index, CAST(dense_rank() OVER (ORDER BY adm1_name) AS INT) AS adm1_index
        FROM (SELECT DISTINCT r_name AS adm1_name, n_name AS adm2_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE n_name IN (SELECT adm2_name FROM v_households WHERE modality = 'f2f'))""",
        "v_households",
    ),
)
def g6(spark, sf):
    surveyed = V.households(spark, sf).where(F.col("modality") == "f2f")
    return G.region_index(V.districts(spark, sf), surveyed).select("adm1_name", "adm2_name", "adm2_index", "adm1_index")

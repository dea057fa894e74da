"""Design tables, models, posterior prediction, summaries, validation, plot tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from mosarea.functions import recode as Rc
from mosarea.functions.expressions import keyed_uniform, text_key
from mosarea.functions.columns import quoted
from mosarea.operators import design as De, draws as Dr, geo as G, intervals as I, logposterior as Lp, plotdata as Pl, predict as Pr, validation as Va, weights as Wt
from mosarea.operators.aggregates import dense_index
from mosarea.plans import views as V
from mosarea.plans.catalog_basic import SIZE_SQL
from mosarea.plans.catalog_frame import (
    B_VIEWS,
    DIRECT_SQL,
    FACE_SQL,
    FRAME_CTE,
    NEIGHBOURS_SQL,
    PHONE_ROWS_SQL,
    WEIGHTS_SQL,
    face_direct,
    interval_sql,
    model_frame,
    phone_wilson,
    survey_weights,
)
from mosarea.plans.registry import R, query, r, rounded
from mosarea.plans.views import UNIFORM_SQL, with_views
from mosarea.session import cut_lineage, written_table
from mosarea.sources.tables import settle_dimension

N_JOINT, N_PHONE = 20, 10
KEYS = ("adm2_index", "adm1_index", "month_idx")


# -------------------------------------------------------------------- tables
CELL_TEXT_KEYS = ("adm2_name", "hhh_edu", "hhh_sex", "h_toilet_type_2way", "h_water_source_2way", "hh_size_bucket", "h_cell")

# Parameter blocks of the keyed test draws: number, spread and offset of each.
BLOCKS = {
    "b0": (1, 0.5, -1.2),
    "betas": (2, 0.6, 0.0),
    "phi": (3, 0.8, 0.0),
    "theta": (4, 0.4, 0.0),
    "nu": (5, 0.6, 0.0),
    "xi": (6, 0.3, 0.0),
    "psi": (7, 0.4, 0.0),
}
SIGMA_BLOCKS = {name: k for k, name in enumerate(Lp.SIGMAS, 8)}


def numbered(design, mode, *keep):
    return De.numbered_covariates(design, De.covariates(mode), list(keep))


class Study:
    """Inputs of the modelling queries; index tables are settled once."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        h = V.households(spark, sf)
        h = Rc.recode(h, Rc.WATER_TWO_WAY).withColumn("hh_size_bucket", Rc.size_bucket(F.col("hh_size")))
        self.phone = h.where(F.col("modality") == "rtm")
        # the second face-to-face round is held out: it only validates
        self.face = h.where(V.first_round())
        seen = h.select("adm2_name", "obs_month", (F.col("modality") == "rtm").alias("phone"), V.first_round().alias("face"), F.col("fcs").isNotNull().alias("scored"))
        self._seen = seen.where("phone or face").distinct()

    @cached_property
    def seen(self):
        """Districts and months of the interviews by survey, with and without a score: one pass over the interviews."""
        return settle_dimension(self._seen)

    @cached_property
    def surveyed(self):
        return settle_dimension(self.seen.where("face").select("adm2_name").distinct())

    @cached_property
    def regions(self):
        return settle_dimension(G.region_index(V.districts(self.spark, self.sf), self.surveyed))

    @cached_property
    def months(self):
        """Months of all interviews with a score."""
        return settle_dimension(dense_index(self.seen.where("scored"), "obs_month", "month_idx"))

    def interviews(self, mode="joint"):
        table = De.phone_table(self.phone, V.cell_scores(self.spark, self.sf), mode, self.surveyed)
        if mode == "joint":
            table = De.stack_surveys(table, De.face_table(self.face, table))
        return De.observation_design(table, self.regions, self.months)

    def scoring_rows(self, mode="joint"):
        phone = Wt.phone_interviews(self.interviews(mode))
        return numbered(phone, mode, *KEYS, F.col("household_id").alias("unit_key"))

    def counterfactual_rows(self):
        phone = Wt.phone_interviews(self.interviews())
        switched = Pr.as_face_to_face(phone, De.SWITCH, De.MAIN_COVARIATES)
        return numbered(switched, "joint", *KEYS, F.col("household_id").alias("unit_key"))

    @cached_property
    def model_cells(self):
        """Completed and raked frame with the count frame, written once."""
        return cut_lineage(model_frame(self.spark, self.sf))

    def frame_rows(self, source, mode="joint"):
        """Scoring cells of one frame."""
        cells = self.model_cells.where(F.col("popframe_source") == source)
        cells = cells.withColumn("unit_key", text_key(*[F.col(c) for c in CELL_TEXT_KEYS]))
        design = De.frame_design(cells, self.regions)
        return numbered(design, mode, "adm2_index", "unit_key", "pop_weight")

    def patterns(self, mode="joint"):
        return De.patterns(self.interviews(mode), De.covariates(mode), KEYS)

    def neighbour_edges(self):
        """Undirected neighbour list in model indices."""
        d = V.districts(self.spark, self.sf)
        index = d.select(F.col("adm2_index").alias("k"), "adm2_name").join(self.regions, "adm2_name")
        pairs = G.contiguity(G.ring_edges(d))
        named = pairs.join(index.select(F.col("k").alias("node1"), F.col("adm2_index").alias("a")), "node1").join(
            index.select(F.col("k").alias("node2"), F.col("adm2_index").alias("b")), "node2"
        )
        return settle_dimension(G.undirected_edges(named.select(F.col("a").alias("node1"), F.col("b").alias("node2"))))

    def posterior(self, interaction="adm1_index"):
        """One posterior draw per supplier with keyed values for every parameter."""
        ns, nr = self.regions.agg(F.max("adm2_index"), F.max("adm1_index")).first()
        nt = self.months.agg(F.max("month_idx")).first()[0]
        np_ = nr if interaction == "adm1_index" else ns
        size = {"b0": 0, "betas": N_JOINT, "phi": ns, "theta": ns, "nu": nt, "xi": nt, "psi": nt * np_}
        blocks = [(name, block, size[name]) for name, (block, _, _) in BLOCKS.items()]
        blocks += [(name, block, 0) for name, block in SIGMA_BLOCKS.items()]
        sizes = F.array(
            *[
                F.struct(F.lit(name).alias("param"), F.lit(block).alias("pid"), F.lit(n).alias("n"))
                for name, block, n in blocks
            ]
        )
        # a few bytes of suppliers become many rows: dealt out before they are unfolded
        suppliers = V.table(self.spark, self.sf, "supplier").select("s_suppkey")
        suppliers = suppliers.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = suppliers.select((F.col("s_suppkey") + 1).cast("int").alias("draw"), F.explode(sizes).alias("s"))
        # positions 1..n of a block; a scalar has the single position 0
        rows = rows.withColumn("k", F.explode(F.sequence(F.least(F.col("s.n"), F.lit(1)), F.col("s.n"))))
        k, param = F.col("k"), F.col("s.param")
        psi = param == "psi"
        rows = rows.select(
            "draw",
            param.alias("param"),
            F.col("s.pid").alias("pid"),
            F.when(psi, (k - 1) % nt + 1).when(k > 0, k).cast("int").alias("i"),
            F.when(psi, F.floor((k - 1) / nt) + 1).cast("int").alias("j"),
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        u = keyed_uniform([F.col("draw"), zero("i"), zero("j"), F.col("pid")])
        value = 0.2 + F.col("u")
        for name, (_, spread, offset) in BLOCKS.items():
            value = F.when(F.col("param") == name, (F.col("u") - 0.5) * spread + offset).otherwise(value)
        out = rows.withColumn("u", u).select("draw", "param", "i", "j", value.alias("value"))
        # the draws are read from several sides of every scoring plan, which must know how large they are
        return written_table(out)


# ----------------------------------------------------------------- SQL views
DESIGN_CTE = {
    "base": f"""SELECT h.*, CASE WHEN h.h_water_source IN ('protected', 'piped') THEN 1 ELSE 0 END AS wat, {SIZE_SQL.format('h.hh_size')} AS bucket,
      CASE WHEN modality = 'rtm' THEN s.p_cell ELSE CASE WHEN h_cell = 'yes' THEN CAST(1 AS DOUBLE) ELSE 0 END END AS p_cell
      FROM v_households h JOIN v_scores s ON s.respondent_id = h.respondent_id
      WHERE fcs IS NOT NULL AND (modality = 'rtm' OR {V.FIRST_ROUND_SQL}) AND adm2_name IN (SELECT adm2_name FROM v_households WHERE {V.FIRST_ROUND_SQL})""",
    "months": "SELECT obs_month, CAST(row_number() OVER (ORDER BY obs_month) AS INT) AS month_idx FROM (SELECT DISTINCT obs_month FROM base)",
    "places": f"""SELECT adm1_name, adm2_name, CAST(dense_rank() OVER (ORDER BY adm2_name) AS INT) AS adm2_index, CAST(dense_rank() OVER (ORDER BY adm1_name) AS INT) AS adm1_index
      FROM (SELECT DISTINCT adm1_name, adm2_name FROM v_households WHERE {V.FIRST_ROUND_SQL})""",
    "d0": """SELECT household_id, base.adm1_name, base.adm2_name, base.obs_month, base.hhh_edu, adm2_index, adm1_index, month_idx, modality, sample_source, CASE WHEN fcs < 28 THEN 1 ELSE 0 END AS poor, CAST(fcs AS DOUBLE) / 112 AS fcs_scaled, p_cell AS x1,
      CAST(modality = 'f2f' AS INT) AS f, CAST(hhh_sex = 'F' AS INT) AS c1, CAST(bucket = '3-4' AS INT) AS c2, CAST(bucket = '5-6' AS INT) AS c3, CAST(bucket = '7+' AS INT) AS c4,
      CAST(hhh_edu = 'primary' AS INT) AS c5, CAST(hhh_edu = 'secondary' AS INT) AS c6, CAST(hhh_edu = 'higher' AS INT) AS c7, wat AS c8, CAST(h_toilet_type_2way = 'improved' AS INT) AS c9
      FROM base JOIN months USING (obs_month) JOIN places ON places.adm2_name = base.adm2_name WHERE hhh_edu IS NOT NULL""",
    "joint": f"SELECT *, CAST(f AS DOUBLE) AS x2, {', '.join(f'CAST(c{k} AS DOUBLE) AS x{k + 2}' for k in range(1, 10))}, {', '.join(f'CAST(f * c{k} AS DOUBLE) AS x{k + 11}' for k in range(1, 10))} FROM d0",
    "phone_only": f"SELECT * EXCLUDE (x1), x1, {', '.join(f'CAST(c{k} AS DOUBLE) AS x{k + 1}' for k in range(1, 10))} FROM d0 WHERE modality = 'rtm'",
}
XJ = ", ".join(f"x{k}" for k in range(1, N_JOINT + 1))
D_VIEWS = ("v_households", "v_scores")


def posterior_sql(interaction: str = "adm1_index") -> dict[str, str]:
    """Draws as SQL: indices by cross products, values by the keyed uniform."""
    rng = lambda n: f"range(1, (SELECT {n} + 1 FROM dims)::BIGINT)"
    parts = ["SELECT CAST(s_suppkey + 1 AS INT) AS draw, 'b0' AS param, NULL::INT AS i, NULL::INT AS j, 1 AS pid FROM supplier"]
    for name, size in (("betas", str(N_JOINT)), ("phi", "ns"), ("theta", "ns"), ("nu", "nt"), ("xi", "nt")):
        parts.append(
            f"SELECT CAST(s_suppkey + 1 AS INT), '{name}', CAST(g.range AS INT), NULL, {BLOCKS[name][0]} FROM supplier, {rng(size)} g"
        )
    nr = "nr" if interaction == "adm1_index" else "ns"
    parts.append(
        f"SELECT CAST(s_suppkey + 1 AS INT), 'psi', CAST(g.range AS INT), CAST(q.range AS INT), 7 FROM supplier, {rng('nt')} g, {rng(nr)} q"
    )
    for name, block in SIGMA_BLOCKS.items():
        parts.append(f"SELECT CAST(s_suppkey + 1 AS INT), '{name}', NULL, NULL, {block} FROM supplier")
    cases = " ".join(f"WHEN '{n}' THEN (u - 0.5::DOUBLE) * {spread}::DOUBLE + ({offset})::DOUBLE" for n, (_, spread, offset) in BLOCKS.items())
    return {
        "dims": "SELECT (SELECT max(adm2_index) FROM places) AS ns, (SELECT max(adm1_index) FROM places) AS nr, (SELECT max(month_idx) FROM months) AS nt",
        "draw_index": " UNION ALL ".join(parts),
        "draws": f"SELECT draw, param, i, j, CASE param {cases} ELSE 0.2::DOUBLE + u END AS value FROM {UNIFORM_SQL('draw_index', ['draw', 'coalesce(i, 0)', 'coalesce(j, 0)', 'pid'], 'u')}",
        "coefs": f"SELECT draw, max(CASE WHEN param = 'b0' THEN value END) AS b0, {', '.join(f'''max(CASE WHEN param = 'betas' AND i = {k} THEN value END) AS b{k}''' for k in range(1, N_JOINT + 1))} FROM draws WHERE param IN ('b0', 'betas') GROUP BY 1",
        "effects": f"""SELECT pl.adm2_index, m.i AS month_idx, m.draw, a.v + m.v + p.value AS effect FROM
          (SELECT draw, i, sum(value) AS v FROM draws WHERE param IN ('nu', 'xi') GROUP BY 1, 2) m
          JOIN (SELECT draw, i, sum(value) AS v FROM draws WHERE param IN ('phi', 'theta') GROUP BY 1, 2) a ON a.draw = m.draw
          JOIN places pl ON pl.adm2_index = a.i
          JOIN draws p ON p.param = 'psi' AND p.draw = m.draw AND p.i = m.i AND p.j = pl.{interaction}""",
    }


def eta_sql(n: int) -> str:
    return "c.b0 + " + " + ".join(f"x{k} * c.b{k}" for k in range(1, n + 1)) + " + e.effect"


def units_sql(rows: str, n: int, extra: str = "") -> str:
    return f"""SELECT rows.*, e.draw, 1 / (1 + exp(-({eta_sql(n)}))) AS p FROM {rows} rows
      JOIN effects e ON e.adm2_index = rows.adm2_index AND e.month_idx = rows.month_idx JOIN coefs c ON c.draw = e.draw {extra}"""


def prevalence_sql(units: str, weight: str = "1", key: str = "household_id", seed: int = 1234) -> str:
    keyed = UNIFORM_SQL(units, [key, "month_idx", "draw"], "u", seed)
    return f"SELECT adm2_index, month_idx, draw, sum({weight} * p) / sum({weight}) AS prev, sum({weight} * CASE WHEN u < p THEN CAST(1 AS DOUBLE) ELSE 0 END) / sum({weight}) AS prev2 FROM {keyed} GROUP BY 1, 2, 3"


SHOW = f"SELECT adm2_index, month_idx, draw, {R('prev')} AS prev, {R('prev2')} AS prev2 FROM"
# Raking stops at 1e-9 of the total, so post-stratified values are compared at 6 decimals.
SHOW_RAKED = SHOW.replace(R("prev"), R("prev", 6)).replace(R("prev2"), R("prev2", 6))
MODEL_CTE = {**DESIGN_CTE, **posterior_sql()}


# --------------------------------------------------------------- M operators
@query(
    "m1_design_joint",
    with_views(f"SELECT household_id, adm2_index, adm1_index, month_idx, poor, {R('fcs_scaled')} AS fcs_scaled, {XJ} FROM joint", *D_VIEWS, **DESIGN_CTE),
)
def m1(spark, sf):
    st = Study(spark, sf)
    design = st.interviews()
    keep = ["household_id", *KEYS, F.col("poor").cast("int").alias("poor"), r("fcs_scaled").alias("fcs_scaled")]
    return numbered(design, "joint", *keep)


@query(
    "m1_design_phone_only",
    with_views(f"SELECT household_id, adm2_index, month_idx, poor, {', '.join(f'x{k}' for k in range(1, 11))} FROM phone_only", *D_VIEWS, **DESIGN_CTE),
)
def m1_phone(spark, sf):
    st = Study(spark, sf)
    design = st.interviews("phone_only")
    return numbered(design, "phone_only", "household_id", "adm2_index", "month_idx", F.col("poor").cast("int").alias("poor"))


PATTERNS_SQL = f"SELECT adm2_index, adm1_index, month_idx, {XJ}, CAST(count(*) AS BIGINT) AS n, CAST(sum(poor) AS BIGINT) AS y FROM joint GROUP BY ALL"


@query("m4_patterns", with_views("SELECT * FROM patterns", *D_VIEWS, **DESIGN_CTE, patterns=PATTERNS_SQL))
def m4(spark, sf):
    return Study(spark, sf).patterns()


def _prior_sql(hyper: str) -> str:
    norm = lambda x, sd: f"(-0.5 * power(({x}) / {sd}, 2) - ln({sd}) - 0.5 * ln(2 * pi()))"
    if hyper == "half_cauchy":
        h = "(-ln(pi()) - ln(1 + value * value))"
    else:
        h = "(-ln(2) - 1.5 * ln(1 / (value * value)) + ln(-ln(0.01)) + ln(0.01) * value)"
    u = lambda p: f"(SELECT d.draw, d.i, d.j, d.value / s.value AS u FROM draws d JOIN draws s ON s.draw = d.draw AND s.param = 'sigma_{p}' WHERE d.param = '{p}')"
    return f"""SELECT draw, sum(t) AS log_prior FROM (
      SELECT a.draw, -0.5 * power(a.u - b.u, 2) AS t FROM (SELECT DISTINCT least(x.adm2_index, y.adm2_index) AS node1, greatest(x.adm2_index, y.adm2_index) AS node2 FROM nb
          JOIN ranked x ON x.k = nb.node1 JOIN ranked y ON y.k = nb.node2) e JOIN {u('phi')} a ON a.i = e.node1 JOIN {u('phi')} b ON b.i = e.node2 AND b.draw = a.draw
      UNION ALL SELECT draw, {norm('sum(u)', '(0.001 * count(*))')} FROM {u('phi')} GROUP BY 1
      UNION ALL SELECT draw, {norm('u', '1')} FROM {u('theta')} UNION ALL SELECT draw, {norm('u', '1')} FROM {u('xi')} UNION ALL SELECT draw, {norm('u', '1')} FROM {u('psi')}
      UNION ALL SELECT draw, {norm('u - coalesce(lag(u) OVER (PARTITION BY draw ORDER BY i), 0)', '1')} FROM {u('nu')}
      UNION ALL SELECT draw, {norm('sum(u)', '(0.01 * count(*))')} FROM {u('nu')} GROUP BY 1
      UNION ALL SELECT draw, {norm('value', '5')} FROM draws WHERE param IN ('b0', 'betas')
      UNION ALL SELECT draw, {h} FROM draws WHERE param LIKE 'sigma%') GROUP BY 1"""


RANKED_SQL = "SELECT n_nationkey AS k, adm2_index FROM nation JOIN places ON adm2_name = n_name"
LIKELIHOOD_SQL = f"SELECT draw, sum(y * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) AS log_lik FROM (SELECT rows.y, rows.n, e.draw, {eta_sql(N_JOINT)} AS eta FROM patterns rows JOIN effects e ON e.adm2_index = rows.adm2_index AND e.month_idx = rows.month_idx JOIN coefs c ON c.draw = e.draw) GROUP BY 1"


def log_posterior_oracle(hyper: str, interaction: str) -> str:
    return with_views(
        f"SELECT draw, {R('log_lik', 5)} AS log_lik, {R('log_prior', 5)} AS log_prior, {R('log_lik + log_prior', 5)} AS log_post FROM lik JOIN pri USING (draw)",
        *D_VIEWS,
        "v_edges",
        **DESIGN_CTE,
        **posterior_sql(interaction),
        patterns=PATTERNS_SQL,
        nb=NEIGHBOURS_SQL,
        ranked=RANKED_SQL,
        lik=LIKELIHOOD_SQL,
        pri=_prior_sql(hyper),
    )


def _log_posterior(spark, sf, hyper, interaction):
    st = Study(spark, sf)
    table = Lp.log_posterior(
        st.patterns(),
        st.posterior(interaction),
        st.neighbour_edges(),
        N_JOINT,
        st.regions,
        hyper,
        interaction,
    )
    return rounded(table, 5)


@query("m5_log_posterior_pc", log_posterior_oracle("pc_precision", "adm1_index"))
def m5(spark, sf):
    return _log_posterior(spark, sf, "pc_precision", "adm1_index")


@query("m5_log_posterior_cauchy", log_posterior_oracle("half_cauchy", "adm1_index"))
def m5_cauchy(spark, sf):
    return _log_posterior(spark, sf, "half_cauchy", "adm1_index")


@query("m5_log_posterior_district_month", log_posterior_oracle("pc_precision", "adm2_index"))
def m5_district(spark, sf):
    return _log_posterior(spark, sf, "pc_precision", "adm2_index")


@query(
    "m5_log_likelihood_relational",
    with_views(
        f"SELECT draw, {R('log_lik', 5)} AS log_lik FROM lik", *D_VIEWS, **MODEL_CTE, patterns=PATTERNS_SQL, lik=LIKELIHOOD_SQL
    ),
)
def m5_relational(spark, sf):
    st = Study(spark, sf)
    return rounded(Lp.log_likelihood(st.patterns(), st.posterior(), N_JOINT, st.regions), 5)


SHOWN_PARAMS = ("b0", "betas", *Lp.SIGMAS)
NAME_SQL = "CASE param WHEN 'b0' THEN 'Intercept' WHEN 'betas' THEN " + "CASE i " + " ".join(
    f"WHEN {k} THEN '{n}'" for k, n in enumerate(De.covariates("joint"), 1)
) + " END ELSE param END"
SHOWN_SQL = "', '".join(SHOWN_PARAMS)


@query(
    "m7_parameter_summary",
    with_views(
        f"SELECT {NAME_SQL} AS name, {R('avg(value)', 3)} AS mean, {R('quantile_cont(value, 0.025)', 3)} AS q2_5, {R('quantile_cont(value, 0.975)', 3)} AS q97_5 FROM draws WHERE param IN ('{SHOWN_SQL}') GROUP BY 1",
        *D_VIEWS,
        **MODEL_CTE,
    ),
)
def m7(spark, sf):
    st = Study(spark, sf)
    return Dr.parameter_summary(Dr.named_parameters(st.posterior(), SHOWN_PARAMS, De.covariates("joint")))


@query(
    "m8_trace_table",
    with_views(
        f"SELECT CAST((draw - 1) % 4 + 1 AS INT) AS chain, CAST(floor((draw - 1) / 4) + 1 AS INT) AS iteration, {NAME_SQL} AS name, {R('value')} AS value FROM draws WHERE param IN ('{SHOWN_SQL}')",
        *D_VIEWS,
        **MODEL_CTE,
    ),
)
def m8(spark, sf):
    st = Study(spark, sf)
    chained = st.posterior().withColumns(
        {
            "chain": ((F.col("draw") - 1) % 4 + 1).cast("int"),
            "iteration": (F.floor((F.col("draw") - 1) / 4) + 1).cast("int"),
        }
    )
    return rounded(Dr.trace_table(Dr.named_parameters(chained, SHOWN_PARAMS, De.covariates("joint"))))


@query(
    "c14_interaction_array",
    with_views(
        f"""SELECT d.household_id, {R('avg(a.psi[(d.adm1_index - 1) * (SELECT nt FROM dims) + d.month_idx])')} AS mean_psi FROM joint d,
        (SELECT draw, list(value ORDER BY j, i) AS psi FROM draws WHERE param = 'psi' GROUP BY 1) a GROUP BY 1""",
        *D_VIEWS,
        **MODEL_CTE,
    ),
)
def c14(spark, sf):
    st = Study(spark, sf)
    draws = st.posterior()
    arrays = Dr.interaction_arrays(draws)
    months = draws.where(F.col("param") == "nu").agg(F.max("i")).scalar()
    # one lookup per (month, province, draw), then interviews join the means
    cells = st.interviews().select("household_id", "adm1_index", "month_idx")
    slots = arrays.select(F.posexplode("psi").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean_psi"))
    placed = cells.withColumn("pos", ((F.col("adm1_index") - 1) * months + F.col("month_idx") - 1).cast("int"))
    return rounded(placed.join(slots, "pos", "left").select("household_id", "mean_psi"))


# --------------------------------------------------------------- D operators
@query(
    "d1_j7_unit_prediction",
    with_views(
        f"SELECT household_id, {R('avg(p)')} AS p_mean, {R('min(p)')} AS p_min, {R('max(p)')} AS p_max FROM units GROUP BY 1",
        *D_VIEWS,
        **MODEL_CTE,
        units=units_sql("joint", N_JOINT),
    ),
)
def d1(spark, sf):
    st = Study(spark, sf)
    rows = numbered(st.interviews(), "joint", *KEYS, "household_id")
    units = Pr.predict_units(rows, st.posterior(), N_JOINT, st.regions, summary=True)
    mean = F.try_divide(F.sum("total"), F.sum("n")).alias("p_mean")
    return rounded(units.groupBy("household_id").agg(mean, F.min("low").alias("p_min"), F.max("high").alias("p_max")))


PHONE_INTERVIEWS = "(SELECT * FROM {0} WHERE sample_source IN ('RDD', 'GeoPoll'))"


@query(
    "d2_d3_mr_phone_only",
    with_views(
        f"{SHOW} ({prevalence_sql('units')})", *D_VIEWS, **MODEL_CTE, units=units_sql(PHONE_INTERVIEWS.format("phone_only"), N_PHONE)
    ),
)
def d2(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mr_estimate_blocks(st.scoring_rows("phone_only"), st.posterior(), N_PHONE, st.regions))


@query(
    "d4_binomial_count_frame",
    with_views(
        f"SELECT adm2_index, month_idx, draw, {R('avg(CASE WHEN u < p THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS prev FROM {UNIFORM_SQL('trials', ['cell_key', 'month_idx', 'draw', 'trial'], 'u')} GROUP BY 1, 2, 3",
        "v_households",
        "v_scores",
        "v_frame_src",
        "v_matched",
        **MODEL_CTE,
        **FRAME_CTE,
        cell_design="@CELLS@f2f",
        units=units_sql("cell_design", N_PHONE),
        trials="SELECT adm2_index, month_idx, draw, cell_key, p, unnest(range(1, CAST(pop_weight AS BIGINT) + 1)) AS trial FROM units",
    ),
)
def d4(spark, sf):
    st = Study(spark, sf)
    cells = st.frame_rows("f2f", "phone_only")
    return rounded(Pr.mrp_estimate_blocks(cells, st.posterior(), N_PHONE, st.regions, response="binomial"))


WEIGHTED_ROWS = "(SELECT d.*, w.dmg_weight_ust AS w FROM joint d LEFT JOIN weights w ON w.obs_month = d.obs_month AND lower(w.adm1_name) = lower(d.adm1_name) AND w.hhh_edu = d.hhh_edu WHERE d.sample_source IN ('RDD', 'GeoPoll'))"


@query(
    "d6_mr_joint_weighted",
    with_views(
        f"{SHOW} ({prevalence_sql('units', 'w')})",
        "v_households",
        "v_scores",
        "v_pop_shares",
        **MODEL_CTE,
        weights=WEIGHTS_SQL,
        units=units_sql(WEIGHTED_ROWS, N_JOINT),
    ),
)
def d6(spark, sf):
    st = Study(spark, sf)
    phone = Wt.phone_interviews(st.interviews()).withColumn("adm1_name", F.initcap("adm1_name"))
    phone = Wt.attach_weights(phone, survey_weights(spark, sf))
    rows = numbered(phone, "joint", *KEYS, F.col("household_id").alias("unit_key"), "dmg_weight_ust")
    estimate = Pr.mr_estimate_blocks(rows, st.posterior(), N_JOINT, st.regions, weight="dmg_weight_ust")
    return rounded(estimate)


SWITCHED_SQL = f"(SELECT * EXCLUDE (x2, {', '.join(f'x{k}' for k in range(12, 21))}), CAST(1 AS DOUBLE) AS x2, {', '.join(f'CAST(c{k} AS DOUBLE) AS x{k + 11}' for k in range(1, 10))} FROM joint WHERE sample_source IN ('RDD', 'GeoPoll'))"


@query(
    "d7_mr_modality_counterfactual",
    with_views(f"{SHOW} ({prevalence_sql('units')})", *D_VIEWS, **MODEL_CTE, units=units_sql(SWITCHED_SQL, N_JOINT)),
)
def d7(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mr_estimate_blocks(st.counterfactual_rows(), st.posterior(), N_JOINT, st.regions))


def cell_design_sql(source: str, mode: str) -> str:
    dummies = [
        "CAST(hhh_sex = 'F' AS INT)", "CAST(hh_size_bucket = '3-4' AS INT)", "CAST(hh_size_bucket = '5-6' AS INT)", "CAST(hh_size_bucket = '7+' AS INT)",
        "CAST(hhh_edu = 'primary' AS INT)", "CAST(hhh_edu = 'secondary' AS INT)", "CAST(hhh_edu = 'higher' AS INT)",
        "CAST(h_water_source_2way = 'improved' AS INT)", "CAST(h_toilet_type_2way = 'improved' AS INT)",
    ]
    double = lambda text, k: f"CAST({text} AS DOUBLE) AS x{k}"
    if mode == "phone_only":
        xs = [double("p_cell", 1)] + [double(d, k) for k, d in enumerate(dummies, 2)]
    else:
        xs = [double("p_cell", 1), double("1", 2)] + [double(d, k) for k, d in enumerate(dummies, 3)] + [double(d, k) for k, d in enumerate(dummies, 12)]
    text = ", '|', ".join(CELL_TEXT_KEYS)
    return f"""SELECT places.adm2_index, m.month_idx, pop_weight, CAST(concat('0x', substr(md5(concat({text.replace('adm2_name', 'c.adm2_name')})), 1, 8)) AS BIGINT) AS cell_key, {', '.join(xs)}
      FROM model_cells c JOIN places ON places.adm2_name = c.adm2_name CROSS JOIN months m WHERE popframe_source = '{source}' AND hhh_edu IS NOT NULL"""


def mrp_oracle(source: str, mode: str, show: str = SHOW_RAKED) -> str:
    n = N_JOINT if mode == "joint" else N_PHONE
    return with_views(
        f"{show} ({prevalence_sql('units', 'pop_weight', 'cell_key')})",
        "v_households",
        "v_scores",
        "v_frame_src",
        "v_matched",
        **MODEL_CTE,
        **FRAME_CTE,
        cell_design=cell_design_sql(source, mode),
        units=units_sql("cell_design", n),
    )


@query("d5_mrp_relational", mrp_oracle("dhs", "phone_only"))
def d5(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mrp_estimate(st.frame_rows("dhs", "phone_only"), st.posterior(), N_PHONE, st.regions), 6)


@query("d8_mrp_dhs_phone_only", mrp_oracle("dhs", "phone_only"))
def d8(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mrp_estimate_blocks(st.frame_rows("dhs", "phone_only"), st.posterior(), N_PHONE, st.regions), 6)


@query("d8_mrp_dhs_joint", mrp_oracle("dhs", "joint"))
def d8_joint(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mrp_estimate_blocks(st.frame_rows("dhs"), st.posterior(), N_JOINT, st.regions), 6)


@query("d8_mrp_f2f_joint", mrp_oracle("f2f", "joint"))
def d8_face(spark, sf):
    st = Study(spark, sf)
    return rounded(Pr.mrp_estimate_blocks(st.frame_rows("f2f"), st.posterior(), N_JOINT, st.regions), 6)


from mosarea.plans.registry import ORACLES  # noqa: E402

ORACLES["d4_binomial_count_frame"] = ORACLES["d4_binomial_count_frame"].replace("@CELLS@f2f", cell_design_sql("f2f", "phone_only").strip())

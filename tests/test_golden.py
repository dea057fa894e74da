"""Hand-computed values and properties without a SQL counterpart."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosarea.functions import expressions as X, nulls as N, recode as Rc
from mosarea.operators import blocksolve as B, frame as Fr, geo as G, hierarchical as H, intervals as I, logposterior as Lp, predict as Pr
from mosarea.operators import raking as Rk, validation as Va, weights as Wt
from mosarea.session import cut_lineage
from mosarea.sources.tables import local_table


def one(df):
    return df.first()[0]


def test_normal_quantiles():
    expected = {0.9: 1.28155156554460, 0.95: 1.64485362695147, 0.975: 1.95996398454005}
    for p, z in expected.items():
        assert X.normal_quantile(p) == pytest.approx(z, abs=1e-12)
        assert X.normal_quantile(1 - p) == pytest.approx(-z, abs=1e-12)
    assert [X.level_tag(q) for q in (0.8, 0.9, 0.95)] == ["80", "90", "95"]


@pytest.mark.parametrize(
    "p, low, high",
    [
        (0.2, 0.123473526660939, 0.307326384810823),
        (0.0, 0.0, 0.0513331857862701),
        (1.0, 0.94866681421373, 1.0),
    ],
)
def test_wilson(spark, p, low, high):
    z = X.normal_quantile(0.95)
    row = spark.range(1).select(
        I.wilson_bound(F.lit(p), F.lit(50), -z).alias("low"), I.wilson_bound(F.lit(p), F.lit(50), z).alias("high")
    ).first()
    assert row.low == pytest.approx(low, abs=1e-12)
    assert row.high == pytest.approx(high, abs=1e-12)


def test_wald_is_not_clipped(spark):
    z = X.normal_quantile(0.95)
    se = math.sqrt(0.2 * 0.8 / 50)
    row = spark.range(1).select(I.wald_bound(F.lit(0.2), F.lit(se), -z), I.wald_bound(F.lit(0.2), F.lit(se), z)).first()
    assert row[0] == pytest.approx(0.106953027705866, abs=1e-12)
    assert row[1] == pytest.approx(0.293046972294134, abs=1e-12)


def test_intervals_nest(spark):
    df = local_table(spark, [(p / 10, 30 + p) for p in range(11)], "y double, n int").withColumn(
        "se", F.sqrt(F.col("y") * (1 - F.col("y")) / F.col("n"))
    )
    wide = I.interval_columns(df, "y", "se", "n")
    bad = wide.where(
        "wilson_low95 > wilson_low90 or wilson_low90 > wilson_low80 or wilson_high80 > wilson_high90 or "
        "wilson_high90 > wilson_high95 or wald_low95 > wald_low80 or wald_high80 > wald_high95"
    )
    assert bad.count() == 0
    kept = I.keep_interval(wide, "wilson", drop=["n", "se"])
    assert kept.columns == ["y", "low80", "high80", "low90", "high90", "low95", "high95"]
    with pytest.raises(ValueError):
        I.keep_interval(wide, "other")


def test_kish_effective_size(spark):
    rows = [("a", "d", "m", 1.0, True), ("a", "d", "m", 2.0, False), ("a", "d", "m", 3.0, True)]
    df = local_table(
        spark, rows, "adm1_name string, adm2_name string, obs_month string, dmg_weight_ust double, poor boolean"
    )
    row = Wt.direct_weighted(df).first()
    assert row.n_w == pytest.approx(2.571428571428571)
    assert row.y_est == pytest.approx(4 / 6)
    norm = Wt.normalised_weights(df).agg(F.sum("dmg_weight_norm"))
    assert one(norm) == pytest.approx(1.0)


def test_direct_estimate_is_null_when_a_weight_is_missing(spark):
    rows = [("a", "d", "m", 1.0, True), ("a", "d", "m", None, False)]
    df = local_table(
        spark, rows, "adm1_name string, adm2_name string, obs_month string, dmg_weight_ust double, poor boolean"
    )
    assert Wt.direct_weighted(df).first().y_est is None


def test_face_to_face_size_counts_missing_scores(spark):
    rows = [("a", "d", "m", 10.0), ("a", "d", "m", 90.0), ("a", "d", "m", None)]
    df = local_table(spark, rows, "adm1_name string, adm2_name string, obs_month string, fcs double")
    row = Wt.direct_unweighted(df).first()
    assert (row.f2f_est, row.n) == (0.5, 3)
    assert row.f2f_est_se == pytest.approx(math.sqrt(0.25 / 3))


def rake_fixture(spark):
    frame = local_table(
        spark, [("r1", "c1", 10.0), ("r1", "c2", 20.0), ("r2", "c1", 30.0), ("r2", "c2", 40.0)], "r string, c string, w double"
    )
    margins = [
        Rk.Margin(("r",), local_table(spark, [("r1", 0.5), ("r2", 0.5)], "r string, freq double")),
        Rk.Margin(("c",), local_table(spark, [("c1", 0.4), ("c2", 0.6)], "c string, freq double")),
    ]
    return frame, margins


@pytest.mark.parametrize("solver", ["sweeps", "newton", "gradients"])
def test_raking_golden(spark, solver):
    frame, margins = rake_fixture(spark)
    done = Rk.rake(frame, margins, weight="w", solver=solver)
    assert done.converged and done.solver == solver
    got = {(r.r, r.c): r.w for r in done.weighted.collect()}
    expected = {
        ("r1", "c1"): 0.703060269,
        ("r1", "c2"): 1.296939731,
        ("r2", "c1"): 0.896939731,
        ("r2", "c2"): 1.103060269,
    }
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-8)
    check = Rk.raking_check(done.weighted, margins, weight="w").collect()
    assert max(abs(r["diff"]) for r in check) < 1e-8
    assert np.mean(list(got.values())) == pytest.approx(1.0)


def test_raking_does_not_depend_on_margin_order(spark):
    frame, margins = rake_fixture(spark)
    a = Rk.rake(frame, margins, weight="w", solver="sweeps").weighted.toPandas().sort_values(["r", "c"]).w.to_numpy()
    b = Rk.rake(frame, margins[::-1], weight="w", solver="sweeps").weighted.toPandas().sort_values(["r", "c"]).w.to_numpy()
    assert np.allclose(a, b, atol=1e-7)


def test_raking_rejects_one_sided_levels(spark):
    frame, margins = rake_fixture(spark)
    extra = Rk.Margin(("r",), local_table(spark, [("r1", 0.5), ("r2", 0.3), ("r3", 0.2)], "r string, freq double"))
    with pytest.raises(ValueError, match="levels only in"):
        Rk.rake(frame, [extra, margins[1]], weight="w")


def test_concordance_golden(spark):
    df = local_table(spark, [(0.1, 0.2), (0.2, 0.2), (0.4, 0.6)], "x double, y double")
    assert one(df.agg(Va.concordance(F.col("x"), F.col("y")))) == pytest.approx(0.727272727272727)


def test_touching_intervals_do_not_overlap(spark):
    rows = [("t", 0.25, 0.125, 0.375, 0.4, 0.375, 0.5), ("u", 0.25, 0.125, 0.375, 0.4, 0.25, 0.5)]
    df = local_table(
        spark, rows, "k string, y_est double, low80 double, high80 double, f2f_est double, f2f_low80 double, f2f_high80 double"
    )
    got = {r.k: r.coverage80 for r in Va.interval_comparison(df, levels=[0.8]).collect()}
    assert got == {"t": 0, "u": 1}


def test_roc_auc_with_ties(spark):
    df = local_table(spark, [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "p double, y int")
    assert Va.roc_auc(df, "y", "p").first().auc == pytest.approx(3.5 / 4)


def test_duplicate_breaks_are_an_error(spark):
    df = local_table(spark, [(0.5, 0)] * 20, "p double, y int")
    with pytest.raises(Exception, match="not unique"):
        Va.decile_calibration(df, "y", "p").collect()


def test_pc_prior_and_icar(spark):
    values = spark.range(1).select(
        X.pc_precision_log_density(F.lit(1.0)).alias("a"), X.pc_precision_log_density(F.lit(4.0)).alias("b")
    ).first()
    assert values.a == pytest.approx(-3.77113774074, abs=1e-9)
    assert values.b == pytest.approx(-3.54799418943, abs=1e-9)
    path = spark.range(1).select(
        F.lit([0.5, -0.25, -0.25]).alias("u"),
        F.array(*[F.struct(F.lit(a).alias("node1"), F.lit(a + 1).alias("node2")) for a in (1, 2)]).alias("e"),
    )
    assert one(path.select(Lp.icar_log_density(F.col("u"), F.col("e")))) == pytest.approx(4.60895445711, abs=1e-9)


def test_null_rules(spark):
    df = local_table(spark, [(1,), (None,), (3,)], "code int")
    assert [r[0] for r in df.select(Rc.sex_from_code(F.col("code"))).collect()] == ["M", None, "F"]
    recoded = Rc.recode(df.withColumnRenamed("code", "hv106"), Rc.DHS_RECODES[2])
    assert [r.hhh_edu for r in recoded.collect()] == ["primary", "preprimary/other", "higher"]
    assert [r[0] for r in df.select(N.member(F.col("code"), [1])).collect()] == [True, False, False]
    assert one(df.agg(N.strict_avg(F.col("code")))) is None
    assert one(df.agg(N.weighted_mean(F.col("code"), F.lit(1.0)))) == 2.0


def test_strata_completion(spark):
    rows = [("p", "A", "M", 2.0), ("p", "A", "M", 3.0), ("p", "B", "F", 1.0)]
    frame = local_table(spark, rows, "adm1_name string, adm2_name string, hhh_sex string, pop_weight double")
    missing = Fr.missing_strata(frame, ["hhh_sex"])
    assert sorted((r.adm2_name, r.level) for r in missing.collect()) == [("A", "F"), ("B", "M")]
    full = Fr.complete_strata(frame, missing, ["hhh_sex"])
    # the two copies of A are equal and merge; weights differ in the originals only
    assert full.where("adm2_name = 'A' and hhh_sex = 'F'").select("pop_weight").collect() == [(0.01,)]
    assert full.count() == 5
    assert Fr.missing_strata(full, ["hhh_sex"]).count() == 0


def test_null_score_point_and_islands(spark):
    square = lambda x, y: [{"x": x, "y": y}, {"x": x + 1, "y": y}, {"x": x + 1, "y": y + 1}, {"x": x, "y": y + 1}]
    d = spark.createDataFrame(
        [(1, square(0.0, 0.0)), (2, square(1.0, 1.0)), (3, square(5.0, 5.0))], "adm2_index int, ring array<struct<x: double, y: double>>"
    )
    edges = G.ring_edges(d)
    pairs = G.contiguity(edges)
    assert sorted(map(tuple, G.undirected_edges(pairs).collect())) == [(1, 2)]
    assert [r.adm2_index for r in G.islands(d, pairs).collect()] == [3]
    points = local_table(spark, [(1, 0.5, 0.5), (2, 3.0, 3.0), (3, 5.2, 5.9)], "pt int, x double, y double")
    placed = {r.pt: r.adm2_index for r in G.assign_points(points, edges, "x", "y", square_edges=1).collect()}
    assert placed == {1: 1, 2: None, 3: 3}
    centre = G.centroids(edges).where("adm2_index = 2").first()
    assert (centre.lon, centre.lat) == (1.5, 1.5)


def test_uniforms_agree_and_are_uniform(spark):
    keys = np.arange(1, 20001, dtype=np.int64)
    table = spark.range(1, 20001).select("id", X.keyed_uniform([F.col("id"), F.lit(7), F.lit(3)]).alias("u")).orderBy("id").toPandas()
    array = Pr.uniform_matrix(keys, 7, np.array([3], dtype=np.int64), 1234)[:, 0]
    assert np.array_equal(table.u.to_numpy(), array)
    counts = np.histogram(array, bins=20, range=(0, 1))[0]
    assert np.sum((counts - 1000) ** 2 / 1000) < 50
    assert abs(np.corrcoef(array[:-1], array[1:])[0, 1]) < 0.03


def simulated_patterns(spark, rng, ns=12, nt=10, rows=40000, sd=0.5):
    place = np.arange(ns) // 4
    area, month = rng.integers(0, ns, rows), rng.integers(0, nt, rows)
    x = rng.integers(0, 2, (rows, 2))
    beta = np.array([0.7, -0.4])
    area_effect = rng.normal(0, sd, ns)
    eta = -0.5 + x @ beta + area_effect[area] + rng.normal(0, 0.3, nt)[month]
    y = rng.random(rows) < 1 / (1 + np.exp(-eta))
    data = spark.createDataFrame(
        [(int(a) + 1, int(m) + 1, float(u), float(v), int(k)) for a, m, (u, v), k in zip(area, month, x, y)],
        "adm2_index int, month_idx int, x1 double, x2 double, y int",
    )
    patterns = data.groupBy("adm2_index", "month_idx", "x1", "x2").agg(F.count("y").alias("n"), F.sum("y").alias("y"))
    regions = local_table(spark, [(a + 1, int(place[a]) + 1) for a in range(ns)], "adm2_index int, adm1_index int")
    edges = local_table(spark, [(a, a + 1) for a in range(1, ns)], "node1 int, node2 int")
    return data, patterns, regions, edges, beta, area_effect


@pytest.fixture(scope="module")
def simulation(spark):
    return simulated_patterns(spark, np.random.default_rng(7))


def test_derivatives_match_finite_differences(spark, simulation):
    _, patterns, *_ = simulation
    rng = np.random.default_rng(1)
    beta, offset = rng.normal(0, 0.3, 2), rng.normal(0, 0.3, (12, 10))
    at = H.derivatives(patterns, 10, beta, offset)
    h = 1e-4
    for k in range(2):
        step = np.eye(2)[k] * h
        up, down = (H.derivatives(patterns, 10, beta + s * step, offset).log_lik for s in (1, -1))
        assert (up - down) / (2 * h) == pytest.approx(at.residual_x[k], rel=1e-5, abs=1e-3)
        assert -(up - 2 * at.log_lik + down) / h**2 == pytest.approx(at.weight_xx[k, k], rel=1e-2)
    bumped = offset.copy()
    bumped[3, 4] += h
    change = H.derivatives(patterns, 10, beta, bumped).log_lik - at.log_lik
    assert change / h == pytest.approx(at.residual[3 * 10 + 4], rel=1e-3, abs=1e-2)


@pytest.mark.parametrize("hyper, interaction", [("pc_precision", "adm1_index"), ("half_cauchy", "adm1_index"), ("pc_precision", "adm2_index")])
def test_hierarchical_fit_recovers_parameters(spark, simulation, hyper, interaction):
    _, patterns, regions, edges, beta, area_effect = simulation
    fit = H.fit_hierarchical(patterns, regions, edges, 2, 10, hyper=hyper, interaction=interaction)
    assert fit.converged
    assert np.allclose(fit.coefficients[1:], beta, atol=0.1)
    s = fit.layout.slices()
    area = fit.mode[s["phi"]] + fit.mode[s["theta"]]
    assert np.corrcoef(area, area_effect)[0, 1] > 0.97
    # at the mode the penalised gradient vanishes
    at_mode = fit.mode_draws(spark)
    gradient = Lp.log_posterior_gradient(patterns, at_mode, edges, 2, regions, interaction)
    assert gradient.count() == fit.layout.size
    assert gradient.agg(F.max(F.abs("gradient"))).first()[0] < 1e-4
    reported = Lp.log_posterior(patterns, at_mode, edges, 2, regions, hyper, interaction).first()
    assert reported.log_lik == pytest.approx(fit.log_lik, abs=1e-6) and reported.log_prior == pytest.approx(fit.log_prior, abs=1e-6)
    draws = H.draw_posterior(spark, fit, n_draws=400, draws_per_point=8).cache()
    assert draws.groupBy("param").count().count() == 12
    sigmas = draws.where("param = 'sigma_phi'").agg(F.countDistinct("value"), F.count("value"), F.countDistinct("draw")).first()
    assert sigmas[0] > 25 and sigmas[1:] == (400, 400)
    fewer = H.draw_posterior(spark, fit, n_draws=100, draws_per_point=8).where("param = 'sigma_phi'").agg(F.countDistinct("value")).first()[0]
    assert fewer < sigmas[0]
    mean = {r.i: r.m for r in draws.where("param = 'betas'").groupBy("i").agg(F.avg("value").alias("m")).collect()}
    assert mean[1] == pytest.approx(fit.coefficients[1], abs=0.02)
    again = H.draw_posterior(spark, fit, n_draws=400, draws_per_point=8)
    assert draws.exceptAll(again).count() == 0


def test_random_intercept_matches_direct_laplace(spark, simulation):
    """The fitted value beats every nearby value of a local evaluation of the criterion."""
    data, patterns, *_ = simulation
    named = data.select(F.concat(F.lit("a"), F.lpad(F.col("adm2_index").cast("string"), 2, "0")).alias("area"), "x1", "x2", "y")
    fit = H.fit_random_intercept(named, ["x1", "x2"], "y", "area")
    assert fit.converged
    p = patterns.groupBy("adm2_index", "x1", "x2").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    area, x = p.adm2_index.to_numpy() - 1, p[["x1", "x2"]].to_numpy()
    n, y = p.n.to_numpy(float), p.y.to_numpy(float)

    def criterion(coefficients, sigma):
        u = np.zeros(12)
        fixed = coefficients[0] + x @ coefficients[1:]
        for _ in range(50):
            q = 1 / (1 + np.exp(-(fixed + u[area])))
            g = np.bincount(area, y - n * q, 12) - u / sigma**2
            w = np.bincount(area, n * q * (1 - q), 12)
            u = u + g / (w + 1 / sigma**2)
        eta = fixed + u[area]
        return np.sum(y * eta - n * np.log1p(np.exp(eta))) - 0.5 * np.sum(u**2) / sigma**2 - 0.5 * np.sum(np.log1p(sigma**2 * w))

    best = criterion(fit.coefficients, fit.sigma)
    assert best == pytest.approx(fit.log_lik, abs=1e-4)
    for k in range(3):
        for step in (0.01, -0.01):
            assert criterion(fit.coefficients + np.eye(3)[k] * step, fit.sigma) < best
    for factor in (1.03, 0.97):
        assert criterion(fit.coefficients, fit.sigma * factor) < best
    scored = H.score_random_intercept(
        fit, local_table(spark, [("a01", 1.0, 0.0), ("new", 1.0, 0.0)], "area string, x1 double, x2 double"), ["x1", "x2"], "area"
    )
    got = {r.area: r.p_cell for r in scored.collect()}
    at_zero = 1 / (1 + math.exp(-(fit.coefficients[0] + fit.coefficients[1])))
    assert got["new"] == pytest.approx(at_zero)


def test_weighted_logistic_score_equations(spark, simulation):
    from mosarea.operators import glm

    data, *_ = simulation
    df = data.withColumns({"w": 1 + F.col("adm2_index") % 3, "g": F.concat(F.lit("g"), F.col("adm2_index") % 4)})
    model = glm.fit_logistic(df, "y", ["x1", "g"], "w")
    scored = df.join(
        glm.score_logistic(model, df.select("adm2_index", "x1", "g").distinct(), ["x1", "g"], ["adm2_index", "x1", "g"]),
        ["adm2_index", "x1", "g"],
    )
    gap = scored.select((F.col("w") * (F.col("y") - F.col("p_cell"))).alias("r"), "x1", "g")
    total = gap.agg(F.sum("r"), F.sum(F.col("r") * F.col("x1")), F.sum(F.when(F.col("g") == "g2", F.col("r")))).first()
    assert max(abs(v) for v in total) < 1e-5
    missing = glm.score_logistic(
        model, local_table(spark, [(1, None, "g1"), (2, 1.0, "g1")], "k int, x1 double, g string"), ["x1", "g"], ["k"]
    )
    assert {r.k: r.p_cell is None for r in missing.collect()} == {1: True, 2: False}


def square_at(x, y, size, turn=1):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)][::turn]


@pytest.mark.parametrize("square_edges", [1, 32])
def test_district_inside_another(spark, square_edges):
    """A ring inside the first is a hole, one in the hole is inside again, a far one another part."""
    rings = [(1, 1, square_at(0.0, 0.0, 4.0)), (1, 2, square_at(1.0, 1.0, 2.0)), (2, 1, square_at(1.0, 1.0, 2.0)), (1, 3, square_at(6.0, 0.0, 1.0)), (1, 4, square_at(1.5, 1.5, 1.0))]
    districts = spark.createDataFrame(rings, "adm2_index int, ring_no int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, 1.2, 2.0), (3, 3.5, 3.5), (4, 6.5, 0.5), (5, 5.0, 0.5), (6, 2.0, 2.0), (7, None, 1.0), (8, -3.0, 0.5), (9, 0.5, 99.0)], "pt int, x double, y double"
    )
    found = {}
    for r in G.assign_points(points, G.ring_edges(districts), "x", "y", square_edges=square_edges).collect():
        found.setdefault(r["pt"], set()).add(r["adm2_index"])
    assert found == {1: {1}, 2: {2}, 3: {1}, 4: {1}, 5: {None}, 6: {1, 2}, 7: {None}, 8: {None}, 9: {None}}
    empty = G.assign_points(points, G.ring_edges(districts.limit(0)), "x", "y")
    assert empty.count() == 9 and empty.where("adm2_index is not null").count() == 0


def test_hole_counts_against_the_centroid(spark):
    for turn in (1, -1):
        rings = [(1, 1, square_at(0.0, 0.0, 4.0)), (1, 2, square_at(2.0, 1.0, 1.0, turn)), (2, 1, square_at(5.0, 0.0, 2.0, turn)), (2, 2, square_at(9.0, 0.0, 2.0))]
        districts = spark.createDataFrame(rings, "adm2_index int, ring_no int, ring array<struct<x: double, y: double>>")
        found = {r.adm2_index: (r.lon, r.lat) for r in G.centroids(G.ring_edges(districts)).collect()}
        assert found[1] == pytest.approx(((16 * 2 - 2.5) / 15, (16 * 2 - 1.5) / 15)) and found[2] == pytest.approx((8.0, 1.0))


def test_quadtree_equals_ray_casting(spark):
    """Detailed borders next to plain ones, squares of many sizes."""
    rng = np.random.default_rng(4)
    districts = []
    for k in range(12):
        n = 400 if k == 0 else int(rng.integers(3, 9))
        angles, radius = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1.0, n) * (0.4 if k == 0 else 3.0)
        x, y = rng.uniform(0, 10, 2)
        districts.append((k, [(float(x + r * np.cos(a)), float(y + r * np.sin(a))) for a, r in zip(angles, radius)]))
    edges = G.ring_edges(spark.createDataFrame(districts, "adm2_index int, ring array<struct<x: double, y: double>>"))
    at = rng.uniform(-2, 12, (1500, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "pt int, x double, y double")

    def inside(ring, x, y):
        crossed = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                crossed = not crossed
        return crossed

    expected = {(k, d) for k, (x, y) in enumerate(at) for d, ring in districts if inside(ring, x, y)}
    tree = G.Quadtree(edges, "adm2_index", 8)
    assert len(tree.levels) > 3
    found = G.assign_points(points, edges, "x", "y", square_edges=8).where("adm2_index is not null")
    assert {(r.pt, r.adm2_index) for r in found.collect()} == expected and len(expected) > 400


def test_block_scoring_names_a_month_without_effect(spark):
    draws = Pr.DistrictDraws(7, np.array([1, 2]), np.array([1, 2, 4]), np.ones((2, 3)), np.ones((2, 1)))
    with pytest.raises(ValueError, match="district 7 .* month 3"):
        draws.month_positions(np.array([1, 3]))
    assert list(draws.month_positions(np.array([1, 4]))) == [0, 2]


# ------------------------------------------------------------ block elimination
def dense_system(system, log_sigma):
    """Precision, linear term and value with every parameter in one dense matrix."""
    layout, c = system.layout, system.cells
    s, ns, nt = layout.slices(), layout.n_areas, layout.n_months
    area, month = np.divmod(np.arange(ns * nt), nt)
    x = np.zeros((ns * nt, layout.size))
    rows = np.arange(ns * nt)
    psi = s["psi"].start + np.array(layout.place)[area] * nt + month
    for column in (np.zeros_like(area), s["phi"].start + area, s["theta"].start + area, s["nu"].start + month, s["xi"].start + month, psi):
        x[rows, column] = 1.0
    beta = slice(1, 1 + layout.n_cov)
    w, wx = c.weight.ravel(), c.weight_x.reshape(-1, layout.n_cov)
    information = x.T @ (w[:, None] * x)
    information[:, beta] += x.T @ wx
    information[beta, :] += (x.T @ wx).T
    information[beta, beta] += c.weight_xx
    linear = x.T @ c.work.ravel()
    linear[beta] += c.work_x
    prior = np.zeros_like(information)
    prior[s["fixed"], s["fixed"]] = np.eye(1 + layout.n_cov) / 25.0
    smooth = {"phi": system.areas, "nu": system.months}
    for name, value in zip(B.EFFECTS, log_sigma):
        block = (smooth[name].vectors * smooth[name].values) @ smooth[name].vectors.T if name in smooth else np.eye(layout.sizes()[name])
        prior[s[name], s[name]] = block * np.exp(-2.0 * value)
    precision = information + prior
    value = 0.5 * linear @ np.linalg.solve(precision, linear) - 0.5 * np.linalg.slogdet(precision)[1] + system.log_hyper(log_sigma)
    return precision, linear, prior, value - sum(layout.sizes()[n] * v for n, v in zip(B.EFFECTS, log_sigma))


def random_system(rng, place, n_months, n_cov, hyper="pc_precision"):
    n_areas = len(place)
    w = rng.uniform(0.5, 20.0, (n_areas, n_months))
    w[0, 0] = 0.0  # a cell without interviews
    share = rng.uniform(0.1, 0.9, (n_areas, n_months, n_cov)) * (w[..., None] > 0)
    xx = np.einsum("st,stb,stc->bc", w, share, share) + np.diag(np.einsum("st,stb->b", w, share * (1 - share)))
    cells = B.Cells(w, w[..., None] * share, rng.normal(0, 3, w.shape) * (w > 0), xx, rng.normal(0, 5, n_cov))
    layout = B.Layout(n_cov, n_areas, n_months, tuple(place))
    return B.BlockSystem(layout, [(a, a + 1) for a in range(1, n_areas - 1)], hyper, cells)  # the last area has no neighbour


@pytest.mark.parametrize("place", [[0, 0, 1, 1, 2], [0, 1, 2, 3, 4], [0, 0, 0, 0, 0]])
def test_block_elimination_equals_the_dense_system(place):
    system = random_system(np.random.default_rng(len(set(place))), place, 4, 3)
    points = [np.log([0.5, 0.4, 0.7, 0.3, 0.2]), np.log([1.5, 0.1, 0.2, 2.0, 0.9]), np.full(5, -3.0)]
    shifts = []
    for log_sigma in points:
        precision, linear, prior, value = dense_system(system, log_sigma)
        mode = system.mode(log_sigma)
        assert np.allclose(mode, np.linalg.solve(precision, linear), atol=1e-8)
        assert system.penalty(mode, log_sigma) == pytest.approx(0.5 * mode @ prior @ mode, rel=1e-8)
        assert np.allclose(system.layout.offset(mode)[1, 2], mode[0] + mode[system.layout.slices()["phi"]][1] + mode[system.layout.slices()["theta"]][1]
            + mode[system.layout.slices()["nu"]][2] + mode[system.layout.slices()["xi"]][2] + mode[system.layout.slices()["psi"]][place[1] * 4 + 2])
        shifts.append(system.log_marginal(log_sigma) - value)
    assert np.allclose(shifts, shifts[0], atol=1e-7)


def test_block_draws_have_the_dense_covariance():
    system, log_sigma = random_system(np.random.default_rng(5), [0, 0, 1], 2, 1), np.log([0.5, 0.4, 0.7, 0.3, 0.6])
    precision, linear, _, _ = dense_system(system, log_sigma)
    covariance = np.linalg.inv(precision)
    draws = system.draw(log_sigma, np.random.default_rng(1), 40000)
    scale = np.sqrt(np.diag(covariance))
    assert np.max(np.abs(draws.mean(axis=0) - covariance @ linear) / scale) < 0.03
    assert np.max(np.abs(np.cov(draws.T) - covariance) / np.outer(scale, scale)) < 0.03
    again = system.draw(log_sigma, np.random.default_rng(1), 40000)
    assert np.array_equal(draws, again)


def test_design_follows_a_skew_marginal():
    """A split normal target is found again, and the weights are then even."""
    center, up, down = np.array([0.2, -1.0]), np.array([0.5, 0.2]), np.array([0.9, 0.4])
    target = lambda v: -0.5 * float(np.sum(((v - center) / np.where(v > center, up, down)) ** 2))
    design = B.Design.around(target, center, h=1e-3)
    points = [design.point(np.random.default_rng([3, k])) for k in range(4000)]
    log_weights = np.array([target(p) - q for p, q in points])
    assert np.std(log_weights) < 1e-6
    values = np.array([p for p, _ in points])
    assert np.mean(values[:, 0] > 0.2) == pytest.approx(0.5 / 1.4, abs=0.03)
    # weights repair a wrong design
    wide = B.Design(center, np.eye(2), np.array([1.0, 1.0]), np.array([1.0, 1.0]))
    points = [wide.point(np.random.default_rng([4, k])) for k in range(20000)]
    w = np.exp([target(p) - q for p, q in points])
    mean = np.average([p for p, _ in points], axis=0, weights=w)
    assert np.allclose(mean, center + np.sqrt(2 / np.pi) * (up - down), atol=0.03)


def test_draws_are_shared_out_by_weight():
    counts = B.shares(np.log([0.1, 0.2, 0.7, 1e-9]), 1000, 0.5)
    assert list(counts) == [100, 200, 700, 0]
    assert B.shares(np.array([5.0]), 7, 0.99).sum() == 7


def test_standard_deviation_at_its_bound_is_an_error(spark, simulation, monkeypatch):
    _, patterns, regions, edges, *_ = simulation
    monkeypatch.setattr(H, "LOG_SIGMA", (-1.0, 3.0))
    with pytest.raises(ValueError, match="xi.* at the bound"):
        H.fit_hierarchical(patterns, regions, edges, 2, 10)


def test_scoring_forms_agree(spark):
    """Relational and streamed scoring, three responses, weights of one, few and many groups."""
    rng = np.random.default_rng(2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2)], "adm2_index int, adm1_index int")
    params = [("b0", None, None), ("betas", 1, None), ("betas", 2, None)]
    params += [(p, k, None) for p, n in (("phi", 3), ("theta", 3), ("nu", 4), ("xi", 4)) for k in range(1, n + 1)]
    params += [("psi", t, p) for t in range(1, 5) for p in (1, 2)]
    draws = local_table(spark, [(d, *p, float(rng.normal(0, 0.5))) for d in range(1, 8) for p in params], "draw int, param string, i int, j int, value double")
    rows = [(int(rng.choice([1, 1, 1, 2])), int(rng.integers(1, 5)), k, float(rng.integers(0, 4)), float(rng.integers(0, 2)), float(rng.normal())) for k in range(300)]
    table = spark.createDataFrame(rows, "adm2_index int, month_idx int, unit_key int, w double, x1 double, x2 double")
    show = lambda df: {tuple(r[k] for k in Pr.RESULT_KEYS): [r[c] for c in df.columns if c.startswith("prev")] for r in df.collect()}
    for response in Pr.RESPONSES:
        for both in ((Pr.mr_estimate, Pr.mr_estimate_blocks), (Pr.mrp_estimate, Pr.mrp_estimate_blocks)):
            frame = table.drop("month_idx") if both[0] is Pr.mrp_estimate else table
            plain, streamed = (show(f(frame, draws, 2, regions, response, "w")) for f in both)
            assert plain.keys() == streamed.keys() and len(plain) > 20
            assert all(np.allclose(plain[k], streamed[k], atol=1e-12, equal_nan=True) for k in plain if plain[k][0] is not None)
    with pytest.raises(Exception, match="not a whole number"):
        Pr.mr_estimate_blocks(table.withColumn("w", F.lit(1.5)), draws, 2, regions, "binomial", "w").collect()


def test_random_intercept_scores_notice_a_wrong_coefficient(spark, simulation):
    import dataclasses

    data, *_ = simulation
    named = data.select(F.concat(F.lit("a"), F.lpad(F.col("adm2_index").cast("string"), 2, "0")).alias("area"), "x1", "x2", "y")
    fit = H.fit_random_intercept(named, ["x1", "x2"], "y", "area")
    scores = lambda f: {r.term: r.score for r in H.random_intercept_scores(f, named, ["x1", "x2"], "y", "area").collect()}
    at_fit = scores(fit)
    assert set(at_fit) == {"intercept", "x1", "x2", "log_sigma"}
    assert max(abs(at_fit[t]) for t in ("intercept", "x1", "x2")) < 40000 * 1e-6 and abs(at_fit["log_sigma"]) < 12 * 5e-5
    for k, term in enumerate(("intercept", "x1", "x2")):
        moved = dataclasses.replace(fit, coefficients=fit.coefficients + 0.01 * np.eye(3)[k])
        assert abs(scores(moved)[term]) > 40000 * 1e-4
    assert abs(scores(dataclasses.replace(fit, sigma=fit.sigma * 1.05))["log_sigma"]) > 12 * 1e-2


@pytest.mark.parametrize("solver", ["newton", "gradients"])
def test_raking_at_many_levels(spark, solver):
    """5,000 districts: the driver holds vectors over levels, margins are met to the tolerance."""
    districts, answers = 5000, 4
    frame = spark.range(districts * answers * 2).select(
        F.format_string("d%05d", F.col("id") % districts).alias("d"),
        (F.floor(F.col("id") / districts) % answers).cast("string").alias("a"),
        F.floor(F.col("id") / (districts * answers)).cast("string").alias("s"),
        (1 + F.col("id") * 7919 % 13).cast("double").alias("pop_weight"),
    )
    margin = lambda v, f: Rk.Margin((v,), frame.select(v).distinct().withColumn("freq", f))
    wanted = [
        margin("d", 1.0 + F.crc32("d") % 7),
        margin("a", 1.0 + F.col("a").cast("double")),
        margin("s", F.when(F.col("s") == "0", 0.3).otherwise(0.7)),
    ]
    done = Rk.rake(frame, wanted, solver=solver)
    check = Rk.raking_check(done.weighted, wanted)
    assert done.converged and check.agg(F.max(F.abs("diff"))).first()[0] < 1e-9 and check.count() == districts + answers + 2
    assert done.weighted.agg(F.avg("pop_weight")).first()[0] == pytest.approx(1.0)


def keyed_draws(spark, n_draws, n_areas, n_months, n_places):
    """Draws unfolded from few numbers: their plan looks as small as the numbers."""
    sizes = {"b0": 0, "betas": 2, "phi": n_areas, "theta": n_areas, "nu": n_months, "xi": n_months}
    rows = [(p, None if n == 0 else k, None) for p, n in sizes.items() for k in range(1, max(n, 1) + 1)]
    rows += [("psi", k, j) for k in range(1, n_months + 1) for j in range(1, n_places + 1)]
    index = local_table(spark, rows, "param string, i int, j int")
    one = index.agg(F.collect_list(F.struct("param", "i", "j"))).scalar()
    draws = spark.range(1, n_draws + 1).select(F.col("id").cast("int").alias("draw"), F.explode(one).alias("s")).select("draw", "s.*")
    value = F.sin(F.col("draw") * 0.7 + F.coalesce("i", F.lit(0)) * 1.3 + F.coalesce("j", F.lit(0)) * 0.9 + F.ascii(F.substring("param", 2, 1))) * 0.5
    return cut_lineage(draws.withColumn("value", value))


def test_draws_do_not_pass_the_driver(spark):
    """Draws come from few suppliers, so the plan takes them for small: no join may send them to all."""
    draws = keyed_draws(spark, 200, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    packed = Pr.packed_draws(draws, 2, regions)
    assert packed._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 1  # the districts
    unfolded = packed.select("adm2_index", "draw", F.explode(F.arrays_zip("m", "e")).alias("x")).select("adm2_index", F.col("x.m").alias("month_idx"), "draw", F.round("x.e", 9).alias("effect"))
    effects = Pr.effect_table(draws, regions).select("adm2_index", "month_idx", "draw", F.round("effect", 9).alias("effect"))
    assert packed.count() == 800 and effects.count() == 2400
    assert unfolded.exceptAll(effects).isEmpty()


def test_few_rows_meet_shares_of_the_draws(spark):
    draws = keyed_draws(spark, 500, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    rows = local_table(spark, [(a, m, float(a + m), float(m), 10 * a + m) for a in (1, 2, 3) for m in (1, 3)], "adm2_index int, month_idx int, x1 double, x2 double, unit_key int")
    unit = Pr.score_rows(rows, 2, F.lit(1.0), F.col("unit_key"), "month_idx")
    packed = Pr.packed_draws(draws, 2, regions)
    make = lambda found: Pr.PrevalenceSums(found, "pr", True, 1234)
    sums = Pr.meet_draws(unit, packed, Pr.draw_count(draws), 2, make, Pr.SUMS)
    # each district's draws are dealt out once, in several shares
    assert sums.count() == sums.select("adm2_index", "month_idx", "draw").distinct().count() == 3 * 2 * 500
    blocks = Pr.mr_estimate_blocks(rows, draws, 2, regions, response="binary")
    plain = Pr.mr_estimate(rows, draws, 2, regions, response="binary")
    shown = lambda df: df.select("adm2_index", "month_idx", "draw", F.round("prev", 9).alias("prev"), F.round("prev2", 9).alias("prev2"))
    assert blocks.count() == 3000 and shown(blocks).exceptAll(shown(plain)).isEmpty()


def test_settled_draws_serve_several_models(spark):
    """Packed once for the chosen months; each model takes its leading coefficients and packs nothing again."""
    draws = keyed_draws(spark, 50, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    months = local_table(spark, [(1,), (3,)], "month_idx int")
    settled = Pr.settle_draws(draws, 2, regions, months=months)
    # a key twice, a weight of zero, a district with a single row
    rows = local_table(
        spark,
        [(a, m, float(a + m), float(m), u, float(u % 3)) for a in (1, 2) for m in (1, 3) for u in (7, 7, 9, 11)] + [(3, 1, 0.5, -1.0, 4, 2.0)],
        "adm2_index int, month_idx int, x1 double, x2 double, unit_key int, w double",
    )
    cells = rows.where("month_idx = 1").drop("month_idx")
    shown = lambda df: df.select("adm2_index", "month_idx", "draw", F.round("prev", 9).alias("prev"), F.round("prev2", 9).alias("prev2"))
    for n in (1, 2):
        shared = Pr.mr_estimate_blocks(rows, settled, n, regions, weight="w")
        plain = Pr.mr_estimate(rows, draws, n, regions, weight="w")
        assert shared.count() == 5 * 50 and shown(shared).exceptAll(shown(plain)).isEmpty()
        assert "param#" not in shared._jdf.queryExecution().optimizedPlan().toString()
        shared = Pr.mrp_estimate_blocks(cells, settled, n, regions, weight="w")
        plain = Pr.mrp_estimate(cells, draws, n, regions, weight="w").join(months, "month_idx", "left_semi")
        assert shared.count() == 3 * 2 * 50 and shown(shared).exceptAll(shown(plain)).isEmpty()
    with pytest.raises(ValueError, match="settled"):
        Pr.mr_estimate_blocks(rows, settled, 3, regions)
    with pytest.raises(ValueError, match="months"):
        Pr.mrp_estimate_blocks(cells, settled, 2, regions, months=months)


@pytest.mark.parametrize("odd", [False, True])
def test_likelihood_of_joined_rows(spark, odd):
    """The sums of the plain join for any draws and patterns, without a row per pattern and draw in the plan."""
    from mosarea.functions.expressions import bernoulli_logit_log_mass

    draws = keyed_draws(spark, 40, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    rows = [(a, m, a + 0.5, float(m), 4.0, float(m - 1)) for a in (1, 2, 3) for m in (1, 2, 3)] + [(1, 2, 0.5, -1.0, 2.5, 1.0)] * 2
    if odd:
        rows += [(None, 1, 1.0, 1.0, 2.0, 1.0), (1, None, 1.0, 1.0, 2.0, 1.0), (1, 1, None, 1.0, 2.0, 1.0), (2, 1, 1.0, 1.0, None, 1.0), (2, 1, 1.0, 1.0, 2.0, None)]
        rows += [(2, 9, 1.0, 1.0, 2.0, 1.0), (7, 1, 1.0, 1.0, 2.0, 1.0)]
        is_ = lambda draw, param, i=None: (F.col("draw") == draw) & (F.col("param") == param) & (F.lit(True) if i is None else F.col("i") == i)
        gone = is_(1, "b0") | is_(2, "betas", 1) | is_(3, "nu", 2) | (is_(3, "xi", 2)) | is_(4, "psi", 1) | is_(5, "phi", 2) | is_(5, "theta", 2) | is_(6, "b0") | is_(6, "betas") | is_(7, "psi")
        gone |= F.col("draw") == 8
        null = is_(9, "psi", 1) | is_(10, "b0") | is_(11, "nu", 3) | is_(11, "xi", 3) | is_(12, "phi", 1)
        draws = draws.where(~gone).withColumn("value", F.when(~null, F.col("value")))
        repeated = draws.where("draw in (13, 14) or (draw = 15 and param = 'psi' and i = 2)").withColumn("value", F.col("value") + 0.25)
        loose = draws.where("draw = 16").withColumn("draw", F.lit(None).cast("int")).unionByName(draws.where("draw = 17 and param = 'psi'").withColumn("i", F.lit(None).cast("int")))
        draws = cut_lineage(draws.unionByName(repeated).unionByName(repeated.where("draw = 14")).unionByName(loose))
    patterns = local_table(spark, rows, "adm2_index int, month_idx int, x1 double, x2 double, n double, y double")
    eta = Pr.linear_predictor(patterns, draws, 2, regions)
    plain = eta.groupBy("draw").agg(F.sum(bernoulli_logit_log_mass(F.col("y"), F.col("n"), F.col("eta"))).alias("log_lik"))
    found = Lp.log_likelihood(patterns, draws, 2, regions)
    shown = lambda df: {r.draw: r.log_lik if r.log_lik is None else round(r.log_lik, 8) for r in df.collect()}
    assert found.columns == plain.columns and shown(found) == shown(plain)
    assert len(shown(plain)) == (37 if odd else 40)
    assert "month_idx" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("response", ["pr", "binary", "binomial"])
def test_poststratification_of_joined_rows(spark, response):
    """The numbers of the plain join for draws with missing months and nulls, without a row per cell and draw in the plan."""
    draws = keyed_draws(spark, 30, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    is_ = lambda draw, param, i=None: (F.col("draw") == draw) & (F.col("param") == param) & (F.lit(True) if i is None else F.col("i") == i)
    gone = is_(1, "b0") | is_(3, "nu", 2) | is_(3, "xi", 2) | is_(4, "psi", 1) | is_(5, "phi", 2) | is_(5, "theta", 2) | is_(6, "b0") | is_(6, "betas") | is_(7, "psi")
    null = is_(9, "psi", 1) | is_(10, "b0") | is_(11, "nu", 3) | is_(11, "xi", 3) | is_(12, "phi", 1)
    draws = cut_lineage(draws.where(~gone).withColumn("value", F.when(~null, F.col("value"))))
    rows = [(a, a + 0.5 * u, float(u) - 2, 10 * u + a, float(u)) for a in (1, 2) for u in (1, 2, 3)] + [(1, 0.5, 1.0, 12, 2.0)] * 2
    rows += [(None, 1.0, 1.0, 3, 1.0), (1, None, 1.0, 4, 3.0), (1, 1.0, 1.0, None, 2.0), (1, 1.0, 1.0, 5, None), (2, 1.0, 1.0, 6, 0.0), (3, 1.0, 1.0, 6, None), (4, None, 1.0, 6, 2.0)]
    cells = local_table(spark, rows, "adm2_index int, x1 double, x2 double, unit_key int, w double")
    joined = cells.join(Pr.effect_table(draws, regions), "adm2_index").join(Pr.coefficient_table(draws, 2), "draw")
    units = joined.withColumn("p", X.logistic(Pr.fixed_part(2) + F.col("effect")))
    plain = Pr.aggregate_draws(units, response, "unit_key", "w", 1234)
    found = Pr.mrp_estimate(cells, draws, 2, regions, response, weight="w")
    shown = lambda df: sorted(tuple(v if v is None or isinstance(v, int) else round(v, 9) for v in r) for r in df.fillna(-1.0).collect())
    assert found.columns == plain.columns and shown(found) == shown(plain) and found.count() > 200
    assert "unit_key" not in found._jdf.queryExecution().optimizedPlan().toString()
    if response == "pr":
        twice = draws.unionByName(draws.where("draw = 20 and param = 'psi' and i = 1"))
        with pytest.raises(Exception, match="twice"):
            Pr.mrp_estimate(cells, twice, 2, regions, response, weight="w").collect()


@pytest.mark.parametrize("odd", [False, True])
def test_units_summarised_over_draws(spark, odd):
    """What the rows of unit and draw give when grouped, for repeated units and any draws, without those rows in the plan."""
    draws = keyed_draws(spark, 40, 4, 3, 2)
    regions = local_table(spark, [(1, 1), (2, 1), (3, 2), (4, 2)], "adm2_index int, adm1_index int")
    rows = [(u, 1 + u % 3, 1 + u // 3 % 3, float(u % 2), u % 5 - 2.5) for u in range(30)] + [(5, 1, 1, 0.0, 0.5), (6, 1, 1, 0.0, 0.5), (6, 1, 1, 0.0, 0.5), (None, 1, 2, 0.0, 0.5)]
    if odd:
        rows += [(40, None, 1, 1.0, 1.0), (41, 1, None, 1.0, 1.0), (42, 1, 1, None, 1.0), (43, 2, 9, 1.0, 1.0), (44, 7, 1, 1.0, 1.0), (5, 1, 1, None, 1.0), (45, 4, 1, 2.0, 1.0)]
        is_ = lambda draw, param, i: (F.col("draw") == draw) & (F.col("param") == param) & (F.col("i") == i)
        gone = is_(3, "nu", 2) | is_(3, "xi", 2) | is_(4, "psi", 1) | is_(5, "phi", 2) | is_(5, "theta", 2) | (F.col("draw") == 8) | (F.col("param").isin("phi", "theta") & (F.col("i") == 3))
        null = is_(9, "psi", 1) | is_(10, "betas", 1) | is_(11, "nu", 3) | is_(11, "xi", 3) | (F.col("param").isin("phi", "theta") & (F.col("i") == 4))
        draws = draws.where(~gone).withColumn("value", F.when(~null, F.col("value")))
        draws = cut_lineage(draws.unionByName(draws.where("draw in (13, 14) or (draw = 15 and param = 'psi' and i = 2)").withColumn("value", F.col("value") + 0.25)))
    units = local_table(spark, rows, "household_id long, adm2_index int, month_idx int, x1 double, x2 double")
    plain = Pr.predict_units(units, draws, 2, regions).groupBy("household_id").agg(F.count("p"), F.sum("p"), F.min("p"), F.max("p"))
    once = Pr.predict_units(units, draws, 2, regions, summary=True)
    found = once.groupBy("household_id").agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high"))
    shown = lambda df: {r[0]: tuple(v if v is None else round(v, 9) for v in r[1:]) for r in df.collect()}
    assert shown(found) == shown(plain)
    assert once.columns == ["household_id", "adm2_index", "month_idx", "n", "total", "low", "high"]
    assert once.count() == (27 if odd else 34)


def test_factored_exponentials_equal_plain_sums():
    """Masses and unit summaries by products of exponentials; large exponents, gaps in chains and rows in several blocks are as exact."""
    rng = np.random.default_rng(5)
    n_draws, months = 150, np.array([2, 3, 7])
    x = rng.integers(0, 2, (900, 4)).astype(float)
    at = np.sort(rng.integers(0, 3, 900))
    n, betas, effects = rng.integers(1, 40, 900), rng.normal(0, 2, (n_draws, 5)), rng.normal(0, 2, (n_draws, 3))
    betas[3, 0], betas[70, 0], effects[90, 1] = 400.0, -250.0, -900.0  # sums of exponents beyond what a product can hold
    y = rng.integers(0, n + 1).astype(float)
    eta = x @ betas[:, 1:].T + betas[:, 0] + effects.T[at]
    mass = (y[:, None] * eta - n[:, None] * np.logaddexp(0.0, eta)).sum(axis=0)
    draws = Pr.JoinedDraws(1, np.arange(n_draws), months, effects, betas)
    blocks = lambda numbers, x: [Pr.RowBlock(months[at][k : k + 250], numbers[k : k + 250], y[k : k + 250], x[k : k + 250]) for k in range(0, 900, 250)]
    for sums, given in ((Lp.MassSums(draws), blocks(n, x)), (Lp.JoinedMassSums(draws), blocks(n * 0, np.column_stack([x, n])))):
        for block in given:
            sums.add(block, Lp.WHOLE)
        assert np.allclose(pa.Table.from_batches(sums.finish())["mass"].to_numpy(), mass, rtol=1e-13)
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    units = Pr.UnitSums(draws)
    for block in blocks(np.arange(900), x):
        units.add(block, Pr.COMPLETE)
    found = pa.Table.from_batches(units.finish()).sort_by("k")
    assert (found["n"].to_numpy() == n_draws).all()
    for name, value in (("total", p.sum(axis=1)), ("low", p.min(axis=1)), ("high", p.max(axis=1))):
        assert np.allclose(found[name].to_numpy(), value, rtol=1e-12, atol=1e-300)


def test_rows_with_the_same_answers_share_their_exponentials(monkeypatch):
    """One exponential per combination of answers and draw, and one logarithm per chain of rows: neither follows the rows."""
    counted = []
    for name in ("exp", "log"):
        original = getattr(np, name)
        monkeypatch.setattr(np, name, lambda v, *a, _f=original, **k: (counted.append(np.size(v)), _f(v, *a, **k))[1])
    rng, rows, n_draws = np.random.default_rng(6), 20_000, 20
    x, at = rng.integers(0, 2, (rows, 3)).astype(float), np.sort(rng.integers(0, 4, rows))
    draws = Pr.DistrictDraws(1, np.arange(n_draws), np.arange(4), rng.normal(size=(n_draws, 4)), rng.normal(size=(n_draws, 4)))
    sums = Lp.MassSums(draws)
    sums.add(Pr.RowBlock(at, np.ones(rows, np.int64), np.ones(rows), x), Pr.PATTERN)
    list(sums.finish())
    assert sum(counted) < rows * n_draws / 10


def test_gradient_is_gathered_by_draw(spark):
    """Against finite differences of the density written out; the plan unfolds no sum into a row per parameter it belongs to."""
    rng = np.random.default_rng(8)
    places, pairs, months, n_x = {1: 1, 2: 1, 3: 2}, [(1, 2), (2, 3)], 3, 2
    names = [("b0", None, None), *[("betas", k, None) for k in (1, 2)], *[(p, a, None) for p in ("phi", "theta") for a in places]]
    names += [(p, t, None) for p in ("nu", "xi") for t in range(1, months + 1)] + [("psi", t, j) for t in range(1, months + 1) for j in (1, 2)]
    values = {d: {**{k: float(rng.normal(0, 0.5)) for k in names}, **{(s, None, None): float(rng.uniform(0.5, 1.5)) for s in Lp.SIGMAS}} for d in range(1, 6)}
    table = [(d, *k, v) for d, own in values.items() for k, v in own.items()] + [(None, "betas", 1, None, 2.0), (None, "phi", 1, None, 2.0)]
    draws = local_table(spark, table, "draw int, param string, i int, j int, value double")
    rows = [(a, t, float(rng.integers(0, 2)), float(rng.normal()), int(rng.integers(1, 9))) for a in (1, 2) for t in (1, 3) for _ in range(3)]
    rows = [(*r, int(rng.integers(0, r[4] + 1))) for r in rows]
    patterns = local_table(spark, [(a, places[a], *r) for a, *r in rows], "adm2_index int, adm1_index int, month_idx int, x1 double, x2 double, n long, y long")
    regions = local_table(spark, list(places.items()), "adm2_index int, adm1_index int")
    edges = local_table(spark, pairs, "node1 int, node2 int")

    def density(v):
        u = lambda p, i, j=None: v[p, i, j] / v[f"sigma_{p}", None, None]
        total = -0.5 * sum(v[k] ** 2 for k in names if k[0] in ("b0", "betas")) / 25
        total -= 0.5 * sum(u(*k) ** 2 for k in names if k[0] in Lp.INDEPENDENT) + 0.5 * sum((u("phi", a) - u("phi", b)) ** 2 for a, b in pairs)
        total -= 0.5 * sum((u("nu", t) - (u("nu", t - 1) if t > 1 else 0.0)) ** 2 for t in range(1, months + 1))
        total -= 0.5 * (sum(u("phi", a) for a in places) / (0.001 * len(places))) ** 2 + 0.5 * (sum(u("nu", t) for t in range(1, months + 1)) / (0.01 * months)) ** 2
        for a, t, x1, x2, n, y in rows:
            eta = v["b0", None, None] + x1 * v["betas", 1, None] + x2 * v["betas", 2, None]
            eta += sum(v[p, a, None] for p in ("phi", "theta")) + sum(v[p, t, None] for p in ("nu", "xi")) + v["psi", t, places[a]]
            total += y * eta - n * np.logaddexp(0.0, eta)
        return total

    gradient = Lp.log_posterior_gradient(patterns, draws, edges, n_x, regions)
    plan = gradient._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 0 and "explode(array(struct" not in plan and "[param#" not in "".join(line for line in plan.splitlines() if "Join" in line)
    found = {(r.draw, r.param, r.i, r.j): r.gradient for r in gradient.collect()}
    assert found.pop((None, "betas", 1, None)) == -2.0 / 25
    assert found.keys() == {(d, *k) for d in values for k in names}
    for (d, *k), g in found.items():
        step = lambda h: density(values[d] | {tuple(k): values[d][tuple(k)] + h})
        assert g == pytest.approx((step(1e-4) - step(-1e-4)) / 2e-4, rel=1e-5, abs=1e-5)

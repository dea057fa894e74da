"""Hierarchical logistic models fitted by distributed Newton passes.

The data enter as likelihood patterns. One pass is a Spark aggregate: tasks
reduce their rows to sums per (area, month), Spark adds the sums up, and at
most areas x months rows of first and second derivatives come back, however
many interviews there are. The driver solves by block elimination, dense only in
covariates, areas and months.

The posterior is approximate: Gaussian at the mode (Laplace), mixed over the
standard deviations of the effects (Rue, Martino and Chopin 2009). It is not a
sampler.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosarea.functions.expressions import logistic
from mosarea.operators.blocksolve import EFFECTS, BlockSystem, Cells, Design, Layout, shares
from mosarea.session import cut_lineage, ship_package
from mosarea.sources.tables import local_table

#: bounds of the log standard deviations; a fit that ends at one is an error
LOG_SIGMA = (-8.0, 3.0)


# ------------------------------------------------------------ distributed pass
@dataclass
class Derivatives:
    """Sums at one parameter value, per cell (area, month) and over all data."""

    residual: np.ndarray
    weight: np.ndarray
    third: np.ndarray
    weight_x: np.ndarray
    third_x: np.ndarray
    residual_x: np.ndarray
    weight_xx: np.ndarray
    log_lik: float
    log_lik_cell: np.ndarray = field(repr=False)


def derivative_table(patterns: DataFrame, n_months: int, beta: np.ndarray, offset: np.ndarray) -> DataFrame:
    """``slot, v0, v1, ..`` at one parameter value; slots are cells, negative ones covariates.

    ``patterns`` is ``(adm2_index, month_idx, x1..xB, n, y)``, ``offset`` the areas x months matrix of
    everything in the predictor that does not multiply a covariate.
    """
    ship_package(patterns.sparkSession)
    n_cov = len(beta)
    width = 4 + 2 * n_cov
    return (
        patterns.select("adm2_index", "month_idx", "n", "y", *[f"x{k}" for k in range(1, n_cov + 1)])
        .mapInArrow(_partial_sums(beta, offset, n_months), "slot int, " + ", ".join(f"v{k} double" for k in range(width)))
        .groupBy("slot")
        .agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(width)])
        .select("slot", *[f"v{k}" for k in range(width)])
    )


def read_derivatives(summed: pa.Table, n_cells: int, n_cov: int) -> Derivatives:
    width = 4 + 2 * n_cov
    slot = summed.column("slot").to_numpy()
    values = np.column_stack([summed.column(f"v{k}").to_numpy() for k in range(width)])
    cells = np.zeros((n_cells, width))
    cells[slot[slot >= 0]] = values[slot >= 0]
    cross = np.zeros((n_cov, width))
    cross[-slot[slot < 0] - 1] = values[slot < 0]
    return Derivatives(
        residual=cells[:, 0],
        weight=cells[:, 1],
        third=cells[:, 2],
        weight_x=cells[:, 4 : 4 + n_cov],
        third_x=cells[:, 4 + n_cov :],
        residual_x=cross[:, 0],
        weight_xx=cross[:, 4 : 4 + n_cov],
        log_lik=float(cells[:, 3].sum()),
        log_lik_cell=cells[:, 3],
    )


def derivatives(patterns: DataFrame, n_months: int, beta: np.ndarray, offset: np.ndarray) -> Derivatives:
    """One pass over the patterns, see :func:`derivative_table`."""
    return read_derivatives(derivative_table(patterns, n_months, beta, offset).toArrow(), offset.size, len(beta))


def _partial_sums(beta: np.ndarray, offset: np.ndarray, n_months: int):
    n_cov = len(beta)
    width = 4 + 2 * n_cov
    flat = offset.ravel()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((flat.size, width))
        cross = np.zeros((n_cov, width))
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            cell = ((column("adm2_index") - 1) * n_months + column("month_idx") - 1).astype(np.int64)
            n, y = column("n"), column("y")
            x = np.column_stack([column(f"x{k}") for k in range(1, n_cov + 1)]) if n_cov else np.zeros((len(n), 0))
            eta = x @ beta + flat[cell]
            p = 1.0 / (1.0 + np.exp(-eta))
            residual, weight = y - n * p, n * p * (1.0 - p)
            third = weight * (1.0 - 2.0 * p)
            mass = y * eta - n * (np.maximum(eta, 0.0) + np.log1p(np.exp(-np.abs(eta))))
            columns = [residual, weight, third, mass, *(weight[:, None] * x).T, *(third[:, None] * x).T]
            for k, values in enumerate(columns):
                cells[:, k] += np.bincount(cell, values, flat.size)
            cross[:, 0] += residual @ x
            cross[:, 4 : 4 + n_cov] += x.T @ (weight[:, None] * x)
        if not seen:
            return
        used = np.flatnonzero(np.any(cells != 0.0, axis=1))
        slots = np.concatenate([used, -np.arange(1, n_cov + 1)]).astype(np.int32)
        rows = np.vstack([cells[used], cross])
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), *[pa.array(rows[:, k].copy()) for k in range(width)]],
            names=["slot", *[f"v{k}" for k in range(width)]],
        )

    return reduce


# ------------------------------------------------------------ full model (M6)
@dataclass
class HierarchicalFit:
    """Mode and marginal of the standard deviations; ``cells`` is the table of derivatives at the mode."""

    layout: Layout
    edges: list[tuple[int, int]]
    hyper: str
    mode: np.ndarray
    log_sigma: np.ndarray
    design: Design
    cells: DataFrame = field(repr=False)
    log_lik: float
    log_prior: float
    passes: int
    converged: bool

    @property
    def sigma(self) -> dict[str, float]:
        return dict(zip(EFFECTS, np.exp(self.log_sigma)))

    @property
    def coefficients(self) -> np.ndarray:
        return self.mode[: 1 + self.layout.n_cov]

    def mode_draws(self, spark: SparkSession) -> DataFrame:
        """The mode as one long draw ``(draw, param, i, j, value)``."""
        labels = _parameter_labels(self.layout)
        values = [*map(float, self.mode), *map(float, np.exp(self.log_sigma))]
        return local_table(spark, [(1, *row) for row in zip(*labels, values)], "draw int, param string, i int, j int, value double")


def _search(function, start: np.ndarray, step: float, smallest: float) -> np.ndarray:
    """Coordinate pattern search."""
    best, point = function(start), start.copy()
    while step >= smallest:
        moved = False
        for k in range(len(point)):
            for sign in (1.0, -1.0):
                trial = point.copy()
                trial[k] = np.clip(trial[k] + sign * step, *LOG_SIGMA)
                value = function(trial)
                if value > best + 1e-10:
                    best, point, moved = value, trial, True
                    break
        if not moved:
            step /= 2.0
    return point


def _at_bound(log_sigma: np.ndarray) -> list[str]:
    low, high = LOG_SIGMA
    return [name for name, s in zip(EFFECTS, log_sigma) if s <= low + 1e-9 or s >= high - 1e-9]


def fit_hierarchical(
    patterns: DataFrame,
    regions: DataFrame,
    edges: DataFrame,
    n_covariates: int,
    n_months: int,
    hyper: str = "pc_precision",
    interaction: str = "adm1_index",
    tolerance: float = 1e-6,
    max_passes: int = 60,
) -> HierarchicalFit:
    """Mode, curvature and hyperparameter posterior of the hierarchical model.

    ``patterns`` as from the design step; ``regions`` holds the dense 1-based
    ``adm2_index`` and ``adm1_index``; ``edges`` the neighbour pairs. A standard
    deviation that ends at the bound of its range is an error.
    """
    places = regions.select("adm2_index", F.col(interaction).alias("place")).distinct().orderBy("adm2_index").collect()
    layout = Layout(n_covariates, len(places), n_months, tuple(r["place"] - 1 for r in places))
    pairs = [tuple(r) for r in edges.select("node1", "node2").collect()]
    frame = BlockSystem(layout, pairs, hyper)
    rows = cut_lineage(patterns)
    beta = slice(1, 1 + n_covariates)

    def expand(d: Derivatives, at: np.ndarray) -> BlockSystem:
        return frame.with_cells(Cells.at(d.residual, d.weight, d.weight_x, d.residual_x, d.weight_xx, at[beta], layout.offset(at)))

    theta = np.zeros(layout.size)
    log_sigma = np.full(len(EFFECTS), np.log(0.5))
    current = derivatives(rows, n_months, theta[beta], layout.offset(theta))
    passes, step, converged = 1, 0.5, False
    while passes < max_passes:
        system = expand(current, theta)
        new_sigma = _search(system.log_marginal, log_sigma, step, max(step / 8.0, 0.004))
        step = max(step / 2.0, 0.016)
        target = system.mode(new_sigma)
        before = current.log_lik - frame.penalty(theta, new_sigma)
        size = 1.0
        while True:
            trial = theta + size * (target - theta)
            found = derivatives(rows, n_months, trial[beta], layout.offset(trial))
            passes += 1
            if found.log_lik - frame.penalty(trial, new_sigma) >= before - 1e-9 or size < 1e-3 or passes >= max_passes:
                break
            size /= 2.0
        change = np.max(np.abs(layout.offset(trial) - layout.offset(theta)))
        change = max(change, float(np.max(np.abs(trial[beta] - theta[beta]), initial=0.0)))
        moved = float(np.max(np.abs(new_sigma - log_sigma)))
        theta, log_sigma, current = trial, new_sigma, found
        if change < tolerance and moved < 0.005:
            converged = True
            break
    if bound := _at_bound(log_sigma):
        raise ValueError(f"the log standard deviation of {', '.join(bound)} ends at the bound of {list(LOG_SIGMA)}")
    design = Design.around(expand(current, theta).log_marginal, log_sigma)
    cells = cut_lineage(derivative_table(rows, n_months, theta[beta], layout.offset(theta)))
    return HierarchicalFit(
        layout, pairs, hyper, theta, log_sigma, design, cells, current.log_lik, frame.log_prior(theta, log_sigma), passes, converged
    )


def _with_system(fit: HierarchicalFit, tasks: int, points: Sequence[tuple], work, schema: str) -> DataFrame:
    """``work(system, points of the task)`` in ``tasks`` tasks that read the table of derivatives.

    The table goes to each task once; effects at the mode, bounded by geography and calendar, are in the
    function's closure.
    """
    layout, edges, hyper, mode = fit.layout, fit.edges, fit.hyper, fit.mode
    n_cells = layout.n_areas * layout.n_months
    beta, offset = mode[1 : 1 + layout.n_cov], layout.offset(mode)
    dealt = [list(points[k::tasks]) for k in range(tasks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, task, parts = None, None, []

        def finish():
            nonlocal frame
            frame = frame or BlockSystem(layout, edges, hyper)
            d = read_derivatives(pa.Table.from_batches(parts), n_cells, layout.n_cov)
            cells = Cells.at(d.residual, d.weight, d.weight_x, d.residual_x, d.weight_xx, beta, offset)
            return work(frame.with_cells(cells), dealt[task])

        for batch in batches:
            ids = batch.column("__task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end > start:
                    if task is not None and ids[start] != task:
                        yield from finish()
                        parts = []
                    task = int(ids[start])
                    parts.append(batch.slice(start, end - start))
        if parts:
            yield from finish()

    spread = fit.cells.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return spread.repartitionByRange(tasks, "__task").sortWithinPartitions("__task").mapInArrow(run, schema)


def integration_points(spark: SparkSession, fit: HierarchicalFit, n_points: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the log standard deviations from keyed numbers, and their log weights against the exact marginal."""
    design = fit.design

    def weigh(system: BlockSystem, own: list) -> Iterator[pa.RecordBatch]:
        values = []
        for k in own:
            point, log_density = design.point(np.random.default_rng([seed, k]))
            values.append(system.log_marginal(point) - log_density)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(values, pa.float64())], names=["k", "w"])

    tasks = min(n_points, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _with_system(fit, tasks, range(n_points), weigh, "k int, w double").toArrow()
    log_weights = np.empty(n_points)
    log_weights[found.column("k").to_numpy()] = found.column("w").to_numpy()
    return np.array([design.point(np.random.default_rng([seed, k]))[0] for k in range(n_points)]), log_weights


def draw_posterior(
    spark: SparkSession, fit: HierarchicalFit, n_draws: int = 4000, draws_per_point: int = 20, seed: int = 1234
) -> DataFrame:
    """Long draws ``(draw, param, i, j, value)`` from the Gaussian mixture.

    The standard deviations are integrated over ``n_draws / draws_per_point`` points, so their number
    grows with the draws: points come from keyed numbers, are weighted by the exact Laplace marginal and get draws in
    proportion. A point's draws have numbers of their own, so a repeated task repeats them.
    """
    points, log_weights = integration_points(spark, fit, max(1, -(-n_draws // draws_per_point)), seed)
    counts = shares(log_weights, n_draws, float(np.random.default_rng([seed, -1 % 2**32]).random()))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    used = [(int(k), points[k], int(counts[k]), int(first[k])) for k in np.flatnonzero(counts)]

    def sample(system: BlockSystem, own: list) -> Iterator[pa.RecordBatch]:
        names, i, j = _parameter_labels(system.layout)
        labels = pa.array(names), pa.array(i, pa.int32()), pa.array(j, pa.int32())
        for k, log_sigma, count, before in own:
            values = system.draw(log_sigma, np.random.default_rng([seed, k, 1]), count)
            for d in range(count):
                row = np.concatenate((values[d], np.exp(log_sigma)))
                number = pa.array(np.full(len(row), before + d + 1, np.int32))
                yield pa.RecordBatch.from_arrays([number, *labels, pa.array(row)], names=["draw", "param", "i", "j", "value"])

    tasks = min(len(used), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _with_system(fit, tasks, used, sample, "draw int, param string, i int, j int, value double")


def _parameter_labels(layout: Layout) -> tuple[list, list, list]:
    params, i, j = ["b0"], [None], [None]
    for name, size in layout.sizes().items():
        if name == "fixed":
            params += ["betas"] * layout.n_cov
            i += list(range(1, layout.n_cov + 1))
            j += [None] * layout.n_cov
        elif name == "psi":
            params += ["psi"] * size
            i += [k % layout.n_months + 1 for k in range(size)]
            j += [k // layout.n_months + 1 for k in range(size)]
        else:
            params += [name] * size
            i += list(range(1, size + 1))
            j += [None] * size
    params += [f"sigma_{name}" for name in EFFECTS]
    i += [None] * len(EFFECTS)
    j += [None] * len(EFFECTS)
    return params, i, j


# ------------------------------------------------- random-intercept model (M3)
@dataclass
class RandomInterceptFit:
    coefficients: np.ndarray  # intercept first
    sigma: float
    areas: list[str]
    effects: np.ndarray
    log_lik: float
    passes: int
    converged: bool


def fit_random_intercept(
    design: DataFrame, covariates: Sequence[str], outcome: str, area: str, tolerance: float = 1e-6, max_passes: int = 100
) -> RandomInterceptFit:
    """Maximum-likelihood logistic model with one random intercept per area (Laplace).

    ``covariates`` are 0/1 or numeric columns of ``design``; incomplete rows are
    left out by the caller.
    """
    names = sorted(r[0] for r in design.select(area).distinct().collect())
    index = local_table(design.sparkSession, [(n, k) for k, n in enumerate(names, 1)], f"`{area}` string, adm2_index int")
    x = [F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(covariates, 1)]
    rows = design.join(index, area).select("adm2_index", F.lit(1).alias("month_idx"), *x, F.col(outcome).cast("int").alias("__y"))
    keys = ["adm2_index", "month_idx", *[f"x{k}" for k in range(1, len(covariates) + 1)]]
    rows = cut_lineage(rows.groupBy(*keys).agg(F.count("__y").alias("n"), F.sum("__y").alias("y")))

    b, beta, u, log_sigma = 0.0, np.zeros(len(covariates)), np.zeros(len(names)), np.log(0.5)
    passes, converged, value = 0, False, -np.inf
    while passes < max_passes:
        s2 = np.exp(2.0 * log_sigma)
        while True:  # conditional mode of the area effects
            d = derivatives(rows, 1, beta, (b + u)[:, None])
            passes += 1
            pull = d.residual - u / s2
            curve = d.weight + 1.0 / s2
            if np.max(np.abs(pull / curve)) < tolerance / 10 or passes >= max_passes:
                break
            u = u + pull / curve
        w = d.weight
        wx = np.column_stack([w, d.weight_x])
        third_x = np.column_stack([d.third, d.third_x])
        share = s2 / (1.0 + s2 * w)
        total = third_x - d.third[:, None] * wx / curve[:, None]
        gradient = np.concatenate([[d.residual.sum()], d.residual_x]) - 0.5 * share @ total
        xx = np.block([[np.array([[w.sum()]]), d.weight_x.sum(axis=0)[None, :]], [d.weight_x.sum(axis=0)[:, None], d.weight_xx]])
        information = xx - (wx / curve[:, None]).T @ wx
        slope_u = 2.0 * u / s2 / curve
        grad_sigma = np.sum(u * u) / s2 - 0.5 * np.sum(share * (2.0 * w + d.third * slope_u))
        info_sigma = max(2.0 * np.sum((share * w) ** 2), 1e-3)
        value = d.log_lik - 0.5 * np.sum(u * u) / s2 - 0.5 * np.sum(np.log1p(s2 * w))
        move = np.linalg.solve(information, gradient)
        move_sigma = float(np.clip(grad_sigma / info_sigma, -0.5, 0.5))
        if np.max(np.abs(move)) < tolerance and (abs(move_sigma) < 1e-6 or log_sigma < -7.0):
            converged = True
            break
        b, beta, log_sigma = b + move[0], beta + move[1:], max(log_sigma + move_sigma, -7.5)
    return RandomInterceptFit(np.concatenate([[b], beta]), float(np.exp(log_sigma)), names, u, float(value), passes, converged)


def score_random_intercept(
    fit: RandomInterceptFit, df: DataFrame, covariates: Sequence[str], area: str, name: str = "p_cell"
) -> DataFrame:
    """Predicted probability; an area without interviews gets the effect zero."""
    effects = local_table(
        df.sparkSession, [(a, float(v)) for a, v in zip(fit.areas, fit.effects)], f"`{area}` string, __u double"
    )
    eta = F.lit(float(fit.coefficients[0])) + F.coalesce("__u", F.lit(0.0))
    for value, column in zip(fit.coefficients[1:], covariates):
        eta = eta + float(value) * F.col(f"`{column}`")
    return df.join(effects, area, "left").withColumn(name, logistic(eta)).drop("__u")


def random_intercept_scores(fit: RandomInterceptFit, df: DataFrame, covariates: Sequence[str], outcome: str, area: str) -> DataFrame:
    """``(term, score)``: gradient of the Laplace criterion at the fit, recomputed from the rows.

    Terms are the intercept, the covariates and the log standard deviation. Rows give sums of
    residuals, weights and third derivatives per area, areas the correction for the curvature of their
    effect; both are aggregates.
    """
    effects = local_table(df.sparkSession, [(a, float(u)) for a, u in zip(fit.areas, fit.effects)], f"`{area}` string, u double")
    terms = ["intercept", *covariates]
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in covariates]]
    scored = score_random_intercept(fit, df, covariates, area, "__p").withColumns({f"__x{k}": v for k, v in enumerate(x)})
    p = F.col("__p")
    w = p * (1.0 - p)
    parts = {"r": F.col(f"`{outcome}`") - p, "w": w, "t": w * (1.0 - 2.0 * p)}
    sums = [F.sum(v * F.col(f"__x{k}")).alias(f"{name}{k}") for k in range(len(x)) for name, v in parts.items()]
    by_area = scored.groupBy(area).agg(*sums).join(effects, area)
    variance = F.lit(fit.sigma**2)
    curve = F.col("w0") + 1.0 / variance
    share = variance / (1.0 + variance * F.col("w0"))
    u = F.col("u")
    scores = [F.col(f"r{k}") - 0.5 * share * (F.col(f"t{k}") - F.col("t0") * F.col(f"w{k}") / curve) for k in range(len(x))]
    scores.append(u * u / variance - 0.5 * share * (2.0 * F.col("w0") + F.col("t0") * 2.0 * u / variance / curve))
    labels = [*terms, "log_sigma"]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), v.alias("v")) for n, v in zip(labels, scores)]))
    return by_area.select(stacked.alias("s")).groupBy(F.col("s.term").alias("term")).agg(F.sum("s.v").alias("score"))

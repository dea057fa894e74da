"""Log posterior of a table of parameter draws, all draws at once.

Draws come long as ``(draw, param, i, j, value)`` with scaled effects
``phi, theta`` (area), ``nu, xi`` (month), ``psi`` (month x province or month x
district), ``b0``, ``betas`` and the five ``sigma_*``. Densities are on the
constrained scale, without a Jacobian for the positive parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from mosarea.functions.expressions import (
    HALF_LOG_TWO_PI,
    cauchy_log_density,
    normal_log_density,
    pc_precision_log_density,
)
from mosarea.operators.predict import (
    ABSENT,
    CELLS,
    PASS_ROWS,
    VALUE,
    DistrictDraws,
    HeldRows,
    JoinedDraws,
    RowBlock,
    distinct_rows,
    draw_count,
    draw_passes,
    factors,
    joined_draws,
    meet_draws,
    packed_draws,
    probabilities,
    read_joined_draws,
    score_rows,
)
from mosarea.session import cut_lineage

# Prior scales.
FIXED_SD = 5.0
AREA_SUM_SD = 0.001
MONTH_SUM_SD = 0.01
SIGMAS = ("sigma_phi", "sigma_theta", "sigma_nu", "sigma_xi", "sigma_psi")
INDEPENDENT = ("theta", "xi", "psi")
HYPER = ("pc_precision", "half_cauchy")


def log_likelihood(
    patterns: DataFrame, draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index"
) -> DataFrame:
    """``(draw, log_lik)``: patterns meet draws on area and month, then one sum per draw.

    The result is that of joining every pattern with every draw of its district and month: repeated keys count each time, what
    has no partner counts nowhere, and a null predictor adds nothing. The joined rows are scored where they meet and never written.
    """
    terms = [*[F.col(f"x{k}") for k in range(1, n_covariates + 1)], F.col("n")]
    x = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in terms])
    whole = reduce(lambda one, c: one & c.isNotNull(), terms, F.col("y").isNotNull())
    rows = patterns.where("adm2_index is not null and month_idx is not null").select(
        "adm2_index",
        F.col("month_idx").cast("int").alias("t"),
        F.lit(0).cast("bigint").alias("k"),
        F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("w"),
        x.alias("x"),
        F.when(whole, WHOLE).otherwise(EMPTY).alias("kind"),
    )
    joined = joined_draws(draws, n_covariates, regions, interaction)
    schema = "draw int, mass double"
    masses = meet_draws(cut_lineage(rows), joined, draw_count(draws), n_covariates, JoinedMassSums, schema, read_joined_draws)
    return masses.groupBy("draw").agg(F.sum("mass").alias("log_lik"))


def log_likelihood_blocks(
    patterns: DataFrame, draws: DataFrame, n_covariates: int, regions: DataFrame, interaction: str = "adm1_index"
) -> DataFrame:
    """Same numbers as :func:`log_likelihood` for draws that all cover the same months once; others are an error.

    The draws of a district meet its patterns as in post-stratification; a group of
    patterns gives one partial sum per draw.
    """
    rows = cut_lineage(score_rows(patterns, n_covariates, F.col("y"), F.col("n"), "month_idx"))
    packed = packed_draws(draws, n_covariates, regions, interaction)
    masses = meet_draws(rows, packed, draw_count(draws), n_covariates, MassSums, "draw int, mass double")
    return masses.groupBy("draw").agg(F.sum("mass").alias("log_lik"))


def softplus(eta: np.ndarray) -> np.ndarray:
    """``log(1 + exp(eta))``, to about 1e-16 of one."""
    tail = np.abs(eta)
    np.negative(tail, out=tail)
    np.exp(tail, out=tail)
    np.add(tail, 1.0, out=tail)
    np.log(tail, out=tail)
    np.add(tail, np.maximum(eta, 0.0), out=tail)
    return tail


#: rows whose ``1 + exp(eta)`` are multiplied before one logarithm is taken
CHAIN = 32
#: logarithm up to which products are let grow
CHAIN_BOUND = 700.0


def chained_rows(n: np.ndarray, of: np.ndarray, at: np.ndarray, absent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of rows with the same ``n`` as columns of two grids (answers, month), and the ``n`` of each chain.

    Cells without a row have the answers ``absent``.
    """
    order = np.argsort(n, kind="stable")
    values, first, counts = np.unique(n[order], return_index=True, return_counts=True)
    length = int(min(CHAIN, np.ceil(counts.mean())))
    inside = np.arange(len(n)) - np.repeat(first, counts)
    chains = -(-counts // length)
    place = inside % length, np.repeat(np.cumsum(chains) - chains, counts) + inside // length
    answers, months = np.full((length, chains.sum()), absent), np.zeros((length, chains.sum()), np.int64)
    answers[place], months[place] = of[order], at[order]
    return answers, months, np.repeat(values, chains)


def log_mass(d: DistrictDraws, x: np.ndarray, months: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of ``y * eta - n * log(1 + exp(eta))`` over the rows, per draw.

    ``y * eta`` is summed over answers and months before it meets the draws. ``1 + exp(eta)`` is one product and one sum,
    as answers and months have their exponentials already; those of rows with the same ``n`` are multiplied before the logarithm.
    """
    out = np.zeros(len(d.draws))
    if not len(months):
        return out
    at, (answers, of) = d.month_positions(months), distinct_rows(x)
    by_month, crossed, successes = np.bincount(at, y, len(d.months)), y @ x, y.sum()
    of_chain, at_chain, n_chain = chained_rows(n, of, at, len(answers))
    for own in draw_passes(len(d.draws)):
        parts = factors(d, answers, own, 1.0)
        if parts is None:
            out[own] = _log_mass_plain(d, x, at, n, y, own)
            continue
        by_answers = np.vstack([parts[0], np.zeros((1, parts[0].shape[1]))])
        limit = np.log1p(parts[0].max() * parts[1].max())
        total = d.betas[own, 1:] @ crossed + d.betas[own, 0] * successes + d.effects[own] @ by_month
        for a in range(0, len(n_chain), PASS_ROWS):
            step = slice(a, a + PASS_ROWS)
            chain, grown = np.ones((len(n_chain[step]), len(total))), 0.0
            term, month = np.empty_like(chain), np.empty_like(chain)
            for level in range(len(of_chain)):
                if grown + limit > CHAIN_BOUND:
                    total -= n_chain[step] @ np.log(chain)
                    chain[:], grown = 1.0, 0.0
                np.take(by_answers, of_chain[level, step], axis=0, out=term, mode="clip")
                np.take(parts[1], at_chain[level, step], axis=0, out=month, mode="clip")
                term *= month
                term += 1.0
                chain *= term
                grown += limit
            total -= n_chain[step] @ np.log(chain, out=chain)
        out[own] = total
    return out


def _log_mass_plain(d: DistrictDraws, x: np.ndarray, at: np.ndarray, n: np.ndarray, y: np.ndarray, own: slice) -> np.ndarray:
    out = 0.0
    for a in range(0, len(at), CELLS // 64):
        step = slice(a, a + CELLS // 64)
        eta = x[step] @ d.betas[own, 1:].T + d.betas[own, 0] + d.effects[own].T[at[step]]
        out = out + y[step] @ eta - n[step] @ softplus(eta)
    return out


class MassSums:
    """Log mass of the patterns of a group per draw."""

    def __init__(self, draws: DistrictDraws):
        self.draws, self.total = draws, np.zeros(len(draws.draws))
        self.rows = HeldRows(self._score)

    def add(self, rows: RowBlock, kind: int) -> None:
        self.rows.add(rows, kind)

    def _score(self, rows: RowBlock, kind: int) -> None:
        self.total += log_mass(self.draws, rows.x, rows.months, np.asarray(rows.numbers, np.float64), rows.weights)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.rows.finish()
        yield pa.RecordBatch.from_arrays([pa.array(self.draws.draws.astype(np.int32)), pa.array(self.total)], names=["draw", "mass"])


#: kinds of patterns: all their numbers are known, or one is null and with it every mass
WHOLE, EMPTY = 1, 2


class JoinedMassSums:
    """Log mass of the joined rows of a group per draw; null if no predictor is known."""

    def __init__(self, draws: JoinedDraws):
        self.draws, n = draws, len(draws.draws)
        self.total, self.counted, self.seen = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
        self.rows = HeldRows(self._score)

    def add(self, rows: RowBlock, kind: int) -> None:
        met = np.isin(rows.months, self.draws.months)
        self.rows.add(RowBlock(*(v[met] for v in (rows.months, rows.numbers, rows.weights, rows.x))), kind)

    def _score(self, rows: RowBlock, kind: int) -> None:
        d = self.draws
        if not len(rows.months):
            return
        if d.state is None:
            self.seen[:] = True
            if kind == WHOLE:
                self.counted[:] = True
                self.total += log_mass(d, rows.x[:, :-1], rows.months, rows.x[:, -1], rows.weights)
            return
        for part, own in rows.pieces(len(d.draws)):
            at = d.month_positions(part.months)
            state = d.state[own].T[at]
            self.seen[own] |= (state != ABSENT).any(axis=0)
            if kind == EMPTY:
                continue
            n, known = part.x[:, -1], state == VALUE
            eta = part.x[:, :-1] @ d.betas[own, 1:].T + d.betas[own, 0] + d.effects[own].T[at]
            mass = part.weights[:, None] * eta - n[:, None] * softplus(eta)
            self.total[own] += np.where(known, mass, 0.0).sum(axis=0)
            self.counted[own] |= known.any(axis=0)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.rows.finish()
        total = pa.array(self.total[self.seen], mask=~self.counted[self.seen])
        yield pa.RecordBatch.from_arrays([pa.array(self.draws.draws[self.seen].astype(np.int32)), total], names=["draw", "mass"])


class ResidualSums:
    """Per draw: residual (successes less their expectation) per month, and times each covariate; a row per draw."""

    def __init__(self, draws: DistrictDraws):
        self.draws = draws
        self.cells = np.zeros((len(draws.months), len(draws.draws)))
        self.crossed = np.zeros((draws.betas.shape[1] - 1, len(draws.draws)))
        self.rows = HeldRows(self._score)

    def add(self, rows: RowBlock, kind: int) -> None:
        self.rows.add(rows, kind)

    def _score(self, rows: RowBlock, kind: int) -> None:
        d = self.draws
        positions, (answers, of) = d.month_positions(rows.months), distinct_rows(rows.x)
        for own in draw_passes(len(d.draws)):
            parts = factors(d, answers, own, -1.0)
            for a in range(0, len(of), PASS_ROWS):
                step = slice(a, a + PASS_ROWS)
                at, x = positions[step], rows.x[step]
                if parts is None:
                    p = probabilities(x @ d.betas[own, 1:].T + d.betas[own, 0] + d.effects[own].T[at])
                else:
                    p = np.take(parts[0], of[step], axis=0)
                    p *= np.take(parts[1], at, axis=0)
                    p += 1.0
                    np.divide(1.0, p, out=p)
                residual = rows.weights[step, None] - rows.numbers[step, None] * p
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                self.cells[at[first], own] += np.add.reduceat(residual, first, axis=0)
                self.crossed[:, own] += x.T @ residual

    def finish(self) -> Iterator[pa.RecordBatch]:
        d, n = self.draws, len(self.draws.draws)
        ends = lambda values: np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        lists = lambda values, kind: pa.ListArray.from_arrays(ends(values), pa.array(values.ravel(), kind))
        self.rows.finish()
        for a in range(0, n, 4096):
            own = slice(a, a + 4096)
            months = np.broadcast_to(d.months.astype(np.int32), (len(d.draws[own]), len(d.months)))
            columns = [pa.array(np.full(len(months), d.area, np.int32)), pa.array(d.draws[own].astype(np.int32)), lists(months, pa.int32())]
            columns += [lists(v[:, own].T, pa.float64()) for v in (self.cells, self.crossed)]
            yield pa.RecordBatch.from_arrays(columns, names=["adm2_index", "draw", "m", "cells", "crossed"])


def log_posterior_gradient(
    patterns: DataFrame,
    draws: DataFrame,
    edges: DataFrame,
    n_covariates: int,
    regions: DataFrame,
    interaction: str = "adm1_index",
) -> DataFrame:
    """``(draw, param, i, j, gradient)`` of the log posterior in every effect and coefficient.

    Effects are the scaled ones, standard deviations are held. Every residual sum of a (district, month) belongs
    to one parameter of each block, every neighbour pair and every pair of months to two. The residuals of a district and
    draw are one row, which meets the numbers of its draw; the terms are made and added up there.
    """
    rows = cut_lineage(score_rows(patterns, n_covariates, F.col("y"), F.col("n"), "month_idx"))
    schema = "adm2_index int, draw int, m array<int>, cells array<double>, crossed array<double>"
    packed = packed_draws(draws, n_covariates, regions, interaction)
    sums = meet_draws(rows, packed, draw_count(draws), n_covariates, ResidualSums, schema)
    places = regions.select("adm2_index", F.col(interaction).cast("int").alias("j")).distinct()
    fixed = F.col("param").isin("b0", "betas")
    numbers = draws.where("draw is not null").select(F.col("draw").cast("int").alias("draw"), "param", F.col("i").cast("int"), F.col("j").cast("int"), "value")
    both = sums.join(F.broadcast(places), "adm2_index").withColumnRenamed("adm2_index", "i").unionByName(numbers, allowMissingColumns=True)
    partitions = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(partitions, "draw").sortWithinPartitions("draw").select("draw", "param", "i", "j", "value", "m", "cells", "crossed")
    pairs = np.array([(r.node1, r.node2) for r in edges.select("node1", "node2").collect()], np.int64).reshape(-1, 2)
    found = dealt.mapInArrow(_gradients(pairs), "draw int, param string, i int, j int, gradient double")
    # a coefficient whose draw is unknown has its prior alone
    lost = draws.where(F.col("draw").isNull() & fixed).groupBy("draw", "param", "i", "j").agg(F.sum(-F.col("value") / (FIXED_SD * FIXED_SD)).alias("gradient"))
    return found.unionByName(lost.select(F.col("draw").cast("int").alias("draw"), "param", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "gradient"))


#: parameters with a gradient
GRADIENT_PARAMS = ("b0", "betas", "phi", "theta", "nu", "xi", "psi")
#: rows of whole draws that are worked on at once
GRADIENT_ROWS = 100_000
#: stands for a null position
NOWHERE = -(1 << 31)


def _gradients(pairs: np.ndarray):
    """Gradients of the draws of a partition, whose rows are sorted by draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            draws = batch.column("draw").to_numpy()
            if size >= GRADIENT_ROWS and held[0].column("draw")[0].as_py() != draws[-1]:
                whole = pa.Table.from_batches(held)
                end = int(np.searchsorted(whole["draw"].to_numpy(), draws[-1]))
                yield from _gradient_terms(whole.slice(0, end), pairs).to_batches()
                held = whole.slice(end).combine_chunks().to_batches()
                size = len(whole) - end
        if held:
            yield from _gradient_terms(pa.Table.from_batches(held), pairs).to_batches()

    return run


def _gradient_terms(rows: pa.Table, pairs: np.ndarray) -> pa.Table:
    import pandas as pd

    keys, codes = ["draw", "param", "i", "j"], {name: k for k, name in enumerate(GRADIENT_PARAMS)}
    numbers = rows.filter(pa.compute.is_valid(rows["param"])).drop_columns(["m", "cells", "crossed"]).to_pandas()
    numbers[["i", "j"]] = numbers[["i", "j"]].fillna(NOWHERE).astype(np.int64)
    terms = []

    def add(param, draw, i, j, v):
        terms.append(pd.DataFrame({"draw": draw, "param": codes[param] if isinstance(param, str) else param, "i": i, "j": j, "v": v}))

    # residuals: each sum of a district and month goes to one parameter of every block
    met = rows.filter(pa.compute.is_null(rows["param"])).combine_chunks()
    if len(met):
        column = lambda name: met[name].combine_chunks() if isinstance(met[name], pa.ChunkedArray) else met[name]
        flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
        draw, area, place = (met[c].to_numpy() for c in ("draw", "i", "j"))
        place = np.where(np.isnan(place), NOWHERE, place).astype(np.int64) if place.dtype.kind == "f" else place
        lengths = column("m").value_lengths().to_numpy()
        cells = pd.DataFrame({"draw": np.repeat(draw, lengths), "area": np.repeat(area, lengths), "place": np.repeat(place, lengths), "month": flat("m"), "v": flat("cells")})
        summed = lambda *by: cells.groupby(["draw", *by], sort=False)["v"].sum(min_count=1).reset_index()
        placed = summed("month", "place")
        add("psi", placed["draw"], placed["month"], placed["place"], placed["v"])
        by_month, by_area, whole = summed("month"), summed("area"), summed()
        for name, found, at in (("nu", by_month, "month"), ("xi", by_month, "month"), ("phi", by_area, "area"), ("theta", by_area, "area")):
            add(name, found["draw"], found[at], NOWHERE, found["v"])
        add("b0", whole["draw"], NOWHERE, NOWHERE, whole["v"])
        lengths = column("crossed").value_lengths().to_numpy()
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        add("betas", np.repeat(draw, lengths), at + 1, NOWHERE, flat("crossed"))

    # the prior, by the numbers of the draw itself
    fixed = numbers[numbers["param"].isin(["b0", "betas"])]
    add(fixed["param"].map(codes), fixed["draw"], fixed["i"], fixed["j"], -fixed["value"] / (FIXED_SD * FIXED_SD))
    sigmas = numbers[numbers["param"].isin(SIGMAS)]
    sigmas = pd.DataFrame({"draw": sigmas["draw"], "param": sigmas["param"].str.removeprefix("sigma_"), "s2": sigmas["value"] ** 2})
    scaled = numbers[numbers["param"].isin([*INDEPENDENT, "phi", "nu"])].merge(sigmas, on=["draw", "param"])
    free = scaled[scaled["param"].isin(INDEPENDENT)]
    add(free["param"].map(codes), free["draw"], free["i"], free["j"], -free["value"] / free["s2"])
    for param, spread in (("phi", AREA_SUM_SD), ("nu", MONTH_SUM_SD)):
        own = scaled[scaled["param"] == param]
        # soft sums to zero: every unit of a block is pulled by the block's sum
        grouped = own.groupby("draw")["value"]
        total, n = grouped.transform(lambda v: v.sum(min_count=1)) if own["value"].isna().any() else grouped.transform("sum"), grouped.transform("count")
        add(param, own["draw"], own["i"], own["j"], -total / (spread * n) ** 2 / own["s2"])
        # a difference pulls its two ends towards each other
        known = own[own["i"] != NOWHERE]
        two = np.unique(known["i"])
        ends = pd.DataFrame(pairs, columns=["i", "two"]) if param == "phi" else pd.DataFrame({"i": two[two > 1] - 1, "two": two[two > 1]})
        gaps = known.merge(ends, on="i").merge(known[["draw", "i", "value"]].rename(columns={"i": "two", "value": "next"}), on=["draw", "two"])
        difference = (gaps["value"] - gaps["next"]) / gaps["s2"]
        add(param, gaps["draw"], gaps["i"], gaps["j"], -difference)
        add(param, gaps["draw"], gaps["two"], gaps["j"], difference)
    start = scaled[(scaled["param"] == "nu") & (scaled["i"] == 1)]
    add("nu", start["draw"], start["i"], start["j"], -start["value"] / start["s2"])

    out = pd.concat(terms).groupby(keys, sort=False)["v"].sum(min_count=1).reset_index()
    where = lambda c: pa.array(out[c].to_numpy().astype(np.int32), mask=(out[c] == NOWHERE).to_numpy())
    names = pa.array(np.array(GRADIENT_PARAMS, object)[out["param"].to_numpy()], pa.string())
    gradient = pa.array(out["v"].to_numpy(np.float64), from_pandas=True)
    return pa.table({"draw": pa.array(out["draw"].to_numpy().astype(np.int32)), "param": names, "i": where("i"), "j": where("j"), "gradient": gradient})


def log_prior(draws: DataFrame, edges: DataFrame, hyper: str = "pc_precision") -> DataFrame:
    """``(draw, log_prior)``; ``edges`` is the undirected neighbour list ``(node1, node2)``.

    One aggregation per draw: sums of squares of the independent blocks, and the
    two short arrays (areas, months) whose differences the smooth priors need.
    """
    if hyper not in HYPER:
        raise ValueError(f"hyper must be one of {HYPER}")
    value = F.col("value")
    of = lambda *params: F.when(F.col("param").isin(*params), value)
    squares = lambda param: F.sum(of(param) * of(param)).alias(f"{param}_s2")
    ordered = lambda param: F.array_sort(
        F.collect_list(F.when(F.col("param") == param, F.struct("i", "value")))
    ).alias(f"{param}_a")
    per_draw = draws.groupBy("draw").agg(
        *[squares(p) for p in INDEPENDENT],
        *[F.count(of(p)).alias(f"{p}_n") for p in INDEPENDENT],
        ordered("phi"),
        ordered("nu"),
        F.sum(F.when(F.col("param").isin("b0", "betas"), normal_log_density(value, 0.0, FIXED_SD))).alias("fixed"),
        F.sum(F.when(F.col("param").isin(*SIGMAS), _hyper_density(value, hyper))).alias("hyper"),
        *[F.max(of(name)).alias(name) for name in SIGMAS],
    )
    per_draw = per_draw.withColumn("edges", edges.agg(F.collect_list(F.struct("node1", "node2"))).scalar())
    unscaled = lambda param: F.transform(
        F.col(f"{param}_a"), lambda e: e["value"] / F.col(f"sigma_{param}")
    )
    total = F.col("fixed") + F.col("hyper")
    total = total + icar_log_density(unscaled("phi"), F.col("edges")) + random_walk_log_density(unscaled("nu"))
    for p in INDEPENDENT:
        sigma = F.col(f"sigma_{p}")
        total = total - 0.5 * F.col(f"{p}_s2") / (sigma * sigma) - F.col(f"{p}_n") * HALF_LOG_TWO_PI
    return per_draw.select("draw", total.alias("log_prior"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def icar_log_density(u: Column, neighbours: Column) -> Column:
    """Pairwise differences over the neighbour list plus the soft sum-to-zero term."""
    differences = F.transform(neighbours, lambda e: F.get(u, e["node1"] - 1) - F.get(u, e["node2"] - 1))
    smooth = F.aggregate(differences, F.lit(0.0), lambda acc, d: acc + d * d)
    return -0.5 * smooth + normal_log_density(_total(u), 0.0, AREA_SUM_SD * F.size(u))


def random_walk_log_density(u: Column) -> Column:
    """First month standard normal, then unit steps, with a soft sum-to-zero term."""
    steps = F.transform(u, lambda x, k: x - F.coalesce(F.get(u, k - 1), F.lit(0.0)))
    squares = F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d * d)
    n = F.size(u)
    return -0.5 * squares - n * HALF_LOG_TWO_PI + normal_log_density(_total(u), 0.0, MONTH_SUM_SD * n)


def log_posterior(
    patterns: DataFrame,
    draws: DataFrame,
    edges: DataFrame,
    n_covariates: int,
    regions: DataFrame,
    hyper: str = "pc_precision",
    interaction: str = "adm1_index",
) -> DataFrame:
    return (
        log_likelihood_blocks(patterns, draws, n_covariates, regions, interaction)
        .join(log_prior(draws, edges, hyper), "draw")
        .withColumn("log_post", F.col("log_lik") + F.col("log_prior"))
    )


def _hyper_density(sigma: Column, hyper: str) -> Column:
    if hyper == "half_cauchy":
        return cauchy_log_density(sigma)
    return pc_precision_log_density(1.0 / (sigma * sigma))

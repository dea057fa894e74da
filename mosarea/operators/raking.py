"""Raking of a frame to population margins.

The frame is collapsed once to the cross-tab of the raking variables, whose
size is bounded by the product of their levels and not by the frame. Every
later step is an aggregate over that checkpointed cross-tab. The weight is
always ``start weight x product of one factor per margin level``, so the plan
does not grow with the number of sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosarea.operators.aggregates import share_of_total, stacked_groups
from mosarea.session import cut_lineage, ship_package
from mosarea.sources.tables import local_table, settle_dimension

# Tolerance relative to the weight total, and allowed sweeps.
TOLERANCE = 1e-9
MAX_SWEEPS = 6000
RAKE_VARIABLES = (
    ("adm1_name", "adm2_name"),
    ("h_toilet_type_2way",),
    ("h_water_source_2way",),
    ("h_cell",),
    ("h_cooking_fuel",),
    ("hhh_sex",),
)


@dataclass
class Margin:
    """Target shares of one or more variables: columns ``variables`` and ``freq``."""

    variables: tuple[str, ...]
    target: DataFrame


@dataclass
class RakeResult:
    weighted: DataFrame
    sweeps: int
    converged: bool
    solver: str


class _CrossTab:
    """Cross-tab with integer level codes and the target total of every code."""

    def __init__(self, frame: DataFrame, margins: Sequence[Margin], weight: str):
        self.margins = list(margins)
        self.variables = sorted({v for m in margins for v in m.variables})
        # the one pass over the frame; everything below reads the written cells
        plain = cut_lineage(
            frame.groupBy(*self.variables).agg(F.sum(weight).alias("w0"), F.count(F.lit(1)).alias("rows"))
        )
        levels = _levels(plain, self.margins)
        coded = plain
        for k, (margin, rows) in enumerate(zip(self.margins, levels)):
            names = list(margin.variables)
            codes = local_table(
                frame.sparkSession,
                [(*key, i) for i, (key, _) in enumerate(rows)],
                ", ".join(f"`__{n}` string" for n in names) + f", c{k} int",
            )
            match = [F.col(n).cast("string") == F.col(f"__{n}") for n in names]
            coded = coded.join(codes, match).drop(*[f"__{n}" for n in names])
        self.table = cut_lineage(coded)
        self.total, self.rows = self.table.agg(F.sum("w0"), F.sum("rows")).first()
        if not self.total or self.total <= 0:
            raise ValueError("the frame has no weight")
        shares = [np.array([freq for _, freq in rows], dtype=float) for rows in levels]
        self.targets = [t / t.sum() * self.total for t in shares]

    def start(self) -> list[np.ndarray]:
        return [np.ones(len(t)) for t in self.targets]

    def weight(self, factors: Sequence[np.ndarray]) -> Column:
        expression = F.col("w0")
        for k, factor in enumerate(factors):
            expression = expression * _lookup(factor, F.col(f"c{k}"))
        return expression

    def margins_of(self, factors: Sequence[np.ndarray], direction: Sequence[np.ndarray] | None = None) -> np.ndarray:
        """Totals of every level of every margin, one after the other; with ``direction``, of the
        weight times the direction's sum over the levels of a cell: second derivatives times that vector."""
        weight, codes, offset = self.weight(factors), [], 0
        if direction is not None:
            weight = weight * sum((_lookup(d, F.col(f"c{k}")) for k, d in enumerate(direction)), F.lit(0.0))
        for k, target in enumerate(self.targets):
            codes.append(F.col(f"c{k}") + offset)
            offset += len(target)
        found = self.table.select(weight.alias("w"), F.explode(F.array(*codes)).alias("a")).groupBy("a").agg(F.sum("w").alias("w")).toArrow()
        out = np.zeros(offset)
        out[found.column("a").to_numpy()] = found.column("w").to_numpy()
        return out

    def sums(self, k: int, factors: Sequence[np.ndarray]) -> np.ndarray:
        rows = self.table.groupBy(f"c{k}").agg(F.sum(self.weight(factors)).alias("s")).collect()
        out = np.zeros(len(self.targets[k]))
        for code, total in rows:
            out[code] = total
        return out


def _lookup(values: np.ndarray, code: Column) -> Column:
    """Array literal indexed by code; the text form keeps every digit of a double."""
    text = F.lit(",".join(repr(float(v)) for v in values))
    return F.get(F.split(text, ",").cast("array<double>"), code)


def _levels(table: DataFrame, margins: Sequence[Margin]) -> list[list[tuple]]:
    """Sorted ``(level key, target)`` list of each margin; a one-sided level is an error.

    Rows are the levels of published margins (districts or answer options).
    """
    stacked = None
    for k, margin in enumerate(margins):
        key = F.array(*[F.col(v).cast("string") for v in margin.variables]).alias("key")
        target = margin.target.groupBy(key).agg(F.sum("freq").cast("double").alias("freq"))
        sampled = table.select(key).distinct().withColumn("freq", F.lit(None).cast("double"))
        for side, part in (("target", target), ("frame", sampled)):
            one = part.select(F.lit(k).alias("k"), F.lit(side).alias("side"), "key", "freq")
            stacked = one if stacked is None else stacked.unionByName(one)
    found = stacked.collect()
    out = []
    for k, margin in enumerate(margins):
        target = {tuple(r["key"]): r["freq"] for r in found if r["k"] == k and r["side"] == "target"}
        sampled = {tuple(r["key"]) for r in found if r["k"] == k and r["side"] == "frame"}
        lonely = sorted(set(target) ^ sampled, key=str)
        if lonely:
            raise ValueError(f"margin {margin.variables}: levels only in frame or only in target: {lonely[:5]}")
        out.append(sorted(target.items()))
    return out


def rake(
    frame: DataFrame,
    margins: Sequence[Margin],
    weight: str = "pop_weight",
    tolerance: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    solver: str = "newton",
    unfinished: bool = False,
) -> RakeResult:
    """Frame with weights that reproduce every margin, rescaled to mean 1.

    ``solver='sweeps'`` runs iterative proportional fitting in margin order, one
    small aggregate per half sweep. ``solver='newton'`` solves the same
    exponential-tilting equations with second derivatives, one aggregate for each of a handful of
    steps, same fixed point; the longest margin may have any number of levels, for the others
    together the driver keeps a matrix. ``solver='gradients'`` keeps only vectors over the levels of all
    margins and takes a few aggregates more per step.
    A solver that does not reach the tolerance is an error, unless ``unfinished`` accepts
    the last sweep.
    """
    if solver not in ("newton", "gradients", "sweeps"):
        raise ValueError(f"unknown solver {solver!r}")
    ship_package(frame.sparkSession)
    tab = _CrossTab(frame, margins, weight)
    if solver == "sweeps":
        found = _sweeps(tab, tolerance, max_sweeps)
    else:
        found = (_newton if solver == "newton" else _gradients)(tab, tolerance)
    if found is None or not (found[2] or unfinished):
        raise RuntimeError(f"raking by {solver} did not reach {tolerance}")
    factors, steps, converged = found
    return RakeResult(_weighted_rows(frame, tab, factors, weight), steps, converged, solver)


def _sweeps(tab: _CrossTab, tolerance: float, max_sweeps: int):
    factors = tab.start()
    for sweep in range(1, max_sweeps + 1):
        change = 0.0
        for k, target in enumerate(tab.targets):
            current = tab.sums(k, factors)
            ratio = np.divide(target, current, out=np.ones_like(target), where=current > 0)
            change = max(change, float(np.max(np.abs(current - target))))
            factors[k] = factors[k] * ratio
        if change < tolerance * tab.total:
            return factors, sweep, True
    return factors, max_sweeps, False


def _newton(tab: _CrossTab, tolerance: float, max_steps: int = 50):
    """Damped Newton on the log factors of all margins but the longest; None when it does not reach the tolerance.

    Given the other factors, those of the longest margin (districts) follow exactly, level by
    level, so they are left to the tasks: the cross-tab is written with all cells of a level in one
    part, and a task returns what the other margins achieve and how that changes, summed
    over its levels. The driver holds vectors, and a matrix over the levels of the other margins.
    """
    sizes = [len(t) for t in tab.targets]
    longest = int(np.argmax(sizes))
    others = [k for k in range(len(sizes)) if k != longest]
    cuts = np.cumsum([sizes[k] for k in others])
    wanted = tab.targets[longest]
    target = np.concatenate([tab.targets[k] for k in others]) if others else np.zeros(0)
    codes = [(F.col(f"c{k}") + int(cut - sizes[k])).alias(f"s{i}") for i, (k, cut) in enumerate(zip(others, cuts))]
    partitions = int(tab.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cut_lineage(tab.table.select(F.col(f"c{longest}").alias("d"), "w0", *codes).repartition(partitions, "d"))

    def evaluate(point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = cells.mapInArrow(_profile(wanted, np.exp(point), len(others)), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(len(point) * (len(point) + 1))
        flat[found.column("at").to_numpy()] = found.column("v").to_numpy()
        return flat[: len(point)], flat[len(point) :].reshape(len(point), len(point))

    lam = np.zeros(len(target))
    achieved, slope = evaluate(lam)
    gap = target - achieved
    for step in range(1, max_steps + 1):
        if np.max(np.abs(gap), initial=0.0) < tolerance * tab.total:
            # the slope is at hand: one more step squares what error is left
            lam = lam + np.linalg.lstsq(slope, gap, rcond=1e-12)[0]
            factors = tab.start()
            for k, part in zip(others, np.split(np.exp(lam), cuts[:-1])):
                factors[k] = part
            factors[longest] = wanted / tab.sums(longest, factors)
            return factors, step - 1, True
        move = np.linalg.lstsq(slope, gap, rcond=1e-12)[0]
        size = 1.0
        while True:
            trial = lam + size * np.clip(move, -3.0, 3.0)
            achieved, next_slope = evaluate(trial)
            next_gap = target - achieved
            if np.isfinite(next_gap).all() and np.linalg.norm(next_gap) < np.linalg.norm(gap):
                lam, slope, gap = trial, next_slope, next_gap
                break
            size /= 2.0
            if size < 1e-3:
                return None
    return None


def _profile(wanted: np.ndarray, factors: np.ndarray, n_codes: int):
    """Achieved totals of the other margins (first ``len(factors)`` places) and their derivatives, with the
    longest margin met exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        level = table.column("d").to_numpy().astype(np.int64)
        codes = [table.column(f"s{i}").to_numpy().astype(np.int64) for i in range(n_codes)]
        weight = table.column("w0").to_numpy().astype(float)
        for code in codes:
            weight = weight * factors[code]
        own, dense = np.unique(level, return_inverse=True)
        weight = weight * (wanted[own] / np.bincount(dense, weight))[dense]
        n = len(factors)
        achieved, slope, by_level = np.zeros(n), np.zeros(n * n), np.zeros((len(own), n))
        for code in codes:
            achieved += np.bincount(code, weight, n)
            np.add.at(by_level, (dense, code), weight)
            for other in codes:
                slope += np.bincount(code * n + other, weight, n * n)
        scaled = by_level / np.where(wanted[own] > 0, wanted[own], 1.0)[:, None]
        values = np.concatenate((achieved, slope - (by_level.T @ scaled).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "v"])

    return run


def _gradients(tab: _CrossTab, tolerance: float, max_steps: int = 50):
    """Damped Newton on all log factors without a matrix; None when it does not reach the tolerance.

    The matrix of second derivatives (two-way margin totals) is never formed: conjugate gradients,
    scaled by the margins themselves, ask for its product with a vector, which is one
    aggregate over the cross-tab. The driver holds vectors over levels.
    """
    cuts = np.cumsum([len(t) for t in tab.targets])[:-1]
    target = np.concatenate(tab.targets)
    split = lambda v: np.split(v, cuts)
    factors = lambda point: split(np.exp(point))
    lam = np.zeros(len(target))
    margins = tab.margins_of(factors(lam))
    gap = target - margins
    for step in range(1, max_steps + 1):
        if np.max(np.abs(gap)) < tolerance * tab.total:
            return factors(lam), step - 1, True
        product = lambda v, at=factors(lam): tab.margins_of(at, split(v))
        # a rough direction is enough: what is left over goes into the next step
        move = _conjugate_gradients(product, gap, margins, accuracy=0.02)
        size = 1.0
        while True:
            trial = lam + size * np.clip(move, -3.0, 3.0)
            found = tab.margins_of(factors(trial))
            if np.isfinite(found).all() and np.linalg.norm(target - found) < np.linalg.norm(gap):
                lam, margins, gap = trial, found, target - found
                break
            size /= 2.0
            if size < 1e-3:
                return None
    return None


def _conjugate_gradients(product, right: np.ndarray, diagonal: np.ndarray, accuracy: float) -> np.ndarray:
    """Solves ``product(x) = right``, scaled by the diagonal, until the scaled residual fell by ``accuracy``."""
    scale = np.where(diagonal > 0, diagonal, 1.0)
    x, residual = np.zeros_like(right), right.copy()
    scaled = residual / scale
    direction, norm = scaled.copy(), float(residual @ scaled)
    wanted = norm * accuracy**2
    for _ in range(len(right)):
        if norm <= wanted:
            break
        image = product(direction)
        curve = float(direction @ image)
        if curve <= 0.0:
            break
        x = x + norm / curve * direction
        residual = residual - norm / curve * image
        scaled = residual / scale
        after = float(residual @ scaled)
        direction, norm = scaled + after / norm * direction, after
    return x


def _weighted_rows(frame: DataFrame, tab: _CrossTab, factors: Sequence[np.ndarray], weight: str) -> DataFrame:
    """Start weight times the factor of its cross-tab cell, divided by the mean.

    The mean needs no pass over the frame: both its total and its row count are
    sums over the cross-tab.
    """
    total = tab.table.agg(F.sum(tab.weight(factors))).first()[0]
    product = F.lit(1.0)
    for k, factor in enumerate(factors):
        product = product * _lookup(factor, F.col(f"c{k}"))
    cells = tab.table.select(*tab.variables, (product / (total / tab.rows)).alias("__factor"))
    return (
        frame.join(settle_dimension(cells), tab.variables)
        .withColumn(weight, F.col(weight) * F.col("__factor"))
        .select(*frame.columns)
    )


def raking_check(
    weighted: DataFrame, margins: Sequence[Margin], weight: str = "pop_weight"
) -> DataFrame:
    """Achieved and target share of every level with design effect, worst first."""
    variables = list(dict.fromkeys(v for m in margins for v in m.variables))
    achieved = stacked_groups(
        weighted.select(*variables, weight),
        variables,
        [],
        deff=1 + F.var_samp(weight),
        avg_weight=F.avg(weight),
        poll_raw=F.sum(weight),
    )
    achieved = share_of_total(achieved, "poll_raw", "poll", by=["var"]).drop("poll_raw")
    wanted = None
    for margin in margins:
        shares = share_of_total(margin.target, "freq", "freq")
        one = stacked_groups(
            shares.select(*margin.variables, "freq"), list(margin.variables), [], pop=F.sum("freq")
        )
        wanted = one if wanted is None else wanted.unionByName(one)
    return (
        achieved.join(wanted.distinct(), ["var", "level"], "full")
        .withColumn("diff", F.col("pop") - F.col("poll"))
        .orderBy((-F.abs(F.col("diff"))).asc(), "var", "level")
    )

"""Gaussian approximation of the hierarchical model by block elimination.

The predictor of a cell (area, month) is a fixed part, an area effect, a month effect and
an interaction. Three facts keep the dense part small:

* interactions meet only the cells of their own place and month, so their block is
  diagonal and leaves by a Schur complement;
* the data see an area's smooth and independent effect only as a sum, whose prior
  precision is the parallel sum of the two (in the eigenbasis of the smooth one a
  number per direction); the smooth effect given the sum is independent again;
* the same holds for months.

What is factored is dense in 1 + covariates + areas + months, whatever the number of
interactions; cells are arrays of areas x months. Nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Prior scales and the order of the effects.
FIXED_PRECISION = 1.0 / 25.0
AREA_SUM_SD = 0.001
MONTH_SUM_SD = 0.01
PC_RATE = -np.log(0.01)
EFFECTS = ("phi", "theta", "nu", "xi", "psi")
HYPER = ("pc_precision", "half_cauchy")


@dataclass(frozen=True)
class Layout:
    """Positions of the parameter blocks in one vector; ``place`` is the interaction place (0-based) of each area."""

    n_cov: int
    n_areas: int
    n_months: int
    place: tuple[int, ...]

    @property
    def n_places(self) -> int:
        return max(self.place) + 1

    def sizes(self) -> dict[str, int]:
        return {
            "fixed": 1 + self.n_cov,
            "phi": self.n_areas,
            "theta": self.n_areas,
            "nu": self.n_months,
            "xi": self.n_months,
            "psi": self.n_months * self.n_places,
        }

    def slices(self) -> dict[str, slice]:
        out, start = {}, 0
        for name, size in self.sizes().items():
            out[name] = slice(start, start + size)
            start += size
        return out

    @property
    def size(self) -> int:
        return sum(self.sizes().values())

    def offset(self, theta: np.ndarray) -> np.ndarray:
        """Areas x months matrix of everything that does not multiply a covariate."""
        s = self.slices()
        area, month = theta[s["phi"]] + theta[s["theta"]], theta[s["nu"]] + theta[s["xi"]]
        psi = theta[s["psi"]].reshape(self.n_places, self.n_months)[list(self.place)]
        return theta[0] + area[:, None] + month[None, :] + psi


def area_structure(n: int, edges: Sequence[tuple[int, int]]) -> np.ndarray:
    """Prior precision of unscaled neighbouring effects (1-based pairs), with the soft sum to zero."""
    out = np.full((n, n), 1.0 / (AREA_SUM_SD * n) ** 2)
    for a, b in edges:
        out[[a - 1, b - 1], [a - 1, b - 1]] += 1.0
        out[[a - 1, b - 1], [b - 1, a - 1]] -= 1.0
    return out


def month_structure(n: int) -> np.ndarray:
    """Prior precision of an unscaled random walk from zero, with the soft sum to zero."""
    step = np.eye(n) - np.eye(n, k=-1)
    return step.T @ step + 1.0 / (MONTH_SUM_SD * n) ** 2


class Smooth:
    """A smooth and an independent effect on the same units, seen as their sum."""

    def __init__(self, structure: np.ndarray):
        values, self.vectors = np.linalg.eigh(structure)
        self.values = np.maximum(values, 0.0)

    def precisions(self, log_smooth: float, log_free: float) -> tuple[np.ndarray, float]:
        return self.values * np.exp(-2.0 * log_smooth), float(np.exp(-2.0 * log_free))

    def prior(self, log_smooth: float, log_free: float) -> tuple[np.ndarray, float]:
        """Prior precision of the sum, and the log determinant of the smooth effect's given it."""
        smooth, free = self.precisions(log_smooth, log_free)
        parallel = smooth * free / (smooth + free)
        return (self.vectors * parallel) @ self.vectors.T, float(np.sum(np.log(smooth + free)))

    def split(self, total: np.ndarray, log_smooth: float, log_free: float, noise: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Smooth and independent effect of units x draws sums: their means, or draws if noise is given."""
        smooth, free = self.precisions(log_smooth, log_free)
        along = (self.vectors.T @ total) * (free / (smooth + free))[:, None]
        if noise is not None:
            along = along + noise / np.sqrt(smooth + free)[:, None]
        part = self.vectors @ along
        return part, total - part

    def square(self, effect: np.ndarray) -> float:
        return float(np.sum(self.values * (self.vectors.T @ effect) ** 2))


@dataclass
class Cells:
    """Second-order expansion of the log likelihood: sums per cell and over all data.

    ``work`` and ``work_x`` are gradient plus information times the parameters it was taken at.
    """

    weight: np.ndarray  # areas x months
    weight_x: np.ndarray  # areas x months x covariates
    work: np.ndarray
    weight_xx: np.ndarray
    work_x: np.ndarray

    @classmethod
    def at(cls, residual, weight, weight_x, residual_x, weight_xx, beta: np.ndarray, offset: np.ndarray) -> Cells:
        """From sums per cell (flat) at ``beta`` and ``offset``."""
        shape = offset.shape
        weight, weight_x = weight.reshape(shape), weight_x.reshape(*shape, len(beta))
        work = residual.reshape(shape) + weight_x @ beta + weight * offset
        work_x = residual_x + weight_xx @ beta + np.tensordot(offset, weight_x, axes=2)
        return cls(weight, weight_x, work, weight_xx, work_x)


@dataclass
class Eliminated:
    """What is left when interactions of one precision are out."""

    information: np.ndarray
    linear: np.ndarray
    diagonal: np.ndarray  # places x months: precision of each interaction
    cross: np.ndarray  # places x months x (1 + covariates): coupling with the fixed part
    linear_psi: np.ndarray
    log_det: float
    square: float


@dataclass
class Solution:
    value: float
    factor: np.ndarray
    half: np.ndarray
    rest: Eliminated


class BlockSystem:
    """Laplace marginal of the log standard deviations, conditional mode and conditional draws."""

    def __init__(self, layout: Layout, edges: Sequence[tuple[int, int]], hyper: str, cells: Cells | None = None, smooth: tuple[Smooth, Smooth] | None = None):
        if hyper not in HYPER:
            raise ValueError(f"hyper must be one of {HYPER}")
        self.layout, self.hyper, self.cells = layout, hyper, cells
        self.areas, self.months = smooth or (Smooth(area_structure(layout.n_areas, edges)), Smooth(month_structure(layout.n_months)))
        self.place = np.array(layout.place)
        # a search moves one standard deviation at a time: the other parts are kept
        self.eliminated = lru_cache(maxsize=4)(self._eliminate)
        self.area_prior = lru_cache(maxsize=4)(self.areas.prior)
        self.month_prior = lru_cache(maxsize=4)(self.months.prior)

    def with_cells(self, cells: Cells) -> BlockSystem:
        return BlockSystem(self.layout, (), self.hyper, cells, (self.areas, self.months))

    def _blocks(self) -> tuple[slice, slice, slice]:
        f, s, t = 1 + self.layout.n_cov, self.layout.n_areas, self.layout.n_months
        return slice(0, f), slice(f, f + s), slice(f + s, f + s + t)

    def _by_place(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.layout.n_places, *values.shape[1:]))
        np.add.at(out, self.place, values)
        return out

    def _eliminate(self, log_psi: float) -> Eliminated:
        c, place = self.cells, self.place
        fixed, area, month = self._blocks()
        w = c.weight
        v = np.concatenate((w[..., None], c.weight_x), axis=2)
        cross, linear_psi = self._by_place(v), self._by_place(c.work)
        w_place = cross[..., 0]
        diagonal = w_place + np.exp(-2.0 * log_psi)
        share = cross / diagonal[..., None]  # of the fixed part
        size = month.stop
        h, b = np.zeros((size, size)), np.zeros(size)

        h[0, 0] = w.sum()
        h[0, 1 : fixed.stop] = h[1 : fixed.stop, 0] = c.weight_x.sum(axis=(0, 1))
        h[1 : fixed.stop, 1 : fixed.stop] = c.weight_xx
        h[fixed, fixed] -= np.tensordot(share, cross, axes=((0, 1), (0, 1)))
        h[fixed, area] = v.sum(axis=1).T - np.einsum("stf,st->fs", share[place], w)
        h[fixed, month] = v.sum(axis=0).T - np.einsum("ptf,pt->ft", share, w_place)
        scaled = w / diagonal[place]
        h[area, month] = w - scaled * w_place[place]
        if self.layout.n_places == self.layout.n_areas:
            h[area, area] = np.diag(w.sum(axis=1) - np.sum(w * scaled, axis=1))
        else:
            block = np.diag(w.sum(axis=1))
            for p in range(self.layout.n_places):
                own = np.flatnonzero(place == p)
                block[np.ix_(own, own)] -= scaled[own] @ w[own].T
            h[area, area] = block
        h[month, month] = np.diag(w.sum(axis=0) - np.sum(w_place**2 / diagonal, axis=0))
        for rows, columns in ((area, fixed), (month, fixed), (month, area)):
            h[rows, columns] = h[columns, rows].T

        pull = linear_psi / diagonal
        b[fixed] = np.concatenate(([c.work.sum()], c.work_x)) - np.tensordot(cross, pull, axes=((0, 1), (0, 1)))
        b[area] = c.work.sum(axis=1) - np.sum(w * pull[place], axis=1)
        b[month] = c.work.sum(axis=0) - np.sum(w_place * pull, axis=0)
        return Eliminated(h, b, diagonal, cross, linear_psi, float(np.sum(np.log(diagonal))), 0.5 * float(np.sum(linear_psi * pull)))

    def solve(self, log_sigma: np.ndarray) -> Solution:
        phi, theta, nu, xi, psi = (float(v) for v in log_sigma)
        fixed, area, month = self._blocks()
        rest = self.eliminated(psi)
        area_precision, area_log_det = self.area_prior(phi, theta)
        month_precision, month_log_det = self.month_prior(nu, xi)
        precision = rest.information.copy()
        precision[fixed, fixed] += FIXED_PRECISION * np.eye(fixed.stop)
        precision[area, area] += area_precision
        precision[month, month] += month_precision
        factor = np.linalg.cholesky(precision)
        half = np.linalg.solve(factor, rest.linear)
        sizes = self.layout.sizes()
        value = 0.5 * half @ half + rest.square - np.sum(np.log(np.diag(factor)))
        value -= 0.5 * (rest.log_det + area_log_det + month_log_det)
        value += self.log_hyper(log_sigma) - sum(sizes[name] * s for name, s in zip(EFFECTS, log_sigma))
        return Solution(float(value), factor, half, rest)

    def log_hyper(self, log_sigma: np.ndarray) -> float:
        """Log prior of the log standard deviations, Jacobian included."""
        sigma = np.exp(log_sigma)
        if self.hyper == "half_cauchy":
            return float(np.sum(-np.log1p(sigma**2) + log_sigma))
        return float(np.sum(-PC_RATE * sigma + log_sigma))

    def log_marginal(self, log_sigma: np.ndarray) -> float:
        """Up to a constant."""
        return self.solve(log_sigma).value

    def _parameters(self, solution: Solution, log_sigma: np.ndarray, reduced: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        """Full vectors (rows) from fixed, area and month parts (columns): conditional means or draws."""
        phi, theta, nu, xi, _ = log_sigma
        fixed, area, month = self._blocks()
        n = reduced.shape[1]
        noise = (lambda *shape: rng.standard_normal(shape)) if rng else (lambda *shape: None)
        smooth, free = self.areas.split(reduced[area], phi, theta, noise(self.layout.n_areas, n))
        walk, jump = self.months.split(reduced[month], nu, xi, noise(self.layout.n_months, n))
        rest, w = solution.rest, self.cells.weight
        out = np.empty((n, self.layout.size))
        slices = self.layout.slices()
        for name, values in (("fixed", reduced[fixed]), ("phi", smooth), ("theta", free), ("nu", walk), ("xi", jump)):
            out[:, slices[name]] = values.T
        for k in range(n):
            coupled = rest.cross @ reduced[fixed, k] + rest.cross[..., 0] * reduced[month, k]
            coupled += self._by_place(w * reduced[area, k][:, None])
            psi = (rest.linear_psi - coupled) / rest.diagonal
            if rng:
                psi += rng.standard_normal(psi.shape) / np.sqrt(rest.diagonal)
            out[k, slices["psi"]] = psi.ravel()
        return out

    def mode(self, log_sigma: np.ndarray) -> np.ndarray:
        solution = self.solve(log_sigma)
        reduced = np.linalg.solve(solution.factor.T, solution.half)[:, None]
        return self._parameters(solution, log_sigma, reduced, None)[0]

    def draw(self, log_sigma: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
        """``n`` draws of all effects given the standard deviations, one per row."""
        solution = self.solve(log_sigma)
        noise = rng.standard_normal((len(solution.half), n))
        # not solve(): with few equations and many right sides it hangs in a forked worker (OpenBLAS 0.3.30)
        reduced = np.linalg.inv(solution.factor).T @ (solution.half[:, None] + noise)
        return self._parameters(solution, log_sigma, reduced, rng)

    def penalty(self, theta: np.ndarray, log_sigma: np.ndarray) -> float:
        """Half the squared norm of the parameters under their prior."""
        s = self.layout.slices()
        scale = dict(zip(EFFECTS, np.exp(-2.0 * np.asarray(log_sigma))))
        total = FIXED_PRECISION * np.sum(theta[s["fixed"]] ** 2)
        total += scale["phi"] * self.areas.square(theta[s["phi"]]) + scale["nu"] * self.months.square(theta[s["nu"]])
        return 0.5 * float(total + sum(scale[p] * np.sum(theta[s[p]] ** 2) for p in ("theta", "xi", "psi")))

    def log_prior(self, theta: np.ndarray, log_sigma: np.ndarray) -> float:
        """Log prior as :func:`mosarea.operators.logposterior.log_prior` has it: unscaled effects, no Jacobian."""
        sizes, sigma = self.layout.sizes(), np.exp(log_sigma)
        half_log = 0.5 * np.log(2.0 * np.pi)
        total = -self.penalty(theta, log_sigma) - sizes["fixed"] * (np.log(5.0) + half_log)
        total -= half_log * sum(sizes[p] for p in ("theta", "nu", "xi", "psi"))
        total -= 2.0 * half_log + np.log(AREA_SUM_SD * sizes["phi"]) + np.log(MONTH_SUM_SD * sizes["nu"])
        if self.hyper == "half_cauchy":
            return float(total + np.sum(-np.log1p(sigma**2) - np.log(np.pi)))
        return float(total + np.sum(np.log(PC_RATE / 2.0) + 3.0 * np.log(sigma) - PC_RATE * sigma))


# ------------------------------------------------- integration over the deviations
@dataclass
class Design:
    """Split normal around the mode of the log standard deviations.

    Each axis of the curvature has its own scale on either side, found from how far the
    marginal falls there. Points come from keyed numbers; their weights correct the rest.
    """

    center: np.ndarray
    axes: np.ndarray  # columns: standard deviations along the axes
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def around(cls, function, center: np.ndarray, h: float = 0.05, reach: float = 1.5) -> Design:
        k = len(center)
        hessian, unit, at = np.zeros((k, k)), np.eye(k) * h, function(center)
        for i in range(k):
            hessian[i, i] = (function(center + unit[i]) - 2 * at + function(center - unit[i])) / h**2
            for j in range(i):
                corner = lambda a, b: function(center + a * unit[i] + b * unit[j])
                hessian[i, j] = hessian[j, i] = (corner(1, 1) - corner(1, -1) - corner(-1, 1) + corner(-1, -1)) / (4 * h**2)
        values, vectors = np.linalg.eigh(-hessian)
        # a flat direction is explored as if it had curvature 1/4; the weights know better
        axes = vectors / np.sqrt(np.maximum(values, 0.25))
        scale = lambda sign, j: np.clip(reach / np.sqrt(2.0 * max(at - function(center + sign * reach * axes[:, j]), 0.05)), 0.3, 3.0)
        return cls(center, axes, np.array([scale(1, j) for j in range(k)]), np.array([scale(-1, j) for j in range(k)]))

    def point(self, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """A point and the log density that it was drawn with, up to a constant."""
        k = len(self.center)
        above = rng.random(k) * (self.up + self.down) < self.up
        size = np.abs(rng.standard_normal(k))
        z = np.where(above, size * self.up, -size * self.down)
        return self.center + self.axes @ z, -0.5 * float(np.sum(size**2))


def shares(log_weights: np.ndarray, n: int, u: float) -> np.ndarray:
    """How many of ``n`` draws each point gets: systematic resampling with one uniform number."""
    weights = np.exp(log_weights - np.max(log_weights))
    edges = np.cumsum(weights) / np.sum(weights)
    edges[-1] = 1.0
    return np.bincount(np.searchsorted(edges, (np.arange(n) + u) / n, "left"), minlength=len(weights))

"""Linear-chain conditional random field over hashed features, in numpy.

Sequences of a batch are padded to one length; forward, backward and Viterbi
passes go over positions with all sequences at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 13


@dataclass
class Crf:
    labels: tuple[str, ...]
    emission: np.ndarray  # feature bucket x label
    transition: np.ndarray  # label x label
    start: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """tokens x slots of feature buckets -> tokens x labels."""
        return self.emission[features].sum(axis=1)


def pad(values: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``values`` as sequences x positions x ..., and which positions are real."""
    lengths = np.diff(limits)
    at = limits[:-1, None] + np.arange(lengths.max())
    mask = np.arange(lengths.max()) < lengths[:, None]
    return values[np.minimum(at, len(values) - 1)], mask


def train(features: np.ndarray, limits: np.ndarray, gold: np.ndarray, labels: tuple[str, ...], steps: int = 100, l2: float = 0.02) -> Crf:
    """Maximum penalised likelihood by Adam over all sequences of a small labelled table."""
    k = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    weights = (model.emission, model.transition, model.start)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    n = len(limits) - 1
    padded_gold, mask = pad(gold, limits)
    both = mask[:, 1:]
    want_start = np.bincount(padded_gold[:, 0], minlength=k).astype(float)
    want_step = np.zeros((k, k))
    np.add.at(want_step, (padded_gold[:, :-1][both], padded_gold[:, 1:][both]), 1)
    token_of = np.flatnonzero(mask.ravel())
    flat, slots = features.ravel(), features.shape[1]
    for step in range(1, steps + 1):
        score, _ = pad(model.scores(features), limits)
        size = score.shape[1]
        # scaled passes: each position's forward weights sum to one
        local, step_weight = np.exp(score - score.max(2, keepdims=True)), np.exp(model.transition)
        alpha, beta, scale = np.empty_like(local), np.ones_like(local), np.ones(mask.shape)
        for t in range(size):
            new = (np.exp(model.start) if t == 0 else alpha[:, t - 1] @ step_weight) * local[:, t]
            scale[:, t] = np.where(mask[:, t], new.sum(1), 1)
            alpha[:, t] = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), alpha[:, t - 1])
        edge = np.zeros((k, k))
        for t in range(size - 1, 0, -1):
            ahead = local[:, t] * beta[:, t] / scale[:, t, None]
            own = mask[:, t]
            edge += step_weight * (alpha[own, t - 1].T @ ahead[own])
            beta[:, t - 1] = np.where(mask[:, t, None], ahead @ step_weight.T, beta[:, t])
        node = alpha * beta
        residual = node.reshape(-1, k)[token_of].copy()
        residual[np.arange(len(gold)), gold] -= 1
        grad_emission = np.stack([np.bincount(flat, np.repeat(residual[:, c], slots), BUCKETS) for c in range(k)], 1)
        grads = (grad_emission, edge - want_step, node[:, 0].sum(0) - want_start)
        for w, g, (m, v) in zip(weights, grads, moments):
            g = g / n + l2 * w / n
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def viterbi(model: Crf, features: np.ndarray, limits: np.ndarray, most: int = 200_000) -> np.ndarray:
    """Best label of every token; sequences are decoded in batches of at most ``most`` padded positions."""
    out = np.zeros(len(features), np.int64)
    lengths = np.diff(limits)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * lengths[order[end]] <= most:
            end += 1
        rows = order[begin:end]
        size = lengths[rows].max()
        at = limits[rows][:, None] + np.minimum(np.arange(size), lengths[rows][:, None] - 1)
        score = model.scores(features[at.ravel()]).reshape(len(rows), size, -1)
        best = model.start + score[:, 0]
        back = np.zeros(score.shape, np.int8)
        trace = [best]
        for t in range(1, size):
            through = best[:, :, None] + model.transition
            back[:, t] = through.argmax(1)
            best = through.max(1) + score[:, t]
            trace.append(best)
        label = np.empty((len(rows), size), np.int64)
        last = lengths[rows] - 1
        final = np.stack(trace, 1)[np.arange(len(rows)), last].argmax(1)
        current = final
        for t in range(size - 1, -1, -1):
            current = np.where(t == last, final, current)
            label[:, t] = current
            if t:
                current = np.where(t <= last, back[np.arange(len(rows)), t, current], current)
        real = np.arange(size) < lengths[rows][:, None]
        out[at[real]] = label[real]
        begin = end
    return out

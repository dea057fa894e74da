"""Document quality by hierarchical empirical Bayes.

A classifier reads each document alone and gives evidence, a log likelihood ratio.
Sites speak as well: the good share of a host is shrunk towards the global share, and that
of a path towards its host, each by a strength estimated from the spread between groups
(method of moments). A sparse site stays at its prior, a rich one is itself. The posterior of
a document is its evidence added to the prior of its path, from which its own share is left
out: a document does not vouch for itself.

Site shares are grouped sums over all documents. Only the classifier is fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mosarea.llm.maps import RESULT, map_texts, ragged
from mosarea.llm.words import NOT_BLANK, find_words
from mosarea.session import cut_lineage
from mosarea.sources.tables import settle_dimension

#: most labelled rows that fit the classifier; 14 numbers each
MOST_LABELLED = 50_000
#: shares are summed as whole millionths, so that the order of addition does not matter
UNIT = 1_000_000
#: strength of a prior when groups do not differ at all
STRONGEST = 1_000_000.0

CLASSES = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "stop": [ord(c) for c in ".,;:!?'\"()-"],
    "symbol": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
}
FEATURES = ("log_words", *CLASSES, "word_bytes", "distinct_words", "symbol_words", "lines", "long_words", "repeated_pairs")

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

_TABLES = []
for _codes in CLASSES.values():
    _table = np.zeros(256, bool)
    _table[_codes] = True
    _TABLES.append(_table)
_SYMBOL = _TABLES[list(CLASSES).index("symbol")]


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows)


def measure(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch | None = None) -> list[pa.Array]:
    """Words and features of each text."""
    words = find_words(data, offsets, NOT_BLANK, lower=False)
    rows, row, n = words.rows, words.row_of(), words.counts()
    size = np.maximum(np.diff(offsets), 1)
    each = np.maximum(n, 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    lengths = words.ends - words.starts
    tail = _SYMBOL[data[words.ends - 1]] if len(row) else np.empty(0, bool)
    inner = row[1:] == row[:-1]
    pairs = (words.hashes[1:] * np.uint64(3) + words.hashes[:-1])[inner]
    columns = [
        np.log1p(n),
        *[per_row(t[data]) / size for t in _TABLES],
        np.bincount(row, lengths, rows) / each / 10,
        _distinct(words.hashes, row, rows) / each,
        np.bincount(row, tail, rows) / each,
        per_row(data == 10) / each,
        np.bincount(row, lengths > 20, rows) / each,
        1 - _distinct(pairs, row[1:][inner], rows) / np.maximum(n - 1, 1),
    ]
    flat = np.stack(columns, 1).ravel() if rows else np.empty(0)
    return [pa.array(n.astype(np.int64)), ragged(pa.array(flat), np.arange(rows + 1) * len(FEATURES))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression on raw features; Newton steps.

    The good share of the sample is taken out of the intercept: what is left is evidence.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1)
    center, scale = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack((np.ones(len(y)), (x - center) / scale))
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * np.maximum(p * (1 - p), 1e-9)) @ design + penalty, design.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    weights = w[1:] / scale
    return np.concatenate(([w[0] - weights @ center - np.log(share / (1 - share))], weights))


def _train(measured: DataFrame, labels: DataFrame, doc_id: str, label_id: str, label: str, most: int) -> tuple[np.ndarray, float]:
    """Weights of the evidence, and the smoothed good share of the sample."""
    known = labels.select(F.col(f"`{label_id}`").alias("__id"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null")
    sample = (
        measured.select(F.col(doc_id).alias("__id"), F.col(RESULT)["x"].alias("x"))
        .join(known, "__id")
        .orderBy(F.xxhash64("__id"), "__id", "y", "x")
        .limit(most)
        .select("x", "y")
        .toArrow()
    )
    y = sample.column("y").to_numpy()
    x = np.array(sample.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    return fit(x, (y > 0).astype(float)), (float((y > 0).sum()) + 1) / (len(y) + 2)


def _evidence(weights: np.ndarray) -> Column:
    x = F.col(RESULT)["x"]
    total = F.lit(float(weights[0]))
    for k, w in enumerate(weights[1:]):
        total = total + x[k] * F.lit(float(w))
    return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Beta strength (pseudo-documents) of the prior, from groups of ``n``, ``s`` (sum) and ``q`` (sum of squares).

    Where groups spread no more than chance, the prior is as strong as can be.
    """
    n, mean = F.col("n").cast("double"), F.col("s") / F.col("n")
    found = groups.agg(
        F.count("*").alias("groups"),
        F.sum(n).alias("n"),
        F.sum("s").alias("s"),
        F.sum(n * n).alias("nn"),
        F.sum(F.greatest(F.col("q") - n * mean * mean, F.lit(0.0))).alias("inside"),
        F.sum(n * (mean - prior) * (mean - prior)).alias("apart"),
    ).first()
    if not found["n"]:
        return STRONGEST
    within = found["inside"] / max(found["n"] - found["groups"], 1.0)
    between = (found["apart"] - (found["groups"] - 1) * within) / max(found["n"] - found["nn"] / found["n"], 1.0)
    center = found["s"] / found["n"]
    strength = center * (1 - center) / between - 1 if between > 1e-12 else STRONGEST
    return float(f"{min(max(strength, 1.0), STRONGEST):.9g}")


@dataclass
class Sites:
    """Sums of predicted shares by path and host, and what shrinks them."""

    table: DataFrame  # host, path, n, s, host_n, host_s; sums in whole millionths
    total: tuple[int, int]  # documents and sum
    strengths: tuple[float, float]  # of the global share for a host, of a host for a path

    def prior(self, n: Column, s: Column, host_n: Column, host_s: Column, own: Column | None = None) -> Column:
        """Prior of a path; without the document whose share (millionths) is ``own``."""
        one, share = (F.lit(0), F.lit(0)) if own is None else (F.lit(1), own)
        unit = F.lit(float(UNIT))
        others = F.lit(self.total[0]) - one
        center = F.when(others > 0, (F.lit(self.total[1]) - share) / unit / others).otherwise(0.5)
        k1, k2 = map(F.lit, self.strengths)
        host_mean = ((host_s - share) / unit + k1 * center) / (host_n - one + k1)
        prior = ((s - share) / unit + k2 * host_mean) / (n - one + k2)
        return F.round(F.greatest(F.least(prior, F.lit(1 - 1e-6)), F.lit(1e-6)), 9)


def count_sites(scored: DataFrame) -> Sites:
    """From documents with ``host``, ``path`` and ``p`` (whole millionths).

    Two sums and two strengths reach the driver.
    """
    paths = cut_lineage(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    )
    hosts = cut_lineage(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]))
    n, s = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    shares = [F.col("n"), (F.col("s") / float(UNIT)).alias("s"), (F.col("q") / float(UNIT) ** 2).alias("q")]
    center = s / UNIT / n if n else 0.5
    k1 = _strength(hosts.select(*shares), F.lit(center))
    table = cut_lineage(paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host"))
    host_mean = (F.col("host_s") / float(UNIT) + k1 * center) / (F.col("host_n") + k1)
    k2 = _strength(table.select(*shares, host_mean.alias("host_mean")), F.col("host_mean"))
    return Sites(table.drop("q"), (n, s), (k1, k2))


def classify(
    documents: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    label_id: str = "doc_id",
    label: str = "quality",
    most_labelled: int = MOST_LABELLED,
    threshold: float = 0.5,
) -> DataFrame:
    """Columns ``keep`` and ``__evidence``, ``__prior``, ``__posterior``, ``__good``.

    ``label`` is positive for good documents; rows with a null label or id are not used, repeated
    ones count each. ``__prior`` leaves the document's own share out; one alone in its host
    has the share of all others. A null host or path is a site of its own. A text without words (null, empty or
    blank) is never good. Without labels of both kinds there is no evidence and sites
    decide nothing. Ties at the threshold are good. Empty tables give an empty table.
    The table of sites is measured as it is written: within the session's broadcast limit it is sent to
    the documents, a larger one meets them by shuffle, where a hot site is split by the skew join.
    """
    keep = list(documents.columns if keep is None else keep)
    site = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in (host, path)]
    sited = documents.withColumns({"__host": site[0], "__path": site[1], "__doc": F.col(f"`{doc_id}`")})
    carried = [*keep, "__host", "__path", "__doc"]
    light = text not in keep
    measured = map_texts(sited, text, FOUND, lambda: measure, carried if light else ["__host", "__path", "__doc"])
    measured = cut_lineage(measured)
    weights, share = _train(measured, labels, "__doc", label_id, label, most_labelled)
    evidence = F.when(F.col(RESULT)["n_words"] > 0, _evidence(weights)).otherwise(-30.0)
    shift = float(np.log(share / (1 - share)))
    p = F.round(F.lit(UNIT) / (1 + F.exp(-(evidence + shift)))).cast("long")
    sites = count_sites(measured.select(F.col("__host").alias("host"), F.col("__path").alias("path"), p.alias("p")))

    # texts are measured again rather than written: reading is cheaper than shuffling them by id
    full = measured if light else map_texts(sited, text, FOUND, lambda: measure, carried)
    known = settle_dimension(sites.table.select(*[F.col(c).alias(f"__{c}") for c in sites.table.columns]))
    judged = full.join(known, ["__host", "__path"])
    prior = sites.prior(*[F.col(f"__{c}") for c in ("n", "s", "host_n", "host_s")], p)
    posterior = F.lit(1.0) / (1 + F.exp(-(F.col("__evidence") + _logit(F.col("__prior")))))
    return (
        judged.withColumns({"__evidence": evidence, "__prior": prior})
        .withColumn("__posterior", posterior)
        .withColumn("__good", (F.col(RESULT)["n_words"] > 0) & (F.col("__posterior") >= threshold))
        .select(*[F.col(f"`{c}`") for c in keep], "__evidence", "__prior", "__posterior", "__good")
    )

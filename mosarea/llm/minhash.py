"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle fills ``bands * rows`` bins with their smallest value; an empty
bin takes the value of the first filled one in its own random order of bins (optimal
densification), so two sets agree in a bin with probability equal to their
similarity. ``rows`` bins make a band; equal bands put documents in one bucket. With 40
bands of 6, a pair at similarity 0.8 shares no bucket with probability 5e-6.

A bucket gives a star of candidate edges from its smallest document, not all pairs;
a document takes the hub that it meets in most buckets. Candidates are confirmed on the
full sets of 64-bit shingle hashes. Stars alone would lose a link between two leaves whose
hub resembles neither. So the documents of buckets whose members are still in
different components are compared once more, exactly and without all pairs: two
sets above the threshold share one of their rarest shingles near the front of both, and
only pairs of different components that do are confirmed.

Equal sets are one node throughout, so groups of exact copies cost one row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from mosarea.llm.components import star_components
from mosarea.llm.maps import RESULT, map_texts, ragged
from mosarea.llm.words import NOT_BLANK, U64, find_words, mix, shingle_hashes
from mosarea.session import cut_lineage

BANDS, ROWS = 40, 6

SKETCH = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("s1", T.LongType()),
        T.StructField("s2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
SET = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """Row j ranks all bins in the order in which an empty bin j tries them."""
    return np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1).argsort(axis=1).astype(np.uint16)


def signatures(values: np.ndarray, limits: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketches of sorted distinct hashes; rows without values are zero."""
    rows = len(limits) - 1
    row = np.repeat(np.arange(rows), np.diff(limits))
    cell = row * bins + ((values >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]))
    out = np.zeros(rows * bins, U64)
    filled = np.zeros(rows * bins, bool)
    out[cell[first]], filled[cell[first]] = values[first], True
    out, filled = out.reshape(rows, bins), filled.reshape(rows, bins)
    orders = _orders(bins)
    for r in np.flatnonzero(filled.any(1) & ~filled.all(1)):
        have, lack = np.flatnonzero(filled[r]), np.flatnonzero(~filled[r])
        out[r, lack] = out[r, have[orders[np.ix_(lack, have)].argmin(1)]]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    factors = np.random.default_rng(rows).integers(1, 1 << 63, rows, dtype=np.uint64) * U64(2) + U64(1)
    parts = signature.reshape(len(signature), bands, rows)
    total = np.zeros(parts.shape[:2], U64)
    for k in range(rows):
        total += mix(parts[:, :, k]) * factors[k]
    return mix(total + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values)))
    return (total[limits[1:]] - total[limits[:-1]]).view(np.int64)


def sketch(documents: DataFrame, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, n, s1, s2, bands`` of each document; ``n, s1, s2`` stand for the set itself."""

    def make():
        def run(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
            values, limits = shingle_hashes(find_words(data, offsets, NOT_BLANK), shingle)
            counts = np.diff(limits)
            keys = band_keys(signatures(values, limits, bands * rows), bands, rows)[counts > 0]
            return [
                pa.array(counts.astype(np.int64)),
                pa.array(_sums(mix(values ^ U64(0x5851F42D4C957F2D)), limits)),
                pa.array(_sums(mix(values * U64(0xDA942042E4DD58B5)), limits)),
                ragged(pa.array(keys.view(np.int64).ravel()), np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0))))),
            ]

        return run

    one = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return map_texts(one, "text", SKETCH, make, ["id"]).select("id", f"{RESULT}.*")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """``id, shingles`` of documents ``id, text``."""

    def make():
        def run(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
            values, limits = shingle_hashes(find_words(data, offsets, NOT_BLANK), shingle)
            return [ragged(pa.array(values.view(np.int64)), limits)]

        return run

    return map_texts(documents, "text", SET, make, ["id"]).select("id", f"{RESULT}.shingles")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = edges.join(left, "a").join(right, "b")
    return joined.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def _sizes_allow(percent: int, x: str, y: str) -> F.Column:
    """The smaller set must have ``percent`` of the larger one."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of
    ``shingle`` words, or the whole sequence of a shorter text. Null and empty texts have empty
    sets and are linked with nothing. ``component_id`` is the smallest id reachable over links,
    ``kept`` says that it is the row's own. Rows with one id and different texts are one
    document with several texts; repeated rows are repeated in the result. A row
    without an id links nothing: its component is null and it is kept. Other columns
    are not read. An empty table gives an empty table.
    """
    sketched = cut_lineage(sketch(documents, doc_id, text, shingle, bands, rows))
    usable = sketched.where("n > 0 and id is not null")
    classes = cut_lineage(usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    labels = _labels(documents, doc_id, text, shingle, percent, usable, classes)
    named = classes.join(labels, classes["rep"] == labels["id"], "left").select(
        "s1", "s2", "n", F.coalesce("label", "rep").alias("component_id")
    )
    named = cut_lineage(named)
    # the larger side is rows, the other one row per distinct set: a hot set is split by the skew join
    return sketched.join(named, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _labels(documents: DataFrame, doc_id: str, text: str, shingle: int, percent: int, usable: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, label`` of the representatives that are not their own label."""
    nodes = usable.join(classes.withColumnRenamed("rep", "id"), ["id", "s1", "s2", "n"], "left_semi")
    placed = nodes.select(F.explode("bands").alias("bucket"), "id", "n")
    buckets = cut_lineage(placed.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last"))
    members = cut_lineage(placed.join(buckets.select("bucket", "hub"), "bucket"))

    candidates = members.select("id").distinct()
    source = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = cut_lineage(shingle_sets(source.join(candidates, "id", "left_semi"), shingle))

    # first star: of the hubs of its buckets, each member takes the one it meets most often
    met = members.where("id > hub").groupBy("id", "hub").agg(F.count("*").alias("times"))
    best = met.groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("hub"))).alias("best"))
    edges = best.select(F.col("id").alias("a"), (-F.col("best.hub")).alias("b"))
    labels = star_components(confirm(edges, sets, percent))

    # buckets whose members are still apart
    known = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    unsettled = cut_lineage(known.join(apart.select("bucket"), "bucket").select("id", "label").distinct())
    found = cut_lineage(confirm(_rare_pairs(sets.join(unsettled, "id"), percent), sets, percent))
    if found.isEmpty():
        return labels
    return star_components(found.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different labels that may reach ``percent``; no pair that does is missing.

    Shingles are ordered by how many of these sets hold them. Similar sets share a shingle among
    the first of both, and what follows their first common one must suffice for the intersection.
    A shingle whose sets have one label is dropped; of a pair, one side has a label that is not
    the commonest at that shingle, so large components are not compared with themselves.
    """
    own = sets.select("id", "label", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("set"), F.explode("shingles").alias("shingle"))
    often = own.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    rarest = Window.partitionBy("id", "set").orderBy("often", "shingle")
    placed = own.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    placed = placed.withColumn("at", F.row_number().over(rarest) - 1)
    front = placed.where((F.col("often") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    front = cut_lineage(front.select("shingle", "id", "label", "n", "at"))
    common = front.groupBy("shingle", "label").agg(F.count("*").alias("times")).groupBy("shingle")
    common = common.agg(F.count("*").alias("labels"), F.max(F.struct("times", "label")).alias("top")).where("labels > 1")
    mixed = front.join(common.select("shingle", F.col("top.label").alias("top")), "shingle")
    few = mixed.where("label <> top").select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "at")])
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    pairs = few.join(mixed, "shingle").where((F.col("label") != F.col("label2")) & _sizes_allow(percent, "n", "n2") & (left >= need))
    return pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()

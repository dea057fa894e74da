"""Exact duplicates by skew-safe combining.

Three stages, each comparing the full normalised texts; a digest only deals them out:

1. every task combines its own rows in a table of digests and texts of bounded size, so a
   text that a third of all rows share leaves a task as one row or a few;
2. those rows meet by digest, text and salt; the salt follows the task that read them, so
   the rows of one hot text are merged by several tasks;
3. the winners of the salts meet by digest and text.

A group's row holds its winner and size. Rows find their group by digest, and by text too
where different texts have one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from mosarea.llm.words import NOT_BLANK, slices
from mosarea.session import cut_lineage, ship_package

SALTS = 32
#: a task hands its table of texts on when it holds so much text
LOCAL_BYTES = 32 << 20


def bare_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without blanks, their row limits, and the code points of each original text."""
    keep = NOT_BLANK[data]
    before = np.concatenate(([0], np.cumsum(keep)))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return data[keep], before[offsets], np.diff(points[offsets])


class LocalGroups:
    """Groups of one task's rows: digest -> texts with that digest, each with its winner and size."""

    def __init__(self, schema: T.StructType, salt: int):
        self.types = [to_arrow_type(f.dataType) for f in schema.fields]
        self.names, self.salt = schema.names, salt
        self.found: dict[bytes, list[list]] = {}
        self.bytes = 0

    def add(self, key: bytes, sha: bytes, content: bytes, minus_length: int, doc_id) -> None:
        rank = (minus_length, doc_id is None, doc_id)
        for group in self.found.setdefault(key, []):
            if group[1] == content:
                group[3] += 1
                if rank[:2] < group[2][:2] or rank[:2] == group[2][:2] and doc_id is not None and doc_id < group[2][2]:
                    group[2] = rank
                return
        self.found[key].append([sha, content, rank, 1])
        self.bytes += len(content) + 200

    def take(self) -> pa.RecordBatch:
        rows = [(key, g[0], g[1], self.salt, *g[2], g[3]) for key, groups in self.found.items() for g in groups]
        self.found, self.bytes = {}, 0
        columns = zip(*rows) if rows else [()] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.types)], names=self.names)


def _source(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    ship_package(documents.sparkSession)
    return documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def local_groups(documents: DataFrame, doc_id: str, text: str, digest_bytes: int, salts: int) -> DataFrame:
    """``key, sha, content, salt, minus_length, no_id, id, size``: first stage."""
    source = _source(documents, doc_id, text)
    schema = T.StructType.fromDDL("key binary, sha binary, content binary, salt int, minus_length long, no_id boolean")
    schema = schema.add("id", source.schema["id"].dataType).add("size", T.LongType())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = LocalGroups(schema, TaskContext.get().partitionId() % salts)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bare, limits, points = bare_texts(data, offsets)
                ids, bare = part.column("id").to_pylist(), bare.tobytes()
                for k, doc in enumerate(ids):
                    content = bare[limits[k] : limits[k + 1]]
                    sha = hashlib.sha256(content).digest()
                    groups.add(sha[:digest_bytes], sha, content, -int(points[k]), doc)
                if groups.bytes > LOCAL_BYTES:
                    yield groups.take()
        yield groups.take()

    return source.mapInArrow(combine, schema)


def digests(documents: DataFrame, doc_id: str, text: str, digest_bytes: int, with_content: bool = False) -> DataFrame:
    """``id, length, sha, key`` of every row, and its normalised text if asked."""
    source = _source(documents, doc_id, text)
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("length long, sha binary, content binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bare, limits, points = bare_texts(data, offsets)
                bare = bare.tobytes()
                contents = [bare[limits[k] : limits[k + 1]] for k in range(part.num_rows)]
                shas = pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary())
                kept = pa.array(contents, pa.binary()) if with_content else pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(points, pa.int64()), shas, kept], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("key", F.substring("sha", 1, digest_bytes))


def groups_of_equal_texts(documents: DataFrame, doc_id: str, text: str, digest_bytes: int = 32, salts: int = SALTS) -> DataFrame:
    """``key, content, sha, winner, size`` of each distinct normalised text.

    ``winner`` is the smallest (minus length, id missing, id): the longest original text, then the smallest id.
    """
    local = local_groups(documents, doc_id, text, digest_bytes, salts)
    best = F.min(F.struct("minus_length", "no_id", "id")).alias("winner")
    salted = local.groupBy("key", "salt", "content").agg(F.first("sha").alias("sha"), best, F.sum("size").alias("size"))
    merged = salted.groupBy("key", "content")
    return merged.agg(F.first("sha").alias("sha"), F.min("winner").alias("winner"), F.sum("size").alias("size"))


def exact_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32, salts: int = SALTS
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null
    counts as empty, so all texts without other characters are one group. Of equal texts the
    row with the most code points in the original text stays, then the one with the smallest
    id; a row without an id stays only if no row of that length has one. ``kept`` is true
    for the row that stays and for rows that repeat its id and length. ``group_size`` counts all
    rows. Other columns are not read; an empty table gives an empty table. ``digest_bytes``
    shortens the digest that deals out the texts; the result does not depend on it.
    """
    groups = groups_of_equal_texts(documents, doc_id, text, digest_bytes, salts)
    settled = cut_lineage(groups.select("key", "winner", "size"))
    if settled.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").isEmpty():
        # the larger side is rows, the other one row per text: a hot text is split by the skew join
        joined = digests(documents, doc_id, text, digest_bytes).join(settled, "key")
    else:
        # some digest stands for several texts: the texts themselves decide
        joined = digests(documents, doc_id, text, digest_bytes, True).join(groups.drop("sha"), ["key", "content"])
    stays = F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("length") == -F.col("winner.minus_length"))
    return joined.select(
        F.col("id").alias(doc_id),
        F.col("winner.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

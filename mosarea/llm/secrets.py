"""Secrets in texts, told apart from copied examples by who owns them.

Each task finds candidates in whole texts. The hash of a candidate's value is then
counted over the corpus by distinct owners and repositories: a value seen with several owners,
or copied over many repositories of one, is a widely copied example; one that belongs to a single
owner, stays in few of its repositories and does not look made up is reported as live. The values themselves are never shuffled, only hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mosarea.llm.maps import RESULT, map_texts
from mosarea.llm.spans import SPAN, Span, digest, join_spans, ordered, row_texts
from mosarea.session import cut_lineage

KINDS = ("assign", "access", "hex", "live")

# ASCII: letters match in either case without their Unicode look-alikes
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run of at least 32, which is what a run of any length gives after short ones are dropped
HEX = re.compile(r"[0-9a-f]{32,}")

LEAST_DISTINCT = 6

CANDIDATE = T.StructType(
    [*SPAN.fields, T.StructField("value_start", T.IntegerType()), T.StructField("value_hash", T.StringType()), T.StructField("plausible", T.BooleanType())]
)
FOUND = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("candidates", T.ArrayType(CANDIDATE)),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of all base spans, unordered."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign", m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return found


def plausible(value: str) -> bool:
    """Not a filler: at least one digit and several distinct characters."""
    return len(set(value)) >= LEAST_DISTINCT and any("0" <= c <= "9" for c in value)


def _scan(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
    counts: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
    digests, candidates = [], []
    for text in row_texts(data, offsets):
        found = base_spans(text)
        spans: list[Span] = ordered([f[:3] for f in found], KINDS)
        for kind, column in counts.items():
            column.append(sum(s[2] == kind for s in spans))
        digests.append(digest(spans))
        own = []
        for start, end, kind, value_start in found:
            value = text[value_start:end]
            own.append(
                {"start": start, "end": end, "kind": kind, "value_start": value_start,
                 "value_hash": hashlib.blake2b(value.encode(), digest_size=16).hexdigest(), "plausible": plausible(value)}
            )
        candidates.append(own)
    kind_type = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value_start", pa.int32()), ("value_hash", pa.string()), ("plausible", pa.bool_())]
    )
    return [*[pa.array(c, pa.int64()) for c in counts.values()], pa.array(digests, pa.string()), pa.array(candidates, pa.list_(kind_type))]


def find_secrets(
    documents: DataFrame,
    owner: F.Column,
    repository: F.Column,
    doc_id: str = "doc_id",
    text: str = "text",
    most_owners: int = 1,
    most_repositories: int = 2,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, candidates, spans, ownership`` of every row.

    ``candidates`` are the base spans; ``spans`` has them and a span ``live`` on the value of each
    candidate that looks real and has at most ``most_owners`` distinct owners and ``most_repositories``
    distinct repositories (of an owner) in the corpus.
    ``ownership`` gives, per distinct candidate hash of the row, its numbers of owners and repositories.
    Null text is empty and has no spans; a null owner or repository is one of its own;
    repeated rows are repeated in the result and add no owner. Other columns are not read.
    An empty table gives an empty table.
    """
    one = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    )
    # written once, without texts; row numbers over the written files stay the same after a retry
    scanned = cut_lineage(map_texts(one, "text", FOUND, lambda: _scan, ["doc_id", "owner", "repository"]))
    scanned = scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", f"{RESULT}.*")
    seen = scanned.select("row", "owner", "repository", F.explode("candidates").alias("c")).select(
        "row", "owner", "repository", F.col("c.value_hash").alias("value_hash")
    )
    owners = cut_lineage(
        seen.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("value_hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))
    )
    judged = (
        seen.select("row", "value_hash").distinct().join(owners, "value_hash")
        .groupBy("row").agg(F.collect_list(F.struct("value_hash", "owners", "repositories")).alias("ownership"))
    )
    full = scanned.join(judged, "row", "left")
    few = F.transform(F.filter("ownership", lambda o: (o["owners"] <= most_owners) & (o["repositories"] <= most_repositories)), lambda o: o["value_hash"])
    live = F.transform(
        F.filter("candidates", lambda c: c["plausible"] & F.array_contains(few, c["value_hash"])),
        lambda c: F.struct(c["value_start"].alias("start"), c["end"].alias("end"), F.lit("live").alias("kind")),
    )
    base = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    spans = F.array_distinct(F.concat(base, F.coalesce(live, F.array().cast(T.ArrayType(SPAN)))))
    return full.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "candidates", spans.alias("spans"),
        F.coalesce("ownership", F.array().cast("array<struct<value_hash:string,owners:bigint,repositories:bigint>>")).alias("ownership"),
    )


def spans_text(spans: F.Column) -> F.Column:
    return join_spans(spans, KINDS)

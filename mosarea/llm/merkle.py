"""Merkle manifest of a table as a postorder append log.

The rows of a group (a source) are the leaves of a tree with runs of ``ARITY`` children; the
groups' roots are the leaves of one more tree. Leaves get their number in the group by a
range sort and prefix sums over ranges, so that no task sees a whole group. Aligned blocks
of ``ARITY ** HEIGHT`` leaves go to builders that append each node when it is complete: a
leaf, then every parent whose run ends with it. The roots of the blocks are the leaves of
the next round, until a tree has one node.

A subtree's nodes lie together in the log, each tree's root last, so the place of a node
follows from subtree sizes alone: node ``index`` of ``level`` ends with leaf ``e = min(ARITY **
level * (index + 1), n) - 1``, before which ``e // ARITY ** t`` nodes of every level ``t`` were
complete. Proofs read the siblings at these places, from the top round down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosarea.session import cut_lineage, ship_package
from mosarea.sources.tables import settle_dimension

ARITY, HEIGHT = 3, 6
BLOCK = ARITY**HEIGHT
DIGEST = 32
#: the tree of the groups' roots
TOP = -1

LOG_SCHEMA = "tree long, n long, block long, nodes binary"
PATH_SCHEMA = "tree long, block long, path binary, subroot binary, root binary"


# ----------------------------------------------------------------- in a block
def parent(children: Sequence[bytes]) -> bytes:
    """Digest of the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def tree_height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


def append_nodes(leaves: Sequence[bytes], height: int) -> list[bytes]:
    """All nodes up to ``height`` levels above the leaves, in the order of their completion."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height)]
    for k, node in enumerate(leaves):
        log.append(node)
        for run in open_runs:
            run.append(node)
            if len(run) < ARITY and k < len(leaves) - 1:
                break
            node = parent(run)
            run.clear()
            log.append(node)
    return log


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the log of a tree with ``n`` leaves."""
    last = min(ARITY**level * (index + 1), n) - 1
    place, power = last + level, ARITY
    while power <= last:
        place += last // power
        power *= ARITY
    return place


def sibling_places(level: int, index: int, n: int) -> tuple[list[int], list[int]]:
    """Places of the other nodes of the run, left and right of the node."""
    count = -(-n // ARITY**level)
    first = index - index % ARITY
    run = range(first, min(first + ARITY, count))
    return [position(level, k, n) for k in run if k < index], [position(level, k, n) for k in run if k > index]


@dataclass(slots=True)
class Step:
    """One level of a proof: hex digests left and right of the node, then the levels above."""

    left: bytes
    right: bytes
    above: Step | None

    def siblings(self) -> bytes:
        step, out = self, []
        while step is not None:
            out += [step.left, step.right]
            step = step.above
        return b"".join(out)

    def fold(self, leaf: bytes) -> bytes:
        """Root from a leaf, both hex."""
        step = self
        while step is not None:
            leaf = hashlib.sha256(step.left + leaf + step.right).hexdigest().encode()
            step = step.above
        return leaf


def write_path(step: Step | None) -> bytes:
    """A path as bytes: per level the numbers of left and right siblings, then their digests."""
    out = []
    while step is not None:
        width = 2 * DIGEST
        out.append(bytes((len(step.left) // width, len(step.right) // width)) + bytes.fromhex((step.left + step.right).decode()))
        step = step.above
    return b"".join(out)


def read_path(path: bytes) -> Step | None:
    levels, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        middle, end = at + 2 + left * DIGEST, at + 2 + (left + right) * DIGEST
        levels.append((path[at + 2 : middle].hex().encode(), path[middle:end].hex().encode()))
        at = end
    step = None
    for left, right in reversed(levels):
        step = Step(left, right, step)
    return step


def leaf_steps(nodes: bytes, n: int, height: int, above: Step | None) -> list[Step | None]:
    """Proof of every leaf of a block; nodes of a run share the levels above it."""
    hexed = nodes.hex().encode()
    at = lambda place: hexed[2 * DIGEST * place : 2 * DIGEST * (place + 1)]
    steps = [above]
    for level in reversed(range(height)):
        found = []
        for index in range(-(-n // ARITY**level)):
            left, right = sibling_places(level, index, n)
            found.append(Step(b"".join(map(at, left)), b"".join(map(at, right)), steps[index // ARITY]))
        steps = found
    return steps


def block_shape(n: int, block: int) -> tuple[int, int]:
    """Leaves of a block of a tree with ``n``, and the levels above them that it holds."""
    if n <= BLOCK:
        return n, tree_height(n)
    return min(BLOCK, n - block * BLOCK), HEIGHT


# ------------------------------------------------------------------- in Spark
def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns, each ``-`` if null, otherwise its UTF-8 byte count, ``:`` and the value."""
    text = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree`` (ascends with ``group``, nulls first), its size ``n`` and ``index`` in it by ``order``.

    Rows are range sorted; a range's rows are numbered where they lie, and counts per range
    and group (ranges + groups rows) give the offsets. Alike rows are dealt over ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    settled = cut_lineage(rows).withColumn("__tie", F.monotonically_increasing_id())
    ranged = settled.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()))
    runs = placed.groupBy("__range", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("__range").alias("__r"),
        F.col(group).alias("__g"),
        (F.coalesce(F.sum("__count").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.min("__first").over(whole).alias("tree"),
        F.sum("__count").over(whole).alias("n"),
    )
    same = (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g"))
    return (
        placed.join(settle_dimension(runs), same)
        .withColumn("index", F.col("__at") + F.col("__shift"))
        .drop("__at", "__range", "__r", "__g", "__shift")
    )


def _build(table: pa.Table) -> pa.Table:
    """Log of one block from its leaves ``tree, n, block, index, digest``."""
    tree, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
    leaves = table.sort_by("index").column("digest").to_pylist()
    _, height = block_shape(n, block)
    nodes = b"".join(append_nodes(leaves, height))
    return pa.table({"tree": pa.array([tree], pa.int64()), "n": pa.array([n], pa.int64()), "block": pa.array([block], pa.int64()), "nodes": pa.array([nodes], pa.binary())})


def build_rounds(leaves: DataFrame) -> list[DataFrame]:
    """Logs ``tree, n, block, nodes`` of all rounds over ``tree, n, index, digest``, each written to the shared folder."""
    ship_package(leaves.sparkSession)
    logs, nodes = [], leaves
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = nodes.select("tree", "n", F.expr(f"index div {BLOCK}").alias("block"), "index", "digest")
        logs.append(cut_lineage(blocks.groupBy("tree", "block").applyInArrow(_build, LOG_SCHEMA)))
        if largest <= BLOCK:
            return logs
        largest = -(-largest // BLOCK)
        nodes = logs[-1].where(F.col("n") > BLOCK).select(
            "tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("index"), _last("nodes").alias("digest")
        )


def _last(nodes: str) -> Column:
    """Digest of the node that was appended last."""
    return F.expr(f"substring({nodes}, -{DIGEST}, {DIGEST})")


def _roots(logs: Sequence[DataFrame]) -> DataFrame:
    """``tree, digest`` of trees that have one node after a round."""
    found = [log.where(F.col("n") <= BLOCK).select("tree", _last("nodes").alias("digest")) for log in logs]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _paths(log: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, block, path, subroot, root`` of the leaves of a round; ``block`` is the leaf's number."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, height = block_shape(row["n"], row["block"])
                steps = leaf_steps(row["nodes"], n, height, read_path(row["path"]))
                first = row["block"] * BLOCK
                columns = [[row["tree"]] * n, range(first, first + n), map(write_path, steps), [row["subroot"]] * n, [row["root"]] * n]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "block", "path", "subroot", "root"])

    return log.join(above, ["tree", "block"]).mapInArrow(expand, PATH_SCHEMA)


@dataclass
class Manifest:
    """Leaves, logs by round, and for every block of the first round the path from its root to the top.

    ``leaves`` has the columns ``tree, n, index, digest`` and those carried along; ``trees`` is
    ``tree`` and the group's value.
    """

    leaves: DataFrame
    trees: DataFrame
    logs: list[DataFrame]
    top_logs: list[DataFrame]
    paths: DataFrame

    def log(self) -> DataFrame:
        """``tree, position, level, index, digest`` of every node of the groups' trees, once each."""

        def unfold(first_level: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        n, height = block_shape(row["n"], row["block"])
                        # the leaves of a later round are the roots of the round before
                        cells = [(l, k) for l in range(first_level > 0, height + 1) for k in range(-(-n // ARITY**l))]
                        index = [row["block"] * ARITY ** (HEIGHT - l) + k for l, k in cells]
                        level = [first_level + l for l, _ in cells]
                        nodes = [row["nodes"][DIGEST * p : DIGEST * (p + 1)] for p in (position(l, k, n) for l, k in cells)]
                        place = [position(l, k, row["leaves"]) for l, k in zip(level, index)]
                        columns = [[row["tree"]] * len(cells), place, level, index, [x.hex() for x in nodes]]
                        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "position", "level", "index", "digest"])

            return run

        sizes = self.leaves.groupBy("tree").agg(F.max("n").alias("leaves"))
        out = None
        for k, log in enumerate(self.logs):
            part = log.join(sizes, "tree").mapInArrow(unfold(k * HEIGHT), "tree long, position long, level int, index long, digest string")
            out = part if out is None else out.unionByName(part)
        return out

    def verify(self, keep: str, claimed: str) -> DataFrame:
        """Per leaf: ``keep``, ``leaf, subroot, root, proof_sha256, folded_root`` (hex) and ``verified``.

        ``claimed`` is a digest carried with each leaf; ``folded_root`` is the root that follows from it
        and the leaf's proof.
        """
        kind = self.leaves.schema[keep].dataType.simpleString()
        schema = f"kept {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

        def prove(leaves: pa.Table, logs: pa.Table) -> pa.Table:
            leaves = leaves.sort_by("index")
            row = logs.to_pylist()[0]
            n, height = block_shape(row["n"], row["block"])
            steps = leaf_steps(row["nodes"], n, height, read_path(row["path"]))
            root = row["root"].hex()
            proofs = [hashlib.sha256(s.siblings() if s else b"").hexdigest() for s in steps]
            given = [d.hex().encode() for d in leaves.column("claimed").to_pylist()]
            folded = [(s.fold(d) if s else d).decode() for s, d in zip(steps, given)]
            return pa.table(
                {
                    "kept": leaves.column("kept"),
                    "leaf": [d.hex() for d in leaves.column("digest").to_pylist()],
                    "subroot": [row["subroot"].hex()] * n,
                    "root": [root] * n,
                    "proof_sha256": proofs,
                    "folded_root": folded,
                    "verified": [f == root for f in folded],
                }
            )

        leaves = self.leaves.select(
            "tree", F.expr(f"index div {BLOCK}").alias("block"), "index", "digest", F.col(claimed).alias("claimed"), F.col(keep).alias("kept")
        )
        logs = self.logs[0].join(self.paths, ["tree", "block"])
        proven = leaves.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInArrow(prove, schema)
        return proven.withColumnRenamed("kept", keep)


def build_manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """Trees over ``rows``, which have a binary column ``digest``; other columns are carried along.

    A tree per value of ``group`` (null is a group of its own, the first), its leaves ascending
    by ``order`` (nulls first, then by digest; alike rows are leaves of their own). Consecutive nodes in
    runs of three, the last run shorter, become their parent until one node remains; a lone
    leaf is its own root. The trees' roots, ordered by group, make one tree in the same way.
    An empty table gives empty logs and no root.
    """
    leaves = cut_lineage(numbered(rows, group, [order, "digest"]))
    trees = leaves.groupBy("tree").agg(F.first(group).alias(group))
    logs = build_rounds(leaves.select("tree", "n", "index", "digest"))

    subroots = _roots(logs).withColumnRenamed("digest", "subroot").withColumn("all", F.lit(0))
    subroots = cut_lineage(numbered(subroots.withColumnRenamed("tree", "source_tree"), "all", ["source_tree"]))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), "n", "index", F.col("subroot").alias("digest"))
    top_logs = build_rounds(top)
    root = F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot")
    above = _roots(top_logs).select("tree", F.lit(0).cast("long").alias("block"), *root, F.col("digest").alias("root"))
    for log in reversed(top_logs):
        above = _paths(log, above)
    tops = subroots.select("index", "source_tree", "subroot").join(above.select(F.col("block").alias("index"), "path", "root"), "index")
    tops = cut_lineage(tops.select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "subroot", "root"))

    paths = None
    for k in reversed(range(len(logs))):
        # trees that end in this round meet the top, the others the round above
        ends = tops.join(logs[k].where(F.col("n") <= BLOCK).select("tree"), "tree", "left_semi")
        paths = ends if paths is None else ends.unionByName(paths)
        if k:
            paths = _paths(logs[k], paths)
    return Manifest(leaves, trees, logs, top_logs, paths)

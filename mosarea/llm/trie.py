"""Prefix trie of conversations from padded turn-id matrices.

A turn is known by 128 bits of its role and text, a conversation by the sequence of its
turns. Sequences are range sorted, so that the members of a node lie together; equal
sequences are ordered by conversation, so that a hot one may span ranges. In a range,
slices of rows become matrices of turn ids padded with 0: numpy sorts them (``lexsort``),
marks the columns that differ from the row above and ors the marks along the columns; a
mark in column d then says that the row begins a node of depth d + 1. Sums over the rows
of every node are one ``reduceat`` per depth.

All results are sums over rows, given how many turns a row shares with the row above:
a node's new text and its children are counted where they begin, a leaf at its last row.
Nodes inside a slice are final. Those with a slice's first or last row may go on next door: they come
as parts, corrected by what two adjoining slices both counted, and recombine by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from mosarea.session import cut_lineage, ship_package

#: cells of one padded matrix; a longer conversation is a matrix of its own
CELLS = 1 << 21
#: ids in one piece of a list of conversations that end in an unfinished node
CHUNK = 1000
ROOT_KEY = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE, PART, ENDS, FIRST, LAST = range(5)

PIECES = pa.schema(
    [
        ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv", pa.int64()), ("depth", pa.int64()),
        ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
        ("ends", pa.string()), ("shard", pa.int32()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())),
    ]
)
PIECES_DDL = (
    "kind int, key binary, parent_key binary, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, "
    "saved long, ends string, shard int, seq long, ids array<long>, lens array<long>"
)


# ------------------------------------------------------------------- sequences
def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, ids, lens``: a conversation's turns in order, two longs and the code points of each.

    Ordered by turn, null first, then by the two longs. Null roles and texts are empty; rows without
    a conversation belong to none. Texts are hashed where they lie; a row is 24 bytes per turn.
    """
    name = lambda c: F.col(f"`{c}`")
    said = [F.coalesce(name(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.where(name(conv).isNotNull()).select(
        name(conv).alias("conv"),
        F.struct(
            name(turn).alias("turn"),
            F.xxhash64(F.lit(1), *said).alias("a"),
            F.xxhash64(F.lit(2), *said).alias("b"),
            F.length(said[1]).cast("long").alias("n"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"])))
    return ordered.select("conv", pairs.alias("ids"), F.col("t.n").alias("lens"))


# -------------------------------------------------------------------- a slice
@dataclass
class Path:
    """One row of a slice: its turns and the keys of the nodes along them, root first."""

    ids: np.ndarray  # turns x 2
    lens: np.ndarray
    keys: list[bytes]

    @classmethod
    def of(cls, ids: np.ndarray, lens: np.ndarray) -> Path:
        keys = [ROOT_KEY]
        for pair in ids:
            keys.append(hashlib.blake2b(keys[-1] + pair.tobytes(), digest_size=16).digest())
        return cls(ids, lens, keys)

    def parent_keys(self) -> list[bytes | None]:
        return [None, *self.keys[:-1]]


def _pieces(n: int, **columns) -> pa.RecordBatch:
    """Rows with the given columns, others null."""
    arrays = []
    for field in PIECES:
        values = columns.get(field.name)
        arrays.append(pa.nulls(n, field.type) if values is None else pa.array(values, field.type, from_pandas=False))
    return pa.RecordBatch.from_arrays(arrays, schema=PIECES)


def corrections(above: Path, below: Path) -> pa.RecordBatch:
    """What two adjoining slices both counted, as parts of the nodes that they share."""
    least = min(len(above.lens), len(below.lens))
    differs = np.flatnonzero((above.ids[:least] != below.ids[:least]).any(axis=1))
    shared = int(differs[0]) if len(differs) else least
    depth = np.arange(shared + 1)
    texts = np.concatenate((above.lens[:shared][::-1].cumsum()[::-1], [0]))  # of turns d + 1 .. shared
    text_of = texts[np.maximum(depth - 1, 0)]
    ended = len(above.lens) == shared
    return _pieces(
        shared + 1,
        kind=np.full(shared + 1, PART),
        key=above.keys[: shared + 1],
        parent_key=above.parent_keys()[: shared + 1],
        depth=depth,
        n_convs=np.zeros(shared + 1, np.int64),
        n_children=-(depth < shared).astype(np.int64),
        n_leaves=np.full(shared + 1, -int(ended)),
        saved=text_of,
    )


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


class Slice:
    """Padded matrix of turn ids, rows sorted."""

    def __init__(self, conv: np.ndarray, turns: np.ndarray, ids: np.ndarray, lens: np.ndarray):
        n, width = len(conv), int(turns.max(initial=0))
        row = np.repeat(np.arange(n), turns)
        limits = np.concatenate(([0], np.cumsum(turns)))
        column = np.arange(len(ids)) - limits[row]
        by_id = np.lexsort((ids[:, 1], ids[:, 0]))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[by_id][1:] != ids[by_id][:-1]).any(axis=1)
        dense = np.empty(len(ids), np.int32)
        dense[by_id] = np.cumsum(new)
        matrix, text = np.zeros((n, width), np.int32), np.zeros((n, width + 1), np.int64)
        matrix[row, column], text[row, column] = dense, lens
        order = np.lexsort((conv, *matrix.T[::-1]))
        self.n, self.width = n, width
        self.conv, self.turns, self.matrix = conv[order], turns[order], matrix[order]
        #: text of the turns from each column on
        self.rest = text[order][:, ::-1].cumsum(axis=1)[:, ::-1]
        change = np.ones((n, width), bool)
        change[1:] = self.matrix[1:] != self.matrix[:-1]
        self.begins = np.logical_or.accumulate(change, axis=1)
        shared = width - self.begins.sum(axis=1)
        self.new_text = self.rest[np.arange(n), shared]
        self.leaf = np.ones(n, np.int64)
        self.leaf[:-1] = shared[1:] < self.turns[:-1]
        at = lambda k: slice(limits[order[k]], limits[order[k] + 1])
        self.first, self.last = Path.of(ids[at(0)], lens[at(0)]), Path.of(ids[at(-1)], lens[at(-1)])

    def level(self, depth: int) -> dict[str, np.ndarray]:
        """Aggregates of every node of a depth; ``start`` and ``stop`` are its rows."""
        if depth == 0:
            start, real = np.zeros(1, np.int64), np.ones(1, bool)
        else:
            start = np.flatnonzero(self.begins[:, depth - 1])
            real = self.matrix[start, depth - 1] > 0
        own = self.rest[:, max(depth - 1, 0)]
        sums = lambda values: np.add.reduceat(values, start)
        child = (self.begins[:, depth] & (self.matrix[:, depth] > 0)).astype(np.int64) if depth < self.width else np.zeros(self.n, np.int64)
        found = {
            "start": start,
            "stop": np.append(start[1:], self.n),
            "conv": np.minimum.reduceat(self.conv, start),
            "n_children": sums(child),
            "n_leaves": sums(self.leaf),
            # every member's text below, less each node's once
            "saved": sums(own) - (sums(self.new_text) - self.new_text[start] + own[start]),
            "ends": sums((self.turns == depth).astype(np.int64)),
        }
        return {name: values[real] for name, values in found.items()}

    def pieces(self, shard: int, seq: int) -> Iterator[pa.RecordBatch]:
        above = None
        for depth in range(self.width + 1):
            nodes = self.level(depth)
            start, stop = nodes["start"], nodes["stop"]
            inside = (start > 0) & (stop < self.n)
            if inside.any():
                yield self._finished(depth, nodes, inside, above)
            for k in np.flatnonzero(~inside):
                path = self.first if start[k] == 0 else self.last
                yield _pieces(
                    1, kind=[PART], key=[path.keys[depth]], parent_key=[path.parent_keys()[depth]], depth=[depth], n_convs=[stop[k] - start[k]],
                    **{name: [nodes[name][k]] for name in ("conv", "n_children", "n_leaves", "saved")},
                )
                ends = self.conv[start[k] : start[k] + nodes["ends"][k]]
                texts = [_joined(ends[c : c + CHUNK]) for c in range(0, len(ends), CHUNK)]
                if texts:
                    seqs = [seq * (1 << 32) + c for c in range(len(texts))]
                    yield _pieces(len(texts), kind=[ENDS] * len(texts), key=[path.keys[depth]] * len(texts), ends=texts, shard=[shard] * len(texts), seq=seqs)
            above = nodes

    def _finished(self, depth: int, nodes: dict, inside: np.ndarray, above: dict) -> pa.RecordBatch:
        of = np.searchsorted(above["start"], nodes["start"][inside], "right") - 1
        known = (above["start"][of] > 0) & (above["stop"][of] < self.n)
        path_key = [None if k else (self.first if a == 0 else self.last).keys[depth - 1] for k, a in zip(known, above["start"][of])]
        ends = [
            hashlib.sha256(_joined(self.conv[a : a + e]).encode()).hexdigest() if e else NO_ENDS
            for a, e in zip(nodes["start"][inside], nodes["ends"][inside])
        ]
        parents = pa.array(above["conv"][of], pa.int64(), mask=~known)
        columns = {name: nodes[name][inside] for name in ("conv", "n_children", "n_leaves", "saved")}
        n = int(inside.sum())
        return _pieces(
            n, kind=np.full(n, NODE), parent_key=path_key, depth=np.full(n, depth), parent=parents, ends=ends,
            n_convs=(nodes["stop"] - nodes["start"])[inside], **columns,
        )


def _cuts(turns: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose padded matrix has at most ``most`` cells, or one row."""
    start = 0
    while start < len(turns):
        cells = np.maximum.accumulate(turns[start:]) * np.arange(1, len(turns) - start + 1)
        end = start + max(1, int(np.searchsorted(cells, most, "right")))
        yield start, end
        start = end


def _shard(cells: int):
    """Pieces of one range of sorted sequences, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, above = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            conv = batch.column("conv").to_numpy(zero_copy_only=False)
            turns = batch.column("lens").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            lens = batch.column("lens").flatten().to_numpy(zero_copy_only=False)
            limits = np.concatenate(([0], np.cumsum(turns)))
            for start, end in _cuts(turns, cells):
                own = slice(limits[start], limits[end])
                part = Slice(conv[start:end], turns[start:end], ids[own], lens[own])
                yield from part.pieces(shard, seq)
                yield corrections(above, part.first) if above else _edge(FIRST, shard, part.first)
                above, seq = part.last, seq + 1
        if above:
            yield _edge(LAST, shard, above)

    return run


def _edge(kind: int, shard: int, path: Path) -> pa.RecordBatch:
    return _pieces(1, kind=[kind], shard=[shard], ids=[path.ids.ravel()], lens=[path.lens])


# ------------------------------------------------------------------- in Spark
def _between_shards(pieces: DataFrame) -> DataFrame:
    """Corrections between ranges; a range gives two rows, so their order is a window over few rows."""
    edges = pieces.where(F.col("kind").isin(FIRST, LAST)).groupBy("shard").agg(
        *[F.max(F.when(F.col("kind") == kind, F.struct("ids", "lens"))).alias(name) for kind, name in ((FIRST, "first"), (LAST, "last"))]
    )
    pairs = edges.withColumn("above", F.lag("last").over(Window.orderBy("shard"))).where("above is not null")
    flat = pairs.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("above", "first") for c in ("ids", "lens")])

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = lambda side: Path.of(np.array(row[f"{side}_ids"], np.int64).reshape(-1, 2), np.array(row[f"{side}_lens"], np.int64))
                yield corrections(path("above"), path("first"))

    return flat.mapInArrow(correct, PIECES_DDL)


def _ends(pieces: DataFrame) -> DataFrame:
    """``key, ends`` of unfinished nodes: the digest runs over the pieces of each list in order, one at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])
        for batch in batches:
            for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if state:
                        yield give()
                    key, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state:
            yield give()

    listed = pieces.where(F.col("kind") == ENDS).select("key", "shard", "seq", "ends")
    return listed.repartition("key").sortWithinPartitions("key", "shard", "seq").select("key", "ends").mapInArrow(digest, "key binary, ends string")


def prefix_trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` has one row per conversation: ``conv`` (a whole number), ``ids`` (two longs per turn) and
    ``lens`` (code points per turn). A node is a distinct sequence of first turns, its members are the
    conversations that start with it; the root, of depth 0, has all of them, those without turns too. A node
    is named by its smallest member and its depth; ``parent_conv_id`` is null for the root alone. ``saved_tokens`` sums
    (members - 1) times the length of the last turn over the node's subtree; ``ends_sha256`` is the
    digest of the ids of members without further turns, ascending, comma-joined. Equal
    conversations are members of their own. No conversations, no nodes. ``cells`` bounds a task's
    matrix.
    """
    ship_package(conversations.sparkSession)
    rows = cut_lineage(conversations.select(F.col("conv").cast("long").alias("conv"), "ids", F.col("lens").cast("array<long>").alias("lens")))
    ranged = rows.repartitionByRange("ids", "conv").sortWithinPartitions("ids", "conv")
    pieces = cut_lineage(ranged.mapInArrow(_shard(cells), PIECES_DDL))

    parts = pieces.where(F.col("kind") == PART).unionByName(_between_shards(pieces))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = parts.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), *sums)
    merged = cut_lineage(merged.join(_ends(pieces), "key", "left"))

    shown = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    nodes = pieces.where(F.col("kind") == NODE)
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent"))
    # the first depths hang on few keys: the larger side is nodes, the other one row per unfinished node
    hanging = nodes.where("parent_key is not null").drop("parent").select("parent_key", *[c for c in shown if c != "parent"])
    hanging = hanging.unionByName(merged.select("parent_key", *[c for c in shown if c != "parent"])).join(parents, "parent_key", "left")
    every = nodes.where("parent_key is null").select(shown).unionByName(hanging.select(shown))
    return every.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

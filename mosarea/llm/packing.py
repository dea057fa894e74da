"""Packing token sequences with minimum bin slack.

A document's ids are cut into windows of ``capacity``; only the last piece can be
shorter. Pieces are dealt by the hash of their row number to groups of about ``group_pieces`` pieces and at most about
``GROUP_TOKENS`` tokens, which bounds what one task holds, and each group is packed alone. The ids
move with their pieces, and a group's task puts them together into its sequences.

For one window the longest remaining piece is placed first. A subset-sum dynamic
program over the remaining lengths, kept as the bits of one integer, then finds the
total closest to the room left; it ends early at an exact fit. Going back through
its layers gives how many pieces of each length to take, and the same counts are
used again while the lengths last.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from mosarea.llm.maps import RESULT, map_texts, ragged
from mosarea.llm.memo import PieceMemo, release_memos, shared_memo
from mosarea.llm.tokencount import load_tokenizer
from mosarea.llm.words import NOT_BLANK, find_words
from mosarea.session import cut_lineage, ship_package

BatchFunction = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 20_000
GROUP_TOKENS = 8 << 20
#: words the library encodes in one call
ENCODED_AT_ONCE = 4096
#: sequences put together at a time
BLOCK_SEQUENCES = 256

PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
PIECES = T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(PIECE))])


def _memo(path: str) -> PieceMemo:
    def make() -> PieceMemo:
        tokenizer = load_tokenizer(path)

        def encode(texts: list[str]) -> list[list[int]]:
            parts = (texts[k : k + ENCODED_AT_ONCE] for k in range(0, len(texts), ENCODED_AT_ONCE))
            return [e.ids for part in parts for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]

        return PieceMemo(encode)

    return shared_memo(path, make)


def tokenize(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and their row limits.

    The tokenizer drops white space and no split crosses it, so the ids of a text are
    those of its blank-separated words in order.
    """
    words = find_words(data, offsets, NOT_BLANK, lower=False)
    memo = _memo(path)
    ids, n = memo.gather(memo.find(words.data, words.starts, words.ends, words.hashes))
    return ids, np.concatenate(([0], np.cumsum(n)))[words.first]


@lru_cache(maxsize=4)
def id_type(path: str, end_id: int) -> str:
    """Little-endian integers that hold every id of the tokenizer, two bytes wide if they can be."""
    most = max([end_id, *load_tokenizer(path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def cut_documents(documents: DataFrame, path: str, text: str, keep: list[str], capacity: int, end_id: int) -> DataFrame:
    """One row per piece: ``keep``, ``doc_tokens``, ``start``, ``length``, ``ids`` (bytes of :func:`id_type`)."""

    def make():
        def run(data: np.ndarray, offsets: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
            ids, limits = tokenize(path, data, offsets)
            sizes = np.diff(limits) + 1
            n = -(-sizes // capacity)
            piece_limits = np.concatenate(([0], np.cumsum(n)))
            start, length, held = [], [], []
            for row, size in enumerate(sizes.tolist()):
                own = np.append(ids[limits[row] : limits[row + 1]], end_id).astype(id_type(path, end_id))
                for s in range(0, size, capacity):
                    piece = own[s : s + capacity]
                    start.append(s)
                    length.append(len(piece))
                    held.append(piece.tobytes())
            pieces = pa.StructArray.from_arrays(
                [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary())], names=PIECE.names
            )
            return [pa.array(sizes.astype(np.int64)), ragged(pieces, piece_limits)]

        return run

    cut = map_texts(documents, text, PIECES, make, keep, pieces=True)
    return cut.select(*[F.col(f"`{c}`") for c in keep], F.col(RESULT)["doc_tokens"].alias("doc_tokens"), F.inline(F.col(RESULT)["pieces"]))


def best_fill(room: int, counts: dict[int, int], order: list[int], placed: int) -> dict[int, int]:
    """How many of each length to add to a window that holds ``placed`` and has ``room`` left.

    The total is the closest to ``room`` from below. If the window cannot be filled, a total that
    makes its length a power of two of at least half of it, which needs no padding, is preferred.
    """
    if room <= 0:
        return {}
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, layers = 1, []
    for length in order:
        left = min(counts.get(length, 0), room // length)
        take = 1
        while left > 0 and not reach & goal:  # multiplicity in powers of two
            take = min(take, left)
            layers.append((reach, length, take))
            reach = (reach | reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    if total < room:
        for k in ((placed + room).bit_length() - 1, (placed + room).bit_length() - 2):
            if placed <= 1 << k <= placed + room and reach >> ((1 << k) - placed) & 1:
                total = (1 << k) - placed
                break
    chosen: dict[int, int] = {}
    for before, length, take in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are 1 to ``capacity``."""
    by_length = {int(n): np.flatnonzero(lengths == n).tolist()[::-1] for n in np.unique(lengths)}
    counts = {n: len(rows) for n, rows in by_length.items()}
    # lengths in an order that mixes sizes, so that few layers reach an exact fit
    order = sorted((n for n in counts if n < capacity), key=lambda n: n * 2654435761 % (1 << 32))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            fill = best_fill(capacity - longest, counts, order, longest)
            counts[longest] += 1
            need = dict(fill)
            need[longest] = need.get(longest, 0) + 1
            for _ in range(min(counts[n] // k for n, k in need.items())):
                at = 0
                for n in sorted(need, reverse=True):
                    for _ in range(need[n]):
                        row = by_length[n].pop()
                        sequence[row], offset[row] = used, at
                        at += n
                used += 1
            for n in need:
                counts[n] = len(by_length[n])
        order = [n for n in order if counts[n]]
    return sequence, offset


def padded_length(n: np.ndarray, capacity: int) -> np.ndarray:
    """Sequences are padded to ``capacity`` unless their length is a power of two."""
    return np.where((n & (n - 1) == 0) | (n >= capacity), n, capacity)


def pack_sequences(
    documents: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pad_id: int = 0,
    group_pieces: int = GROUP_PIECES,
    group_tokens: int = GROUP_TOKENS,
    then: Callable[[T.StructType], tuple[T.StructType, BatchFunction]] | None = None,
) -> DataFrame:
    """One row per training sequence: ``sequence_id, n_tokens, ids, pieces``.

    ``ids`` are the tokens, padded with ``pad_id``; the first ``n_tokens`` are those of ``pieces``
    (``doc_id, start, doc_tokens, offset``) one after the other.

    ``path`` is a tokenizer file that drops white space, present on every executor. A document
    is its ids and ``end_id``; null and empty texts are that id alone. Rows are packed each,
    repeated or with a null id alike. Other columns are not read. An empty table
    gives an empty table. Sequence ids are distinct but not gapless. ``then`` makes other rows of
    the sequences, in the same task.
    """
    ship_package(documents.sparkSession)
    one = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # written once: tokenizing is the costly step, and the number of groups follows the count
    pieces = cut_lineage(cut_documents(one, path, "text", ["doc_id"], capacity, end_id))
    n_pieces, n_tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-n_pieces // group_pieces), -(-n_tokens // group_tokens))
    # row numbers over the written pieces stay the same after a retry, and spread repeated rows and null ids too
    dealt = pieces.select(F.monotonically_increasing_id().alias("row"), *pieces.columns)
    dealt = dealt.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), *dealt.columns)
    part = T.StructType([*dealt.select("doc_id", "start", "doc_tokens").schema.fields, T.StructField("offset", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("pieces", T.ArrayType(part)),
        ]
    )
    kind, part_type, arrow_schema = id_type(path, end_id), to_arrow_type(part), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pieces of words that tokenizing held are not looked up here; sequences leave block by block
        release_memos()
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        # the same order after a retry, and with it the same sequences
        by_row = np.argsort(table.column("row").to_numpy())
        length = table.column("length").to_numpy()[by_row]
        sequence, offset = pack_lengths(length, capacity)
        order = np.lexsort((offset, sequence))
        first = np.searchsorted(sequence[order], np.arange(sequence.max() + 2))
        for low in range(0, len(first) - 1, BLOCK_SEQUENCES):
            limits = first[low : low + BLOCK_SEQUENCES + 1]
            rows = order[limits[0] : limits[-1]]
            own = table.take(pa.array(by_row[rows]))
            flat = np.frombuffer(b"".join(own.column("ids").to_pylist()), kind)
            n = np.add.reduceat(length[rows], limits[:-1] - limits[0])
            ends = np.concatenate(([0], np.cumsum(padded_length(n, capacity))))
            ids = np.full(ends[-1], pad_id, np.int32)
            ids[np.repeat(ends[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(flat))] = flat
            columns = [own.column(c).combine_chunks().cast(part_type.field(c).type) for c in ("doc_id", "start", "doc_tokens")]
            parts = pa.StructArray.from_arrays([*columns, pa.array(offset[rows])], fields=list(part_type))
            arrays = [
                pa.array((key[0].as_py() << 32) + np.arange(low, low + len(n))),
                pa.array(n),
                ragged(pa.array(ids), ends),
                ragged(parts, limits - limits[0]),
            ]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow_schema)], schema=arrow_schema)

    if then is None:
        return dealt.groupBy("group").applyInArrow(pack, schema)
    made, function = then(schema)

    def pack_then(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(pack(key, batches))

    return dealt.groupBy("group").applyInArrow(pack_then, made)


def piece_rows(packed: T.StructType, with_ids: bool = False, with_sequences: bool = False) -> tuple[T.StructType, BatchFunction]:
    """One row per piece of :func:`pack_sequences`: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Length and CRC are those of the slice of the sequence at ``offset``. ``ids`` is that slice, if asked;
    ``sequence`` the whole padded sequence, on its row at offset 0 and null on the others, if asked.
    """
    part = packed["pieces"].dataType.elementType
    number, ids_type = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            part["doc_id"],
            part["start"],
            T.StructField("length", number),
            T.StructField("ids_crc32", number),
            part["doc_tokens"],
            T.StructField("sequence_id", number),
            part["offset"],
            *([T.StructField("ids", ids_type)] if with_ids else []),
            *([T.StructField("sequence", ids_type)] if with_sequences else []),
        ]
    )
    arrow_schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK_SEQUENCES):
                batch = whole.slice(low, BLOCK_SEQUENCES)
                ids, parts = batch.column("ids"), batch.column("pieces")
                flat = ids.flatten().to_numpy()
                begins = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                counts = np.diff(parts.offsets.to_numpy())
                of, rows = np.repeat(np.arange(len(counts)), counts), parts.flatten()
                offset = rows.field("offset").to_numpy()
                lead = np.concatenate(([0], np.cumsum(counts)[:-1]))
                stop = np.append(offset[1:], 0)
                stop[np.cumsum(counts) - 1] = batch.column("n_tokens").to_numpy()
                start, end = begins[of] + offset, begins[of] + stop
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), end.tolist())]
                arrays = [
                    rows.field("doc_id"), rows.field("start"), pa.array(end - start), pa.array(crc, pa.int64()),
                    rows.field("doc_tokens"), batch.column("sequence_id").take(pa.array(of)), rows.field("offset"),
                ]
                if with_ids:
                    own = np.concatenate([flat[a:b] for a, b in zip(start.tolist(), end.tolist())])
                    arrays.append(ragged(pa.array(own), np.concatenate(([0], np.cumsum(end - start)))))
                if with_sequences:
                    index = np.full(len(of), -1)
                    index[lead] = np.arange(len(counts))
                    arrays.append(ids.take(pa.array(index, mask=index < 0)))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow_schema)], schema=arrow_schema)

    return schema, run


def pack_documents(documents: DataFrame, path: str, *args, with_ids: bool = False, with_sequences: bool = False, **settings) -> DataFrame:
    """The pieces (:func:`piece_rows`) of the sequences that :func:`pack_sequences` makes of the documents."""
    return pack_sequences(documents, path, *args, **settings, then=lambda packed: piece_rows(packed, with_ids, with_sequences))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Token sequences from :func:`pack_documents` with ids: padded to ``capacity`` unless the length is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    n = F.size(ids)
    whole = F.bit_count(n) == 1
    padding = F.when(whole | (n >= capacity), F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))
    return rows.select("sequence_id", n.alias("n_tokens"), F.concat(ids, padding).alias("ids"))

"""Extendible hashing of rows into shards of at most a given number of bytes.

A row's key has 60 hash bits. The directory starts as one bucket; only a bucket
above the limit is split, on its next bit, until every shard fits. Sizes are summed
once per prefix of a few more bits than an even spread would need (a cell), so that
the tree above the cells follows from one small table; the rows of cells that are
still too large are summed again on their next bits. Rows that share all bits
(repeated rows) cannot be told apart by any bit: they go to a chain of overflow
shards. A single row above the limit has a shard of its own.

Only keys and sizes are shuffled, never texts. All steps are built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from mosarea.session import cut_lineage

KEY_BITS = 60
STEP_BITS = 6
#: rows of one key that a task orders
BLOCK_ROWS = 10_000


def row_key(*columns: Column) -> Column:
    """60 bits of the MD5 of the values; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.md5(c.cast("string"))), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _prefix(key: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", key, (F.lit(KEY_BITS) - bits).cast("int"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth of the bucket that holds each cell of ``high`` bits; 0 < depth <= high.

    The bucket is the shallowest one, from depth ``low`` on, within the limit; a cell
    too large at ``high`` bits gets null. Each level of the tree is one partial sum.
    """
    levels = cells.select(
        "cell", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    ).withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes"), F.sum("rows").alias("bucket_rows"))
    fits = F.when((F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1), F.struct("depth", "bucket", "bucket_bytes", "bucket_rows"))
    return (
        levels.select("cell", "depth", "bucket")
        .join(sums, ["depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(fits).alias("leaf"))
        .select("cell", F.col("leaf.depth").alias("depth"), "leaf.bucket", "leaf.bucket_bytes", "leaf.bucket_rows")
    )


def _chains(copies: DataFrame, limit: int, key: str, size: str) -> DataFrame:
    """Overflow links of rows that share all bits: ``depth``, ``bucket``, ``chain`` by size and running size of the key.

    Rows of one key and size are dealt to blocks of about ``BLOCK_ROWS``; only the blocks of a key are ordered together.
    """
    # row numbers over the written rows stay the same after a retry
    numbered = copies.withColumn("row", F.monotonically_increasing_id())
    many = numbered.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = cut_lineage(numbered.join(many, key).withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks"))
    before = Window.partitionBy(key).orderBy(size, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(key, size, "block").agg(F.count("*").alias("n")).select(
        key, size, "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("n") * F.col(size)).over(before), F.lit(0)).alias("bytes_before"),
    )
    within = F.row_number().over(Window.partitionBy(key, size, "block").orderBy("row"))
    ranked = dealt.withColumn("at", within).join(blocks, [key, size, "block"])
    number, running = F.col("rows_before") + F.col("at"), F.col("bytes_before") + (F.col("at") - 1) * F.col(size)
    # each copy is at most half a limit, or alone, so a chain link of half the limit never overflows
    link = F.when(F.col(size) * 2 > limit, number + 2 * F.floor(running / F.lit(limit))).otherwise(F.floor(running * 2 / F.lit(limit)))
    chained = ranked.withColumns({"depth": F.lit(KEY_BITS), "bucket": F.col(key), "chain": link.cast("long") + 1})
    return chained.select(*copies.columns, "depth", "bucket", "chain")


def shard_rows(keyed: DataFrame, limit: int, key: str = "key", size: str = "bytes") -> DataFrame:
    """Adds ``depth``, ``bucket`` (the first ``depth`` bits of the key), ``chain``.

    ``keyed`` needs a 60-bit ``key`` and a byte ``size``; the three together name a shard.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    total = keyed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    low, high = 0, min(KEY_BITS, max(1, math.ceil(math.log2(max(2.0, total / limit)))) + STEP_BITS)
    rest, placed = keyed, []
    while True:
        celled = rest.withColumn("cell", _prefix(F.col(key), high))
        cells = celled.groupBy("cell").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
        leaves = cut_lineage(_leaves(cells, low, high, limit))
        found = celled.join(leaves.select("cell", "depth", "bucket"), "cell")
        placed.append(found.where("depth is not null").drop("cell").withColumn("chain", F.lit(0).cast("long")))
        if leaves.where("depth is null").isEmpty():
            break
        if high == KEY_BITS:
            # every bit is used: copies of one key, dealt by running size; no order among equals matters
            chained = cut_lineage(found.where("depth is null").drop("cell", "depth", "bucket"))
            placed.append(_chains(chained, limit, key, size))
            break
        rest = found.where("depth is null").drop("cell", "depth", "bucket")
        low, high = high + 1, min(KEY_BITS, high + STEP_BITS)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def directory(sharded: DataFrame, size: str = "bytes") -> DataFrame:
    """One row per shard: its prefix as bits, local depth, rows and bytes.

    A directory of ``max(depth)`` bits sends each of its entries to the one shard
    whose prefix begins it; the prefixes form a prefix-free code.
    """
    return (
        sharded.groupBy("depth", "bucket", "chain")
        .agg(F.count("*").alias("shard_rows"), F.sum(size).alias("shard_bytes"))
        .withColumn("shard_id", shard_name())
    )


def shard_name() -> Column:
    """Bits of the prefix, with the number of the overflow link after a dash."""
    depth, bucket = F.col("depth").cast("int"), F.col("bucket")
    bits = F.when(depth == 0, "").otherwise(F.lpad(F.bin(bucket), depth, "0"))
    return F.when(F.col("chain") == 0, bits).otherwise(F.concat(bits, F.lit("-"), F.col("chain").cast("string")))


def shard_documents(documents: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard of every document: ``doc_id, bytes, depth, shard_id, shard_rows, shard_bytes``.

    A document's size is its UTF-8 bytes; null and empty texts have none. Null
    ids are keyed like any value. Repeated rows share all bits and are dealt to
    overflow shards once they exceed the limit together. Other columns are not read.
    An empty table gives an empty table.
    """
    # one pass over the texts; what is read again is the key and the size
    keyed = cut_lineage(
        documents.select(
            F.col(f"`{id_column}`").alias("doc_id"),
            row_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("key"),
            F.coalesce(F.octet_length(f"`{text_column}`"), F.lit(0)).cast("long").alias("bytes"),
        )
    )
    sharded = shard_rows(keyed, limit)
    shards = directory(sharded).drop("shard_id")
    return sharded.join(shards, ["depth", "bucket", "chain"]).select(
        "doc_id", "bytes", F.col("depth").cast("int").alias("depth"), shard_name().alias("shard_id"), "shard_rows", "shard_bytes"
    )

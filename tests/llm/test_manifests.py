"""Exact dedup, Merkle manifest and prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mosarea.llm import exact, merkle, trie
from mosarea.llm.queries import op12, shared_heads


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact dedup


def brute_groups(rows):
    """(id, text) -> sorted result rows."""
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i))
    best = {c: min(g, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0)) for c, g in groups.items()}
    out = []
    for i, t in rows:
        c = bare(t)
        low, _, keep = best[c]
        out.append((i, keep, len(groups[c]), keep == i and -low == len(t or ""), sha(c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_duplicates(spark, edge_documents, clashing, digest_bytes):
    extra = [(50, "on e"), (51, "o\tn\x0be"), (52, "one\x1c"), (53, "ünder x"), (54, "ün der x"), (49, "ü nder x "), (-3, "o n e")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    for table in (edge_documents, clashing):
        rows = table.select("doc_id", "text").unionByName(more)
        got = exact.exact_duplicates(rows, digest_bytes=digest_bytes, salts=3)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_groups([(r.doc_id, r.text) for r in rows.collect()])
    assert exact.exact_duplicates(clashing).count() == clashing.count()
    assert exact.exact_duplicates(edge_documents.limit(0), digest_bytes=digest_bytes).count() == 0


def test_one_text_in_all_partitions(spark):
    rows = spark.range(0, 3000, 1, 40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a b"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")))).otherwise(F.col("id").cast("string")).alias("text")
    )
    got = sorted(map(tuple, exact.exact_duplicates(rows).collect()), key=str)
    assert got == brute_groups([(r.doc_id, r.text) for r in rows.collect()])


def test_ids_that_are_strings(spark):
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("é", "x "), ("z", "x ")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": ("z", False), "a": ("z", False), None: ("z", False), "é": ("z", False), "z": ("z", True)}


def test_local_tables_are_handed_on(spark, monkeypatch):
    schema = exact.T.StructType.fromDDL("key binary, sha binary, content binary, salt int, minus_length long, no_id boolean, id long, size long")
    groups = exact.LocalGroups(schema, 0)
    for k in (5, None, 3, 4):
        groups.add(b"k", b"s", b"text", -4, k)
    groups.add(b"k", b"s", b"other", -5, None)
    rows = groups.take().to_pylist()
    assert [(r["content"], r["id"], r["size"]) for r in rows] == [(b"text", 3, 4), (b"other", None, 1)]
    assert groups.bytes == 0 and groups.take().num_rows == 0


# --- Merkle manifest


def tree_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def brute_manifest(rows):
    """(group, id, digest, claimed) -> sorted rows of the manifest."""
    groups = {}
    for g, i, leaf, claimed in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, claimed, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    levels = {}
    for g in names:
        groups[g].sort(key=lambda r: r[:4])
        levels[g] = tree_levels([r[2] for r in groups[g]])
    top = tree_levels([levels[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, leaf, claimed, i) in enumerate(groups[g]):
            steps = path_of(levels[g], at) + path_of(top, k)
            folded = claimed
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((i, leaf, levels[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str), levels


def leaves_of(documents, *changed):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claimed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("a"), F.lit(""))).otherwise(F.col("text"))
    return documents.select(
        "doc_id", "source", merkle.leaf_digest([*columns, F.col("text")]).alias("digest"), merkle.leaf_digest([*columns, claimed]).alias("claimed")
    )


def test_positions_are_those_of_the_append_log():
    for n in (*range(1, 40), 81, 82, 243, 728):
        height = merkle.tree_height(n)
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        log = merkle.append_nodes(leaves, height)
        levels = tree_levels([d.hex() for d in leaves])
        found = {}
        for level, nodes in enumerate(levels):
            for index, node in enumerate(nodes):
                found[merkle.position(level, index, n)] = node
        assert [found[k] for k in range(len(log))] == [d.hex() for d in log] and len(found) == len(log)


def test_paths_survive_writing():
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        height = merkle.tree_height(n)
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        nodes = merkle.append_nodes(leaves, height)
        for leaf, step in zip(leaves, merkle.leaf_steps(b"".join(nodes), n, height, None)):
            again = merkle.read_path(merkle.write_path(step))
            assert again == step
            assert (again.fold(leaf.hex().encode()).decode() if again else leaf.hex()) == nodes[-1].hex()


def test_manifest_edges(spark, edge_documents, clashing):
    for table in (edge_documents, clashing.withColumn("index", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("digest", F.lit("x"))):
        leaves = leaves_of(table)
        got = merkle.build_manifest(leaves, "source", "doc_id").verify("doc_id", "claimed")
        expected, _ = brute_manifest([(r.source, r.doc_id, r.digest.hex(), r.claimed.hex()) for r in leaves.collect()])
        assert sorted(map(tuple, got.collect()), key=str) == expected
    empty = merkle.build_manifest(leaves_of(edge_documents.limit(0)), "source", "doc_id")
    assert empty.verify("doc_id", "claimed").count() == 0 and empty.log().count() == 0


def test_null_fields_and_empty_ones_differ(spark):
    rows = spark.createDataFrame([("", None), (None, ""), ("a", "b"), ("ab", "")], "x string, y string")
    digests = [r.d.hex() for r in rows.select(merkle.leaf_digest([F.col("x"), F.col("y")]).alias("d")).collect()]
    assert digests == [sha("0:-"), sha("-0:"), sha("1:a1:b"), sha("2:ab0:")]


def test_manifest_of_several_rounds(spark):
    """One group above two rounds of blocks, repeated rows, many groups."""
    big = spark.range(0, 3000, 1, 7).select((F.col("id") % 2900).alias("doc_id"), F.lit("big").alias("source"))
    many = spark.range(0, 900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"))
    rows = big.unionByName(many).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1), "text": F.concat(F.lit("a"), "doc_id")})
    leaves = leaves_of(rows)
    manifest = merkle.build_manifest(leaves, "source", "doc_id")
    assert len(manifest.logs) == 2 and len(manifest.top_logs) == 2
    expected, levels = brute_manifest([(r.source, r.doc_id, r.digest.hex(), r.claimed.hex()) for r in leaves.collect()])
    assert sorted(map(tuple, manifest.verify("doc_id", "claimed").collect()), key=str) == expected

    names = {r.tree: r.source for r in manifest.trees.collect()}
    logs = {}
    for r in manifest.log().collect():
        assert levels[names[r.tree]][r.level][r["index"]] == r.digest
        logs.setdefault(names[r.tree], []).append(r.position)
    assert all(sorted(logs[g]) == list(range(sum(map(len, levels[g])))) for g in levels)


# --- prefix trie


def brute_trie(convs):
    nodes, children = {}, {}
    for c, turns in convs:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = sum(saved[c] for c in below) + ((len(nodes[node]) - 1) * len(node[-1][1]) if node else 0)
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        smallest = min(c for c, _ in members)
        out.append((smallest, len(node), parent, len(members), len(children.get(node, [])), leaves[node], saved[node], sha(ends)))
    return sorted(out, key=str)


def trie_of(spark, convs, **settings):
    rows = [(c, k, r, t) for c, turns in convs for k, (r, t) in enumerate(turns)]
    found = trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    bare = spark.createDataFrame([(c, [], []) for c, turns in convs if not turns], "conv long, ids array<long>, lens array<long>")
    return sorted(map(tuple, trie.prefix_trie(found.unionByName(bare), **settings).collect()), key=str)


@pytest.mark.parametrize("cells", [1 << 21, 40, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_trie(spark, cells, seed):
    """A third of all conversations are alike; matrices of any size, ranges of any number."""
    rnd = random.Random(seed)
    hot = [("u", "hi"), ("a", "thére")] * seed
    convs = []
    for c in range(240):
        turns = [(rnd.choice("ua"), rnd.choice(["x", "yy", "zzz", ""])) for _ in range(rnd.choice([0, 1, 2, 3, 6]))]
        convs.append((c - 30, hot if c % 3 == 0 else turns))
    convs.append((1000, [("u", "hi")] * 60))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert trie_of(spark, convs, cells=cells) == brute_trie(convs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_few(spark):
    for convs in ([(7, [("u", "a")])], [(7, []), (8, [])], [(3, [("u", "a")]), (2, [("u", "a"), ("a", "b")])], [(1, [])] * 3):
        assert trie_of(spark, convs) == brute_trie(convs)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(shared_heads(trie.sequences(none))).count() == 0


def test_ends_longer_than_a_piece(spark):
    convs = [(k, [("u", "same")]) for k in range(2 * trie.CHUNK + 10)]
    assert trie_of(spark, convs) == brute_trie(convs)


def test_rebuilt_conversations(spark, tmp_path):
    """Turn order, null turns, roles and texts, missing and short first conversations, clashing columns."""
    rnd = random.Random(3)
    rows = []
    for c in (*range(100, 160), *range(300, 340), 400, *range(401, 420), 523):
        n = 2 if c in (100, 400) else rnd.randrange(0, 7)
        rows += [(c, None if k == 0 else k, rnd.choice(["u", None]), rnd.choice(["x", None, "", "yy"])) for k in range(n)]
    rows += [(None, 1, "u", "x"), (None, None, None, None)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("ids", "lens", "conv", "depth", "h", "base", "a.b")]
    )
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt.append((c, own.get(c - c % 100, [])[:h] + turns[h:]))
    assert sorted(map(tuple, op12(spark, str(tmp_path)).collect()), key=str) == brute_trie(rebuilt)

"""Operators over whole tables: quality, search, chat format, sharding."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosarea.llm import bm25, chat, quality, sharding

SF = "/root/testdata/sf0.001"


def sites():
    return F.col("source"), F.concat_ws("/", "source", "lang")


# --- quality

def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    judged = quality.classify(documents, known, *sites(), keep=["doc_id"]).join(held, "doc_id").collect()
    right = [r["__good"] == (r.quality > 0) for r in judged]
    assert len(judged) > 100 and sum(right) >= 0.97 * len(right)
    good = [r["__good"] for r in judged if r.quality > 0]
    assert sum(good) >= 0.99 * len(good)


def test_sparse_sites_shrink_to_the_global_share(spark):
    rows = [("=a", "=a/1", 900_000)] * 400 + [("=b", "=b/1", 100_000)] * 400 + [("=a", "=a/2", 100_000), ("=c", "=c/1", 100_000)]
    sites = quality.count_sites(spark.createDataFrame(rows, "host string, path string, p long"))
    priors = {r.path: r.prior for r in sites.table.select("path", sites.prior(*map(F.col, ("n", "s", "host_n", "host_s"))).alias("prior")).collect()}
    assert abs(priors["=a/1"] - 0.9) < 0.02 and abs(priors["=b/1"] - 0.1) < 0.02
    assert 0.1 < priors["=c/1"] < 0.52
    assert priors["=a/2"] > priors["=c/1"]  # its host is good


def left_out_priors(rows):
    """Priors of (host, path, share) rows by the method of moments, each from all other rows."""

    def strength(groups, center_of):
        n = sum(len(v) for v in groups.values())
        s = sum(map(sum, groups.values()))
        inside = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in groups.values())
        apart = sum(len(v) * (sum(v) / len(v) - center_of(g)) ** 2 for g, v in groups.items())
        within = inside / max(n - len(groups), 1)
        between = (apart - (len(groups) - 1) * within) / max(n - sum(len(v) ** 2 for v in groups.values()) / n, 1)
        return min(max(s / n * (1 - s / n) / between - 1 if between > 1e-12 else 1e6, 1), 1e6)

    paths, hosts = {}, {}
    for host, path, p in rows:
        paths.setdefault((host, path), []).append(p)
        hosts.setdefault(host, []).append(p)
    n, total = len(rows), sum(r[2] for r in rows)
    k1 = strength(hosts, lambda h: total / n)
    k2 = strength(paths, lambda g: (sum(hosts[g[0]]) + k1 * total / n) / (len(hosts[g[0]]) + k1))
    out = []
    for host, path, p in rows:
        center = (total - p) / (n - 1) if n > 1 else 0.5
        mean = (sum(hosts[host]) - p + k1 * center) / (len(hosts[host]) - 1 + k1)
        out.append((sum(paths[host, path]) - p + k2 * mean) / (len(paths[host, path]) - 1 + k2))
    return out


@pytest.mark.parametrize("n", [1, 3, 400])
def test_priors_leave_the_document_out(spark, n):
    rnd = random.Random(n)
    rows = []
    for _ in range(n):
        host = int(rnd.paretovariate(0.7)) % 40
        rows.append((f"h{host}", f"p{rnd.randrange(3)}", rnd.randrange(1, 1_000_000) // (1 + host % 3)))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, host string, path string, p long")
    sites = quality.count_sites(table)
    prior = sites.prior(*map(F.col, ("n", "s", "host_n", "host_s")), F.col("p"))
    found = [r.prior for r in table.join(sites.table, ["host", "path"]).select("k", prior.alias("prior")).orderBy("k").collect()]
    expected = left_out_priors([(h, q, p / 1_000_000) for h, q, p in rows])
    assert len(found) == n and all(abs(x - min(max(y, 1e-6), 1 - 1e-6)) < 1e-7 for x, y in zip(found, expected))


def test_a_document_alone_in_its_site_has_the_share_of_the_others(spark):
    """Its prior does not move with its own evidence."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    rows = [(k, ("good words here, and more. " if k % 2 else "#x@ %% &&& ") * (3 + k), f"s{k}", "en") for k in range(20)]
    priors = []
    for last in ("good words here, and more. " * 9, "#x@ %% &&& " * 9):
        table = spark.createDataFrame([*rows, (99, last, "alone", "en")], "doc_id long, text string, source string, lang string")
        judged = {r.doc_id: r for r in quality.classify(table, labels, *sites(), keep=["doc_id"]).collect()}
        priors.append(judged[99]["__prior"])
        assert abs(judged[99]["__evidence"]) > 1
    assert abs(priors[0] - priors[1]) < 1e-9


def test_quality_edges(spark, edge_documents, clashing):
    labels = spark.createDataFrame([(0, 1), (3, 0), (20, None), (None, 1), (21, 1), (21, 1)], "doc_id long, quality int").withColumn("x", F.lit(1))
    for table in (edge_documents, clashing):
        judged = quality.classify(table, labels, *sites())
        assert judged.columns[: len(table.columns)] == table.columns
        rows = judged.collect()
        assert len(rows) == table.count()
        assert all(r["__good"] is not None and r["__prior"] is not None for r in rows)
        assert not any(r["__good"] for r in rows if not (r.text or "").strip())
    for labelled in (labels.limit(0), labels.where("quality = 1")):
        light = quality.classify(edge_documents, labelled, *sites(), keep=["doc_id"])
        assert light.count() == edge_documents.count()
    assert quality.classify(edge_documents.limit(0), labels, *sites(), keep=["doc_id"]).count() == 0


# --- search

def brute_top(rows, queries, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    docs = [(i, words(t)) for i, t in rows if i is not None]
    n, average = len(docs), sum(len(w) for _, w in docs) / max(1, len(docs))
    df = {}
    for _, w in docs:
        for word in set(w):
            df[word] = df.get(word, 0) + 1
    sets = {}
    for i, t in queries:
        if i is not None:
            sets.setdefault(i, set()).update(words(t))
    out = []
    for q, terms in sets.items():
        scores = []
        for i, w in docs:
            score = 0
            for word in terms & set(w):
                tf = w.count(word)
                idf = math.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5))
                score += round(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / average)) * idf * 1_000_000)
            if score:
                scores.append((-score, i))
        out += [(q, r + 1, i, -s / 1_000_000) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("query_terms", [1_000_000, 50])
def test_top_k_equals_brute_force(spark, monkeypatch, query_terms):
    monkeypatch.setattr(bm25, "SHARD_DOCUMENTS", 70)
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "the of"), (900, None), (901, ""), (100, "the zebra"), (5, "repeated"), (5, "repeated")], documents.schema)
    documents = documents.unionByName(extra).withColumns({"score": F.lit(1), "rank": F.lit(2), "terms": F.lit("")})
    queries = documents.where("doc_id % 20 = 0 or doc_id is null")
    found = bm25.top_k(documents, queries, k=7, query_terms=query_terms).collect()
    expected = brute_top([(r.doc_id, r.text) for r in documents.collect()], [(r.doc_id, r.text) for r in queries.collect()], 7)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == sorted(e[:3] for e in expected)
    assert all(abs(r.score - e[3]) < 1e-5 for r, e in zip(sorted(found, key=lambda r: (r.query_id, r["rank"])), sorted(expected)))


def test_pruning_passes_over_documents(spark):
    """The searcher skips pivots without losing any of the best."""
    import numpy as np

    from mosarea.llm.bm25 import Searcher, _read

    rnd = random.Random(1)
    rows = [(k, " ".join([rnd.choice("abcdefgh") * 3 for _ in range(30)] + (["rare"] * 3 if k % 97 == 0 else []))) for k in range(2000)]
    shard = bm25.build_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text").first().asDict()
    searcher = Searcher(_read(shard), 30.0)
    idf = np.full(len(searcher.terms), 0.1)
    counts = np.diff(searcher.limits)
    idf[counts.argmin()] = 8.0
    ids, scores = searcher.search(searcher.terms, idf, 5)
    every = np.zeros(2000)
    np.add.at(every, searcher.docs, np.rint(searcher.weight * np.repeat(idf, counts) * 1_000_000))
    best = sorted(zip(-every, searcher.ids))[:5]
    assert [(-int(s), int(i)) for s, i in best] == list(zip(scores.tolist(), ids.tolist()))
    assert searcher.pivots < 1000
    # with a floor that ties reach, all that reach it stay
    for floor in (int(scores[-1]), int(scores[-1]) + 1):
        above = [(-int(s), int(i)) for s, i in best if -s >= floor]
        ids_2, scores_2 = searcher.search(searcher.terms, idf, 5, floor)
        assert list(zip(scores_2.tolist(), ids_2.tolist())) == above


def test_ties_over_many_shards(spark, monkeypatch):
    """Of equal scores the smaller ids are the best, wherever they lie; rows out follow queries, not shards."""
    monkeypatch.setattr(bm25, "SHARD_DOCUMENTS", 16)
    rows = [((k * 377) % 800, "same words in every row" if k % 3 else f"same word{k % 5}") for k in range(800)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    queries = documents.where("doc_id % 100 = 0")
    found = bm25.top_k(documents, queries, k=9).collect()
    expected = brute_top(rows, [r for r in rows if r[0] % 100 == 0], 9)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == sorted(e[:3] for e in expected)


def test_search_of_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert bm25.top_k(table.limit(0), table).count() == 0
    assert bm25.top_k(table, table.limit(0)).count() == 0


# --- chat format

ROLES = ["user", "assistant", "system", "to: ol", None, "a\\b#<"]
PIECES = ["### ", "### Assistant: ", "</turn>", "</turn>\n", "\\", "\\l", "\\b", "\\c", "<", "#", "</tu", "rn>", "ok", " ", "\n", ": ", "é", "😀", "user", "###"]


def test_round_trip(spark):
    rnd = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 6)):
            text = None if rnd.random() < 0.05 else "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(8)))
            rows.append((None if conv == 7 else conv, None if rnd.random() < 0.05 else turn, rnd.choice(ROLES), text))
    rows += [(200, 1, "user", "same"), (200, 1, "user", "same"), (201, 0, "assistant", "plain"), (201, 1, "user", "also plain")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2), "all": F.lit(3)})
    formatted = chat.format_conversations(table)
    found = {r.conv_id: r for r in chat.digest(formatted).collect()}
    expected = {}
    for conv, turn, role, text in rows:
        expected.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        turns.sort()
        r = found[conv]
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {r.conv_id: r for r in formatted.collect()}
    assert texts[201].formatted == "### assistant: plain</turn>\n### user: also plain</turn>\n" and texts[201].n_escaped == 0
    assert chat.format_conversations(table.limit(0)).count() == 0


# --- sharding

def test_shards_fit_and_split_only_what_is_too_large(spark, edge_documents, clashing):
    limit = 3000
    for table in (edge_documents, clashing):
        rows = sharding.shard_documents(table, limit).collect()
        assert len(rows) == table.count()
        shards = {}
        for r in rows:
            shards.setdefault(r.shard_id, []).append(r)
        for members in shards.values():
            assert sum(m.bytes for m in members) == members[0].shard_bytes and len(members) == members[0].shard_rows
            assert members[0].shard_bytes <= limit or len(members) == 1
        names = sorted(s for s in shards if "-" not in s)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
        for name in names:  # the parent bucket was too large, or it would not have been split
            if name:
                under = [m for s, ms in shards.items() if s.startswith(name[:-1]) for m in ms]
                assert sum(m.bytes for m in under) > limit and len(under) > 1
    assert sharding.shard_documents(edge_documents.limit(0), limit).count() == 0


def test_repeated_rows_overflow(spark):
    rows = [(1, "x" * 100)] * 55 + [(2, "y" * 2000)] * 3 + [(k, "z") for k in range(20)] + [(None, None), (None, "")]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    total, count = {}, {}
    for r in found:
        total[r.shard_id] = total.get(r.shard_id, 0) + r.bytes
        count[r.shard_id] = count.get(r.shard_id, 0) + 1
    assert len(found) == len(rows) and all(t <= 1000 or count[s] == 1 for s, t in total.items())


def test_copies_of_one_key_are_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    sizes = [10] * 500 + [600] * 70
    keyed = spark.createDataFrame([(7, n) for n in sizes], "key long, bytes long")
    rows = sharding._chains(keyed, 1000, "key", "bytes").collect()
    assert sorted(r.bytes for r in rows) == sizes
    links = {}
    for r in rows:
        links.setdefault(r.chain, []).append(r.bytes)
    assert max(map(sum, links.values())) <= 1000 and len(links) <= 2 * sum(sizes) // 1000 + 2
    assert all(len(x) == 1 for x in links.values() if 600 in x)


def test_terms_are_looked_up_once_a_shard():
    shard = {"ids": [5, 6], "lengths": [2, 1], "terms": [3, 9], "limits": [0, 2, 3], "docs": [0, 1, 0], "tfs": [1, 1, 1]}
    searcher = bm25.Searcher({k: np.array(v, bm25._DTYPES[k]) for k, v in shard.items()}, 1.5)
    every, idf = np.array([1, 3, 9, 12], np.uint64), np.array([1.0, 0.5, 2.0, 1.0])
    places = searcher.places(every)
    assert places.tolist() == [-1, 0, 1, -1]
    for some in ([0, 1], [1, 2], [0, 3], [2]):
        found, plain = searcher.search_places(places[some], idf[some], 2), searcher.search(every[some], idf[some], 2)
        assert [x.tolist() for x in found] == [x.tolist() for x in plain]

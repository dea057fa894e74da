import numpy as np
import pytest

from mosarea.llm import minhash
from mosarea.llm.components import star_components
from mosarea.llm.words import NOT_BLANK, find_words


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(blank, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, edge_documents, clashing, size):
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    expected = brute(rows, size)
    for table in (edge_documents, clashing):
        found = minhash.near_duplicates(table, shingle=size).collect()
        assert len(found) == len(rows)
        counts = {r.doc_id: r.n_shingles for r in found if r.doc_id is not None}
        assert counts == {i: len(shingles(t, size)) for i, t in rows if i is not None}
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_chain_without_common_hub(spark):
    """Links between leaves are found though the smallest document resembles only one end."""
    base = [f"w{k}" for k in range(400)]
    texts, words = [], list(base)
    for step in range(12):
        texts.append(" ".join(words))
        for k in range(16):
            words[(step * 16 + k) * 2] = f"z{step}_{k}"
    order = [5, 0, 11, 3, 8, 1, 10, 6, 2, 9, 4, 7]
    rows = [(n, texts[k]) for n, k in enumerate(order)] + [(100, "other words here"), (101, " ".join(reversed(base)))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 2)


def test_empty_table(spark, edge_documents):
    assert minhash.near_duplicates(edge_documents.limit(0)).collect() == []


def test_densified_bins_agree_as_often_as_sets():
    draw = np.random.default_rng(3)
    shared, own = draw.integers(0, 2**64, 16, dtype=np.uint64), draw.integers(0, 2**64, (400, 4), dtype=np.uint64)
    agree = []
    for k in range(0, 400, 2):
        values = [np.sort(np.concatenate((shared + np.uint64(k), o))) for o in own[k : k + 2]]
        signature = minhash.signatures(np.concatenate(values), np.array([0, 20, 40]), 240)
        agree.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(agree) - 16 / 24) < 0.02


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.label for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(2, 31)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_do_not_cross_rows():
    data = np.frombuffer("abcd ef".encode(), np.uint8)
    found = find_words(data, np.array([0, 2, 2, 7]), NOT_BLANK)
    assert found.counts().tolist() == [1, 0, 2]

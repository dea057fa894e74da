"""Registered queries against their SQL checks, and the pipeline against its parts."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from oracle_check import connect, differences
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from mosarea.llm import decontam, minhash, pii, quality  # noqa: E402
from mosarea.llm.maps import RESULT  # noqa: E402
from mosarea.llm.queries import ORACLES, QUERIES, site_columns  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name in ORACLES:
        assert differences(ours, connect(SF).execute(ORACLES[name]).df()) is None


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    host, path = site_columns()
    good = {r.doc_id for r in quality.classify(documents, labels, host, path, keep=["doc_id"]).where("__good").collect()}
    first = corpus_pipeline.quality_classifier(spark, documents, SF)
    assert first.columns == documents.columns and {r.doc_id for r in first.collect()} == good

    second = corpus_pipeline.near_dedup(spark, first, SF)
    kept = {r.doc_id for r in minhash.near_duplicates(first).where("kept").collect()}
    assert second.columns == documents.columns and {r.doc_id for r in second.collect()} == kept and 0 < len(kept) < len(good)

    third = corpus_pipeline.benchmark_decontamination(spark, second, SF)
    dirty = {r.doc_id for r in decontam.find_contamination(second, benchmark).where(decontam.contaminated(F.col(RESULT))).collect()}
    assert third.columns == documents.columns and {r.doc_id for r in third.collect()} == kept - dirty and dirty

    fourth = corpus_pipeline.personal_data(spark, third, SF)
    assert fourth.columns == documents.columns and fourth.count() == len(kept - dirty)
    assert fourth.schema == documents.schema
    rows = fourth.collect()
    assert not any(pii.base_spans(r.text) for r in rows) and all(r.n_chars == len(r.text) for r in rows)

    packed = corpus_pipeline.pack(spark, fourth, SF)
    assert {r.doc_id for r in packed.collect()} == kept - dirty
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept - dirty


def test_pack_stage_holds_the_tokens(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = corpus_pipeline.pack(spark, documents, SF).collect()
    whole = {r.sequence_id: r.sequence for r in rows if r.offset == 0}
    for r in rows:
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32


def test_dedup_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (None, "x", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "3", "None"]


def test_dedup_stage_keeps_different_texts_of_one_id(spark):
    first = " ".join(f"w{k}" for k in range(60))
    own, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "uv")
    rows = [(1, first), (5, first), (5, own), (6, first + " more"), (6, other), (7, "x y z"), (7, "p q r"), (7, "p q r"), (7, None), (-3, own + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = [(1, first), (6, other), (7, "x y z"), (7, "p q r"), (7, None), (-3, own + " end")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()))) == sorted(map(str, expected))

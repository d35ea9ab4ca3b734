import importlib

import numpy as np

import corpus_pipeline
from tests.llm.test_near import brute_kept
from tickloom.llm import exact_dedup, quality
from tickloom.llm.queries import QUERIES, table

ROOT = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    assert {"pipeline", *QUERIES} <= set(importlib.import_module("__spark_entry__").queries())


def test_stages_on_their_own_input(spark):
    docs = table(spark, ROOT, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, ROOT).cache()
    good = {r["doc_id"] for r in quality.scores(docs, table(spark, ROOT, "labels")).collect() if r["score"] >= 0.7}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    single = stages["exact"](spark, kept, ROOT).cache()
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in exact_dedup.exact_duplicates(kept).collect() if r["kept"]}
    assert single.select("text").distinct().count() == single.count()
    apart = stages["near"](spark, single, ROOT).cache()
    assert {r["doc_id"] for r in apart.collect()} == brute_kept([(r["doc_id"], r["text"]) for r in single.collect()], k=5)
    mixed = stages["mix"](spark, apart, ROOT).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in apart.collect()}
    packed = stages["pack"](spark, mixed, ROOT).collect()
    starts = [r for r in packed if r["start"] == 0]
    assert len(starts) == mixed.count()
    filled = np.bincount([r["sequence_id"] for r in packed], [r["length"] for r in packed])
    assert (filled[:-1] == 4096).all()


def test_run_returns_packed_pieces(spark):
    out = corpus_pipeline.run(spark, ROOT)
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0

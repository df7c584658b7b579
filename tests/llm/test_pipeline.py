"""The corpus pipeline, stage by stage, against brute force on the smallest documents."""

import duckdb

import corpus_pipeline
from trailmark.llm import decontamination

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    from test_operators import brute_classes, check_packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.collect()}
    known = [(i, q) for i, q in labels.items() if q is not None]
    assert sum((i in kept) == bool(q) for i, q in known) / len(known) > 0.9
    one = corpus_pipeline.near_duplicate_stage(spark, good, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c, _, _ in brute_classes(rows)})
    clean = corpus_pipeline.decontamination_stage(spark, one, SF).cache()
    items = [decontamination.normal(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    exact = {r["doc_id"] for r in one.collect() if any(p in decontamination.normal(r["text"]) for p in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert not exact & left and len(left) >= one.count() - len(exact) - 2
    assert clean.columns == docs.columns
    packed = corpus_pipeline.packing_stage(spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == left and check_packing(packed, 4096)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, columns of the names that the operators use, and no rows."""
    docs = spark.createDataFrame([(1, None, 9.0, "a", 5, 1), (None, "", 8.0, "b", 6, 2), (2, "one two three", 7.0, "c", 7, 3), (2, "one two three", 7.0, "c", 7, 3)], "doc_id long, text string, score double, class_id string, _n int, _leak_key int")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            got = stage(spark, rows, SF)
            n = got.count()
            assert n == 0 if not rows.count() else n <= 4
            if name != "best_fit_packing":
                assert got.columns == docs.columns
    assert corpus_pipeline.near_duplicate_stage(spark, docs, SF).count() == 3
    assert corpus_pipeline.decontamination_stage(spark, docs, SF).count() == 4
    assert {r["score"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()} <= {9.0, 8.0, 7.0}

import importlib.util

import pytest
from test_shinglejoin import brute_groups

import __spark_entry__ as entry
import corpus_pipeline


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages(spark, sf_dir, docs):
    from glidepath.llm import tiling
    from glidepath.llm.perplexity import quality
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs
    kept = {r.doc_id for r in quality(docs).filter("kept").collect()}
    rows = corpus_pipeline.STAGES[0][1](spark, rows, sf_dir)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept
    before = sorted(rows.collect(), key=lambda r: r.doc_id)
    first = {}
    for r, g in zip(before, brute_groups([r.text for r in before])[0]):
        first.setdefault(g, r.doc_id)
    one = corpus_pipeline.STAGES[1][1](spark, rows, sf_dir)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(first.values())
    leaked = {r.doc_id for r in tiling.contaminations(one, benchmark).collect()}
    clean = corpus_pipeline.STAGES[2][1](spark, one, sf_dir)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    safe = corpus_pipeline.STAGES[3][1](spark, clean, sf_dir)
    assert safe.dtypes == docs.dtypes and safe.count() == clean.count()
    packed = corpus_pipeline.STAGES[4][1](spark, safe, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, again.collect())) == sorted(map(str, packed.collect()))


@pytest.mark.parametrize("k", range(4))
def test_stages_take_empty_tables(spark, sf_dir, empty, k):
    out = corpus_pipeline.STAGES[k][1](spark, empty, sf_dir)
    assert out.columns == empty.columns and out.count() == 0


def test_entry_imports_without_the_package():
    assert importlib.util.find_spec("glidepath.llm") is not None

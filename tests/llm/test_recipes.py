"""Exact duplicates against grouping by text in Python; fewer hash bits make chunks clash."""

import hashlib
from collections import defaultdict

import pytest
from conftest import DOCS, EDGE
from pyspark.sql import functions as F

from glidepath.llm import recipes


def brute(rows, change=lambda t: t):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[change(text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_edge_rows(edge, bits):
    got = recipes.exact_duplicates(edge, bits=bits)
    assert found(got) == brute([(r[0], r[1]) for r in EDGE])
    kept = got.filter("kept").collect()
    assert len(kept) == len({r[1] or "" for r in EDGE}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(recipes.exact_duplicates(docs)) == brute(rows)


def test_a_third_of_the_rows_are_copies(spark):
    texts = [f"{'same words here again ' * 300}" if i % 3 == 0 else f"text {i // 6} of its own" for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(5)
    assert found(recipes.exact_duplicates(docs)) == brute(rows)
    assert found(recipes.exact_duplicates(docs, bits=2)) == brute(rows)


def test_normalised(edge):
    got = recipes.exact_duplicates(edge, lambda t: F.regexp_replace(F.lower(t), "[0-9]", ""))
    assert found(got) == brute([(r[0], r[1]) for r in EDGE], lambda t: "".join(c for c in t.lower() if c not in "0123456789"))


def test_chunks_make_up_the_text(spark, docs, edge):
    both = docs.select("text").union(edge.select("text")).union(spark.createDataFrame([("x" * 100_000,), (" " * 5000,), ("日本語" * 5000,), ("a b " * 9000,)], "text string"))
    rows = both.select("text", recipes.chunks(F.col("text"), 16, 64).alias("chunks")).collect()
    assert all("".join(r["chunks"]) == (r["text"] or "") and all(r["chunks"]) for r in rows)
    assert max(len(c) for r in rows for c in r["chunks"]) <= 64 * 128
    # An edit at the front leaves the later chunks as they are.
    text = docs.selectExpr("max_by(text, length(text))").first()[0]
    a, b = (r[0] for r in spark.createDataFrame([(text,), ("new words " + text,)], "text string").select(recipes.chunks(F.col("text"), 16)).collect())
    assert len(set(a) - set(b)) <= 1 < len(a)


def test_empty_and_crowded(empty, edge, crowded):
    assert recipes.exact_duplicates(empty).collect() == []
    more = crowded.withColumns({c: F.lit("x") for c in ["chunk", "recipe", "_row", "_rh", "_salt", "_hot", "group_size", "keep_id"]})
    assert found(recipes.exact_duplicates(more)) == found(recipes.exact_duplicates(edge))


def test_no_python_in_the_plan(docs):
    plan = recipes.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""The manifest against a plain tree in Python."""

import hashlib
from itertools import groupby

import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from glidepath.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def climb(digests, arity):
    """(root, for each digest its path of (left, right) sibling texts)."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for n, i in enumerate(at):
            run = i // arity * arity
            paths[n].append(("".join(digests[run:i]), "".join(digests[i + 1 : run + arity])))
        digests = [h("".join(digests[i : i + arity])) for i in range(0, len(digests), arity)]
        at = [i // arity for i in at]
    return digests[0], paths


def brute(rows, arity):
    """Sorted (doc_id, source, leaf, subroot, root, path)."""
    first = lambda x: (x is not None, x)
    rows = sorted(rows, key=lambda r: (first(r["source"] and r["source"].encode()), first(r["doc_id"]), leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r["source"])]
    trees = [climb([leaf(r) for r in g], arity) for g in groups]
    root, tops = climb([t[0] for t in trees], arity)
    return [(r["doc_id"], r["source"], leaf(r), sub, root, path + top)
            for g, (sub, paths), top in zip(groups, trees, tops) for r, path in zip(g, paths)]


def found(df):
    def plain(row):
        path = [(s["before"].hex(), s["after"].hex()) for s in row["path"]]
        return (row["doc_id"], row["source"], row["leaf"].hex(), row["subroot"].hex(), row["root"].hex(), path)
    return [plain(r) for r in df.collect()]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_edge_rows(edge, arity):
    rows = [dict(zip(NAMES, r)) for r in EDGE]
    assert sorted(found(merkle.manifest(edge, COLUMNS, "source", "doc_id", arity)), key=repr) == sorted(brute(rows, arity), key=repr)


def test_documents_and_partitions(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    want = sorted(brute(rows, 3), key=repr)
    assert sorted(found(merkle.manifest(docs.repartition(7), COLUMNS, "source", "doc_id")), key=repr) == want
    # One source with all rows: one tree over all range partitions.
    one = docs.withColumn("source", F.lit("one"))
    want = sorted(brute([{**r, "source": "one"} for r in rows], 3), key=repr)
    assert sorted(found(merkle.manifest(one, COLUMNS, "source", "doc_id")), key=repr) == want


def test_altered_rows_are_found(docs):
    changed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = merkle.audited(docs, COLUMNS, "source", "doc_id", {"text": changed}).select("doc_id", "verified", "folded_root", F.hex("root").alias("root")).collect()
    assert {r["doc_id"] for r in rows if r["verified"]} == {r["doc_id"] for r in rows if r["doc_id"] % 2}
    assert all((r["folded_root"] == r["root"].lower()) == r["verified"] for r in rows)


def test_proof_of_a_lone_row(spark, docs):
    alone = docs.limit(1)
    row = merkle.manifest(alone, COLUMNS, "source", "doc_id").withColumn("proof", merkle.proof_digest(F.col("path"))).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == h("")


def test_empty_and_crowded(empty, edge, crowded):
    assert merkle.manifest(empty, COLUMNS, "source", "doc_id").collect() == []
    names = ["tree", "idx", "digest", "before", "after", "path", "root", "leaf", "_group", "_order", "_at"]
    more = crowded.withColumns({c: F.lit("x") for c in names})
    want = sorted(found(merkle.manifest(edge, COLUMNS, "source", "doc_id")), key=repr)
    assert sorted(found(merkle.manifest(more, COLUMNS, "source", "doc_id")), key=repr) == want

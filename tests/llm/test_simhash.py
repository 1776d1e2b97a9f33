import random

import numpy as np
import pytest
import xxhash

from glidepath.llm.components import components
from glidepath.llm.simhash import fingerprint, forest, near_duplicates, one_of_each


def plain(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, fps[i], least.get(find(i)))) for i, (d, _) in enumerate(rows))


def result(df, **k):
    return sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in near_duplicates(df, **k).collect())


def test_fingerprint_is_xxh64_of_shingles(spark, edge):
    from pyspark.sql import functions as F
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", seed=42)
    for r in edge.collect():
        assert fingerprint(r.text) == plain(r.text)


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == brute(rows)
    assert result(docs, tile=16) == brute(rows)


def test_edges(edge, empty, crowded):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert result(edge) == brute(rows) == result(crowded, tile=2)
    assert near_duplicates(empty).count() == 0
    kept = one_of_each(crowded)
    assert kept.columns == crowded.columns
    assert kept.count() == len({(r.group) for r in near_duplicates(edge).collect()})
    assert one_of_each(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_forest_joins_what_links_join(radius):
    rnd = np.random.default_rng(radius)
    centre = rnd.integers(0, 2**63, 8, dtype=np.uint64)
    a = np.unique(np.concatenate([centre ^ (np.uint64(1) << rnd.integers(0, 64, 8).astype(np.uint64)) for _ in range(40)]))
    left, right = a[::2], a[1::2]
    for pair in ((left, right), (a, None)):
        both = pair[0] if pair[1] is None else np.concatenate(pair)
        edges = forest(*pair, radius)
        assert len(edges) < len(both)
        group = list(range(len(both)))

        def find(i):
            while group[i] != i:
                i = group[i]
            return i
        for x, y in edges:
            assert int(both[x] ^ both[y]).bit_count() <= radius
            group[find(x)] = find(y)
        n = len(pair[0])
        for i in range(len(both)):
            for j in range(len(both)):
                if (pair[1] is None or (i < n) != (j < n)) and int(both[i] ^ both[j]).bit_count() <= radius and i != j:
                    if pair[1] is None or i < n:
                        assert find(i) == find(j)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}

    def find(i):
        group.setdefault(i, i)
        while group[i] != i:
            i = group[i]
        return i
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    assert got == {i: find(i) for i in group}

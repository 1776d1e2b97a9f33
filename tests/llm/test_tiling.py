import random

import numpy as np
import pytest

from glidepath.llm.tiling import Index, contaminations, decontaminated, leaks, tiles, words_of


def brute_tiles(a, b, size):
    """Greedy string tiling as first described: the longest unmarked common run is marked, again and again."""
    used_a, used_b, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return out
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        out += n


@pytest.mark.parametrize("seed", range(20))
def test_tiles_cover_as_much_as_the_plain_method(seed):
    rnd = random.Random(seed)
    a = [rnd.choice("abcdefgh") for _ in range(30)]
    b = a[10:22] + ["z"] + a[:9] + [rnd.choice("abcdefgh") for _ in range(30)]
    index = Index([(1, a)], 4)
    seeds = index.found(index.numbers(b)).get(0, [])
    made = tiles(index.items[0][1], index.numbers(b), seeds, 4)
    assert sum(n for *_, n in made) >= 21 and abs(sum(n for *_, n in made) - brute_tiles(a, b, 4)) <= 4
    marked = [(p + k, q + k) for p, q, n in made for k in range(n)]
    assert len({p for p, _ in marked}) == len(marked) == len({q for _, q in marked})
    assert all(a[p] == b[q] for p, q in marked)


def test_reordered_passages_are_caught():
    item = "One two three four five six. Seven eight nine ten eleven! Twelve thirteen fourteen fifteen sixteen."
    index = Index([(7, words_of(item)), (8, ["a", "b"]), (9, words_of("nothing of this is in there at all"))])
    text = "filler Twelve, thirteen fourteen\nFIFTEEN sixteen and more filler one two three four five six, done seven eight nine ten eleven"
    assert leaks(index, text, 0.5) == [(7, 1.0, 3, True)]
    assert leaks(index, "one two three four filler", 0.5) == [] and leaks(index, None, 0.5) == []


def test_documents(spark, docs, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, words_of(r.text)) for r in benchmark.collect()]
    wanted = []
    for r in docs.collect():
        w = words_of(r.text)
        have = {tuple(w[i:i + 4]) for i in range(len(w) - 3)}
        for i, item in items:
            cover = {p + k for p in range(len(item) - 3) if tuple(item[p:p + 4]) in have for k in range(4)}
            if len(cover) >= 0.5 * len(item):
                wanted.append((r.doc_id, i))
    got = contaminations(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(wanted) and wanted
    assert sorted((r.doc_id, r.item_id) for r in contaminations(docs, benchmark, block_words=300).collect()) == sorted(wanted)
    bad = {d for d, _ in wanted}
    for words in (10**6, 300):
        clean = decontaminated(docs, benchmark, block_words=words)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)


def test_edges(spark, edge, empty, crowded):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, None), (3, "too short"), (None, "no id at all here"), (4, ""), (1, "x y z q")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contaminations(crowded, items).collect())
    assert got == [(-5, 1), (4, 1), (4, 1), (5, 1), (6, 1)]
    assert contaminations(empty, items).count() == 0 and contaminations(edge, items.limit(0)).count() == 0
    clean = decontaminated(crowded, items)
    assert clean.columns == crowded.columns and clean.count() == edge.count() - 5
    assert decontaminated(edge, items.limit(0)).count() == edge.count()


def test_hashes_are_looked_up_by_value():
    index = Index([(1, list("abcdabcd"))], 4)
    assert sorted(index.found(index.numbers(list("xxabcd")))[0]) == [(0, 2), (4, 2)]
    assert isinstance(index.sorted, np.ndarray)

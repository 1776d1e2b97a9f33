import random

import pytest

from glidepath.llm import anchors
from glidepath.llm.anchors import WINDOW, remove_repeats


def brute(docs):
    """docs: (doc_id, text); rows that repeat both are one document."""
    rows = [(d, t, (t or "").encode().split()) for d, t in docs]
    order = sorted({(d is not None, d or 0, t or "") for d, t, _ in rows})
    seen = {}
    for key in order:
        w = key[2].encode().split()
        for i in range(len(w) - WINDOW + 1):
            seen.setdefault(tuple(w[i:i + WINDOW]), (key, i))
    out = []
    for d, t, w in rows:
        key, gone = (d is not None, d or 0, t or ""), set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i:i + WINDOW])] != (key, i):
                gone.update(range(i, i + WINDOW))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in remove_repeats(df).collect())


def test_documents(docs):
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge, empty, crowded):
    rows = [(r.doc_id, r.text) for r in edge.collect() if not (r.doc_id == 4 and r.text.startswith("v"))]
    plain = edge.filter("doc_id IS NULL OR doc_id <> 4 OR text NOT LIKE 'v%'")
    assert result(plain) == brute(rows)
    assert sorted(r.n_words for r in remove_repeats(crowded).collect()) == sorted(len((r.text or "").encode().split()) for r in edge.collect())
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_planted_repeats_at_every_offset(spark, seed):
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(rnd.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [rnd.choice("xyz") + str(rnd.randint(0, 2000)) for _ in range(rnd.randint(0, 30))]
            if rnd.random() < 0.7:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 2)
                w += p[a:rnd.randint(a, len(p))]
        rows.append((rnd.randint(0, 10**6) * 1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df) == brute(rows)


def test_rolling_matches_windows():
    import numpy as np
    h = np.arange(1, 60, dtype=np.uint64)
    for n in (1, 2, 3, 10, 20, 59):
        r = anchors.rolling(h, n)
        assert len(r) == 60 - n and len(set(r.tolist())) == len(r)
        at = min(5, len(r) - 1)
        assert anchors.rolling(h[at:at + n], n)[0] == r[at]
    assert not len(anchors.rolling(h, 60))


def test_copies_spread_over_all_bins():
    import numpy as np
    import pyarrow as pa
    text = " ".join(f"w{i}" for i in range(40))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text_key": [77] * 400, "text": [text] * 400, "spots": [anchors.packed(np.array([0, 10, 10]))] * 400})
    for run in (anchors._probe(16, 4), anchors._extend(16)):
        rows = [r for b in run(iter([batch])) for r in b.to_pylist() if r["sure"]]
        docs = {r["bin"]: len(r["ids"]) // 8 for r in rows}
        assert len(docs) == 16 and 399 <= sum(docs.values()) <= 400 and max(docs.values()) < 60
    run = np.repeat(np.arange(400), 2)
    dealt = anchors._dealt(run, np.tile([0, 5], 400), np.arange(400), np.full(400, 77), 16)
    assert len(dealt) == 16 and set(dealt["bin"]) == set(range(16))

import zlib
from itertools import product

import numpy as np

from glidepath.llm.hilbert import curve_index, hilbert_shards


def test_curve_moves_one_step_at_a_time():
    for n, bits in ((2, 4), (3, 3), (4, 2), (1, 3)):
        cells = np.array(list(product(range(1 << bits), repeat=n)))
        order = cells[np.argsort(curve_index(cells, bits))]
        assert sorted(curve_index(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check(rows, docs, shards=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(docs, edge, empty, crowded):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    first = hilbert_shards(docs).collect()
    check(first, plain)
    assert sorted(map(str, first)) == sorted(map(str, hilbert_shards(docs.repartition(5)).collect()))
    own = [(r.doc_id, r.text) for r in edge.collect()]
    check(hilbert_shards(edge).collect(), own)
    check(hilbert_shards(crowded).collect(), own)
    assert hilbert_shards(empty).count() == 0


def test_shards_have_narrow_bounds(docs):
    rows = {(r.doc_id): r for r in docs.collect()}
    langs, curve = 0, hilbert_shards(docs).collect()
    for s in range(8):
        langs += len({rows[r.doc_id].lang for r in curve if r.shard == s})
    assert langs < 8 * 4  # dealt by hash every shard would hold every language

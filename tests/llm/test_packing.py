import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glidepath.llm.packing import pack
from glidepath.llm.packplan import plan
from glidepath.llm.wordtokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, end):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def check(rows, docs, size=4096, padding=0.05):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in docs]
    wanted, got = defaultdict(int), defaultdict(int)
    for d, x in ids:
        wanted[d] += len(x)
    slices = {(d, a, n): set() for d, a, n in ((r.doc_id, r.start, r.length) for r in rows)}
    for d, x in ids:
        for d2, a, n in slices:
            if d2 == d and a + n <= len(x):
                slices[d, a, n].add((zlib.crc32(x[a:a + n].tobytes()), len(x)))
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        assert (r.ids_crc32, r.doc_tokens) in slices[r.doc_id, r.start, r.length]
        sequences[r.sequence_id].append((r.offset, r.length))
    assert wanted == got
    waste = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        waste += 0 if at & (at - 1) == 0 else size - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert waste <= size or waste <= padding * size * len(sequences)


def test_words_encode_like_whole_texts(docs):
    random.seed(3)
    letters = "abTHE .,'\n\t \x1c\x01▁éé ß​　日\U0001d518ﬁ<|endoftext|>12_ſKİΣ"
    texts = [r.text for r in docs.limit(40).collect()] + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    own = WordTokens(PATH, limit=200)  # empties its store all the time
    plain = Tokenizer.from_file(PATH)
    for i in range(0, len(texts), 20):
        for text, raw in zip(texts[i:i + 20], own.encode(texts[i:i + 20])):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_token_once(seed):
    rnd = random.Random(seed)
    counts = [{3000: 500}, {rnd.randint(1, 4095): rnd.randint(1, 50) for _ in range(200)}, {2049: 7}, {}, {1: 5}, {4095: 90, 1: 3, 700: 11}][seed]
    seen, total, waste = set(), 0, 0
    for w in plan(counts, (512, 1024, 2048, 4096)):
        assert w.filled <= w.size and w.count > 0
        total += w.filled * w.count
        waste += 0 if w.filled == w.size else w.count
        for r in w.runs:
            assert r.count == w.count
            for k in range(r.lo, r.lo + r.count):
                for t in range(r.start, r.start + r.length):
                    assert (r.of, k, t) not in seen
                    seen.add((r.of, k, t))
    assert total == len(seen) == sum(k * n for k, n in counts.items()) and waste <= 3


def test_all_documents(docs):
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge, empty, crowded):
    for df in (edge, crowded):
        check(pack(df, PATH).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert pack(empty, PATH).count() == 0


def test_steps_of_a_tier_cost_alike(docs):
    rows = pack(docs, PATH, step_tokens=4 * 4096).collect()
    by_step = defaultdict(int)
    for r in rows:
        if r.tier == 4096:
            by_step[r.step] += r.length
    assert len(by_step) > 3 and max(by_step.values()) - min(by_step.values()) <= 4096

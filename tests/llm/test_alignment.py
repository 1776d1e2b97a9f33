"""Alignment against byte ranges in plain Python, and the store of units against the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from conftest import DOCS, EDGE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glidepath.llm import alignment
from glidepath.llm.queries import BYTE_TOKENIZER, PIECE_MODEL

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def spans(entries):
    out, at = [], 0
    for e in entries:
        out.append((at, at + len(e)))
        at += len(e)
    return out


def brute(rows, libraries):
    """Rows of NAMES for (doc_id, text), from all overlapping pairs of byte ranges."""
    a, b = libraries
    byte = alignment.byte_alphabet()
    docs, total = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        whole = b" " + (text or "").encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        in_a, in_b = spans(raw_a), spans(raw_b)
        links, j0 = [], 0
        for i, (s, e) in enumerate(in_a):
            while in_b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(in_b) and in_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        cuts = sorted({e for _, e in in_a} & {e for _, e in in_b})
        groups, x, y = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while x < len(in_a) and in_a[x][1] <= c:
                ga.append(ids_a[x])
                x += 1
            while y < len(in_b) and in_b[y][1] <= c:
                gb.append(ids_b[y])
                y += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        total.update(links)
        docs.append((doc_id, ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return sorted(((d, len(x), len(y), len(g), len(k), sum(total[p] == most[p[1]] for p in k), sum(total[p] for p in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in docs), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


HARD = ["a", " ", "  x", "x  ", "\n", "\n\n a", "a\n\nb\n", "\t tab\tx \t", "it's we'll DON'T 'sa", "日本語のテキスト", "naïve café — “q”", "\U0001f600\U0001f468‍\U0001f469", "é ﬁ",
        "x y 　z", "▁mark ▁", "\x00nul\x1f", "<|endoftext|> <s></s><unk>", "1234567 3.14", "a" * 3000, "ab " * 2000, "\r\n\r\nx\r", " \n \n", "<0x41> <0x0A>",
        "foo    bar     baz", "word\x0bnext\x0cpage", "!\x1c? \x1d"]


def test_store_equals_the_libraries(libraries):
    tools = alignment.Encoders(BYTE_TOKENIZER, PIECE_MODEL, limit=20_000)
    rng = random.Random(5)
    alphabet = list("abcde THE.,'\"!?0123\n\t \r éñßжд日本▁\x00  ") + [" the", " and", "\n\n", "  ", "ing", "'s", "<s>", "\U0001f600"]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for got, text in zip(zip(*tools.encode(part)), part):
            want = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
            assert got == tuple(tools._packed(w) for w in want), text


def test_documents(docs, libraries):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(alignment.alignments(docs, BYTE_TOKENIZER, PIECE_MODEL, size=50_000)) == brute(rows, libraries)


def test_edge_rows(spark, edge, libraries):
    more = spark.createDataFrame([(100 + n, t, None, None, None) for n, t in enumerate(HARD)], DOCS)
    rows = [(r[0], r[1]) for r in EDGE] + [(100 + n, t) for n, t in enumerate(HARD)]
    assert found(alignment.alignments(edge.unionByName(more), BYTE_TOKENIZER, PIECE_MODEL)) == brute(rows, libraries)


def test_pair_counts(docs, libraries):
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(docs, BYTE_TOKENIZER, PIECE_MODEL).collect()}
    rows = brute([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    assert sum(got.values()) == sum(r[4] for r in rows)
    assert sum(n * n for n in got.values()) == sum(r[6] for r in rows)


def test_empty_and_crowded(empty, edge, crowded):
    assert alignment.alignments(empty, BYTE_TOKENIZER, PIECE_MODEL).collect() == []
    more = crowded.withColumns({c: F.lit("x") for c in ["block", "code", "pair", "hits", "links", "doc", "n_a", "a", "b"]})
    assert found(alignment.alignments(more, BYTE_TOKENIZER, PIECE_MODEL)) == found(alignment.alignments(edge, BYTE_TOKENIZER, PIECE_MODEL))


def test_a_block_is_many_small_rows(spark, docs, libraries):
    """Readers and writers hold whole batches of rows: a row of all the pairs of a block made a task's memory grow with its input."""
    texts = docs.select("doc_id", "text").coalesce(1)
    made = alignment.blocks(texts, BYTE_TOKENIZER, PIECE_MODEL).select("block", *[F.size(c).alias(c) for c in ("doc_id", "pair", "code")]).collect()
    assert sum(r["code"] for r in made) > 10_000 and len({r["block"] for r in made}) < 10
    assert all(max(r["doc_id"], r["pair"], r["code"]) <= 1024 for r in made)
    assert found(alignment.alignments(texts, BYTE_TOKENIZER, PIECE_MODEL)) == brute([tuple(r) for r in texts.collect()], libraries)

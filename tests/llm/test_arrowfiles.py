import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from glidepath.llm import arrowfiles
from glidepath.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, **options):
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()) for r in df.collect()))
    wanted, at = [], 0
    for known, d, _, text in rows:
        ids = np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids + [1], "<u4")
        wanted.append((d if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = arrowfiles.token_files(df, PATH, **options).collect()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got)


def test_round_trip(docs, edge, empty, crowded):
    check(docs)
    check(docs, length=64)
    check(edge)
    check(crowded, length=16)
    assert arrowfiles.token_files(empty, PATH).count() == 0


def test_random_access_to_one_sequence(spark, docs):
    path = fresh_path(spark, "tokens")
    manifest = arrowfiles.write_sequences(docs, PATH, path, length=128).orderBy("part").collect()
    assert sum(r.documents for r in manifest) == docs.count()
    for r in manifest:
        with pa.memory_map(f"{path}/{r.path}") as source:
            flat = np.concatenate([ids for _, ids in arrowfiles.read_documents(source, 128)])
            assert len(flat) == r.tokens
            for row in {0, r.sequences // 2, r.sequences - 1}:
                ids, mask = arrowfiles.sequence(source, row)
                part = flat[128 * row:128 * (row + 1)]
                assert len(ids) == len(mask) == 128 and mask.sum() == len(part) and (ids[:len(part)] == part).all()

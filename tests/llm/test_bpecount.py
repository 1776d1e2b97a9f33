import random

import public_tokenizers
import sentencepiece

from glidepath.llm.bpecount import MergeCounter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(docs):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), MergeCounter(PATH, limit=500)
    rnd = random.Random(1)
    letters = "abcTHE .,'\n\t \x1c\x01▁éé ñß​　日本\U0001d518ﬁ<|endoftext|>  12_-ſK"
    texts = [r.text for r in docs.collect()] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["</s><s> <0x0A> <unk>", " x", "\nx \n y", " \n", "\n", "\n\n", "a\n b", "a \nb", "a" * 5000, " " * 100, "▁"]
    for text in texts:
        assert own.count(text) == len(library.encode(text)), repr(text)


def test_table(edge, empty, crowded):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    wanted = sorted(str((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096)) for r in edge.collect())
    for df in (edge, crowded):
        assert sorted(str(tuple(r)) for r in token_counts(df, PATH).collect()) == wanted
    assert token_counts(empty, PATH).count() == 0

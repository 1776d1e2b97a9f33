"""Token ids of whole texts by a tokenizer of the `tokenizers` library that never joins characters across white space.

Every white-space separated word then has ids of its own, so each worker keeps the ids of words it has met and asks the library only
for new ones. The ids equal those of a call with the whole text (tests compare them).
"""

from __future__ import annotations

import os
import re

import numpy as np

from glidepath.llm.common import worker_store

#: White space as Unicode defines it, which is what the tokenizer drops.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{SPACE}]+")
#: str.split() takes these for white space as well; the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_MARK = "\x01"


class _Known(dict):
    """Ids of words; words that are asked for and not there are noted, and have no ids for now."""

    def __init__(self):
        super().__init__()
        self.missing: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.missing.append(word)
        return b""


class WordTokens:
    """`limit`: bytes that the store of words may take in a worker (as estimated from their lengths) before it is emptied; it bounds
    memory and does not change results."""

    def __init__(self, path: str, limit: int = 224 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.held = limit, 0
        self.known = _Known()
        self.mark = self._ids(_MARK)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORDS.findall(text) if any(c in text for c in _SEPARATORS) else text.split()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            plain = [w for w in words[at : at + 4096] if _MARK not in w]
            if len(self.mark) == 1 and plain:
                ids = np.array(self._ids(f" {_MARK} ".join(plain)), dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark[0])
                if len(cuts) == len(plain) - 1:
                    raw, edges = ids.tobytes(), [0, *(cuts + 1).tolist(), len(ids) + 1]
                    self.known.update((w, raw[4 * a : 4 * (b - 1)]) for w, a, b in zip(plain, edges, edges[1:]))
            for w in words[at : at + 4096]:
                if w not in self.known:
                    self.known[w] = np.array(self._ids(w), dtype="<u4").tobytes()
        self.held += 180 * len(words) + 6 * sum(map(len, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        if self.held > self.limit:
            self.known, self.held = _Known(), 0
        known, out, pending = self.known, [], []
        get, missing = known.__getitem__, known.missing
        for n, text in enumerate(texts):
            words, noted = self.words(text) if text else [], len(missing)
            out.append(b"".join(map(get, words)))
            if len(missing) > noted:
                pending.append((n, words))
        self._learn(list(dict.fromkeys(missing)))
        missing.clear()
        for n, words in pending:
            out[n] = b"".join(map(get, words))
        return out


def word_tokens(path: str) -> WordTokens:
    """The worker's store for the tokenizer at `path`."""
    return worker_store(f"words {path}", lambda: WordTokens(path))

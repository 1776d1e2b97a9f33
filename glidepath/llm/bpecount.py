"""Token counts by byte-pair merging with a heap of ranked pairs over a linked list of symbols."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import text_groups, worker_store

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class MergeCounter:
    """Counts for a SentencePiece model of byte-pair type with byte fallback.

    The library is asked only for the vocabulary: its pieces and their ranks. No piece holds the space mark after another character (checked
    on loading), so no merge crosses from one word to the next and counts of words met before are kept; `limit` bounds how many.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {pieces[i]: -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces of this model cross words; counts by word would be wrong")
        self.lines = not any("\n" in p for p in self.rank)  # then a line feed is a byte of its own and no merge crosses it
        self.limit, self.inner, self.first = limit, {}, {}

    def unit(self, text: str) -> int:
        """Symbols minus merges. A character that is no piece counts as its bytes and takes part in no merge."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        count = sum(1 if c in rank else len(c.encode()) for c in symbols)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        heap = []
        for i in range(size - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j < 0 or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                if (r := rank.get(joined := piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, joined))
            if (h := before[i]) >= 0 and (r := rank.get(joined := symbols[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, joined))
        return count

    def _known(self, store: dict[str, int], words: list[str], mark: str) -> int:
        try:
            return sum(map(store.__getitem__, words))
        except KeyError:
            if len(store) + len(words) > self.limit:
                store.clear()
            for w in words:
                if w not in store:
                    store[w] = self.unit(mark + w)
            return sum(map(store.__getitem__, words))

    def count(self, text: str | None) -> int:
        """As the library counts: a space mark before a text that isn't empty, spaces become marks, everything else stays."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if not self.lines or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text:
            total = 0
            for n, line in enumerate(text.split("\n") if self.lines else [text]):
                units = _UNITS.findall((MARK if n == 0 else "") + line.replace(" ", MARK))
                total += (n > 0) + self._known(self.first, units, "")
            return total
        lines = text.split("\n")
        total = len(lines) - 1
        marked: list[str] = []
        opening: list[str] = []
        for n, line in enumerate(lines):
            parts = line.split(" ")
            if n:
                opening.append(parts[0])
                del parts[0]
            marked += parts
        return total + self._known(self.inner, marked, MARK) + self._known(self.first, [w for w in opening if w], "")


def merge_counter(path: str) -> MergeCounter:
    return worker_store(f"merges {path}", lambda: MergeCounter(path))


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of each text of `docs`, and whether it has more than `limit` tokens. No ids are made.

    One pass without a shuffle; a worker holds one slice of texts and its store of words. Null texts count as empty (0 tokens).
    Repeated rows and null doc_ids give a row each; an empty table gives none; other columns are ignored.
    """
    def run(batches):
        counter = merge_counter(model)
        for part, texts in text_groups(batches):
            tokens = np.array([counter.count(t) for t in texts], dtype=np.int64)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                             names=[c.split()[0] for c in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)

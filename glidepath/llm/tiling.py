"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.llm.common import text_groups

#: Shortest tile in words, and the share of a test item's words that tiles must cover.
MIN_TILE, COVERAGE = 4, 0.5
#: Words of test items per pass; a larger benchmark takes several passes over the documents.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Index:
    """Test items as numbers of words, and where each run of `size` words begins in them, by its Karp-Rabin hash."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int = MIN_TILE):
        self.size = size
        self.number: dict[str, int] = {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64)) for i, ws in items if len(ws) >= size]
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ws) in enumerate(self.items):
            for p, h in enumerate(self.hashes(ws).tolist()):
                self.seeds[h].append((k, p))
        self.sorted = np.array(sorted(self.seeds), dtype=np.uint64)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        """Karp-Rabin hashes of all runs of `size` numbers; runs that hold a word no item has are wrong, and never looked up."""
        n = len(numbers) - self.size + 1
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(self.size if n > 0 else 0):
            h = h * _BASE + numbers[j : j + n].astype(np.uint64)
        return h * _BASE

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, numbers: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per item the (place in item, place in document) of shared seeds."""
        h = self.hashes(numbers)
        if not len(h) or not len(self.sorted):
            return {}
        at = np.flatnonzero(self.mask[(h >> np.uint64(44)).astype(np.int64)])
        at = at[self.sorted[np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)] == h[at]]
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for q in at.tolist():
            for k, p in self.seeds[int(h[q])]:
                if np.array_equal(self.items[k][1][p : p + self.size], numbers[q : q + self.size]):
                    out[k].append((p, q))
        return out


def tiles(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(place in item, place in document, length) of the tiles: the longest match first, none overlapping another in either text.

    Seeds on one diagonal that follow each other make one maximal match. A match that meets marked words is cut to its unmarked runs,
    which wait their turn by length.
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for p, q in seeds:
        diagonals[q - p].append(p)
    heap: list[tuple[int, int, int]] = []
    for d, places in diagonals.items():
        places.sort()
        begin = end = places[0]
        for p in places[1:] + [None]:
            if p is not None and p <= end + 1:
                end = p
                continue
            heap.append((-(end - begin + size), begin, begin + d))
            if p is not None:
                begin = end = p
    heapq.heapify(heap)
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = ~(used_item[p : p - n] | used_doc[q : q - n])
        if free.all():
            used_item[p : p - n] = True
            used_doc[q : q - n] = True
            out.append((p, q, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return out


def leaks(index: Index, text: str | None, least: float) -> list[tuple[int, float, int, bool]]:
    """(item_id, coverage, number of tiles, reordered) of the items whose tiles cover `least` of their words or more."""
    numbers = index.numbers(words_of(text))
    out = []
    for k, seeds in index.found(numbers).items():
        item_id, item = index.items[k]
        reach = np.zeros(len(item) + 1, np.int64)
        starts = np.unique([p for p, _ in seeds])
        reach[starts] += 1
        np.subtract.at(reach, starts + index.size, 1)
        if np.count_nonzero(np.cumsum(reach[:-1]) > 0) < least * len(item):
            continue  # even all seeds together cover too little
        made = sorted(tiles(item, numbers, seeds, index.size), key=lambda t: t[1])
        share = sum(n for _, _, n in made) / len(item)
        if share >= least:
            out.append((item_id, share, len(made), any(a[0] > b[0] for a, b in zip(made, made[1:]))))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def _indexes(benchmark: DataFrame, size: int, block_words: int):
    """The benchmark as broadcast indexes of `block_words` words or so each: one, unless it is large."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    words = items.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(Index([(r["item_id"], words_of(r["text"])) for r in rows], size))


LEAKS = "doc_id long, item_id long, coverage double, n_tiles long, reordered boolean"


def contaminations(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, size: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item whose tiles cover at least `least` of the item's words.

    Words are runs of letters, digits and underscores in lower case, so punctuation and line breaks don't hide a passage; tiles may come
    in any order, so neither does reordering. The benchmark is read in blocks of bounded size, each broadcast as an index of seeds; the
    documents are scanned once per block and never shuffled. An item that its seeds cannot cover far enough is dropped before tiling,
    which changes nothing.

    Null and empty texts match nothing, nor do items under `size` words or with a null id or text; a repeated item or document gives
    its rows again; a null doc_id stays null. Empty tables give no rows.
    """
    def scan(index):
        def run(batches):
            for part, texts in text_groups(batches):
                rows = [(doc, *leak) for doc, text in zip(part.column("doc_id").to_pylist(), texts) for leak in leaks(index.value, text, least)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in LEAKS.split(", ")])
        return run

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return reduce(DataFrame.unionByName, [rows.mapInArrow(scan(index), LEAKS) for index in _indexes(benchmark, size, block_words)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, size: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` that hold no test item by `contaminations`, all columns as they are, in one pass per block without a shuffle."""
    def sieve(index):
        def run(batches):
            for part, texts in text_groups(batches):
                clean = pa.array([not leaks(index.value, text, least) for text in texts], pa.bool_())
                yield part.select(["row"]).filter(clean)
        return run

    row = T.StructType([T.StructField("row", docs.schema)])
    out = docs.select(F.struct("*").alias("row"))
    for index in _indexes(benchmark, size, block_words):
        out = out.select("row", F.col("row.text").cast("string").alias("text")).mapInArrow(sieve(index), row)
    return out.select("row.*")

"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.common import partitions, stored, text_groups
from glidepath.llm.packplan import Windows, plan
from glidepath.llm.shinglejoin import _spread
from glidepath.llm.wordtokens import word_tokens

TIERS = (512, 1024, 2048, 4096)
PIECES = "doc_id long, text_key long, text_key2 long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, size: int):
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([*[(c.split()[0], pa.int64()) for c in PIECES.split(", ")], ("ids", pa.binary())])

    def run(batches):
        for part, texts in text_groups(batches):
            rows, tools = [], word_tokens(path)
            kind = "<u2" if max(tools.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
            own = (part.column(c).to_pylist() for c in ("doc_id", "text_key", "text_key2"))
            for doc, key, key2, ids in zip(*own, tools.encode(texts)):
                ids += tail
                n = len(ids) // 4
                for a in range(0, n, size):
                    # Only what does not fill a window may be cut again; its ids stay beside it.
                    rest = np.frombuffer(ids, "<u4", offset=4 * a).astype(kind).tobytes() if n - a < size else None
                    rows.append((doc, key, key2, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n, rest))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _slices(batches):
    """Checksums of parts of pieces, which come with their ids (as many bytes each as the piece has ids)."""
    for part in batches:
        crc = []
        for raw, of, first, start, length in zip(*(part.column(c).to_pylist() for c in ("ids", "of", "first", "start", "length"))):
            ids = np.frombuffer(raw, f"<u{len(raw) // of}")
            crc.append(zlib.crc32(ids[start - first : start - first + length].astype("<u4").tobytes()))
        keep = [n for n in part.schema.names if n not in ("ids", "of", "first")]
        yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])


class _Places:
    """For remainder number `rank` of length `of`: the windows that its parts go to, as flat arrays for a binary search."""

    def __init__(self, windows: list[Windows], tiers: tuple[int, ...], step_tokens: int, first_id: dict[int, int], whole: int):
        by_tier: dict[int, list[Windows]] = defaultdict(list)
        for w in windows:
            by_tier[w.size].append(w)
        self.tiers = tiers
        parts: dict[int, list[tuple]] = defaultdict(list)
        self.next_id, step_base = 0, 0
        for size in sorted(tiers, reverse=True):
            made = sorted(by_tier[size], key=lambda w: (w.cost, w.runs[0].of, w.runs[0].lo))
            own = whole if size == max(tiers) else 0
            total = own + sum(w.count for w in made)
            steps = -(-total // max(1, step_tokens // size))
            first_id[size] = self.next_id
            at = 0
            for w in made:
                offset = 0
                for r in w.runs:
                    parts[r.of].append((r.lo, r.count, r.start, r.length, self.next_id + at, offset, size, at, steps, step_base))
                    offset += r.length
                at += w.count
            if own:  # whole windows cost most, so they come last in their tier
                parts[size].append((0, own, 0, size, self.next_id + at, 0, size, at, steps, step_base))
            self.next_id += total
            step_base += steps
        keys, first, flat = [], [0], []
        for of in sorted(parts):
            edges = sorted({p[0] for p in parts[of]} | {p[0] + p[1] for p in parts[of]})
            opening = defaultdict(list)
            for p in parts[of]:
                opening[p[0]].append(p)
            live: list[tuple] = []
            for lo in edges:
                live = [p for p in live if p[0] + p[1] > lo] + opening[lo]
                keys.append((of << 44) + lo)
                flat += sorted(live, key=lambda p: p[2])
                first.append(len(flat))
        self.keys, self.first = np.array(keys, dtype=np.int64), np.array(first, dtype=np.int64)
        self.flat = np.array(flat, dtype=np.int64).reshape(-1, 10)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the input, repeated once per part, and the rows of `flat` that belong to them."""
        at = np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1
        n = self.first[at + 1] - self.first[at]
        rows = np.repeat(np.arange(len(at)), n)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return rows, self.first[at][rows] + inner


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long, text_key long, text_key2 long"


def _place(places: _Places):
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            length, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            rows, at = places.of(length, rank)
            lo, _, start, part, seq, offset, size, nth, steps, base = places.flat[at].T
            k = rank[rows] - lo
            out = f.iloc[rows].drop(columns=["rank"]).copy()
            out["whole"] = (part == length[rows])
            out["start"] = out["start"].to_numpy(np.int64) + start
            out["length"] = part
            out["sequence_id"] = seq + k
            out["offset"] = offset
            out["tier"] = size.astype(np.int32)
            turn, pos = np.divmod(nth + k, np.maximum(steps, 1))
            out["step"] = base + np.where(turn % 2 == 0, pos, steps - 1 - pos)
            yield out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step", "text_key", "text_key2", "whole"]]

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 20) -> DataFrame:
    """Packs every token of `docs` (doc_id, text) into sequences and returns one row per piece.

    A document is routed to the smallest tier that holds it; one beyond the largest tier first fills windows of its own. Windows of a
    tier are opened by its longest documents, their gaps filled from shorter tiers (`packplan`), so a sequence has exactly its tier's
    length, except the very last ones. Sequences of a tier are dealt to steps of `step_tokens` tokens back and forth in the order of
    their attention cost, so steps of a tier cost nearly the same.

    The plan needs only how many remainders have which length. Each remainder then gets its number within its length (numbered in
    salted parts, so a length that a third of the rows share is spread), which says where its tokens go. Texts are encoded once: the ids of
    remainders are written beside them, once per row, and a remainder that is cut takes its checksums from them. Cut rows and ids meet by
    hash of the text; hashes that many cut rows share are dealt over parts.

    Null texts count as empty: a document has its end token at least. Rows with a null or repeated doc_id are packed like others;
    equal rows are told apart by place only. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = max(tiers)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"),
                       F.xxhash64("text", F.lit(1)).alias("text_key2"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, end_id, size), PIECES + ", ids binary"), "pieces")
    salts = partitions(spark)
    salted = pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # lengths 1 .. size
    whole = histogram.pop(size, 0)
    places = _Places(plan(histogram, tiers), tiers, step_tokens, {}, whole)
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "text_key", "start"))
    ranked = salted.withColumn("inner", inner).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner") - 1)
    placed = stored(ranked.select("doc_id", "text_key", "text_key2", "start", "length", "ids_crc32", "doc_tokens", "rank")
                    .mapInPandas(_place(places), PLACED + ", whole boolean"), "placed")
    names = [c.split()[0] for c in PLACED.split(", ")][:-2]
    cut = placed.filter(~F.col("whole")).drop("ids_crc32", "whole")
    wanted = cut.select("text_key", "text_key2").distinct()
    ids = pieces.filter(F.col("ids").isNotNull()).join(wanted, ["text_key", "text_key2"], "left_semi").groupBy("text_key", "text_key2").agg(
        F.min(F.struct("start", "length", "ids")).alias("p")).select("text_key", F.col("text_key2").alias("key2"), F.col("p.start").alias("first"),
                                                                     F.col("p.length").alias("of"), F.col("p.ids").alias("ids"))
    with_ids = _spread(cut, ids, "text_key", F.col("text_key2") == F.col("key2")).drop("key2")
    fields = ", ".join(c for c in PLACED.split(", ") if not c.startswith("ids_crc32")) + ", ids_crc32 long"
    again = with_ids.select(*cut.columns, "ids", "of", "first").mapInArrow(_slices, fields)
    return placed.filter("whole").select(names).unionByName(again.select(names))

"""Two tokenizers over one corpus: where their tokens end together, which tokens overlap, and how often each pair does.

Within a task everything is Arrow: lists of ids are flattened beside their parents, byte ends are segmented cumulative sums, a hash join
on (document, end) keys lines the tokens up, and grouped tables hold partial counts. Spark adds the counts up and hands them back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import stored, text_groups, worker_store

MARK = "▁"
#: A run of white space and what follows it; the first alphabet never joins tokens of two such units (see `Encoders`).
_UNITS = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: Texts with other white space (of which pieces may hold the carriage return), controls or the space mark itself go to the libraries whole.
_WHOLE = re.compile(f"[\\x00-\\x08\\x0b-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff{MARK}]")
#: A document-end key: the document's place in the slice above the byte end.
_END_BITS = 40


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class Encoders:
    """Ids of both tokenizers for whole texts, as the libraries give them for space + text and for text.

    `a` is a byte-level BPE that splits before white space, `b` a SentencePiece BPE without a piece that has white space after another
    character (checked). Tokens of either then never cross from one unit to the next, and a worker keeps the ids of units it has met, up
    to `limit` bytes, after which the store is emptied; results do not depend on it.
    """

    def __init__(self, a: str, b: str, limit: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        with open(a, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        byte = byte_alphabet()
        size = self.a.get_vocab_size()
        bytes_a = [b""] * size
        for entry, i in entries.items():
            bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(c in p for p in plain for c in "\t\n") or any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("pieces of the second model cross white space; ids by unit would be wrong")
        self.mark = self.b.piece_to_id(MARK)
        self.bytes = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.sizes = [pa.array([len(x) for x in y], pa.int64()) for y in (bytes_a, bytes_b)]
        self.lengths = [x.to_numpy() for x in self.sizes]
        #: Each id as text, with what follows it inside a group and at its end: `,` and `|` after the first's, `,` and `;` after the second's.
        self.shown = pa.array([f"{i}{c}" for i in range(size) for c in ",|"] + [f"{i}{c}" for i in range(len(pieces)) for c in ",;"], pa.large_string())
        self.limit, self.held = limit, 0
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _cut(self, ids: list[int], side: int, sizes: np.ndarray) -> list[bytes] | None:
        """`ids` of units put together, dealt to the units by their sizes in bytes; None if a token crosses from one to the next."""
        at = np.asarray(ids, dtype="<u4")
        ends, wanted = np.cumsum(self.lengths[side][at]), np.cumsum(sizes)
        last = np.searchsorted(ends, wanted)
        if not len(at) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return None
        raw, cuts = at.tobytes(), [0, *((last + 1) * 4).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn(self, units: list[str]) -> None:
        # Units that end in white space (ends of texts) go alone, as the split depends on what follows; so does a run that begins otherwise.
        alone = [u for u in units if u[-1] in " \t\n"]
        rest = sorted(u for u in units if u[-1] not in " \t\n")
        rest = [u for u in rest if u[0] == " "] + [u for u in rest if u[0] != " "]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            if part[0][0] != " ":
                alone += part
                continue
            whole, sizes = "".join(part), np.array([len(u.encode()) for u in part])
            found = self._cut(self.a.encode(whole, add_special_tokens=False).ids, 0, sizes), self._cut(self.b.encode(whole[1:]), 1, sizes)
            if found[0] is None or found[1] is None:
                alone += part
                continue
            self.known[0].update(zip(part, found[0]))
            self.known[1].update(zip(part, found[1]))
            self.held += int(sizes.sum()) * 5 + 350 * len(part)
        # The library puts a space mark in front: that of the unit's own space, or one more, which no piece that begins with other white space takes in.
        for u, ids in zip(alone, self.b.encode([u[1:] if u[0] == " " else u for u in alone], num_threads=1) if alone else []):
            if u[0] != " " and ids[:1] != [self.mark]:
                raise ValueError(f"no space mark before {u[:20]!r}")
            self.known[0][u] = self._packed(self.a.encode(u, add_special_tokens=False).ids)
            self.known[1][u] = self._packed([self.mark] if u == " " else ids if u[0] == " " else ids[1:])
            self.held += len(u) * 9 + 350

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Little-endian unsigned 32-bit ids of each text by both; none for null and empty texts."""
        out: tuple[list[bytes], list[bytes]] = [], []
        get = self.known[0].__getitem__, self.known[1].__getitem__
        pending = []
        for n, text in enumerate(texts):
            if not text or _WHOLE.search(text):
                out[0].append(self._packed(self.a.encode(" " + text, add_special_tokens=False).ids) if text else b"")
                out[1].append(self._packed(self.b.encode(text)) if text else b"")
                continue
            units = _UNITS.findall(" " + text)
            try:
                one = b"".join(map(get[0], units))
                out[0].append(one)
                out[1].append(b"".join(map(get[1], units)))
            except KeyError:
                pending.append((n, units))
                out[0].append(b"")
                out[1].append(b"")
        fresh = {u for _, units in pending for u in units if u not in self.known[1]}
        if self.held > self.limit:
            self.known[0].clear()
            self.known[1].clear()
            self.held = 0
            fresh = {u for _, units in pending for u in units}
        self._learn(list(fresh))
        for n, units in pending:
            out[0][n], out[1][n] = b"".join(map(get[0], units)), b"".join(map(get[1], units))
        return out


def encoders(a: str, b: str) -> Encoders:
    return worker_store(f"encoders {a} {b}", lambda: Encoders(a, b))


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))


def _spells(lists: pa.LargeListArray, entries: pa.LargeBinaryArray, texts: list[str | None]) -> list[bool]:
    """Whether each list's entries, put together, are a space and the text."""
    raw = entries.take(pc.list_flatten(lists))
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = memoryview(raw.buffers()[2] or b"").cast("B")
    cuts = ends[np.asarray(lists.offsets)].tolist()
    return [bool(t) and data[i:j] == b" " + t.encode() for t, i, j in zip(texts, cuts, cuts[1:])]


def _ends(lists: pa.LargeListArray, sizes: pa.Int64Array, name: str) -> pa.Table:
    """A row per token: its document-end key and its id."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets.slice(0, len(lists)))
    end = pc.subtract(total, before.take(doc))
    return pa.table({"key": pc.add(pc.multiply(doc, 1 << _END_BITS), end), name: ids})


def aligned(a: pa.LargeListArray, b: pa.LargeListArray, sizes: list[pa.Int64Array], shown: pa.LargeStringArray) -> tuple[pa.Table, list[str], np.ndarray]:
    """Links (doc, a, b) of the documents' lists, the digest of each document's groups, and its number of groups.

    The union of both tokenizers' ends cuts the bytes of a document into pieces, each inside one token of either: a piece is a link. A null
    id of the full join is that of the next end on its side.
    """
    left, right = _ends(a, sizes[0], "a"), _ends(b, sizes[1], "b")
    joined = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    joined = joined.take(pc.sort_indices(joined["key"]))
    has_a, has_b = (np.asarray(joined[c].is_valid()) for c in ("a", "b"))
    both = has_a & has_b
    group = np.cumsum(both) - both
    doc = pc.shift_right(joined["key"], _END_BITS)
    links = pa.table({"doc": doc, "a": pc.fill_null_backward(joined["a"]), "b": pc.fill_null_backward(joined["b"])})
    n_groups = np.bincount(np.asarray(doc)[both], minlength=len(a)).astype(np.int64)

    groups = int(both.sum())
    in_a, in_b = group[has_a], group[has_b]
    per_a, per_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    order = np.empty(len(in_a) + len(in_b), dtype=np.int64)
    order[np.arange(len(in_a)) + (np.cumsum(per_b) - per_b)[in_a]] = np.asarray(left["a"]).astype(np.int64) * 2 + both[has_a]
    order[np.arange(len(in_b)) + np.cumsum(per_a)[in_b]] = 2 * len(sizes[0]) + np.asarray(right["b"]).astype(np.int64) * 2 + both[has_b]
    text = shown.take(pa.array(order))
    digests = [""] * len(a)
    if len(order):
        data, ends = memoryview(text.buffers()[2]), np.frombuffer(text.buffers()[1], dtype=np.int64)
        cuts = ends[np.asarray(a.offsets) + np.asarray(b.offsets)].tolist()
        digests = [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]
    return links, digests, n_groups


#: A block is handed over in pieces of so many entries of each of its lists: readers and writers hold whole batches of rows, so a row is small.
PIECE = 512
BLOCK = ("block long, piece int, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
         "pair array<bigint>, hits array<bigint>, doc array<int>, code array<int>, links array<int>")
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _slice(tools: Encoders, part: pa.RecordBatch, texts: list[str | None]) -> tuple[dict, pa.Table]:
    """What the documents of a slice have by themselves, and how many links of each id pair they hold (doc, pair, n)."""
    ids = tools.encode(texts)
    lists = [_lists(x) for x in ids]
    good = np.logical_and(*[_spells(x, e, texts) for x, e in zip(lists, tools.bytes)])
    if not good.all():
        lists = [_lists([i if ok else b"" for i, ok in zip(x, good)]) for x in ids]
    links, digests, n_groups = aligned(*lists, tools.sizes, tools.shown)
    pair = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64()))
    counts = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    own = {"doc_id": part.column("doc_id").cast(pa.int64()).to_pylist(), "n_a": np.diff(np.asarray(lists[0].offsets)), "n_b": np.diff(np.asarray(lists[1].offsets)),
           "n_groups": n_groups, "n_links": np.bincount(np.asarray(links["doc"]), minlength=len(texts)), "groups_sha256": digests}
    return own, counts.rename_columns(["doc", "pair", "n"])


def _block(block: int, parts: list[tuple[dict, pa.Table]]) -> pa.RecordBatch:
    """Several slices as one block: documents, different pairs with partial counts, and each document's pairs by their place among those.

    A row per piece: the lists of a block are cut at the same places and go on in the next piece.
    """
    row: dict[str, list] = {k: [x for own, _ in parts for x in own[k]] for k in parts[0][0]}
    first = np.cumsum([0] + [len(own["doc_id"]) for own, _ in parts])
    held = pa.concat_tables([pa.table({"doc": pc.add(t["doc"], int(n)).cast(pa.int32()), "pair": t["pair"], "n": t["n"]}) for (_, t), n in zip(parts, first)]).combine_chunks()
    total = held.select(["pair", "n"]).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    code = pc.index_in(held["pair"], total["pair"].combine_chunks())
    row |= {"pair": total["pair"], "hits": total["n_sum"], "doc": held["doc"], "code": code, "links": held["n"].cast(pa.int32())}
    fields = [f.split(" ", 1) for f in BLOCK.split(", ")]
    kinds = {"array<bigint>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}
    pieces = max(1, -(-max(len(x) for x in row.values()) // PIECE))
    arrays = [pa.array([block] * pieces, pa.int64()), pa.array(range(pieces), pa.int32())]
    for name, kind in fields[2:]:
        flat = row[name]
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else pa.array(flat, kinds[kind])
        cuts = np.minimum(np.arange(pieces + 1) * PIECE, len(flat)).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(cuts), flat.cast(kinds[kind])))
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def blocks(docs: DataFrame, a: str, b: str, size: int = 6 << 20, step: int = 1 << 20) -> DataFrame:
    """`docs` encoded and aligned in blocks of about `size` bytes of text, a row per piece; a task works on `step` bytes at a time (one document at least)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoders(a, b)
        task, n, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for part, texts in text_groups(batches, limit=step):
            parts.append(_slice(tools, part, texts))
            held += sum(len(t) for t in texts if t)
            if held >= size:
                yield _block((task << 32) + n, parts)
                n, held, parts = n + 1, 0, []
        if parts:
            yield _block((task << 32) + n, parts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def _settled(key: tuple, held: pa.Table, replies: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of their pairs added up."""
    worker_store("alignment counts", dict)  # nothing is kept; lets the encoders' store go
    held = held.sort_by("piece")
    row = {c: held[c].combine_chunks().flatten() for c in held.column_names if c not in ("block", "piece")}
    count, best = np.zeros(len(row["pair"]), np.int64), np.zeros(len(row["pair"]), np.int64)
    code = np.asarray(replies["code"])
    count[code], best[code] = np.asarray(replies["n"]), np.asarray(replies["best"]).astype(np.int64)
    doc, at, links = (np.asarray(row[c]) for c in ("doc", "code", "links"))
    docs = len(row["doc_id"])
    sums = [np.zeros(docs, np.int64) for _ in range(2)]
    for out, each in zip(sums, (best, count)):
        np.add.at(out, doc, links * each[at])
    named = {**{c: row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table({f.split()[0]: named[f.split()[0]] for f in ROWS.split(", ")})


def alignments(docs: DataFrame, a: str, b: str, size: int = 6 << 20) -> DataFrame:
    """A row per document: tokens of both tokenizers (`n_a`, `n_b`), groups between common byte ends, links between overlapping tokens, how
    many of its links have their second id's most frequent pair (`n_best`), the corpus-wide counts of its links added up (`count_sum`),
    and the digest of its groups.

    Null and empty texts, and texts that the tokens do not spell out, have no tokens: zeros and an empty digest. Repeated rows and null
    doc_ids give a row each and count each; an empty table gives none. Other columns are ignored.

    A pair reaches the shuffle once per block of about 6 MB of text, however often the block has it, and its count goes back once per
    block; documents do not move again, but their pairs as numbers do. A pair that every block has is one row per block.
    """
    held = stored(blocks(docs, a, b, size), "alignment")
    asked = held.select("block", "piece", F.posexplode(F.arrays_zip("pair", "hits")).alias("at", "p"))
    asked = asked.select("block", (F.col("piece") * PIECE + F.col("at")).alias("code"), "p.pair", "p.hits")
    counts = stored(asked.groupBy("pair").agg(F.sum("hits").alias("n")), "alignment-counts").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    judged = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    replies = asked.join(judged, "pair").select(F.col("block").alias("asked_by"), "code", "n", "best")
    return held.drop("hits").groupBy("block").cogroup(replies.groupBy("asked_by")).applyInArrow(_settled, ROWS)


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: how many links of the corpus hold the two ids linked."""
    held = blocks(docs, a, b).select(F.explode(F.arrays_zip("pair", "hits")).alias("p"))
    sums = held.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.hits").alias("n"))
    return sums.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")

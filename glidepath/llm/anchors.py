"""Exact repeats across documents by fixed-block anchors: aligned blocks are indexed, every rolling window probes them, hits are extended."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import mixed, partitions, text_groups

WINDOW = 20
#: A window of WINDOW words always holds one whole block that starts at a multiple of BLOCK words.
BLOCK = WINDOW // 2
_BASE = np.uint64(0xD6E8FEB86659FD93)
_words: dict[bytes, int] = {}

#: Runs of one document in a row of entries: its key (id and text hash) and how many of the entries are its own.
ROWS = "bin int, ids binary, keys binary, counts binary, hashes binary, places binary, sure boolean"
_SCHEMA = pa.schema([("bin", pa.int32()), *[(c, pa.binary()) for c in ("ids", "keys", "counts", "hashes", "places")], ("sure", pa.bool_())])
DEALT = "bin int, ids binary, keys binary, counts binary, places binary"
SPOTS = "doc_id long, text_key long, spots binary"


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > 1_000_000:
        _words.clear()
    known = _words
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n entries, by joining runs of half the length."""
    size, roll, done, length = 1, h, None, 0
    power = _BASE
    while n:
        if n & 1:
            if done is None:
                done, length = roll, size
            else:  # done covers `length` entries, roll the `size` entries after them
                m = len(roll) - length
                done = done[:m] * power + roll[length : length + m]
                length += size
        n >>= 1
        if n:
            m = len(roll) - size
            if m <= 0:
                return np.zeros(0, np.uint64)
            roll = roll[:m] * power + roll[size : size + m]
            power = np.uint64(int(power) ** 2 % 2**64)
            size *= 2
    return mixed(done) if len(done) else done


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the len(h) - n + 1 runs of n word hashes; none if there are fewer words."""
    return _rolling(h, n) if len(h) >= n else np.zeros(0, np.uint64)


class _Group:
    """Documents of one slice of texts, long enough to hold a window, as one run of word hashes."""

    def __init__(self, ids: list, keys: list, texts: list[str | None]):
        split = [(t or "").encode().split() for t in texts]
        rows = [i for i, w in enumerate(split) if len(w) >= WINDOW]
        self.rows = np.array(rows, dtype=np.int64)
        self.ids = np.array([_NULL if ids[i] is None else ids[i] for i in rows], dtype=np.int64)
        self.keys = np.array([keys[i] for i in rows], dtype=np.int64)
        self.size = np.array([len(split[i]) for i in rows], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.hashes = _hashes([w for i in rows for w in split[i]])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and place of every run of n words that lies in one document."""
        h = rolling(self.hashes, n)
        doc = np.repeat(np.arange(len(self.size)), self.size)[: len(h)]
        place = (np.arange(len(h)) - self.begin[doc]) if len(h) else np.zeros(0, np.int64)
        inside = place + n <= self.size[doc] if len(h) else np.zeros(0, bool)
        return h[inside], doc[inside], place[inside]

    def row(self, to: int, doc: np.ndarray, place: np.ndarray, hashes: bytes, sure: bool) -> tuple:
        """One row of entries, which must be sorted by document and place."""
        docs, counts = np.unique(doc, return_counts=True)
        steps = np.diff(place, prepend=0)
        steps[np.cumsum(counts) - counts] = place[np.cumsum(counts) - counts]
        return to, self.ids[docs].tobytes(), self.keys[docs].tobytes(), counts.astype("<u4").tobytes(), hashes, packed(steps), sure


_NULL = np.iinfo(np.int64).min


def _bins_of(ids: np.ndarray, keys: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each document, by id and text hash, so that copies of one text spread over all bins."""
    return (mixed(ids.view(np.uint64) ^ mixed(keys.view(np.uint64))) % np.uint64(bins)).astype(np.int64)


def _sure(group: _Group, doc: np.ndarray, place: np.ndarray, bins: int) -> list[tuple]:
    """Entries that need no match, sorted by document and place, dealt by document to where they are gathered."""
    to = _bins_of(group.ids, group.keys, bins)[doc]
    order = np.argsort(to, kind="stable")
    rows = []
    for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        rows.append(group.row(int(to[at[0]]), doc[at], place[at], b"", True))
    return rows


def packed(steps: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: each as often 255 as that goes into it, then the rest."""
    full, rest = np.divmod(steps, 255)
    out = np.full(int(full.sum()) + len(steps), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = rest
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """Sums of the numbers up to each one."""
    values = np.frombuffer(raw, np.uint8)
    return np.cumsum(values.astype(np.int64))[values != 255]


def _places(rows, counts: np.ndarray) -> np.ndarray:
    """Places of all entries from the steps between them, which begin anew with each run."""
    sums = np.concatenate([unpacked(x) for x in rows])
    whole = np.cumsum(np.array([0, *(0 if not x else int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in rows)]))
    sums = sums + np.repeat(whole[:-1], [np.count_nonzero(np.frombuffer(x, np.uint8) != 255) for x in rows])
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, sums[first - 1], 0)
    return sums - np.repeat(base, counts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _by_bin(group: _Group, h: np.ndarray, doc: np.ndarray, place: np.ndarray, bins: int, width: int) -> list[tuple]:
    """Entries dealt by hash: the quotient names the bin's entry in `width` bytes, the remainder the bin."""
    to = (h % np.uint64(bins)).astype(np.int64)
    order = np.argsort(to, kind="stable")  # keeps the entries of a bin sorted by document
    edges = np.searchsorted(to[order], np.arange(bins + 1))
    rest = (h // np.uint64(bins)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    rows = []
    for b in range(bins):
        at = order[edges[b] : edges[b + 1]]
        if len(at):
            rows.append(group.row(b, doc[at], place[at], np.ascontiguousarray(rest[at]).tobytes(), False))
    return rows


def _first(h: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes the entry that comes first by `more` (then by position), and whether each entry is such a one."""
    order = np.lexsort((np.arange(len(h)), *reversed(more), h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = np.zeros(len(h), bool)
    first[order[new]] = True
    return order[new], first


def _probe(bins: int, width: int):
    """All rolling blocks of a slice. Blocks that occur again in the slice are sure hits; of each block one entry goes on to its bin."""
    def run(batches):
        for part, texts in text_groups(batches, limit=8 << 20):
            group = _Group(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), texts)
            h, doc, place = group.windows(BLOCK)
            if not len(h):
                continue
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            aligned, again = place % BLOCK == 0, counts[inverse] > 1
            keep = np.sort(_first(h, ~aligned)[0])  # the aligned one, if there is one, stands for the others
            yield _batch(_by_bin(group, h[keep], doc[keep], place[keep], bins, width) + _sure(group, doc[again], place[again], bins))

    return run


def _unpack(frame: pd.DataFrame, width: int):
    """The entries of a bin: hash remainder, run number, place; and the keys of the runs."""
    ids, keys = (np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("ids", "keys"))
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in frame["counts"]])
    run = np.repeat(np.arange(len(counts)), counts)
    place = _places(frame["places"], counts)
    if width:
        raw = np.frombuffer(b"".join(frame["hashes"]), np.uint8)
        wide = np.zeros((len(run), 8), np.uint8)
        wide[:, :width] = raw.reshape(-1, width)
        return wide.view("<u8").ravel(), run, place, ids, keys
    return None, run, place, ids, keys


def _dealt(run: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray, bins: int) -> pd.DataFrame:
    """Entries dealt by document: one row per bin of documents, so a bin of hashes replies in as many rows as there are bins at most."""
    to = _bins_of(ids, keys, bins)[run]
    order = np.lexsort((place, run, to))
    rows = []
    for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        docs, first, counts = np.unique(run[at], return_index=True, return_counts=True)
        steps = np.diff(place[at], prepend=0)
        steps[first] = place[at][first]
        rows.append((int(to[at[0]]), ids[docs].tobytes(), keys[docs].tobytes(), counts.astype("<u4").tobytes(), packed(steps)))
    return pd.DataFrame(rows, columns=["bin", "ids", "keys", "counts", "places"])


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per document with all its places."""
    _, run, place, ids, keys = _unpack(frame, 0)
    pairs, doc = np.unique(np.stack([ids, keys], axis=1), axis=0, return_inverse=True)
    doc = doc.ravel()[run]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    doc, place = doc[new], place[new]
    edges = np.append(np.searchsorted(doc, np.arange(len(pairs))), len(doc))
    steps = np.diff(place, prepend=0)
    steps[edges[:-1]] = place[edges[:-1]]
    known = pd.array(pairs[:, 0], dtype="Int64")
    known[pairs[:, 0] == _NULL] = pd.NA
    return pd.DataFrame({"doc_id": known, "text_key": pairs[:, 1], "spots": [packed(steps[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]})


def _match(width: int, bins: int):
    """Probes that meet an indexed block of another place."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        open_ = frame[~frame["sure"]]
        out = [frame.loc[frame["sure"], ["bin", "ids", "keys", "counts", "places"]]]  # dealt by document already
        if len(open_):
            h, runs, place, ids, keys = _unpack(open_, width)
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            indexed = np.zeros(len(counts), bool)
            indexed[inverse[place % BLOCK == 0]] = True
            hit = (counts > 1)[inverse] & indexed[inverse]
            out.append(_dealt(runs[hit], place[hit], ids, keys, bins))
        return pd.concat(out)

    return run


def _extend(bins: int):
    """Windows that hold a hit block, at any of its places; of equal windows of a slice all but the earliest are sure repeats."""
    def run(batches):
        for part, texts in text_groups(batches, limit=8 << 20):
            group = _Group(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), texts)
            h, doc, place = group.windows(WINDOW)
            if not len(h):
                continue
            hits = np.zeros(len(group.hashes) + 1, np.int64)
            spots = part.column("spots").to_pylist()
            for d, row in enumerate(group.rows.tolist()):
                at = unpacked(spots[row])
                hits[group.begin[d] + at + 1] = 1
            seen = np.cumsum(hits)
            at = group.begin[doc] + place
            live = seen[at + WINDOW - BLOCK + 1] > seen[at]
            h, doc, place = h[live], doc[live], place[live]
            if not len(h):
                continue
            rank = np.empty(len(group.ids), np.int64)
            rank[np.lexsort((group.keys, group.ids))] = np.arange(len(group.ids))
            same = {}
            for d, k in enumerate(zip(group.ids.tolist(), group.keys.tolist())):
                rank[d] = same.setdefault(k, rank[d])  # repeated rows are one document
            keep, first = _first(h, rank[doc], place)
            order = np.argsort(h[keep])
            keeper = keep[order][np.searchsorted(h[keep][order], h)]
            sure = np.flatnonzero(~first & ~((rank[doc] == rank[doc[keeper]]) & (place == place[keeper])))
            keep = np.sort(keep)
            yield _batch(_sure(group, doc[sure], place[sure], bins) + _by_bin(group, h[keep], doc[keep], place[keep], bins, 8))

    return run


def _repeats(bins: int):
    """Windows that also start earlier: all but the smallest (document, start) of equal windows."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        open_ = frame[~frame["sure"]]
        out = [frame.loc[frame["sure"], ["bin", "ids", "keys", "counts", "places"]]]  # dealt by document already
        if len(open_):
            h, runs, place, ids, keys = _unpack(open_, 8)
            _, rank = np.unique(np.stack([ids, keys], axis=1), axis=0, return_inverse=True)
            rank = rank.ravel()[runs]
            order = np.lexsort((place, rank, h))
            h, r, p = h[order], rank[order], place[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            late = order[(r != r[lead]) | (p != p[lead])]
            out.append(_dealt(runs[late], place[late], ids, keys, bins))
        return pd.concat(out)

    return run


def kept_words(text: str | None, starts: np.ndarray) -> tuple[list[bytes], int]:
    """The words of a text that no window starting at one of `starts` covers, and how many there are in all."""
    words = (text or "").encode().split()
    if not len(starts):
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c], len(words)


RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


def removed_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` (doc_id, text, text_key) and, per document, the starts of its windows that also start earlier."""
    spark = docs.sparkSession
    bins = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    probes = rows.mapInArrow(_probe(bins, 4), ROWS)
    hits = probes.groupBy("bin").applyInPandas(_match(4, bins), DEALT)
    spots = hits.groupBy("bin").applyInPandas(_gathered, SPOTS)
    windows = _with(rows, spots, "inner").mapInArrow(_extend(bins), ROWS)
    late = windows.groupBy("bin").applyInPandas(_repeats(bins), DEALT)
    return rows, late.groupBy("bin").applyInPandas(_gathered, SPOTS)


def _with(rows: DataFrame, spots: DataFrame, how: str) -> DataFrame:
    """Both joins of an operator deal the texts by the same keys, so the second reads the shuffle of the first."""
    same = (F.col("r.text_key") == F.col("s.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))
    return rows.alias("r").join(spots.alias("s"), same, how).select("r.*", "s.spots")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) and the removed stretches of each row of `docs`.

    A word goes if one of the windows of 20 words that cover it also starts earlier: in a document with a smaller doc_id, or earlier in
    its own. Windows are compared on the input, so what one removal leaves does not count.

    A repeat of 20 words contains in its first place a whole aligned block of 10 words, which some rolling block of the second place
    equals: rolling blocks meet the index in bins of their hash, and what they hit says which windows can repeat at all. Only those are
    extended: windows at every offset around a hit are compared in full, so the windows removed make up the maximal exact repeats. Each
    slice of texts hands on one entry per different block or window, so a passage that a third of the documents share costs one entry per
    slice. Blocks are matched by 32 bits beyond the bin, which only lets some windows through in vain; windows by 64 bits and the bin.

    Null texts have no words; null doc_ids count as smallest; rows that repeat an id and a text are one document and come out alike;
    rows that repeat an id only are ordered by a hash of the text. Texts under 20 words lose nothing. An empty table gives no rows.
    """
    rows, late = removed_windows(docs)
    whole = _with(rows, late, "left")

    def run(batches):
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for part, texts in text_groups(batches):
            out = []
            for doc, text, spots in zip(part.column("doc_id").to_pylist(), texts, part.column("spots").to_pylist()):
                starts = unpacked(spots) if spots else np.zeros(0, np.int64)
                words, n = kept_words(text, starts)
                edge = np.flatnonzero(np.diff(starts) > WINDOW) + 1 if len(starts) else []
                runs = [{"start": int(s[0]), "end": int(s[-1]) + WINDOW} for s in np.split(starts, edge)] if len(starts) else []
                out.append((doc, n, n - len(words), b" ".join(words).decode(), runs))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                             names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    return whole.mapInArrow(run, RESULT)


def kept_digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()

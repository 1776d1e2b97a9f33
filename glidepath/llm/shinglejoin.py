"""Near duplicates by the Jaccard similarity of their word shingles: candidates from min-hash bands, each checked on the whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.anchors import rolling
from glidepath.llm.common import mixed, stored, text_groups
from glidepath.llm.components import components

WIDTH, LEAST = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** BAND) ** BANDS: 0.99993 at 0.8.
BANDS, BAND = 24, 5
_MULTIPLY = mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(1001, BANDS * BAND + 1001, dtype=np.uint64))
_LAST = (1 << 63) - 1


def shingles(text: str | None, known: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the different shingles of `width` words (lower-cased ASCII; all words, if they are fewer)."""
    words = text.encode().lower().split() if text else []
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(mixed(rolling(h, min(width, len(h))))) if len(h) else h


def least_values(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of BANDS * BAND permutations of the hashes."""
    least = np.empty(BANDS * BAND, np.uint64)
    step = max(1, (1 << 18) // len(found))
    for at in range(0, len(least), step):
        least[at : at + step] = (found * _MULTIPLY[at : at + step, None] + _ADD[at : at + step, None]).min(axis=1)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the smallest values of BAND permutations."""
    raw = least.reshape(BANDS, BAND)
    keys = [xxhash.xxh64_intdigest(raw[i].tobytes(), seed=i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _mapped(make, fields: list[tuple[str, pa.DataType]]):
    """One row per text, of its keys and what `make` says of its shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *fields])

    def run(batches):
        for part, texts in text_groups(batches):
            known: dict[bytes, int] = {}
            made = list(zip(*[make(shingles(t, known)) for t in texts]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *[pa.array(list(c), f[1]) for c, f in zip(made, fields)]],
                                             schema=schema)

    return run


def _sketch(found: np.ndarray) -> tuple[int, np.ndarray]:
    node = int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))
    return node, band_keys(least_values(found)) if len(found) else np.arange(BANDS, dtype=np.int64)


def _spread(many: DataFrame, few: DataFrame, on: str, unlike: Column | None = None) -> DataFrame:
    """`many` joined with `few`, whatever number of rows of `many` shares a key; `unlike`: a further condition of the join.

    A key with over a thousandth of the rows is dealt over as many parts as it has thousandths; there are a thousand such keys at most.
    """
    most = max(1, many.count() // 1000)
    hot = many.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).filter("_parts > 1")
    hot = F.broadcast(stored(hot, "hot"))
    parts = F.coalesce("_parts", F.lit(1))
    one = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts)).drop("_parts")
    two = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    two = two.select(F.col(on).alias("_on"), F.col("_part").alias("_at"), *[c for c in few.columns if c != on])
    same = (F.col(on) == F.col("_on")) & (F.col("_part") == F.col("_at"))
    return one.join(two, same if unlike is None else same & unlike).drop("_part", "_on", "_at")


def _alike(least: float):
    """Pairs whose sets have a Jaccard similarity of `least` or more."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(sets: list[np.ndarray], sides: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of similarity `least` or more between sets; if there are two sides, of those between the sides.

    Values shared by many sets are columns of a 0-1 matrix and counted by its product with itself, the others pair by pair.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(values)])
    both = np.zeros((n, n), np.float32)
    many = np.flatnonzero(counts * 8 > max(n, 64))
    for at in range(0, len(many), 1024):
        runs = many[at : at + 1024]
        held = np.zeros((n, len(runs)), np.float32)
        for k, run in enumerate(runs):
            held[owner[first[run] : first[run] + counts[run]], k] = 1
        both += held @ held.T
    few = (counts > 1) & (counts * 8 <= max(n, 64))
    start, stay = np.repeat(first[few], counts[few]), np.repeat(counts[few], counts[few])
    at = start + np.arange(len(start)) - np.repeat(np.cumsum(counts[few]) - counts[few], counts[few])
    end = start + stay
    flat, step = both.reshape(-1), 1
    while len(at := at[(keep := at + step < end)]):
        end = end[keep]
        np.add.at(flat, owner[at] * n + owner[at + step], 1)
        np.add.at(flat, owner[at + step] * n + owner[at], 1)
        step += 1
    two, new, a, b = sides.min() != sides.max(), np.ones(n, bool), [], []
    for root in range(n):
        if not new[root]:
            continue
        new[root], waiting = False, [root]
        while waiting:
            i = waiting.pop()
            alike = new & (both[i] > 0) & (both[i] >= least * (sizes[i] + sizes - both[i].astype(np.float64)) - 1e-9)
            found = np.flatnonzero(alike & (sides != sides[i]) if two else alike)
            new[found] = False
            a += [i] * len(found)
            b += found.tolist()
            waiting += found.tolist()
    return a, b


def _tiles_alike(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        a, b = _forest(sets, table.column("tile").to_numpy(), least)
        nodes = table.column("node").to_numpy()
        return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

    return run


def _within_crowds(crowds: DataFrame, sets: DataFrame, least: float, docs: int, size: int) -> DataFrame:
    """Links (a, b) that join what is alike of each crowd: node, crowd. All pairs of a crowd are compared on their whole sets, in pairs of
    tiles of about `docs` sets and `size` values; a pair of tiles is one small group, which passes on a forest of its links."""
    narrow = stored(crowds.join(sets.select("node", "n"), "node"), "crowds")
    parts = narrow.groupBy("crowd").agg(F.greatest(F.ceil(F.count(F.lit(1)) / docs), F.ceil(F.sum("n") / size), F.lit(1)).cast("int").alias("parts"))
    tiled = _spread(narrow, parts, "crowd").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sets.select("node", "set").join(tiled.select("node", "crowd", "tile", "parts"), "node").withColumn("other", other)
    dealt = dealt.select("node", "crowd", "tile", "set", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    return dealt.groupBy("crowd", "low", "high").applyInArrow(_tiles_alike(least), "a long, b long")


#: Buckets of so many nodes are paired row by row, larger ones in tiles of so many sets and values.
FEW, TILE_DOCS, TILE_VALUES = 4, 1024, 1 << 18


def near_duplicates(docs: DataFrame, least: float = LEAST, tile_docs: int = TILE_DOCS) -> DataFrame:
    """doc_id, text_key and group of each row: groups are the connected components of all pairs that share a band and have similarity
    `least` or more.

    Equal sets are one node. Nodes of a band bucket of FEW nodes are paired, and every pair is checked on its whole sets. Nodes that larger
    buckets connect are a crowd, and all its pairs are compared on their whole sets in tiles, whether they share a band or not. A group of n
    texts so makes n rows for each `tile_docs` texts that it has, and n * n comparisons, in groups of bounded size.

    Null and blank texts have no shingles and are one group; texts of fewer words than a shingle are alike if they are equal but for the
    case of A-Z and white space. Null doc_ids count as the largest. Repeated rows are in one group; an empty table gives none.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    run = _mapped(_sketch, [("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
    rows = stored(keyed.mapInArrow(run, "doc_id long, text_key long, node long, bands array<long>"), "sketches")
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text_key")
    nodes = stored(rows.groupBy("node").agg(F.min(place).alias("place"), F.min("bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    members = stored(_spread(members, shared, "key"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("place.doc", "place.text_key", "node")
    texts = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).join(wanted, ["doc", "text_key"]).dropDuplicates(["node"])
    whole = _mapped(lambda s: (s.tobytes(), len(s)), [("set", pa.binary()), ("n", pa.int64())])
    # The node goes through the pass in place of the id.
    sets = stored(texts.select(F.col("node").alias("doc_id"), "text_key", "text").mapInArrow(whole, "doc_id long, text_key long, set binary, n long")
                  .select(F.col("doc_id").alias("node"), "set", "n"), "sets")
    links = members.filter(F.col("n") > FEW).select(F.col("first").alias("a"), F.col("node").alias("b"))
    crowds = stored(components(links).withColumnRenamed("component", "crowd"), "crowds")
    edges = _within_crowds(crowds, sets, least, tile_docs, TILE_VALUES)
    paired = members.filter(F.col("n") <= FEW).select("key", "node").join(crowds, "node", "left")
    other = paired.select("key", F.col("node").alias("a"), F.col("crowd").alias("crowd_a"))
    apart = F.col("crowd").isNull() | F.col("crowd_a").isNull() | (F.col("crowd") != F.col("crowd_a"))
    pairs = paired.withColumnRenamed("key", "_key").join(other, (F.col("_key") == F.col("key")) & (F.col("a") < F.col("node")) & apart)
    pairs = stored(pairs.select("a", F.col("node").alias("b")).distinct(), "pairs")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    found = both.select("a", "b", "set_a", "set_b").mapInArrow(_alike(least), "a long, b long")
    groups = components(edges.unionByName(found)).withColumnRenamed("component", "group")
    return rows.join(groups, "node", "left").select("doc_id", "text_key", F.coalesce("group", "node").alias("group"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs` with one row per group of near duplicates: that with the smallest doc_id (null last), then text hash."""
    rows = near_duplicates(docs, least).withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
    stays = stored(rows.groupBy("group").agg(F.min(F.struct("doc", "text_key")).alias("s")).select("s.doc", "s.text_key").distinct(), "stays")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_key"))
    turn = F.row_number().over(Window.partitionBy("doc", "text_key").orderBy("doc"))
    return keyed.join(stays, ["doc", "text_key"], "left_semi").withColumn("turn", turn).filter("turn = 1").select("row.*")

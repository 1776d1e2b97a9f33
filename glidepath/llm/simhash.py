"""Near duplicates by SimHash: exact comparison of tiles of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.common import partitions, positions, stored, text_groups
from glidepath.llm.components import components

#: Different fingerprints per tile: 64 KB, so a task holds two tiles in cache and few tile pairs are shuffled.
TILE = 8192
QUARTERS = 4
_BITS = np.arange(64, dtype=np.uint64)
_LAST = (1 << 63) - 1


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the hashes of the `width`-word shingles (lower-cased ASCII, repeats included)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (64 bits as a signed long) of each row; one pass, whole texts, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for part, texts in text_groups(batches):
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fps.view(np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges (indices into left + right) that join what links within `radius` bits between the two tiles, or inside `left`.

    Every pair is compared; of the links only a spanning forest is kept, which joins the same rows and is never longer than the tiles.
    """
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    label = np.arange(len(left) + (0 if right is None else len(right)))
    ones, theirs = np.bitwise_count(left).astype(np.int16), np.bitwise_count(other).astype(np.int16)
    order = np.argsort(theirs, kind="stable")
    ranked, counts = other[order], theirs[order]
    lows = np.searchsorted(counts, ones - radius, side="left")
    highs = np.searchsorted(counts, ones + radius, side="right")
    edges = []
    for i in range(len(left)):
        lo, hi = lows[i], highs[i]
        if lo == hi:
            continue
        near = np.flatnonzero(np.bitwise_count(ranked[lo:hi] ^ left[i]) <= radius)
        if not len(near):
            continue
        nodes = order[lo + near] + shift
        labels = label[nodes]
        mine = label[i]
        for other_label in np.unique(labels[labels != mine]).tolist():
            edges.append((i, int(nodes[np.flatnonzero(labels == other_label)[0]])))
            label[label == other_label] = mine
    return edges


def _gap(low: str, high: str) -> Column:
    return F.greatest(F.col(f"b.{low}") - F.col(f"a.{high}"), F.col(f"a.{low}") - F.col(f"b.{high}"), F.lit(0))


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """a, b: edges between fingerprints (column fp, all different) that join all that differ in `radius` bits at most.

    Fingerprints are sorted by their population count, then by those of their quarters, and cut into tiles. The population counts of two
    fingerprints differ by no more than their bits do, in all and summed over the quarters, so tile pairs whose ranges lie further
    apart are skipped; all others are compared exactly. Tile pairs are found by an equi-join on the population count.
    """
    spark = fps.sparkSession
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(QUARTERS)]
    keyed = fps.select("fp", F.bit_count("fp").alias("ones"), *[c.alias(f"q{i}") for i, c in enumerate(quarter)])
    names = ["ones", *[f"q{i}" for i in range(QUARTERS)]]
    ordered, _ = positions(keyed, [*names, "fp"], "fingerprints")
    tiled = ordered.withColumn("tile", F.expr(f"position DIV {tile}L"))
    ranges = [f(F.col(c)).alias(f"{p}_{c}") for c in names for f, p in ((F.min, "lo"), (F.max, "hi"))]
    tiles = stored(tiled.groupBy("tile").agg(F.collect_list("fp").alias("fps"), *ranges), "tiles")
    index = tiles.drop("fps")
    own = index.withColumn("ones", F.explode(F.sequence("lo_ones", "hi_ones")))
    reach = index.withColumn("ones", F.explode(F.sequence(F.col("lo_ones") - radius, F.col("hi_ones") + radius)))
    quarters = sum((_gap(f"lo_q{i}", f"hi_q{i}") for i in range(QUARTERS)), F.lit(0))
    pairs = own.alias("a").join(reach.alias("b"), (F.col("a.ones") == F.col("b.ones")) & (F.col("a.tile") <= F.col("b.tile")) & (quarters <= radius))
    pairs = pairs.select(F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b")).distinct()
    one = tiles.select(F.col("tile").alias("tile_a"), F.col("fps").alias("left"))
    two = tiles.select(F.col("tile").alias("tile_b"), F.col("fps").alias("right"))
    work = pairs.join(one, "tile_a").join(two, "tile_b").repartition(4 * partitions(spark), "tile_a", "tile_b")

    def run(frames):
        for frame in frames:
            for a, b, x, y in frame[["tile_a", "tile_b", "left", "right"]].itertuples(index=False):
                left, right = np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(y, dtype=np.int64).view(np.uint64)
                both = left if a == b else np.concatenate([left, right])
                found = forest(left, None if a == b else right, radius)
                signed = both.view(np.int64)
                if found:
                    yield pd.DataFrame({"a": signed[[e[0] for e in found]], "b": signed[[e[1] for e in found]]})

    return work.select("tile_a", "tile_b", "left", "right").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, text_key, fp, component_id and group of each row. group names the component; component_id is the smallest doc_id that links of `radius` bits at most reach from it, itself included.

    Equal fingerprints are one node from the start, so exact copies cost one comparison whatever their number. Texts without words have
    fingerprint zero and link like others. A null text counts as empty; null doc_ids take part but are no component's name unless it
    has no other (then it is null); repeated rows come out repeated; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width), "rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("fp"), radius, tile)
    groups = components(edges)
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(names, "component").select("fp", "component_id", F.col("component").alias("group")), "fp") \
        .select("doc_id", "text_key", "fp", "component_id", "group")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """The rows of `docs` with one row per group of near duplicates: that with the smallest doc_id (null last), then text hash.

    The groups are worked out on narrow rows; the texts are shuffled once, to meet the keys of those that stay.
    """
    rows = near_duplicates(docs, width, radius, tile).withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
    stays = stored(rows.groupBy("group").agg(F.min(F.struct("doc", "text_key")).alias("s")).select("s.doc", "s.text_key").distinct(), "stays")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_key"))
    turn = F.row_number().over(Window.partitionBy("doc", "text_key").orderBy("doc"))
    return keyed.join(stays, ["doc", "text_key"], "left_semi").withColumn("turn", turn).filter("turn = 1").select("row.*")

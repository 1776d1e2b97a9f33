"""Shards cut from a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.llm.common import positions


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of `cells` (points x dimensions, values below 2**bits).

    By the transposed form of Skilling (2004): undo the excess rotations from the highest bit down, Gray-encode, interleave the bits.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def _scale(df: DataFrame, column: str) -> Column:
    """A number that orders like the column: numbers as they are, texts by their first six bytes. Null comes first."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    head = F.conv(F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.coalesce(head, F.lit(-1.0))


def hilbert_order(df: DataFrame, dimensions: list[str], bits: int = 5) -> DataFrame:
    """`df` with `hilbert_index`: each dimension cut into 2**bits cells at quantiles of all rows, cells numbered along the curve.

    Cells keep the order of the values, so the values of a run of the curve have narrow bounds in every dimension and readers can skip
    files by them. The quantiles come from one aggregate with sketches of fixed size; equal values always share a cell.
    """
    if bits * len(dimensions) > 62:
        raise ValueError("bits * dimensions must not exceed 62")
    scaled = df.withColumns({f"_d{i}": _scale(df, d) for i, d in enumerate(dimensions)})
    marks = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = scaled.agg(*[F.percentile_approx(f"_d{i}", marks, 10_000).alias(f"_d{i}") for i in range(len(dimensions))]).first()
    bounds = [np.array(row[f"_d{i}"] or [], dtype=float) for i in range(len(dimensions))]

    @F.pandas_udf("long")
    def index(*values: pd.Series) -> pd.Series:
        cells = np.stack([np.searchsorted(b, v.to_numpy(), side="left") for b, v in zip(bounds, values)], axis=1)
        return pd.Series(curve_index(cells, bits))

    return scaled.withColumn("hilbert_index", index(*[f"_d{i}" for i in range(len(dimensions))])).drop(*[f"_d{i}" for i in range(len(dimensions))])


def cut_runs(df: DataFrame, shards: int, ties: list[str]) -> DataFrame:
    """`df` (with `hilbert_index`) with `shard` and `slot`: `shards` runs of the curve whose row counts differ by one at most.

    Rows at one point of the curve are ordered by `ties`. A run is contiguous, so the shard with the most rows of a value may well be
    all of one value, which is what pruning wants.
    """
    placed, total = positions(df, ["hilbert_index", *ties], "hilbert")
    # Shard s begins at the first position p with p * shards >= s * total; whole numbers only, so no rounding.
    shard = F.expr(f"CAST((position * {shards}L) DIV {max(total, 1)}L AS INT)")
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) DIV {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - begin).drop("position")


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 5) -> DataFrame:
    """Puts all rows of `docs` into `shards` shards along a Hilbert curve; one row each with doc_id, size, text_crc32, shard and slot.

    Law: rows. Only these narrow columns are shuffled; text is reduced to size and checksum where it is read. Null texts have size 1 and
    the checksum of no bytes, null dimensions the first cell, repeated rows a slot each. An empty table gives no rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
                         *[F.col(f"`{d}`").alias(f"dim_{d}") for d in dimensions])
    ordered = hilbert_order(narrow, [f"dim_{d}" for d in dimensions], bits)
    return cut_runs(ordered, shards, ["doc_id", "text_crc32", "size"])

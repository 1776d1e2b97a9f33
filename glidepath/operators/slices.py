"""Time slices: the unit in which a hot key is split over tasks.

Every operator that needs neighbours in time works per (key, slice) instead of per key. After
de-duplication a key has at most one row per timestamp, so a (key, slice) pair is bounded by
the slice length, however many rows the key holds in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_S = 6 * 3600


def slice_of(ts, slice_s: int = SLICE_S) -> Column:
    """Number of the slice a timestamp lies in."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts) / F.lit(slice_s)).cast("bigint")


def with_halo(df: DataFrame, ts: str, slice_s: int, halo_s: int) -> DataFrame:
    """Adds `_slice` and `_halo`: the last `halo_s` seconds of a slice are repeated in the next
    one with `_halo` true, so that a slice sees its predecessors without a wider partition."""
    if slice_s < halo_s:
        raise ValueError(f"slice of {slice_s} s is shorter than its halo of {halo_s} s")
    own = slice_of(ts, slice_s)
    in_tail = F.unix_seconds(F.col(ts)) + F.lit(halo_s) >= (own + 1) * F.lit(slice_s)
    targets = F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_slice", F.explode(targets)).withColumn(
        "_halo", F.col("_slice") != F.col("_own")).drop("_own")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, lo: str, hi: str,
                  slice_s: int = SLICE_S, how: str = "inner") -> DataFrame:
    """Rows of `points` with `lo <= ts <= hi` of an interval with equal keys.

    The intervals are repeated once per slice they touch and the join key is (keys, slice): an
    equi-join whose hot keys are spread over their slices, with every pair found exactly once.
    `how="left"` keeps points without an interval.
    """
    first, last = slice_of(lo, slice_s), slice_of(hi, slice_s)
    right = (intervals.where(F.col(lo) <= F.col(hi))
             .withColumn("_slice", F.explode(F.sequence(first, last))))
    left = points.withColumn("_slice", slice_of(ts, slice_s)).alias("l")
    right = right.alias("r")
    cond = (F.col("l._slice") == F.col("r._slice")) & (F.col(f"l.{ts}") >= F.col(f"r.{lo}")) & (
        F.col(f"l.{ts}") <= F.col(f"r.{hi}"))
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    right_cols = [F.col(f"r.{c}") for c in intervals.columns if c not in keys]
    return left.join(right, cond, how).select(*[F.col(f"l.{c}") for c in points.columns], *right_cols)


def salted_left_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Left join to a small table on keys that may be hot.

    The lookup is repeated once per salt and each row takes the salt of its `spread_by` value,
    so one key's rows are shared by `salts` tasks. No row is broadcast unmeasured.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def two_level(df: DataFrame, keys: list[str], labels: list[str], sums: dict[str, Column] | None = None,
              mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None,
              words: dict[str, Column] | None = None) -> DataFrame:
    """Groups by `keys`, with the smallest value of each label, the largest of each text in
    `words`, and decomposable measures.

    Minima and maxima of text would force a sort-based aggregate over all rows; grouping by the
    texts first keeps the large pass a hash aggregate with map-side combine, and the second pass
    sees about one row per group.
    """
    words = words or {}
    parts = [(n, e, F.sum) for n, e in (sums or {}).items()]
    parts += [(n, e, F.min) for n, e in (mins or {}).items()]
    parts += [(n, e, F.max) for n, e in (maxs or {}).items()]
    fine = df.groupBy(*keys, *labels, *[e.alias(n) for n, e in words.items()]).agg(*[f(e).alias(n) for n, e, f in parts])
    return fine.groupBy(*keys).agg(
        *[F.min(label).alias(label) for label in labels], *[F.max(n).alias(n) for n in words],
        *[f(F.col(n)).alias(n) for n, _, f in parts])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, ahead_s: int = 0,
              slice_s: int = SLICE_S) -> DataFrame:
    """Each left row with the newest right row of equal keys at or before `left_ts + ahead_s`.

    Both sides are merged per (keys, slice); a slice without an earlier right row takes the last
    one of the slices before it, from a table with one row per (keys, slice). Right rows of one
    key and time must be unique. Right columns are null where nothing is early enough.
    """
    values = [c for c in right.columns if c not in keys]
    at = F.unix_micros(F.col(left_ts)) + F.lit(ahead_s * 1_000_000)
    payload = F.struct(*values)
    empty = F.lit(None).cast(right.select(payload.alias("_v")).schema["_v"].dataType)
    none = F.lit(None).cast(left.select(F.struct(*left.columns).alias("_l")).schema["_l"].dataType)
    l_rows = left.select(*keys, at.alias("_us"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_l"), empty.alias("_v"))
    r_rows = right.select(*keys, F.unix_micros(F.col(right_ts)).alias("_us"), F.lit(0).alias("_left"), none.alias("_l"),
                          payload.alias("_v"))
    number = F.floor(F.col("_us") / F.lit(slice_s * 1_000_000)).cast("bigint")
    merged = l_rows.unionByName(r_rows).withColumn("_slice", number)
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_us", "_left").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = (right.withColumn("_us", F.unix_micros(F.col(right_ts))).withColumn("_slice", number)
            .groupBy(*keys, "_slice").agg(F.max_by(payload, "_us").alias("_end")))
    present = left.select(*keys, at.alias("_us")).withColumn("_slice", number).select(*keys, "_slice").distinct()
    by_key = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (present.join(ends, [*keys, "_slice"], "full").withColumn("_carry", F.last("_end", True).over(by_key))
             .select(*keys, "_slice", "_carry"))
    found = (merged.withColumn("_found", F.last("_v", True).over(in_slice)).where(F.col("_left") == 1)
             .join(carry, [*keys, "_slice"], "left"))
    best = F.coalesce("_found", "_carry")
    return found.select("_l.*", *[best[c].alias(c) for c in values])

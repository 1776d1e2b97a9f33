"""Profiles and drift from stored sketches: one scan per day of data, any range of days afterwards from a few rows.

A day keeps, for every field, its counts, extremes, a KLL sketch of a number's distribution and a HyperLogLog sketch of an
identifier's distinct values. Both kinds merge, so a range of days is an aggregate over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidepath.functions.numbers import share_pct
from glidepath.operators.health import severity
from glidepath.sources.catalog import Catalog

#: Parameters of the sketches, with the errors they stand for: ranks are off by RANK_ERROR of the rows at most (99 % of the time),
#: distinct counts by DISTINCT_ERROR (three standard errors of 2^14 registers).
KLL_K, RANK_ERROR = 1000, 0.004
HLL_BITS, DISTINCT_ERROR = 14, 0.025
#: Quantiles that stand for a distribution where two are compared.
GRID = 500


def day_sketches(df: DataFrame, time_col: str, numbers: list[str], ids: list[str]) -> DataFrame:
    """dt, field, n_rows, n, lo, hi, quantiles, distinct: one row per day and field, by one aggregate over the rows.

    Null and NaN values count as missing. Partial sketches merge before the shuffle, so a day with most rows is no hot group.
    """
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("binary")
    for i, name in enumerate(numbers):
        v = F.nanvl(F.col(name).cast("double"), none)
        aggs += [F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(f"_q{i}")]
        rows.append(F.struct(F.lit(name).alias("field"), F.col(f"_n{i}").alias("n"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"),
                             F.when(F.col(f"_n{i}") > 0, F.col(f"_q{i}")).alias("quantiles"), blank.alias("distinct")))
    for i, name in enumerate(ids):
        v = F.col(name).cast("string")
        aggs += [F.count(v).alias(f"_m{i}"), F.hll_sketch_agg(v, F.lit(HLL_BITS)).alias(f"_d{i}")]
        rows.append(F.struct(F.lit(name).alias("field"), F.col(f"_m{i}").alias("n"), none.alias("lo"), none.alias("hi"), blank.alias("quantiles"),
                             F.col(f"_d{i}").alias("distinct")))
    return df.groupBy(F.to_date(time_col).alias("dt")).agg(*aggs).select("dt", F.col("_rows").alias("n_rows"), F.inline(F.array(*rows)))


def keep_sketches(cat: Catalog, name: str, df: DataFrame, time_col: str, numbers: list[str], ids: list[str]) -> None:
    """Writes the sketches of the days that `df` has, in place of what the table held of those days; other days stay unread."""
    made = day_sketches(df, time_col, numbers, ids)
    made.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(cat.path(name))


def over_days(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """The fields' sketches merged over the days from `first` to `last`."""
    days = sketches.where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.groupBy("field").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def coverage(merged: DataFrame) -> DataFrame:
    """Coverage, extremes, median and distinct values of each field."""
    known = (F.col("n") > 0) & F.col("lo").isNotNull()
    return merged.select(
        F.col("field").alias("field_name"), F.col("n").alias("non_null_count"), share_pct(F.col("n"), F.col("n_rows")).alias("non_null_pct"),
        F.col("lo").alias("min_val"), F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median_val"), F.col("hi").alias("max_val"),
        F.when(F.col("lo").isNull() & F.col("distinct").isNotNull(), F.hll_sketch_estimate("distinct")).alias("distinct_values"))


def _grid(sketch: str) -> Column:
    """GRID evenly spaced quantiles of a sketch: the share of values below an edge is the share of these."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))


def drift(reference: DataFrame, comparison: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per number, from merged sketches alone: reference quantiles as edges, shares from both sketches' ranks.

    As `health.psi`: outer bins are open, repeated edges collapse, an empty bin counts as 1e-6, a constant reference gives 0.
    """
    both = reference.where("lo IS NOT NULL").select("field", F.col("quantiles").alias("q"), F.col("n").alias("ref_rows"), "lo", "hi").join(
        comparison.where("lo IS NOT NULL").select("field", F.col("quantiles").alias("p"), F.col("n").alias("comp_rows")), "field")
    inner = F.array(*[F.kll_sketch_get_quantile_double("q", F.lit(i / bins)) for i in range(1, bins)])
    edges = F.filter(F.array_distinct(inner), lambda e: (e > F.col("lo")) & (e <= F.col("hi")))
    cut = both.withColumns({"_edges": edges, "_q": _grid("q"), "_p": _grid("p")}).withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_edges"))))

    def share(grid: str) -> Column:
        def below(i: Column) -> Column:
            return F.size(F.filter(grid, lambda v: v < F.get("_edges", i))) / GRID
        upper = F.when(F.col("_at") == F.size("_edges"), 1.0).otherwise(below(F.col("_at")))
        return upper - F.when(F.col("_at") == 0, 0.0).otherwise(below(F.col("_at") - 1))

    r, c = (F.greatest(share(s), F.lit(1e-6)) for s in ("_q", "_p"))
    value = F.sum((c - r) * F.ln(c / r))
    return cut.groupBy(F.col("field").alias("feature"), "ref_rows", "comp_rows").agg(value.alias("psi")).withColumn("severity", severity(F.col("psi")))

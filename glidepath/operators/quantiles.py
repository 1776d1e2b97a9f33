"""Exact interpolated quantiles without holding a group's values in one task."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glidepath.sources.catalog import stored


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 100_000,
                    few_groups: bool = False, at_index: bool = False) -> DataFrame:
    """`keys, n, q` where `q` is the array of linearly interpolated quantiles of `value` at `probs`.

    A first pass brackets each quantile with an approximate one, whose rank error is known. The
    second pass counts what lies below each bracket and ranks only the distinct values inside it,
    about 4 / `accuracy` of a group. Null and NaN values are ignored; a group without any other
    value is absent. `few_groups` says that the keys come from a short fixed list, such as the
    model's features; only then is the one-row-per-group table broadcast. `at_index` takes the
    element at index int(p * n) of the sorted values instead of interpolating.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    eps = 2.0 / accuracy
    marks = [max(p - eps, 0.0) for p in probs] + [min(p + eps, 1.0) for p in probs]
    m = len(probs)
    # written: both passes over the values read it
    brackets = stored(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", marks, accuracy).alias("_marks")), "brackets")
    if not keys:
        held = rows.crossJoin(F.broadcast(brackets))  # a single row
    else:
        held = rows.join(F.broadcast(brackets) if few_groups else brackets, keys)
    v = F.col("_v")
    sums = []
    for i in range(m):
        lo, hi = F.get("_marks", F.lit(i)), F.get("_marks", F.lit(i + m))
        sums += [F.count_if(v < lo).alias(f"_below{i}"), F.max(F.when(v < lo, v)).alias(f"_prev{i}"), F.min(F.when(v > hi, v)).alias(f"_next{i}")]
    # one hash aggregate over the values as they are; without keys an empty input still gives a row, which goes
    wide = held.groupBy(*keys).agg(F.max("n").alias("n"), *sums).where(F.col("n").isNotNull())
    around = wide.select(*keys, "n", F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), *[F.col(f"{c}{i}").alias(c) for c in ("_below", "_prev", "_next")]) for i in range(m)])))
    inside = F.filter(F.array(*[F.lit(i) for i in range(m)]), lambda i: (v >= F.get("_marks", i)) & (v <= F.get("_marks", i + m)))
    # few values lie in any bracket, and plain comparisons tell so faster than the filter of the list
    near = reduce(or_, [(v >= F.get("_marks", F.lit(i))) & (v <= F.get("_marks", F.lit(i + m))) for i in range(m)])
    ranked = (
        held.where(near).select(*keys, "_v", F.explode(inside).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    last = (F.col("n") - 1).cast("double")
    at = F.least(F.floor(prob * F.col("n")).cast("double"), last) if at_index else prob * last
    per_prob = (around.withColumn("_pos", at)
                .withColumns({"_k0": F.floor("_pos") - F.col("_below"), "_k1": F.ceil("_pos") - F.col("_below")}))
    joined = per_prob.join(ranked, [*keys, "_i"], "left")
    first_upto = F.col("_upto") - F.col("_c")

    def pick(k: str):
        within = F.max(F.when((F.col(k) >= first_upto) & (F.col(k) < F.col("_upto")), F.col("_v")))
        outside = F.max(F.when(F.col(k) < 0, F.col("_prev")).otherwise(F.col("_next")))
        return F.coalesce(within, outside)

    one = joined.groupBy(*keys, "_i").agg(F.max("n").alias("n"), F.max("_pos").alias("_pos"), pick("_k0").alias("_a"),
                                          pick("_k1").alias("_b"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return (one.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", value_at.alias("q")))).alias("_q"))
            .select(*keys, "n", F.col("_q.q").alias("q")))

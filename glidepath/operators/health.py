"""Drift, model health and volume checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.constants import PSI_MODERATE, PSI_SIGNIFICANT
from glidepath.operators.quantiles import exact_quantiles

HEALTH_COLUMNS = ["checked_at", "check_type", "metric_name", "value", "severity", "detail"]


def severity(value: Column) -> Column:
    return (F.when(value.isNull() | F.isnan(value), "unknown").when(value < PSI_MODERATE, "none")
            .when(value < PSI_SIGNIFICANT, "moderate").otherwise("significant"))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))


def psi(reference: DataFrame, comparison: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index per column, over the reference's quantile bins.

    The outer bins are open, repeated edges collapse, an empty bin counts as 1e-6. A constant
    reference gives 0; a column without values on either side gives null.
    """
    ref, comp = _long(reference, columns), _long(comparison, columns)
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(ref, ["feature"], "v", probs, few_groups=True).select(
        "feature", F.array_distinct("q").alias("_edges"))
    # an edge for each column named by the caller, so the table is as short as that list
    both = ref.withColumn("_r", F.lit(1)).unionByName(comp.withColumn("_r", F.lit(0))).join(F.broadcast(edges), "feature", "left")
    # the inner edges, of which there are `bins` - 1 at most, compared one by one
    upto = [F.when((F.size("_edges") > i + 1) & (F.get("_edges", F.lit(i)) <= F.col("v")), 1).otherwise(0) for i in range(1, bins)]
    counted = both.withColumns({"_bin": sum(upto, F.lit(0)), "_spread": F.size("_edges") >= 2})
    per_bin = counted.groupBy("feature", "_bin").agg(
        F.sum("_r").alias("_ref"), F.sum(1 - F.col("_r")).alias("_comp"), F.bool_and("_spread").alias("_spread"))
    of_feature = Window.partitionBy("feature")  # a row per bin
    joined = per_bin.withColumns({"ref_rows": F.sum("_ref").over(of_feature), "comp_rows": F.sum("_comp").over(of_feature)})
    r = F.greatest(F.try_divide(F.col("_ref"), F.col("ref_rows")), F.lit(1e-6))
    c = F.greatest(F.try_divide(F.col("_comp"), F.col("comp_rows")), F.lit(1e-6))
    scored = joined.groupBy("feature").agg(
        F.max("ref_rows").alias("ref_rows"), F.max("comp_rows").alias("comp_rows"),
        F.sum((c - r) * F.ln(c / r)).alias("_psi"), F.bool_and("_spread").alias("_spread"))
    known = (F.col("ref_rows") > 0) & (F.col("comp_rows") > 0)
    value = F.when(known, F.when(F.col("_spread"), F.col("_psi")).otherwise(0.0))
    names = F.broadcast(scored)
    wanted = reference.sparkSession.createDataFrame([(x,) for x in columns], "feature string")
    return wanted.join(names, "feature", "left").select(
        "feature", F.coalesce("ref_rows", F.lit(0)).alias("ref_rows"), F.coalesce("comp_rows", F.lit(0)).alias("comp_rows"),
        value.alias("psi"), severity(value).alias("severity"))


def drift_rows(drift: DataFrame, now: Column, min_rows: int = 200) -> DataFrame:
    """Health rows of a drift table; columns with too few values on a side are left out."""
    return drift.where((F.col("ref_rows") >= min_rows) & (F.col("comp_rows") >= min_rows)).select(
        now.alias("checked_at"), F.lit("feature_drift").alias("check_type"), F.col("feature").alias("metric_name"),
        F.col("psi").alias("value"), "severity",
        F.format_string("PSI %.3f (%d ref rows, %d live rows)", "psi", "ref_rows", "comp_rows").alias("detail"))


def performance_row(errors: DataFrame, registered_mae: float, now: Column, min_n: int = 20, max_pct: float = 20.0) -> DataFrame:
    """Rolling MAE against the registered one; no row below `min_n` errors."""
    worse = 100 * (F.col("value") - registered_mae) / registered_mae
    return (
        errors.agg(F.count("error_min").alias("_n"), F.avg(F.abs("error_min")).alias("value")).where(F.col("_n") >= min_n)
        .select(now.alias("checked_at"), F.lit("performance").alias("check_type"), F.lit("rolling_mae_min").alias("metric_name"),
                "value", F.when(worse > max_pct, "significant").otherwise("none").alias("severity"),
                F.format_string(f"rolling MAE %.3f vs registered {registered_mae:.3f} (%+.1f%%, n=%d)", "value", worse, "_n").alias("detail")))


def freshness_row(df: DataFrame, now: Column, stale_hours: float = 24.0) -> DataFrame:
    """Hours since the newest report."""
    hours = (F.unix_micros(now) - F.unix_micros("_latest")) / 3.6e9
    return (
        df.agg(F.max("snapshot_ts").alias("_latest")).where(F.col("_latest").isNotNull()).withColumn("value", hours)
        .select(now.alias("checked_at"), F.lit("freshness").alias("check_type"), F.lit("hours_since_last_report").alias("metric_name"),
                "value", F.when(F.col("value") > stale_hours, "significant").otherwise("none").alias("severity"),
                F.format_string(f"latest report %.1fh ago (threshold {stale_hours:g}h)", "value").alias("detail")))


def volume_row(df: DataFrame, now: Column, days: int = 7, min_days: int = 3, low_share: float = 0.2) -> DataFrame:
    """Today's reports against the median of the days before; no row with too few days."""
    today = F.to_date(now)
    ago = F.datediff(today, F.col("_d"))
    recent = df.where((F.col("snapshot_ts") >= F.date_sub(today, days).cast("timestamp")) & (F.col("snapshot_ts") < F.date_add(today, 1).cast("timestamp")))
    per_day = recent.groupBy(F.to_date("snapshot_ts").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    one = per_day.agg(
        F.coalesce(F.sum(F.when(ago == 0, F.col("_n"))), F.lit(0)).alias("_today"),
        F.count_if(ago.between(1, days)).alias("_days"), F.median(F.when(ago.between(1, days), F.col("_n"))).alias("_median"))
    low = (F.col("_median") > 0) & (F.col("_today") < low_share * F.col("_median"))
    return one.where(F.col("_days") >= min_days).select(
        now.alias("checked_at"), F.lit("volume").alias("check_type"), F.lit("reports_today").alias("metric_name"),
        F.col("_today").cast("double").alias("value"), F.when(low, "significant").otherwise("none").alias("severity"),
        F.format_string(f"%d reports today vs {days}-day median %.0f", "_today", "_median").alias("detail"))


def health(*rows: DataFrame) -> DataFrame:
    """All health rows in one table."""
    out = rows[0].select(HEALTH_COLUMNS)
    for r in rows[1:]:
        out = out.unionByName(r.select(HEALTH_COLUMNS))
    return out

"""What holds of trained models whatever they learn, with SQL twins: splits, counts, bounds and consistency of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.operators import features, learn
from glidepath.session import fresh_path
from glidepath.sources.catalog import Catalog, stored
from glidepath.workbench import models  # noqa: F401
from glidepath.workbench.ingest import fitted, learning_rows
from glidepath.workbench.registry import SQL, flat, query
from glidepath.workbench.sqlparts import with_parts

# The fixture spans three hours, of which the last is the test day and the one before it the validation.
_TEST = "(ts//3600)%24=2"
_BANDS = f"SELECT band, count(*) AS n FROM (SELECT band FROM trn WHERE {_TEST} AND band IS NOT NULL UNION ALL SELECT 'ALL' FROM trn WHERE {_TEST}) b GROUP BY 1"


@query("m04_split_parts", with_parts(f"""
SELECT CASE WHEN {_TEST} THEN 'test' WHEN (ts//3600)%24=1 THEN 'val' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT seg_id) AS segments FROM trn GROUP BY 1"""))
def split_parts(spark, sf):
    return flat(learning_rows(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seg_id").alias("segments")))


@query("m05_holdout_counts", with_parts(f"SELECT band, n, 1 AS errors_in_bounds FROM ({_BANDS}) q"))
def holdout_counts(spark, sf):
    """Every test row is in the report once and once under ALL; no error is negative or beyond its 90th percentile's reach."""
    model, rows = fitted(spark, sf)
    report, _ = learn.holdout_report(model, rows.where("part = 'test'"))
    return flat(report.select("band", "n", ((F.col("MAE_min") >= 0) & (F.col("MAE_min") <= 40) & (F.abs("bias_min") <= F.col("MAE_min") + 0.01)).alias("errors_in_bounds")))


@query("m06_importance_sums", "SELECT CAST(18 AS BIGINT) AS features, 1 AS add_up_to_one, CAST(0 AS BIGINT) AS negative")
def importance_sums(spark, sf):
    model, rows = fitted(spark, sf)
    return flat(learn.importances(model, rows).agg(
        F.count_distinct("feature").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("add_up_to_one"), F.count_if(F.col("importance") < 0).alias("negative")))


@query("m08_scored_consistency", f"""
SELECT count(*) AS n, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS arrivals_off FROM ({SQL['p17_scoring_rows']}) q""")
def scored_consistency(spark, sf):
    """One prediction per scoring row, none negative, and each arrival as far from its report as the prediction says."""
    model, _ = fitted(spark, sf)
    rows = learn.score_batch(model, features.scoring_rows(td.tracks(spark, sf), td.inbound(spark, sf)), 1, F.timestamp_seconds(F.lit(td.EPOCH)))
    off = F.abs((F.unix_micros("predicted_touchdown_ts") - F.unix_micros("snapshot_ts")) / 6e7 - F.col("predicted_eta_min")) > 1e-6
    return flat(rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_eta_min") < 0).alias("negative"), F.count_if(off).alias("arrivals_off")))


@query("m10_refit_on_versions", with_parts(f"SELECT v.trained_on, q.band, q.n FROM ({_BANDS}) q CROSS JOIN (SELECT unnest(['old','new']) AS trained_on) v"))
def refit(spark, sf):
    """Models fitted on two numbered loads of the training table, both reported on the test part."""
    rows, cat = learning_rows(spark, sf), Catalog(spark, fresh_path(spark, "versions"))
    cat.append_load("training", rows.where("pmod(xxhash64(seg_id), 2) = 0"), 1)
    cat.append_load("training", rows, 2)
    test = stored(rows.where("part = 'test'"), "test")
    report = learn.compare_versions(cat.read_load("training", 1), cat.read_load("training", 2), test, n_params=1, max_trees=5)
    return flat(report.select("trained_on", "band", "n"))

"""Feature, training-set, gate and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.constants import ETA_FEATURES, HEAVY_TYPES
from glidepath.operators import events, features, gate, health, traffic
from glidepath.plans import sqlfunctions
from glidepath.sources.catalog import stored
from glidepath.workbench.registry import SQL, flat, query
from glidepath.workbench.sqlparts import part, with_parts

_CYC = """sin(hour_utc/24e0*2*pi()) AS hour_sin, cos(hour_utc/24e0*2*pi()) AS hour_cos, sin((dow-1)/7e0*2*pi()) AS dow_sin, cos((dow-1)/7e0*2*pi()) AS dow_cos"""
part("ftr", f"""
SELECT *, sin(radians(bearing_to_apt)) AS bearing_sin, cos(radians(bearing_to_apt)) AS bearing_cos, gs_kt*cos(radians(heading_err_deg)) AS closure_geom_kt,
 {_CYC}, CASE WHEN ac_type IN ({", ".join(f"'{t}'" for t in HEAVY_TYPES)}) THEN 1 ELSE 0 END AS is_heavy FROM trn
""")
NUM = features.NUMERIC_FEATURES


@query("m01_eta_features", with_parts("SELECT seg_id, ts AS snapshot_ts, phase, " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c in ("alt_ft", "sel_altitude_ft", "airport_inbound_count", "is_heavy") else f"round({c},6) AS {c}" for c in NUM) + " FROM ftr"))
def eta_features(spark, sf):
    return flat(td.training(spark, sf).select("seg_id", "snapshot_ts", *ETA_FEATURES))


@query("m02_arrival_training_set", with_parts("""
SELECT seg_id, icao, ts AS snapshot_ts, td_ts AS touchdown_ts, round(minutes_to_touchdown,6) AS minutes_to_touchdown, round(dist_to_apt_nm,6) AS dist_to_apt_nm,
 hour_utc, dow, airport_inbound_count FROM arr"""))
def arrivals(spark, sf):
    return flat(td.arrivals(spark, sf).select("seg_id", "icao", "snapshot_ts", "touchdown_ts", "minutes_to_touchdown", "dist_to_apt_nm",
                                              "hour_utc", "dow", "airport_inbound_count"))


@query("m03_baseline", with_parts("SELECT seg_id, ts AS snapshot_ts, round(minutes_to_touchdown,6) AS minutes_to_touchdown, round(baseline_pred,6) AS baseline_pred FROM trn"))
def baseline(spark, sf):
    return flat(td.training(spark, sf).select("seg_id", "snapshot_ts", "minutes_to_touchdown", "baseline_pred"))


_BAND = """SELECT band, count(*) AS n, round(avg(abs(e)),2) AS MAE_min, round(quantile_cont(abs(e),0.9),2) AS P90_min, round(avg(e),2) AS bias_min
FROM (SELECT band, {p}-minutes_to_touchdown AS e FROM trn WHERE band IS NOT NULL UNION ALL SELECT 'ALL', {p}-minutes_to_touchdown FROM trn) q GROUP BY 1"""
part("bands_old", _BAND.format(p="baseline_pred"))
part("bands_new", _BAND.format(p="0.9*baseline_pred"))


@query("a11_band_report", with_parts("SELECT * FROM bands_old"))
def bands(spark, sf):
    return flat(features.band_report(stored(td.training(spark, sf), "training"), "baseline_pred"))


@query("a13_overall_accuracy", with_parts("""
SELECT round(m,6) AS mae, round(r,6) AS rmse, round(b,6) AS baseline_mae, round((b-m)/nullif(b,0)*100,1) AS improvement_pct FROM (
 SELECT avg(abs(0.9*baseline_pred-minutes_to_touchdown)) AS m, sqrt(avg(pow(0.9*baseline_pred-minutes_to_touchdown,2))) AS r,
 avg(abs(baseline_pred-minutes_to_touchdown)) AS b FROM trn) q"""))
def accuracy(spark, sf):
    rows = td.training(spark, sf).withColumn("pred", F.col("baseline_pred") * 0.9)
    return flat(features.overall_accuracy(rows, "pred", "baseline_pred"))


@query("p17_scoring_rows", with_parts("""
SELECT icao, ts AS snapshot_ts, round(dist_to_apt_nm,6) AS dist_to_apt_nm, airport_inbound_count FROM (
 SELECT t.*, coalesce(c.n_inbound_common,0) AS airport_inbound_count, row_number() OVER (PARTITION BY t.icao ORDER BY t.ts DESC) AS rn FROM trk t
 LEFT JOIN inb c ON c.minute_ts=(t.ts//60)*60 WHERE t.ts>=(SELECT max(ts) FROM trk)-1200) q
WHERE rn=1 AND inbound_flag AND NOT is_grounded AND dist_to_apt_nm<=120 AND gs_kt>40"""))
def scoring(spark, sf):
    return flat(features.scoring_rows(td.tracks(spark, sf), td.inbound(spark, sf)).select(
        "icao", "snapshot_ts", "dist_to_apt_nm", "airport_inbound_count"))


@query("m11_scaler", with_parts(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(coalesce(avg(CAST({c} AS DOUBLE)),0e0),6) AS mean, round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE))>0 THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1e0 END,6) AS std FROM trn"
    for c in ("dist_to_apt_nm", "alt_ft", "gs_kt", "vrate_fpm", "closure_kt", "turn_rate_dps", "sel_altitude_ft"))))
def scaler(spark, sf):
    return flat(features.scaler(td.training(spark, sf), ["dist_to_apt_nm", "alt_ft", "gs_kt", "vrate_fpm", "closure_kt", "turn_rate_dps", "sel_altitude_ft"]))


@query("m11_scaled", with_parts("""
SELECT seg_id, ts AS snapshot_ts, round((dist_to_apt_nm-(SELECT avg(dist_to_apt_nm) FROM trn))/(SELECT stddev_pop(dist_to_apt_nm) FROM trn),6) AS dist_to_apt_nm,
 round(coalesce((closure_kt-(SELECT avg(closure_kt) FROM trn))/(SELECT stddev_pop(closure_kt) FROM trn),0e0),6) AS closure_kt FROM trn"""))
def scaled(spark, sf):
    rows = td.training(spark, sf)
    cols = ["dist_to_apt_nm", "closure_kt"]
    return flat(features.scaled(rows.select("seg_id", "snapshot_ts", *cols), features.scaler(rows, cols), cols))


@query("m12_phase_index", with_parts("""
SELECT phase, CAST(list_position(['ground','climb','descent','cruise','level','unknown'], phase)-1 AS BIGINT) AS phase_idx, count(*) AS n FROM sil GROUP BY 1,2"""))
def phases(spark, sf):
    return flat(td.positions(spark, sf).groupBy("phase", features.phase_index().alias("phase_idx")).agg(F.count(F.lit(1)).alias("n")))


def _tables(spark, sf):
    # the training set is a written table, read by every evaluation
    rows = stored(td.training(spark, sf), "training").withColumn("pred", F.col("baseline_pred") * 0.9)
    return features.band_report(rows, "pred"), features.band_report(rows, "baseline_pred")


part("aligned", """
SELECT coalesce(n.band,o.band) AS band, n.MAE_min AS challenger, o.MAE_min AS champion, n.MAE_min-o.MAE_min AS delta FROM bands_new n FULL JOIN bands_old o ON o.band=n.band
""")
part("gated", """
SELECT gain>=-1 AND bad IS NULL AS passed, gain, concat_ws(' | ', printf('error %.3f, champion %.3f, gain %+.1f%%', new, old, gain),
 CASE WHEN gain<-1 THEN 'gain below 2.0% and beyond the tolerance of 1.0%' END,
 CASE WHEN bad IS NOT NULL THEN 'bands worse by more than 0.05 min: {'||bad||'}' END) AS reasons FROM (
 SELECT 100*(max(champion) FILTER (band='ALL')-max(challenger) FILTER (band='ALL'))/max(champion) FILTER (band='ALL') AS gain, max(challenger) FILTER (band='ALL') AS new,
 max(champion) FILTER (band='ALL') AS old, string_agg(''''||band||''': '||round(delta,3), ', ' ORDER BY band) FILTER (band<>'ALL' AND delta>0.05) AS bad FROM aligned) q
""")


@query("j12_aligned_bands", with_parts("SELECT band, challenger, champion, round(delta,6) AS delta FROM aligned"))
def aligned(spark, sf):
    return flat(gate.align_bands(*_tables(spark, sf)))


@query("m13_gate", with_parts("SELECT CAST(passed AS INT) AS passed, round(gain,6) AS improvement_pct, reasons FROM gated"))
def gated(spark, sf):
    return flat(gate.evaluate_gate(*_tables(spark, sf), max_regress=0.05))


@query("m14_gate_audit", with_parts("""
SELECT CAST(1704067200 AS BIGINT) AS audited_at, 'ml.eta_touchdown' AS model_name, CAST(2 AS BIGINT) AS challenger_version, CAST(1 AS BIGINT) AS champion_version_before,
 CASE WHEN passed THEN 'PASS' ELSE 'HOLD' END AS gate_verdict, CAST(passed AS INT) AS applied, reasons FROM gated"""))
def audited(spark, sf):
    decision = gate.evaluate_gate(*_tables(spark, sf), max_regress=0.05)
    return flat(gate.audit_row(decision, "ml.eta_touchdown", 2, 1, True, F.timestamp_seconds(F.lit(td.EPOCH))))


# The other way round the same tables are an improvement, and the gate lets it pass.
_TURNED = "SELECT coalesce(n.band,o.band) AS band, o.MAE_min AS challenger, n.MAE_min AS champion, o.MAE_min-n.MAE_min AS delta FROM bands_new n FULL JOIN bands_old o ON o.band=n.band"


def _decision_turned(spark, sf):
    worse, better = _tables(spark, sf)
    return gate.evaluate_gate(better, worse, max_regress=0.05)


@query("m13_gate_passed", with_parts("SELECT CAST(passed AS INT) AS passed, round(gain,6) AS improvement_pct, reasons FROM gated", aligned=_TURNED))
def gate_passed(spark, sf):
    return flat(_decision_turned(spark, sf))


@query("m14_gate_applied", with_parts("""
SELECT CAST(1704067200 AS BIGINT) AS audited_at, 'ml.eta_touchdown' AS model_name, CAST(2 AS BIGINT) AS challenger_version, CAST(1 AS BIGINT) AS champion_version_before,
 CASE WHEN passed THEN 'PASS' ELSE 'HOLD' END AS gate_verdict, CAST(passed AS INT) AS applied, reasons FROM gated""", aligned=_TURNED))
def gate_applied(spark, sf):
    return flat(gate.audit_row(_decision_turned(spark, sf), "ml.eta_touchdown", 2, 1, True, F.timestamp_seconds(F.lit(td.EPOCH))))


# Drift between the two halves of the events, and of two line statuses.
def _halves(spark, sf):
    ev = td.table(spark, sf, "events").select("value", F.get_json_object("props", "$.k").try_cast("double").alias("k"),
                                              F.lit(7.0).alias("constant"), F.lit(None).cast("double").alias("empty"), "ts")
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return ev.where(~late), ev.where(late)


part("ev_long", """
SELECT 'value' AS feature, value AS v, ts<TIMESTAMP '2024-01-16' AS ref FROM events UNION ALL
SELECT 'k', CAST(json_extract_string(props,'$.k') AS DOUBLE), ts<TIMESTAMP '2024-01-16' FROM events
""")
part("ev_edges", "SELECT feature, list_sort(list_distinct(quantile_cont(v,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM ev_long WHERE ref GROUP BY 1")
part("ev_bins", """
SELECT l.feature, len(list_filter(e[2:len(e)-1], lambda x: x<=l.v)) AS bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM ev_long l JOIN ev_edges g ON g.feature=l.feature GROUP BY 1,2
""")
part("ev_psi", """
SELECT feature, CAST(max(rt) AS BIGINT) AS ref_rows, CAST(max(ct) AS BIGINT) AS comp_rows, sum((greatest(c/ct,1e-6)-greatest(r/rt,1e-6))*ln(greatest(c/ct,1e-6)/greatest(r/rt,1e-6))) AS psi
FROM (SELECT *, sum(r) OVER (PARTITION BY feature) AS rt, sum(c) OVER (PARTITION BY feature) AS ct FROM ev_bins) q GROUP BY 1
""")


@query("h01_psi", with_parts("""
SELECT feature, ref_rows, comp_rows, round(psi,6) AS psi, CASE WHEN psi<0.1 THEN 'none' WHEN psi<0.25 THEN 'moderate' ELSE 'significant' END AS severity FROM ev_psi
UNION ALL SELECT 'constant', count(*) FILTER (ts<TIMESTAMP '2024-01-16'), count(*) FILTER (ts>=TIMESTAMP '2024-01-16'), 0e0, 'none' FROM events
UNION ALL SELECT 'empty', 0, 0, NULL, 'unknown'"""))
def psi(spark, sf):
    return flat(health.psi(*_halves(spark, sf), ["value", "k", "constant", "empty"]))


_NOW = "2024-01-30 23:59:00"
part("days", "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")


@query("h07_health", with_parts("""
SELECT CAST(1706659140 AS BIGINT) AS checked_at, 'feature_drift' AS check_type, feature AS metric_name, round(psi,6) AS value,
 CASE WHEN psi<0.1 THEN 'none' WHEN psi<0.25 THEN 'moderate' ELSE 'significant' END AS severity, printf('PSI %.3f (%d ref rows, %d live rows)', psi, ref_rows, comp_rows) AS detail
FROM ev_psi WHERE ref_rows>=200 AND comp_rows>=200
UNION ALL SELECT 1706659140, 'performance', 'rolling_mae_min', round(avg(abs(error)),6), CASE WHEN 100*(avg(abs(error))-3)/3>20 THEN 'significant' ELSE 'none' END,
 printf('rolling MAE %.3f vs registered 3.000 (%+.1f%%, n=%d)', avg(abs(error)), 100*(avg(abs(error))-3)/3, count(*)) FROM err HAVING count(*)>=20
UNION ALL SELECT 1706659140, 'freshness', 'hours_since_last_report', round((1706659140000000-max(epoch_us(ts)))/3.6e9,6), 'none',
 printf('latest report %.1fh ago (threshold 24h)', (1706659140000000-max(epoch_us(ts)))/3.6e9) FROM events
UNION ALL SELECT 1706659140, 'volume', 'reports_today', CAST(t AS DOUBLE), CASE WHEN m>0 AND t<0.2*m THEN 'significant' ELSE 'none' END, printf('%d reports today vs 7-day median %.0f', t, m)
FROM (SELECT CAST(max(n) FILTER (d=DATE '2024-01-30') AS BIGINT) AS t, CAST(median(n) FILTER (d BETWEEN DATE '2024-01-23' AND DATE '2024-01-29') AS DOUBLE) AS m FROM days) q"""))
def checks(spark, sf):
    now = F.lit(_NOW).cast("timestamp")
    reports = td.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("snapshot_ts"))
    errors = features.prediction_errors(td.predictions(spark, sf), td.touchdowns(spark, sf))
    return flat(health.health(
        health.drift_rows(health.psi(*_halves(spark, sf), ["value", "k"]), now), health.performance_row(errors, 3.0, now),
        health.freshness_row(reports, now), health.volume_row(reports, now)))


@query("v09_model_health", with_parts("""
SELECT 'feature_drift' AS check_type, feature AS metric_name, round(psi,3) AS value, CASE WHEN psi<0.1 THEN 'none' WHEN psi<0.25 THEN 'moderate' ELSE 'significant' END AS severity,
 printf('PSI %.3f (%d ref rows, %d live rows)', psi, ref_rows, comp_rows) AS detail, CAST(1706659140 AS BIGINT) AS checked_at FROM ev_psi"""))
def model_health(spark, sf):
    from glidepath.plans.views import model_health as newest
    return flat(newest(health_rows(spark, sf)))


def health_rows(spark, sf):
    """Drift checks of two moments, the newer one at `_NOW`."""
    now = F.lit(_NOW).cast("timestamp")
    drift = health.psi(*_halves(spark, sf), ["value", "k"])
    before = F.timestamp_seconds(F.unix_seconds(now) - 86400)
    return health.drift_rows(drift, now).unionByName(health.drift_rows(drift, before))


@query("v09_sql_function", SQL["v09_model_health"])
def sql_health(spark, sf):
    sqlfunctions.register(spark, {"model_health": stored(health_rows(spark, sf), "health")}, "v09")
    return flat(spark.sql("SELECT * FROM v09_model_health()"))


@query("j07_confirmed_rows", with_parts("SELECT seg_id, count(*) AS n FROM arr WHERE seg_id IN (SELECT seg_id FROM td WHERE conf='confirmed') GROUP BY 1"))
def confirmed(spark, sf):
    sure = td.touchdowns(spark, sf).where(F.col("touchdown_confidence") == "confirmed").select("seg_id")
    return flat(td.arrivals(spark, sf).join(sure, "seg_id", "left_semi").groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")))


@query("j08_hold_labels", with_parts("""
SELECT t.seg_id, max(CASE WHEN h.seg_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS is_held, count(*) AS n FROM trk t LEFT JOIN irr h ON h.seg_id=t.seg_id AND h.kind='holding' GROUP BY 1"""))
def hold_labels(spark, sf):
    reports, segments = td.gold(spark, sf)
    held = events.irregularities(reports, segments).where(F.col("kind") == "holding").select("seg_id", F.lit(1).alias("is_held"))
    rows = reports.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"))
    return flat(rows.join(held, "seg_id", "left").select("seg_id", F.coalesce("is_held", F.lit(0)).alias("is_held"), "n"))


@query("g08_vrate_sources", with_parts("SELECT vrate_src, count(*) AS n, round(avg(vrate_fpm),6) AS mean_vrate FROM trk GROUP BY 1"))
def vrate(spark, sf):
    return flat(td.tracks(spark, sf).groupBy("vrate_src").agg(F.count(F.lit(1)).alias("n"), F.avg("vrate_fpm").alias("mean_vrate")))


@query("p08_rings", with_parts("""
SELECT CASE WHEN dist_to_apt_nm<40 THEN '00-40' WHEN dist_to_apt_nm<100 THEN '40-100' ELSE '100+' END AS ring, count(*) AS n FROM sil GROUP BY 1"""))
def rings(spark, sf):
    return flat(td.positions(spark, sf).groupBy(traffic.ring().alias("ring")).agg(F.count(F.lit(1)).alias("n")))

"""Demand queries on the real event times, taken as landings."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.operators import demand
from glidepath.workbench.registry import flat, query
from glidepath.workbench.sqlparts import part, with_parts

Z = [-1.2815515655446004, -0.8416212335729143, -0.5244005127080407, -0.2533471031357997, 0, 0.2533471031357997,
     0.5244005127080407, 0.8416212335729143, 1.2815515655446004]


def landings(spark, sf):
    return td.table(spark, sf, "events").select(F.lit("KATL").alias("apt_icao"), F.col("ts").cast("timestamp").alias("touchdown_ts"))


def frame(spark, sf):
    return demand.day_frame(demand.demand_series(landings(spark, sf)))


part("dm_bins", "SELECT CAST(floor(epoch_us(ts)/900000000.0) AS BIGINT) AS b, count(*) AS arrivals FROM events GROUP BY 1")
part("dm_days", "SELECT b//96 AS d, sum(arrivals) AS total FROM dm_bins GROUP BY 1 HAVING sum(arrivals)>=20")
part("dm_y", """
SELECT d.d, s.slot, (d.d+4)%7+1 AS dow, CAST(coalesce(b.arrivals,0) AS DOUBLE) AS y
FROM dm_days d CROSS JOIN (SELECT unnest(range(96)) AS slot) s LEFT JOIN dm_bins b ON b.b=d.d*96+s.slot
""")
part("dm_ref", """
SELECT a.*, (SELECT avg(o.y) FROM dm_y o WHERE o.slot=a.slot AND o.d<>a.d) AS clim,
  (SELECT avg(o.y) FROM dm_y o WHERE o.slot=a.slot AND o.d<>a.d AND o.dow=a.dow) AS cdow0,
  (SELECT o.y FROM dm_y o WHERE o.slot=a.slot AND o.d=(SELECT max(d) FROM dm_days WHERE dm_days.d<>a.d)) AS naive FROM dm_y a
""")
part("dm_cuts", "SELECT unnest([32,44,56,68,80]) AS cut")
part("dm_ctx", """
SELECT y.d, c.cut, avg(y.y) FILTER (y.slot>=c.cut-8) AS ctx8, avg(y.y) FILTER (y.slot>=c.cut-4) AS ctx4,
  sum(y.y*pow(0.7e0,c.cut-1-y.slot)*CASE WHEN y.slot=0 THEN 1e0 ELSE 0.3e0 END) AS smooth
FROM dm_y y CROSS JOIN dm_cuts c WHERE y.slot<c.cut GROUP BY 1,2
""")
part("dm_points", """
SELECT r.d, c.cut, r.slot-c.cut AS step, r.slot, r.dow, r.y AS actual, r.clim AS climatological_mean, coalesce(r.cdow0,r.clim) AS climatological_dow,
  r.naive AS seasonal_naive,
  (1-w.w)*coalesce(r.cdow0,r.clim)+w.w*c.ctx4 AS blended, c.ctx8 AS context_mean, greatest(c.smooth,0) AS exp_smoothing
FROM dm_ref r JOIN dm_ctx c ON c.d=r.d AND r.slot BETWEEN c.cut AND c.cut+11
JOIN (SELECT unnest(range(12)) AS s, unnest([0.6e0,0.35e0,0.15e0,0,0,0,0,0,0,0,0,0]) AS w) w ON w.s=r.slot-c.cut
""")
part("dm_long", " UNION ALL ".join(
    f"SELECT d, cut, step, actual, seasonal_naive AS naive, '{m}' AS model, {m} AS pred FROM dm_points" for m in demand.MODELS))
_LOSS = "+".join(
    f"greatest({(i + 1) / 10}e0*(actual-greatest(pred+({z})*sqrt(greatest(pred,1e0)),0e0)),"
    f"({(i + 1) / 10}e0-1)*(actual-greatest(pred+({z})*sqrt(greatest(pred,1e0)),0e0)))" for i, z in enumerate(Z))
part("dm_win", f"""
SELECT d, cut, model, avg(abs(actual-pred)) AS mae, CASE WHEN avg(abs(actual-naive))>1e-9 THEN avg(abs(actual-pred))/avg(abs(actual-naive)) END AS mase,
  CASE WHEN model IN ('climatological_mean','climatological_dow') THEN 2*sum(({_LOSS})/9)/greatest(sum(actual),1e0) END AS wql
FROM dm_long GROUP BY 1,2,3
""")
part("dm_prof", """
SELECT slot, dow, avg(y) AS mean FROM dm_y GROUP BY 1,2 UNION ALL SELECT slot, NULL, avg(y) FROM dm_y GROUP BY 1
""")


@query("f01_bin_counts", with_parts("SELECT 'KATL' AS apt_icao, b*900 AS bin_start_ts, arrivals FROM dm_bins"))
def bins(spark, sf):
    return flat(demand.bin_counts(landings(spark, sf)))


@query("f02_demand_series", with_parts("""
SELECT 'KATL' AS apt_icao, (d*96+slot)*900 AS bin_start_ts, CAST(y AS BIGINT) AS arrivals, CAST(slot//4 AS BIGINT) AS hour_utc,
  dow, d AS bin_date FROM dm_y"""))
def series(spark, sf):
    return flat(demand.demand_series(landings(spark, sf)))


@query("f03_day_frame_gaps", with_parts("""
SELECT d.d AS date, s.slot, CAST(b.arrivals AS DOUBLE) AS y, (d.d+4)%7+1 AS dow
FROM (SELECT DISTINCT b//96 AS d FROM dm_bins) d CROSS JOIN (SELECT unnest(range(96)) AS slot) s LEFT JOIN dm_bins b ON b.b=d.d*96+s.slot"""))
def day_frame_gaps(spark, sf):
    counts = demand.bin_counts(landings(spark, sf)).withColumn("bin_date", F.to_date("bin_start_ts"))
    return flat(demand.day_frame(counts).select("date", "slot", "y", "dow"))


@query("f04_reference_values", with_parts("""
SELECT d AS date, slot, round(clim,6) AS clim, round(coalesce(cdow0,clim),6) AS clim_dow, naive FROM dm_ref"""))
def references(spark, sf):
    return flat(demand.reference_values(frame(spark, sf)).select("date", "slot", "clim", "clim_dow", "naive"))


@query("f06_contexts", with_parts("""
SELECT d AS date, CAST(cut AS BIGINT) AS cut, round(ctx8,6) AS ctx8, round(ctx4,6) AS ctx4, round(smooth,6) AS smoothed FROM dm_ctx"""))
def context_levels(spark, sf):
    return flat(demand.contexts(frame(spark, sf)).select("date", "cut", "ctx8", "ctx4", "smoothed"))


@query("f07_blended_points", with_parts("""
SELECT d AS date, CAST(cut AS BIGINT) AS cut, step, round(blended,6) AS blended, round(exp_smoothing,6) AS exp_smoothing FROM dm_points"""))
def blended(spark, sf):
    return flat(demand.backtest_points(frame(spark, sf)).select("date", "cut", "step", "blended", "exp_smoothing"))


@query("f08_backtest", with_parts("""
SELECT d AS date, CAST(cut AS BIGINT) AS cut, model, round(mae,6) AS mae, round(mase,6) AS mase, round(wql,6) AS wql FROM dm_win"""))
def windows(spark, sf):
    return flat(demand.backtest(frame(spark, sf)).drop("series"))


@query("f10_backtest_summary", with_parts("""
SELECT model, round(avg(mae),3) AS mae, round(stddev_samp(mae),3) AS mae_sd, round(avg(mase),3) AS mase, round(avg(wql),3) AS wql,
  count(*) AS n FROM dm_win GROUP BY 1"""))
def summary(spark, sf):
    return flat(demand.backtest_summary(demand.backtest(frame(spark, sf))))


@query("f10_best_model", with_parts("""
SELECT model, round(avg(mae),3) AS mae, round(avg(mase),3) AS mase FROM dm_win
WHERE model IN ('climatological_dow','climatological_mean','blended') GROUP BY 1 ORDER BY mae, model LIMIT 1"""))
def best(spark, sf):
    return flat(demand.best_model(demand.backtest(frame(spark, sf))))


@query("f11_profile", with_parts("SELECT slot, dow, round(mean,6) AS mean FROM dm_prof"))
def profile(spark, sf):
    return flat(demand.profile(frame(spark, sf)).select("slot", "dow", "mean"))


_Q = ", ".join(f"round(greatest(mean+({z})*sqrt(greatest(mean,1e0)),0e0),6) AS q{(i + 1) * 10}" for i, z in enumerate(Z))


@query("f12_quantiles", with_parts(f"SELECT slot, dow, round(mean,6) AS mean, {_Q}, round(greatest(mean,0e0),6) AS predicted_mean FROM dm_prof"))
def quantiles(spark, sf):
    return flat(demand.with_quantiles(demand.profile(frame(spark, sf))).drop("series"))


@query("f14_bucket_mase", with_parts("""
SELECT model, bucket, round(avg(mase),6) AS mase, count(*) AS windows FROM (
  SELECT d, cut, model, bucket, CASE WHEN avg(abs(actual-naive))>1e-9 THEN avg(abs(actual-pred))/avg(abs(actual-naive)) END AS mase
  FROM (SELECT *, (step//4)||'-'||(step//4+1)||'h' AS bucket FROM dm_long UNION ALL SELECT *, 'ALL' FROM dm_long) q
  GROUP BY 1,2,3,4) w GROUP BY 1,2"""))
def bucket_mase(spark, sf):
    return flat(demand.horizon_bucket_mase(demand.backtest_points(frame(spark, sf)), demand.MODELS))


@query("f17_surge_alerts", with_parts("""
SELECT count(*) FILTER (climatological_dow>4) AS flagged, count(*) FILTER (actual>4) AS surges, count(*) FILTER (climatological_dow>4 AND actual>4) AS hits,
  round(count(*) FILTER (climatological_dow>4 AND actual>4)/nullif(count(*) FILTER (climatological_dow>4),0),6) AS precision,
  round(count(*) FILTER (climatological_dow>4 AND actual>4)/nullif(count(*) FILTER (actual>4),0),6) AS recall FROM dm_points WHERE step>=2"""))
def surge(spark, sf):
    return flat(demand.surge_alerts(demand.backtest_points(frame(spark, sf)), "climatological_dow", 4.0))


@query("a10_active_days", with_parts("SELECT 'KATL' AS apt_icao, d AS bin_date, CAST(total AS BIGINT) AS day_total FROM dm_days"))
def active(spark, sf):
    return flat(demand.active_days(demand.bin_counts(landings(spark, sf))))


@query("a20_day_totals", with_parts("""
SELECT 'KATL' AS apt_icao, d AS bin_date, count(*) AS bins, CAST(sum(y) AS BIGINT) AS total, CAST(max(y) AS BIGINT) AS peak FROM dm_y GROUP BY d"""))
def totals(spark, sf):
    return flat(demand.day_totals(demand.demand_series(landings(spark, sf))))

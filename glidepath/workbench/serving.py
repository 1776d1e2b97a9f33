"""Queries over the serving tables: read views, facts, prediction errors, joins between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.constants import AIRPORT
from glidepath.operators import demand, events, features
from glidepath.plans import situation, sqlfunctions, views
from glidepath.workbench.registry import SQL, flat, query
from glidepath.workbench.sqlparts import part, with_parts

part("prd_now", "SELECT * FROM prd WHERE scored_at=(SELECT max(scored_at) FROM prd)")
part("fct_now", "SELECT * FROM fct WHERE scored_at=(SELECT max(scored_at) FROM fct)")
part("flg_now", "SELECT * FROM flg WHERE scored_at=(SELECT max(scored_at) FROM flg) AND scored_at>=(SELECT max(scored_at) FROM prd)-900")


def hm(x: str) -> str:
    return f"printf('%02d:%02d', ({x}//3600)%24, ({x}//60)%60)"


@query("s15_latest_run", with_parts("SELECT icao, scored_at, ts AS snapshot_ts, round(eta,6) AS predicted_eta_min, land_ts AS predicted_touchdown_ts FROM prd_now"))
def latest(spark, sf):
    return flat(views.latest_run(td.predictions(spark, sf)).select("icao", "scored_at", "snapshot_ts", "predicted_eta_min", "predicted_touchdown_ts"))


@query("s15_predictions", with_parts("SELECT icao, scored_at, ts AS snapshot_ts, round(eta,6) AS predicted_eta_min, land_ts AS predicted_touchdown_ts FROM prd"))
def predictions(spark, sf):
    return flat(td.predictions(spark, sf).select("icao", "scored_at", "snapshot_ts", "predicted_eta_min", "predicted_touchdown_ts"))


@query("v01_arrival_picture", with_parts("""
SELECT count(*) AS inbound, count(*) FILTER (eta<=10) AS within_10_min, count(*) FILTER (eta<=30) AS within_30_min, CAST(max(ver) AS BIGINT) AS model_version,
 max(scored_at) AS scored_at FROM prd_now HAVING count(*)>0"""))
def picture(spark, sf):
    return flat(views.arrival_picture(td.predictions(spark, sf)))


@query("v02_next_arrivals", with_parts(f"""
SELECT row_number() OVER (ORDER BY land_ts, icao) AS rank, callsign, ac_type, round(eta,1) AS eta_min, {hm('land_ts')} AS touchdown_utc,
 round(dist_to_apt_nm) AS dist_nm, scored_at FROM prd_now ORDER BY land_ts, icao LIMIT 20"""))
def next_arrivals(spark, sf):
    return flat(views.next_arrivals(td.predictions(spark, sf), 50))


@query("v03_aircraft", with_parts(f"""
SELECT callsign, ac_type, round(eta,1) AS eta_min, {hm('land_ts')} AS touchdown_utc, round(dist_to_apt_nm) AS dist_nm, CAST(round(alt_ft) AS DOUBLE) AS alt_ft,
 round(gs_kt) AS gs_kt, round(vrate_fpm) AS vrate_fpm, phase, scored_at FROM prd_now WHERE upper(callsign)='ABC11' OR lower(icao)='abc11'"""))
def aircraft(spark, sf):
    return flat(views.aircraft(td.predictions(spark, sf), " abc11 "))


@query("f13_forecast_runs", with_parts("""
SELECT scored_at, apt_icao, bin_ts AS bin_start_ts, CAST(step AS BIGINT) AS horizon_step, seen AS arrivals_so_far, round(q10,6) AS predicted_q10,
 round(q50,6) AS predicted_q50, round(q90,6) AS predicted_q90, round(q50,6) AS predicted_mean FROM fct"""))
def forecast_runs(spark, sf):
    return flat(td.forecasts(spark, sf))


_OUTLOOK = f"""SELECT CAST(step AS BIGINT) AS horizon_step, {hm('bin_ts')} AS bin_start_utc, round(q50,1) AS predicted, round(q90,1) AS upper, 22.5e0 AS cap_per_15min,
 CAST(q50>22.5 AS INT) AS over_cap, CAST(q90>22.5 AS INT) AS upper_over_cap, round(sum(CASE WHEN step<4 THEN q50 END) OVER (PARTITION BY scored_at)) AS next_hour_total,
 round(sum(q50) OVER (PARTITION BY scored_at)) AS next_3h_total, CAST(seen AS BIGINT) AS arrivals_seen_today, scored_at FROM """


@query("v04_demand_outlook", with_parts(_OUTLOOK + "fct_now"))
def outlook(spark, sf):
    return flat(views.demand_outlook(td.forecasts(spark, sf)))


@query("f15_outlook_runs", with_parts(_OUTLOOK.replace("22.5e0", "5e0").replace(">22.5", ">5") + "fct"))
def outlook_runs(spark, sf):
    return flat(demand.outlook(td.forecasts(spark, sf), 20))


@query("v05_irregularities", with_parts("""
SELECT kind, count(*) OVER (PARTITION BY kind) AS kind_count, CAST(severity AS BIGINT) AS severity, callsign, ac_type, round(dist_nm) AS dist_nm,
 round(alt_ft) AS alt_ft, detail, scored_at FROM flg_now"""))
def current(spark, sf):
    preds, _, flags = td.serving(spark, sf)
    return flat(views.irregularities(flags, preds, AIRPORT))


def briefings(spark, sf):
    return td.table(spark, sf, "documents").select(
        F.lit(AIRPORT).alias("apt_icao"), F.col("text").alias("briefing"), F.col("source"), (F.col("n_chars") > 1000).alias("stale"),
        F.timestamp_seconds(F.lit(td.EPOCH) + F.col("doc_id") * 7 - 60).alias("data_as_of"),
        F.timestamp_seconds(F.lit(td.EPOCH) + F.col("doc_id") * 7).alias("generated_at"))


@query("v06_latest_briefing", """
SELECT text AS briefing, source, CAST(n_chars>1000 AS INT) AS stale, 1704067200+doc_id*7-60 AS data_as_of, 1704067200+doc_id*7 AS generated_at
FROM documents ORDER BY doc_id DESC LIMIT 1""")
def briefing(spark, sf):
    return flat(views.latest_briefing(briefings(spark, sf), AIRPORT))


def refresh_audit(spark, sf):
    return td.table(spark, sf, "orders").select(
        F.lit(AIRPORT).alias("apt_icao"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 10000).alias("elapsed_min"),
        F.col("o_orderdate").cast("timestamp").alias("data_as_of"), F.col("o_custkey").alias("n_inbound"), F.lit(0).alias("n_flags"),
        F.col("o_orderpriority").alias("briefing_source"), F.lit("").alias("reasons"), F.lit("").alias("warnings"),
        F.timestamp_seconds(F.lit(td.EPOCH) + F.col("o_orderkey")).alias("checked_at"))


@query("v07_refresh_status", """
SELECT o_orderstatus AS status, round(o_totalprice/10000,1) AS elapsed_min, CAST(epoch_us(o_orderdate)//1000000 AS BIGINT) AS data_as_of, o_custkey AS inbound, CAST(0 AS BIGINT) AS flagged,
 o_orderpriority AS briefing_source, '' AS reasons, '' AS warnings, 1704067200+o_orderkey AS checked_at FROM orders ORDER BY o_orderkey DESC LIMIT 1""")
def refreshed(spark, sf):
    return flat(views.refresh_status(refresh_audit(spark, sf), AIRPORT))


def gate_audit(spark, sf):
    odd = F.col("o_orderkey") % 2 == 1
    return td.table(spark, sf, "orders").select(
        F.when(odd, "ml.eta_touchdown").otherwise("ml.demand_forecast").alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("HOLD").alias("gate_verdict"), F.col("o_orderkey").alias("challenger_version"),
        F.col("o_custkey").alias("champion_version_before"), (F.col("o_orderstatus") == "F").alias("applied"),
        F.col("o_orderpriority").alias("reasons"), F.timestamp_seconds(F.lit(td.EPOCH) + F.col("o_orderkey")).alias("audited_at"))


@query("v08_model_status", """
SELECT 'ml.eta_touchdown' AS model_name, CASE WHEN o_orderstatus='F' THEN 'PASS' ELSE 'HOLD' END AS gate_verdict, o_orderkey AS challenger_version,
 o_custkey AS champion_version_before, CAST(o_orderstatus='F' AS INT) AS applied, o_orderpriority AS reasons, 1704067200+o_orderkey AS audited_at
FROM orders WHERE o_orderkey%2=1 ORDER BY o_orderkey DESC LIMIT 5""")
def status(spark, sf):
    return flat(views.model_status(gate_audit(spark, sf), "Model 1"))


@query("p21_model_names", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text),'model ?1|eta|touchdown|arrival.?time') THEN 'eta_touchdown'
 WHEN regexp_matches(lower(text),'model ?2|demand|forecast') THEN 'demand_forecast' ELSE 'other' END AS model FROM documents""")
def names(spark, sf):
    docs = td.table(spark, sf, "documents")
    named = views.model_named(F.col("text"))
    return docs.select("doc_id", F.when(named.isin("eta_touchdown", "demand_forecast"), named).otherwise("other").alias("model"))


@query("v10_headline", with_parts(f"""
SELECT (SELECT count(*) FROM prd_now) AS inbound_now, round(sum(q50)) AS next_3h, count(*)*22.5e0 AS capacity_3h, round(22.5-max(q50),1) AS peak_headroom,
 (SELECT {hm('bin_ts')} FROM fct_now ORDER BY q50 DESC, step LIMIT 1) AS peak_utc, (SELECT count(*) FROM flg_now) AS alerts,
 (SELECT count(*) FROM flg_now WHERE kind='emergency') AS emergency, (SELECT count(*) FROM flg_now WHERE kind='go_around') AS go_around,
 (SELECT count(*) FROM flg_now WHERE kind='holding') AS holding FROM fct_now"""))
def headline(spark, sf):
    preds, fc, flags = td.serving(spark, sf)
    return flat(views.headline(fc, flags, preds, AIRPORT))


@query("v11_data_age", with_parts("""
SELECT min(m) AS data_as_of, arg_min(s, (m, s)) AS oldest_source FROM (SELECT 'predictions' AS s, max(scored_at) AS m FROM prd UNION ALL SELECT 'flags', max(scored_at) FROM flg
 UNION ALL SELECT 'tracks', max(ts) FROM trk) q"""))
def age(spark, sf):
    preds, _, flags = td.serving(spark, sf)
    return flat(views.oldest_stamp({
        "predictions": (preds, "scored_at"), "flags": (flags, "scored_at"),
        "tracks": (td.tracks(spark, sf), "snapshot_ts")}))


@query("p16_eta_bands", with_parts("SELECT CASE WHEN eta<=10 THEN '≤ 10 min' WHEN eta<=25 THEN '10–25 min' ELSE '> 25 min' END AS band, count(*) AS n FROM prd GROUP BY 1"))
def bands(spark, sf):
    return td.predictions(spark, sf).groupBy(views.eta_band().alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_stitched_curve", with_parts("""
SELECT scored_at, (land_ts//900)*900 AS bin_start_ts, CAST(count(*) AS DOUBLE) AS expected, 'flights' AS source FROM prd WHERE land_ts>=scored_at AND land_ts-scored_at<2700 GROUP BY 1,2
UNION ALL SELECT scored_at, bin_ts, round(q50,6), 'forecast' FROM fct WHERE bin_ts-scored_at>=2700"""))
def stitched(spark, sf):
    return flat(demand.stitched_curve(td.predictions(spark, sf), td.forecasts(spark, sf)).drop("apt_icao"))


@query("j05_prediction_errors", with_parts("""
SELECT icao, scored_at, ts AS snapshot_ts, round(eta,6) AS predicted_eta_min, td_ts AS actual_touchdown_ts, round(actual,6) AS actual_eta_min, round(error,6) AS error_min FROM err"""))
def errors(spark, sf):
    return flat(features.prediction_errors(td.predictions(spark, sf), td.touchdowns(spark, sf)).select(
        "icao", "scored_at", "snapshot_ts", "predicted_eta_min", "actual_touchdown_ts", "actual_eta_min", "error_min"))


@query("j05_first_landing", with_parts("SELECT icao, scored_at, min(td_ts) AS actual_touchdown_ts FROM err GROUP BY 1,2"))
def first_errors(spark, sf):
    return flat(features.prediction_errors(td.predictions(spark, sf), td.touchdowns(spark, sf), first_only=True).select(
        "icao", "scored_at", "actual_touchdown_ts"))


@query("a12_matched_accuracy", with_parts("""
SELECT count(*) AS n, round(avg(abs(error)),2) AS MAE_min, round(quantile_cont(abs(error),0.9),2) AS P90_min, round(avg(error),2) AS bias_min FROM err"""))
def matched(spark, sf):
    rows = features.prediction_errors(td.predictions(spark, sf), td.touchdowns(spark, sf))
    return flat(features.error_stats(rows.withColumnRenamed("error_min", "error"), []))


part("sit_p", """
SELECT scored_at AS now, count(*) AS inbound, count(*) FILTER (eta<=10) AS w10, count(*) FILTER (eta<=30) AS w30,
 arg_min(callsign, (eta, icao)) AS first_cs, round(min(eta),1) AS first_eta FROM prd GROUP BY 1
""")
part("sit_d", f"""
SELECT scored_at, CAST(round(max(seen)) AS BIGINT) AS seen, CAST(round(sum(q50) FILTER (step<4)) AS BIGINT) AS hour1, {hm('arg_max(bin_ts, (q50, -step))')} AS peak_utc,
 round(max(q50),1) AS peak, round(arg_max(q90, (q50, -step)),1) AS peak_up, round(5-round(max(q50),1),1) AS headroom, count(*) FILTER (q50>5) AS over, count(*) FILTER (q90>5) AS up_over FROM fct GROUP BY 1
""")
part("sit_f", """
SELECT scored_at, count(*) FILTER (kind='emergency') AS em, count(*) FILTER (kind='go_around') AS ga, count(*) FILTER (kind='holding') AS ho,
 string_agg(callsign||' '||replace(kind,'_',' ')||' at '||CAST(round(dist_nm) AS BIGINT)||' nm', ', ' ORDER BY rk) FILTER (rk<=5) AS listed
FROM (SELECT *, row_number() OVER (PARTITION BY scored_at ORDER BY severity DESC, dist_nm, icao, kind) AS rk FROM flg) q GROUP BY 1
""")
part("sit", """
SELECT p.*, d.* RENAME (scored_at AS d_at), f.* RENAME (scored_at AS f_at), f.scored_at IS NOT NULL AND p.now-f.scored_at<=900 AS has_f
FROM sit_p p LEFT JOIN sit_d d ON d.scored_at=(SELECT max(scored_at) FROM fct WHERE fct.scored_at<=p.now+900)
LEFT JOIN sit_f f ON f.scored_at=(SELECT max(scored_at) FROM flg WHERE flg.scored_at<=p.now+900)
""")


def _facts(spark, sf):
    preds, fc, flags = td.serving(spark, sf)
    moments = preds.select(F.col("scored_at").alias("now")).distinct()
    return situation.situation_facts(preds, fc, flags, AIRPORT, moments, per_hour=20)


@query("t07_situation_facts", with_parts("""
SELECT now, inbound, w10 AS within_10_min, w30 AS within_30_min, first_cs, first_eta, seen AS arrivals_seen_today, hour1 AS predicted_next_hour, peak_utc, peak AS peak_predicted, peak_up AS peak_upper,
 headroom AS peak_headroom, over AS bins_over_cap, up_over AS bins_upper_over_cap, CASE WHEN has_f THEN em END AS emergency, CASE WHEN has_f THEN ga END AS go_around,
 CASE WHEN has_f THEN ho END AS holding,
 CAST(greatest(0, coalesce(greatest(now-d_at,0),0), CASE WHEN has_f THEN greatest(now-f_at,0) ELSE 0 END)//60 AS BIGINT) AS max_age_min FROM sit"""))
def facts(spark, sf):
    return flat(_facts(spark, sf).select(
        "now", "inbound.inbound", "inbound.within_10_min", "inbound.within_30_min", F.col("inbound.next")[0]["callsign"].alias("first_cs"),
        F.col("inbound.next")[0]["eta_min"].alias("first_eta"), "demand.arrivals_seen_today", "demand.predicted_next_hour", "demand.peak_utc",
        "demand.peak_predicted", "demand.peak_upper", "demand.peak_headroom", "demand.bins_over_cap", "demand.bins_upper_over_cap",
        "flags.emergency", "flags.go_around", "flags.holding", "max_age_min"))


@query("t08_facts_text", with_parts("""
SELECT now, concat_ws(' ', 'Inbound aircraft at KATL: '||inbound||'; landing within 10 min: '||w10||', within 30 min: '||w30||'; next '||first_cs||' ('||first_eta||' min).',
 CASE WHEN d_at IS NULL THEN 'Demand: no data.' ELSE 'Next hour: '||hour1||' of 20 possible landings. Peak quarter '||peak_utc||' UTC: '||peak||' (up to '||peak_up||
   ') of 5.0. Quarters over capacity: '||over||' expected, '||up_over||' at most.' END,
 CASE WHEN has_f THEN 'Flags: emergency '||em||', go-around '||ga||', holding '||ho||'.' ELSE 'Flags: none.' END,
 CASE WHEN has_f THEN 'Listed: '||listed||'.' END) AS text FROM sit"""))
def facts_text(spark, sf):
    return flat(situation.facts_text(_facts(spark, sf)).select("now", "text"))


@query("a15_top_json", with_parts("""
SELECT '['||string_agg('{"callsign":"'||callsign||'","pings":'||pings||'}', ',' ORDER BY heading_spread DESC, icao)||']' AS orbits FROM (
 SELECT icao, min(callsign) AS callsign, count(*) AS pings, round(1-sqrt(pow(avg(cos(radians(track_deg))),2)+pow(avg(sin(radians(track_deg))),2)),2) AS heading_spread
 FROM sil WHERE alt_ft BETWEEN 1000 AND 45000 GROUP BY icao ORDER BY heading_spread DESC, icao LIMIT 8) q"""))
def top_json(spark, sf):
    circling = events.orbits(td.positions(spark, sf), min_n=0, min_speed_kt=0, min_spread=-1, max_box_km=1e9)
    top = circling.orderBy(F.desc("heading_spread"), "icao").limit(8)
    item = F.struct((-F.col("heading_spread")).alias("o"), "icao", F.struct("callsign", "pings").alias("v"))
    return top.agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"])).alias("orbits"))


@query("a17_kind_counts", with_parts("""
SELECT scored_at, count(*) FILTER (kind='emergency') AS emergency, count(*) FILTER (kind='go_around') AS go_around, count(*) FILTER (kind='holding') AS holding FROM flg GROUP BY 1"""))
def kinds(spark, sf):
    return flat(situation.flag_facts(td.flags(spark, sf)).drop("flagged"))


@query("p19_fresh_flags", with_parts("SELECT icao, kind, scored_at FROM flg_now"))
def fresh(spark, sf):
    preds, _, flags = td.serving(spark, sf)
    return flat(views.current_flags(flags, preds, AIRPORT).select("icao", "kind", "scored_at"))


@query("s19_decoded", """
SELECT event_id, TRY_CAST(CASE WHEN event_id%10=0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS user_id, round(TRY_CAST(props AS DOUBLE),6) AS props, event_type FROM events""")
def decoded(spark, sf):
    cells = td.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(
            F.col("user_id").cast("string")).alias("user_id"), "props", "event_type")
    return flat(views.decoded(cells, {"event_id": "bigint", "user_id": "bigint", "props": "double"}))


@query("t13_compacted", """
SELECT o_orderkey, (SELECT count(*) FROM orders) AS row_count, CAST((SELECT count(*) FROM orders)>25 AS INT) AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def compacted(spark, sf):
    rows = td.table(spark, sf, "orders")
    return flat(views.compacted(rows, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "row_count", "truncated"))


# The same views, called as table functions with arguments from SQL text.
def called(spark, prefix, text, **tables):
    sqlfunctions.register(spark, tables, prefix)
    return flat(spark.sql(text))


@query("v01_sql_function", SQL["v01_arrival_picture"])
def sql_picture(spark, sf):
    return called(spark, "v01", "SELECT * FROM v01_arrival_picture()", predictions=td.predictions(spark, sf))


@query("v02_sql_function", SQL["v02_next_arrivals"])
def sql_next(spark, sf):
    return called(spark, "v02", "SELECT * FROM v02_next_arrivals(asked_n => 50)", predictions=td.predictions(spark, sf))


@query("v03_sql_function", SQL["v03_aircraft"])
def sql_aircraft(spark, sf):
    return called(spark, "v03", "SELECT * FROM v03_aircraft(' abc11 ')", predictions=td.predictions(spark, sf))


@query("v04_sql_function", SQL["v04_demand_outlook"])
def sql_outlook(spark, sf):
    return called(spark, "v04", "SELECT * FROM v04_demand_outlook()", demand_forecast=td.forecasts(spark, sf))


@query("v05_sql_function", SQL["v05_irregularities"])
def sql_flags(spark, sf):
    preds, _, flags = td.serving(spark, sf)
    return called(spark, "v05", f"SELECT * FROM v05_irregularities('{AIRPORT}')", predictions=preds, irregularity_flags=flags)


@query("v06_sql_function", SQL["v06_latest_briefing"])
def sql_briefing(spark, sf):
    return called(spark, "v06", f"SELECT * FROM v06_latest_briefing('{AIRPORT}')", ops_briefings=briefings(spark, sf))


@query("v07_sql_function", SQL["v07_refresh_status"])
def sql_refreshed(spark, sf):
    return called(spark, "v07", f"SELECT * FROM v07_refresh_status('{AIRPORT}')", refresh_audit=refresh_audit(spark, sf))


@query("v08_sql_function", SQL["v08_model_status"])
def sql_status(spark, sf):
    return called(spark, "v08", "SELECT * FROM v08_model_status('Model 1')", gate_audit=gate_audit(spark, sf))

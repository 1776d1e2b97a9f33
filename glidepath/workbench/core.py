"""Trajectory, event and congestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.operators import events, traffic
from glidepath.workbench.registry import flat, query
from glidepath.workbench.sqlparts import with_parts

TRACK_SQL = with_parts("""
SELECT seg_id, icao, callsign, ac_type, ts AS snapshot_ts, round(lat,6) AS lat, round(lon,6) AS lon, CAST(alt_ft AS BIGINT) AS alt_ft,
  round(gs_kt,6) AS gs_kt, track_deg, round(dist_to_apt_nm,6) AS dist_to_apt_nm, round(bearing_to_apt,6) AS bearing_to_apt,
  round(heading_err_deg,6) AS heading_err_deg, CAST(is_grounded AS INT) AS is_grounded, phase, dt_s, round(closure_kt,6) AS closure_kt,
  turn_deg, round(vrate_fpm,6) AS vrate_fpm, vrate_src, round(turn_rate_dps,6) AS turn_rate_dps, seg_n AS seg_n_reports,
  seg_start AS seg_start_ts, seg_end AS seg_end_ts, CAST(inbound_flag AS INT) AS inbound_flag FROM trk
""")


@query("g05_tracks", TRACK_SQL)
def tracks(spark, sf):
    cols = ["seg_id", "icao", "callsign", "ac_type", "snapshot_ts", "lat", "lon", "alt_ft", "gs_kt", "track_deg",
            "dist_to_apt_nm", "bearing_to_apt", "heading_err_deg", "is_grounded", "phase", "dt_s", "closure_kt",
            "turn_deg", "vrate_fpm", "vrate_src", "turn_rate_dps", "seg_n_reports", "seg_start_ts", "seg_end_ts", "inbound_flag"]
    return flat(td.tracks(spark, sf).select(cols))


@query("g17_touchdowns", with_parts("""
SELECT seg_id, icao, callsign, ac_type, apt_icao, td_ts AS touchdown_ts, min_dist_nm, CAST(min_alt_ft AS BIGINT) AS min_alt_ft,
  descent_reports, n_short_final, conf AS touchdown_confidence FROM td"""))
def touchdowns(spark, sf):
    return flat(events.touchdowns(td.summary(spark, sf)))


@query("g15_holding", with_parts("SELECT * FROM hold"))
def holding(spark, sf):
    return flat(events.holding(td.summary(spark, sf)))


@query("g21_irregularities", with_parts("SELECT * REPLACE (round(confidence,6) AS confidence, CAST(landed AS BIGINT) AS landed) FROM irr"))
def irregularities(spark, sf):
    return flat(events.irregularities(*td.gold(spark, sf, events.REPORT_COLUMNS)))


@query("a01_congestion", with_parts("SELECT * FROM cong"))
def congestion(spark, sf):
    return flat(traffic.congestion(td.tracks(spark, sf)))

"""The read views as SQL table functions, to be called with arguments from any SQL text of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glidepath.constants import ACCEPTANCE_PER_HOUR

#: Table each function reads under the name `<prefix>_<table>`.
TABLES = ["predictions", "demand_forecast", "irregularity_flags", "ops_briefings", "refresh_audit", "gate_audit", "model_health"]


def _settled(value: str, digits: int = 0) -> str:
    return f"round(round({value}, {digits + 4}), {digits})"


def _latest(table: str, stamp: str = "scored_at") -> str:
    """Rows of the newest run; the newest stamp is one value, found before the scan."""
    return f"(SELECT * FROM {table} WHERE {stamp} = (SELECT max({stamp}) FROM {table}))"


_NAME = "coalesce(nullif(trim(callsign), ''), icao)"
_ETA = f"{_settled('predicted_eta_min', 1)} AS eta_min, date_format(predicted_touchdown_ts, 'HH:mm') AS touchdown_utc, {_settled('dist_to_apt_nm')} AS dist_nm"


def _bodies(p: str) -> dict[str, tuple[str, str]]:
    """For each function its arguments and its query, over tables that begin with `p`."""
    t = {name: f"{p}_{name}" for name in TABLES}
    preds = _latest(t["predictions"])
    # the newest run of each airport; one of over 15 minutes before the newest predictions is an old one: nothing is flagged now
    now = f"""{t['irregularity_flags']} f JOIN (SELECT apt_icao AS run_apt, max(scored_at) AS run_at FROM {t['irregularity_flags']} GROUP BY apt_icao) r
                ON f.apt_icao = r.run_apt AND f.scored_at = r.run_at
            WHERE apt_icao = asked_apt AND unix_micros((SELECT max(scored_at) FROM {t['predictions']})) - unix_micros(scored_at) <= 900000000"""
    model = """CASE WHEN lower(asked_model) RLIKE 'model ?1|eta|touchdown|arrival.?time' THEN 'eta_touchdown'
        WHEN lower(asked_model) RLIKE 'model ?2|demand|forecast' THEN 'demand_forecast' ELSE trim(asked_model) END"""
    return {
        "arrival_picture": ("", f"""
            SELECT count(*) AS inbound, count_if(predicted_eta_min <= 10) AS within_10_min, count_if(predicted_eta_min <= 30) AS within_30_min,
                   max(model_version) AS model_version, max(scored_at) AS scored_at FROM {preds} HAVING count(*) > 0"""),
        "next_arrivals": ("asked_n INT DEFAULT 10", f"""
            SELECT * FROM (
                SELECT row_number() OVER (ORDER BY predicted_touchdown_ts, icao) AS rank, {_NAME} AS callsign, ac_type, {_ETA}, scored_at
                FROM (SELECT * FROM {preds} ORDER BY predicted_touchdown_ts, icao LIMIT 20)) WHERE rank <= least(greatest(asked_n, 1), 20)"""),
        "aircraft": ("asked_name STRING", f"""
            SELECT {_NAME} AS callsign, ac_type, {_ETA}, {_settled('CAST(alt_ft AS DOUBLE)')} AS alt_ft, {_settled('gs_kt')} AS gs_kt,
                   {_settled('vrate_fpm')} AS vrate_fpm, phase, scored_at FROM {preds}
            WHERE upper(trim(callsign)) = upper(trim(asked_name)) OR lower(icao) = lower(trim(asked_name))"""),
        "demand_outlook": (f"asked_per_hour DOUBLE DEFAULT {float(ACCEPTANCE_PER_HOUR)}D", f"""
            SELECT horizon_step, date_format(bin_start_ts, 'HH:mm') AS bin_start_utc, {_settled('predicted_mean', 1)} AS predicted,
                   {_settled('predicted_q90', 1)} AS upper, {_settled('asked_per_hour / 4', 1)} AS cap_per_15min,
                   predicted_mean > asked_per_hour / 4 AS over_cap, predicted_q90 > asked_per_hour / 4 AS upper_over_cap,
                   {_settled('sum(CASE WHEN horizon_step < 4 THEN predicted_mean END) OVER (PARTITION BY scored_at, apt_icao)')} AS next_hour_total,
                   {_settled('sum(predicted_mean) OVER (PARTITION BY scored_at, apt_icao)')} AS next_3h_total,
                   CAST(arrivals_so_far AS BIGINT) AS arrivals_seen_today, scored_at FROM {_latest(t['demand_forecast'])}"""),
        "irregularities": ("asked_apt STRING", f"""
            SELECT kind, count(*) OVER (PARTITION BY kind) AS kind_count, severity, {_NAME} AS callsign, ac_type, {_settled('dist_to_apt_nm')} AS dist_nm,
                   {_settled('CAST(alt_ft AS DOUBLE)')} AS alt_ft, detail, scored_at FROM {now}"""),
        "latest_briefing": ("asked_apt STRING", f"""
            SELECT briefing, source, stale, data_as_of, generated_at FROM {t['ops_briefings']} WHERE apt_icao = asked_apt ORDER BY generated_at DESC LIMIT 1"""),
        "refresh_status": ("asked_apt STRING", f"""
            SELECT status, {_settled('elapsed_min', 1)} AS elapsed_min, data_as_of, n_inbound AS inbound, n_flags AS flagged, briefing_source, reasons, warnings, checked_at
            FROM {t['refresh_audit']} WHERE apt_icao = asked_apt ORDER BY checked_at DESC LIMIT 1"""),
        "model_status": ("asked_model STRING", f"""
            SELECT model_name, gate_verdict, challenger_version, champion_version_before, applied, reasons, audited_at
            FROM {t['gate_audit']} WHERE endswith(model_name, {model}) ORDER BY audited_at DESC LIMIT 5"""),
        "model_health": ("", f"""
            SELECT check_type, metric_name, {_settled('value', 3)} AS value, severity, detail, checked_at FROM {_latest(t['model_health'], 'checked_at')}
            ORDER BY CASE severity WHEN 'significant' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, metric_name"""),
    }


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "arrivals") -> list[str]:
    """Makes `<prefix>_<view>(...)` callable in the session's SQL for every view whose tables are given; returns their names.

    Tables are known to the session as `<prefix>_<table>`; nothing is read until a function is called.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"no view reads {sorted(unknown)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    made = []
    for name, (arguments, body) in _bodies(prefix).items():
        if all(f"{prefix}_{t}" not in body for t in TABLES if t not in tables):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({arguments}) RETURNS TABLE RETURN {body}")
            made.append(f"{prefix}_{name}")
    return made

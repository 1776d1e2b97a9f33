"""Queries again over the dense reports (see `testdata`), where segments cross slices and every kind of event occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.constants import AIRPORT, FIELD_ELEV_FT
from glidepath.operators import events, features, health, learn, sketches, traffic
from glidepath.operators.tracks import enrich_tracks, incremental_tracks, open_segments
from glidepath.plans import views
from glidepath.session import fresh_path
from glidepath.sources.catalog import Catalog, stored
from glidepath.workbench import core, demand, ingest, models, points, serving, texts  # noqa: F401
from glidepath.workbench.points import decade_landings
from glidepath.workbench.registry import QUERIES, SQL, flat, query
from glidepath.workbench.sqlparts import PARTS, part, with_parts

_EVENTS = """SELECT event_id, user_id, event_type, value, CAST((us//864000000000)*86400+16200+floor((us%864000000000)/80000000.0)+30*j AS BIGINT) AS t
FROM (SELECT *, epoch_us(ts)-1704067200000000 AS us FROM events) e CROSS JOIN (SELECT unnest(range(12)) AS j) s"""
AGAIN = ["g05_tracks", "g06_segments", "g15_holding", "g17_touchdowns", "g21_irregularities", "g22_live_flags", "g27_causal_windows", "a01_congestion",
         "m02_arrival_training_set", "j05_prediction_errors"]


def dense_sql(sql: str) -> str:
    """A twin over the dense reports: only the times of the events differ."""
    if PARTS["src_events"] not in sql:
        raise ValueError("the query does not read the reports")
    return sql.replace(PARTS["src_events"], _EVENTS)


def dense_again(name: str) -> None:
    """Registers a query over the dense reports, but for the closure rate: among so many rows some lie at a half of any digit, see `hundredths`."""
    has = "closure_kt" in SQL[name].rsplit("FROM", 1)[0].rsplit("SELECT", 1)[-1]
    sql = dense_sql(SQL[name])

    def run(spark, sf):
        rows = QUERIES[name](spark, sf + td.DENSE)
        return rows.drop("closure_kt") if has else rows

    query(f"{name}_dense", f"SELECT * EXCLUDE (closure_kt) FROM ({sql}) q" if has else sql)(run)


def hundredths(value: str):
    """A rate in whole hundredths, cut at an odd place where hardly any value lies."""
    return F.floor(F.col(value) * 100 + 0.123456789).cast("bigint")


HUNDREDTHS = "CAST(floor(closure_kt*100+0.123456789e0) AS BIGINT) AS closure_kt"


for _name in AGAIN:
    dense_again(_name)


@query("g14_incremental_tracks_dense", dense_sql(with_parts(f"""
SELECT seg_id, icao, ts AS snapshot_ts, seg_start AS seg_start_ts, seg_end AS seg_end_ts, seg_n AS seg_n_reports, dt_s, {HUNDREDTHS}, turn_deg,
 round(vrate_fpm,6) AS vrate_fpm, CAST(inbound_flag AS INT) AS inbound_flag FROM trk WHERE ts>=1704067200+86400+21540""")))
def incremental(spark, sf):
    """From a minute before the second morning's slice border on, in slices of half an hour."""
    silver, cutoff = td.positions(spark, sf + td.DENSE), "2024-01-02 05:59:00"
    rows = incremental_tracks(silver, cutoff, open_segments(silver, cutoff, slice_s=1800), slice_s=1800)
    return flat(rows.select("seg_id", "icao", "snapshot_ts", "seg_start_ts", "seg_end_ts", "seg_n_reports", "dt_s", hundredths("closure_kt").alias("closure_kt"), "turn_deg", "vrate_fpm", "inbound_flag"))


@query("g05_short_slices_dense", dense_sql(with_parts(f"""
SELECT seg_id, icao, ts AS snapshot_ts, seg_start AS seg_start_ts, seg_end AS seg_end_ts, seg_n AS seg_n_reports, {HUNDREDTHS}, CAST(inbound_flag AS INT) AS inbound_flag FROM trk""")))
def short_slices(spark, sf):
    rows = enrich_tracks(td.positions(spark, sf + td.DENSE), slice_s=900)
    rows = rows.withColumn("closure_kt", hundredths("closure_kt"))
    return flat(rows.select("seg_id", "icao", "snapshot_ts", "seg_start_ts", "seg_end_ts", "seg_n_reports", "closure_kt", "inbound_flag"))


# Hold risk on its own label: circling segments whose aircraft lands soon after. The fixture's aircraft circle all morning, in more segments a
# day than the rule takes for a hold, so it is given a higher limit.
SAME_DAY = 20
part("genuine", f"""
SELECT DISTINCT h.seg_id FROM (SELECT i.seg_id, i.icao, max(g.ts) AS t_end, count(DISTINCT j.seg_id) AS n FROM irr i JOIN trk g ON g.seg_id=i.seg_id
  JOIN irr j ON j.kind='holding' AND j.icao=i.icao AND j.event_ts//86400=i.event_ts//86400 WHERE i.kind='holding' GROUP BY 1,2) h
JOIN td_decade d ON d.icao=h.icao AND d.td_ts>h.t_end AND d.td_ts<h.t_end+5400 WHERE h.n<={SAME_DAY}
""")
part("hold_rows", """
SELECT t.seg_id, t.ts, CASE WHEN g.seg_id IS NOT NULL THEN 1 ELSE 0 END AS is_held FROM trk t LEFT JOIN genuine g ON g.seg_id=t.seg_id
WHERE t.dist_to_apt_nm BETWEEN 20 AND 60 AND t.gs_kt>60 AND t.alt_ft IS NOT NULL AND t.vrate_fpm IS NOT NULL AND t.heading_err_deg IS NOT NULL AND t.closure_kt IS NOT NULL
 AND t.turn_rate_dps IS NOT NULL AND t.bearing_to_apt IS NOT NULL
""")


@query("g23_genuine_holds_dense", dense_sql(with_parts("SELECT seg_id FROM genuine")))
def genuine(spark, sf):
    rows, segments = td.gold(spark, sf + td.DENSE, events.REPORT_COLUMNS)
    return flat(events.genuine_holds(events.irregularities(rows, segments), rows, decade_landings(segments), max_same_day=SAME_DAY))


def hold_rows(spark, sf):
    more = ["bearing_to_apt", "closure_kt", "turn_rate_dps", "inbound_flag"]  # of the model and the inbound count
    rows, segments = td.gold(spark, sf + td.DENSE, events.REPORT_COLUMNS + more)
    held = stored(events.genuine_holds(events.irregularities(rows, segments), rows, decade_landings(segments), max_same_day=SAME_DAY), "held")
    # written first, so that the joins know the size of both small sides before they move any report
    inbound = stored(traffic.common_ring_inbound(traffic.congestion(rows)), "inbound")
    made = learn.hold_rows(features.with_inbound_count(rows, inbound), held)
    return stored(made.select("seg_id", "snapshot_ts", "is_held", *learn.HOLD_FEATURES), "hold_rows")


@query("m09_hold_rows", dense_sql(with_parts("SELECT seg_id, ts AS snapshot_ts, CAST(is_held AS BIGINT) AS is_held FROM hold_rows")))
def labelled(spark, sf):
    return flat(hold_rows(spark, sf).select("seg_id", "snapshot_ts", "is_held"))


@query("m09_balanced_folds", dense_sql(with_parts("""
SELECT CAST(is_held AS BIGINT) AS positive, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, least(count(*), 5) AS folds, 1 AS groups_apart_at_most_1, 1 AS groups_whole
FROM (SELECT seg_id, max(is_held) AS is_held, count(*) AS n FROM hold_rows GROUP BY 1) q GROUP BY 1""")))
def folds(spark, sf):
    """Every segment in one fold, and folds that differ by one segment of either class."""
    dealt = learn.balanced_folds(hold_rows(spark, sf))
    per_fold = dealt.groupBy("positive", "fold").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.count_distinct("seg_id").alias("d"))
    return flat(per_fold.groupBy("positive").agg(
        F.sum("g").alias("n_groups"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("folds"),
        (F.max("g") - F.min("g") <= 1).alias("groups_apart_at_most_1"), (F.sum("g") == F.sum("d")).alias("groups_whole")))


@query("m09_genuine_hold_risk")
def hold_risk(spark, sf):
    """The risk of each row by a model trained with the defaults on the label of genuine holds; no row where too few segments are positive."""
    rows = hold_rows(spark, sf)
    model, info = learn.train_hold_risk(rows)
    if model is None:
        return flat(rows.where("false").select("seg_id", "snapshot_ts", "is_held", F.lit(0.0).alias("risk")))
    return flat(learn.hold_risk(model, rows).select("seg_id", "snapshot_ts", "is_held", "risk"))


# Sketches of three mornings, written day by day; errors are held against exact values of the same rows.
_FIELDS, _IDS = ["alt_ft", "gs_kt", "dist_to_apt_nm", "baro_rate_fpm"], ["icao", "callsign"]


def sketched(spark, sf):
    """The reports and the table of their sketches; the last day is written twice, as a rerun does."""
    reports = td.positions(spark, sf + td.DENSE).select("snapshot_ts", *_FIELDS, *_IDS)  # no other column is sketched or compared
    rows, cat = stored(reports, "positions"), Catalog(spark, fresh_path(spark, "sketches"))
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-03"):
        sketches.keep_sketches(cat, "sketches", rows.where(F.to_date("snapshot_ts") == F.lit(day).cast("date")), "snapshot_ts", _FIELDS, _IDS)
    return rows, spark.read.parquet(cat.path("sketches"))


@query("a06_sketched_coverage", dense_sql(with_parts(" UNION ALL ".join(
    f"SELECT '{c}' AS field_name, count({c}) AS non_null_count, round(count({c})/count(*)*100,2) AS non_null_pct, round(CAST(min({c}) AS DOUBLE),6) AS min_val, round(CAST(max({c}) AS DOUBLE),6) AS max_val,"
    f" 1 AS median_in_bound FROM sil WHERE ts>=1704067200+86400" for c in _FIELDS))))
def sketched_coverage(spark, sf):
    """The last two days; the sketched median's exact rank lies in the bound."""
    rows, table = sketched(spark, sf)
    found = stored(sketches.coverage(sketches.over_days(table, "2024-01-02", "2024-01-03")).where(F.col("field_name").isin(_FIELDS)), "coverage")
    late = rows.where("snapshot_ts >= timestamp'2024-01-02 00:00:00'")
    values = late.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("double").alias("v")) for c in _FIELDS])))
    ranks = values.join(F.broadcast(found.select("field_name", "median_val")), "field_name").groupBy("field_name").agg(  # a row per field
        (F.count_if(F.col("v") < F.col("median_val")) / F.count("v")).alias("below"), (F.count_if(F.col("v") <= F.col("median_val")) / F.count("v")).alias("upto"))
    ok = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    return flat(found.join(ranks, "field_name").select("field_name", "non_null_count", "non_null_pct", "min_val", "max_val", ok.alias("median_in_bound")))


@query("a16_sketched_distinct", dense_sql(with_parts("""
SELECT 'icao' AS field_name, count(icao) AS n, count(DISTINCT icao) AS exact, 1 AS in_bound FROM sil UNION ALL SELECT 'callsign', count(callsign), count(DISTINCT callsign), 1 FROM sil""")))
def sketched_distinct(spark, sf):
    rows, table = sketched(spark, sf)
    exact = None
    for c in _IDS:
        one = rows.select(c).distinct().agg(F.lit(c).alias("field_name"), F.count(c).alias("exact"))
        exact = one if exact is None else exact.unionByName(one)
    found = sketches.coverage(sketches.over_days(table, "2024-01-01", "2024-01-03")).join(exact, "field_name")
    return flat(found.select("field_name", F.col("non_null_count").alias("n"), "exact",
                             (F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * sketches.DISTINCT_ERROR + 1).alias("in_bound")))


@query("h01_sketched_drift", dense_sql(with_parts(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) FILTER (ts<1704067200+86400) AS ref_rows, count({c}) FILTER (ts>=1704067200+172800) AS comp_rows, 1 AS near_exact FROM sil" for c in _FIELDS))))
def sketched_drift(spark, sf):
    """The third day against the first one, from sketches and from the rows."""
    rows, table = sketched(spark, sf)
    first, last = (sketches.over_days(table, d, d) for d in ("2024-01-01", "2024-01-03"))
    exact = health.psi(rows.where("snapshot_ts < timestamp'2024-01-02 00:00:00'"), rows.where("snapshot_ts >= timestamp'2024-01-03 00:00:00'"), _FIELDS)
    found = sketches.drift(first, last).join(exact.select("feature", F.col("psi").alias("exact")), "feature")
    return flat(found.select("feature", "ref_rows", "comp_rows", (F.abs(F.col("psi") - F.col("exact")) <= 0.02).alias("near_exact")))


# The live path over tables by day: what is read of three days is the last one.
def live_tables(spark, sf):
    """Tracks, congestion, predictions and flags of the dense reports, in day folders."""
    cat = Catalog(spark, fresh_path(spark, "live"))
    cat.replace("tracks", td.tracks_by_day(spark, sf + td.DENSE), "snapshot_ts", dealt=True)
    tracks = cat.read("tracks")
    cat.replace("congestion", traffic.congestion(tracks), "minute_ts")
    cat.append("predictions", td.predictions_of(tracks), "scored_at")
    cat.append("irregularity_flags", td.flags_of(events.irregularities(tracks, events.segment_summary(tracks, FIELD_ELEV_FT))), "scored_at")
    return cat


@query("s15_latest_run_by_day", dense_sql(SQL["s15_latest_run"]))
def latest_run(spark, sf):
    rows = live_tables(spark, sf).latest_run("predictions")
    return flat(rows.select("icao", "scored_at", "snapshot_ts", "predicted_eta_min", "predicted_touchdown_ts"))


@query("v01_arrival_picture_by_day", dense_sql(SQL["v01_arrival_picture"]))
def picture(spark, sf):
    return flat(views.arrival_picture(live_tables(spark, sf).latest_run("predictions")))


@query("v02_next_arrivals_by_day", dense_sql(SQL["v02_next_arrivals"]))
def next_arrivals(spark, sf):
    return flat(views.next_arrivals(live_tables(spark, sf).latest_run("predictions"), 50))


@query("v05_irregularities_by_day", dense_sql(SQL["v05_irregularities"]))
def irregularities(spark, sf):
    cat = live_tables(spark, sf)
    return flat(views.irregularities(cat.newest_day("irregularity_flags"), cat.latest_run("predictions"), AIRPORT))


@query("p19_fresh_flags_by_day", dense_sql(SQL["p19_fresh_flags"]))
def fresh_flags(spark, sf):
    cat = live_tables(spark, sf)
    return flat(views.current_flags(cat.newest_day("irregularity_flags"), cat.latest_run("predictions"), AIRPORT).select("icao", "kind", "scored_at"))


@query("p17_scoring_rows_by_day", dense_sql(SQL["p17_scoring_rows"]))
def scoring_rows(spark, sf):
    cat = live_tables(spark, sf)
    rows = features.scoring_rows(cat.recent("tracks", "snapshot_ts", 20), traffic.common_ring_inbound(cat.recent("congestion", "minute_ts", 60)))
    return flat(rows.select("icao", "snapshot_ts", "dist_to_apt_nm", "airport_inbound_count"))


@query("g22_live_flags_by_day", dense_sql(SQL["g22_live_flags"]))
def live_flags(spark, sf):
    rows = events.live_flags(live_tables(spark, sf).recent("tracks", "snapshot_ts", 30), AIRPORT)
    return flat(rows.select("icao", "callsign", "snapshot_ts", "dist_to_apt_nm", "alt_ft", "kind", "severity", "detail"))

"""Source, sink and stream queries: envelopes made from the events, landed, read back and refined."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.constants import AIRPORT, AIRPORT_LAT, AIRPORT_LON, FIELD_ELEV_FT
from glidepath.operators import events, learn, traffic
from glidepath.operators.tracks import enrich_tracks
from glidepath.session import fresh_path
from glidepath.sources import catalog, envelopes, history
from glidepath.streaming import dealing, medallion, stateful
from glidepath.workbench.registry import flat, query
from glidepath.workbench.sqlparts import bearing, nm, part, with_parts

_REPORT = """named_struct(
 'hex', CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('h', user_id) END, 'flight', concat(' FL', user_id, ' '), 'r', concat('N', user_id),
 't', element_at(array('A321', 'B738', 'B763', 'C172', 'CRJ9'), cast(user_id % 5 + 1 AS int)), 'category', 'A3',
 'lat', CASE WHEN event_id % 13 <> 0 THEN 33e0 + (user_id % 17) / 10e0 END, 'lon', CASE WHEN event_id % 13 <> 0 THEN -84e0 - (user_id % 11) / 10e0 END,
 'alt_baro', CASE event_id % 7 WHEN 0 THEN 'ground' WHEN 1 THEN 'junk' WHEN 2 THEN 'GROUND' ELSE cast(event_id % 40000 AS string) END,
 'alt_geom', event_id % 41000, 'gs', value, 'track', cast((event_id * 7) % 360 AS double),
 'baro_rate', CASE WHEN event_id % 3 <> 0 THEN event_id % 5000 - 2500 END, 'geom_rate', CASE WHEN event_id % 4 <> 0 THEN event_id % 3000 - 1500 END,
 'nav_altitude_mcp', 3000, 'squawk', '1200', 'emergency', CASE WHEN event_id % 29 = 0 THEN 'general' END, 'nic', 8, 'rc', 186, 'seen', 0.5e0,
 'seen_pos', 1.5e0, 'mag_heading', CASE WHEN event_id % 6 = 0 THEN 10e0 END)"""


def envelope_json(spark, sf, unit: int = 1000, extra: dict[str, str] | None = None, where: str = "true"):
    """One envelope text per event: live ones in milliseconds (unit 1000), archive ones in seconds (unit 1); `extra` fields by expression."""
    ev = td.table(spark, sf, "events").withColumn("ms", F.expr("unix_micros(cast(ts AS timestamp)) div 1000")).where(where)
    ev = ev.withColumn("rep", F.expr(_REPORT))
    for name, value in (extra or {}).items():
        ev = ev.withColumn("rep", F.col("rep").withField(name, F.expr(value)))
    twin = F.col("rep").withField("hex", F.concat(F.lit("x"), F.col("user_id").cast("string"))).withField(
        "lat", F.lit(None).cast("double"))
    reps = F.when(F.col("event_id") % 17 == 0, F.expr("filter(array(rep), r -> false)")).when(
        F.col("event_id") % 4 == 0, F.array("rep", twin)).otherwise(F.array("rep"))
    other = F.col("event_id") % 5 == 0
    none = F.lit(None).cast("int")
    capture = F.struct(
        F.lit(AIRPORT).alias("apt_icao"), F.lit(AIRPORT_LAT).alias("apt_lat"), F.lit(AIRPORT_LON).alias("apt_lon"), F.lit(250).alias("radius_nm"),
        F.lit("live").alias("source"), F.to_date("ts").cast("string").alias("src_date"))
    now = F.col("ms") if unit == 1000 else F.col("ms") / 1000
    live = ev.where(~other).select(F.to_json(F.struct(now.alias("now"), none.alias("total"), reps.alias("ac"), capture.alias("capture"))).alias("value"))
    old = ev.where(other).select(F.to_json(F.struct(now.alias("now"), none.alias("total"), reps.alias("aircraft"), capture.alias("capture"))).alias("value"))
    return live.unionByName(old)


def landed(spark, sf, copies: int = 1, unit: int = 1000, **kw) -> str:
    """Writes the envelopes, one per line, to a new folder."""
    rows = envelope_json(spark, sf, unit, **kw)
    path = fresh_path(spark, "landing")
    for _ in range(copies):
        rows.write.mode("append").text(path)
    return path


def read_landed(spark, path, **kw):
    # the text sink names its files *.txt
    return envelopes.read_envelopes(spark, path, one_per_file=False, pattern="*.txt", **kw)


part("rp_one", """
SELECT event_id, user_id, epoch_us(ts)//1000 AS ms, CAST(CAST(ts AS DATE) AS VARCHAR) AS src_date, CASE WHEN event_id%101=0 THEN NULL ELSE 'h'||user_id END AS icao,
 'FL'||user_id AS callsign, CASE WHEN event_id%13<>0 THEN 33e0+(user_id%17)/10e0 END AS lat, CASE WHEN event_id%13<>0 THEN -84e0-(user_id%11)/10e0 END AS lon,
 CASE event_id%7 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE event_id%40000 END AS alt_ft, event_id%41000 AS alt_geom_ft, value AS gs_kt, CAST((event_id*7)%360 AS DOUBLE) AS track_deg,
 CASE WHEN event_id%3<>0 THEN CAST(event_id%5000-2500 AS DOUBLE) END AS baro, CASE WHEN event_id%4<>0 THEN CAST(event_id%3000-1500 AS DOUBLE) END AS geom,
 CASE WHEN event_id%29=0 THEN 'general' ELSE 'none' END AS emergency FROM events WHERE event_id%17<>0
""")
part("rp", "SELECT * FROM rp_one UNION ALL SELECT * REPLACE ('x'||user_id AS icao, NULL AS lat) FROM rp_one WHERE event_id%4=0")
part("rp_geo", f"""
SELECT *, CASE WHEN lat IS NOT NULL THEN {nm('lat','lon','33.6407e0','(-84.4277e0)')} END AS dist, CASE WHEN lat IS NOT NULL THEN {bearing('lat','lon','33.6407e0','(-84.4277e0)')} END AS brg,
 coalesce(baro,geom) AS vr, alt_ft<=0 AND gs_kt<50 AS gnd FROM rp WHERE icao IS NOT NULL
""")
_SILVER = """SELECT icao, ms AS snapshot_ms, callsign, CAST(alt_ft AS BIGINT) AS alt_ft, round(gs_kt,6) AS gs_kt, emergency, CAST(lat IS NOT NULL AS INT) AS has_position,
 round(dist,6) AS dist_to_apt_nm, round(least(abs(fmod(track_deg-brg,360e0)),360e0-abs(fmod(track_deg-brg,360e0))),6) AS heading_err_deg, vr AS vertical_rate_fpm,
 CASE WHEN baro IS NOT NULL THEN 'baro' WHEN geom IS NOT NULL THEN 'geom' END AS vertical_rate_src, CAST(gnd AS INT) AS is_grounded,
 CASE WHEN gnd THEN 'ground' WHEN vr>400 THEN 'climb' WHEN vr<-400 THEN 'descent' WHEN alt_ft>=18000 THEN 'cruise' WHEN vr IS NOT NULL THEN 'level' ELSE 'unknown' END AS phase FROM rp_geo"""


def silver_view(silver):
    return flat(silver.select(
        "icao", F.unix_millis("snapshot_ts").alias("snapshot_ms"), "callsign", "alt_ft", "gs_kt", "emergency", "has_position", "dist_to_apt_nm",
        "heading_err_deg", "vertical_rate_fpm", "vertical_rate_src", "is_grounded", "phase"))


@query("s04_exploded_reports", with_parts("SELECT icao, ms AS snapshot_ms, alt_geom_ft AS alt_geom, 'KATL' AS apt_icao FROM rp"))
def exploded(spark, sf):
    bronze = envelopes.to_bronze(read_landed(spark, landed(spark, sf)))
    return flat(bronze.select(F.col("report.hex").alias("icao"), F.unix_millis("snapshot_ts").alias("snapshot_ms"),
                              F.col("report.alt_geom").cast("bigint").alias("alt_geom"), "apt_icao"))


@query("s05_peek", with_parts("SELECT src_date, count(*) AS n FROM rp GROUP BY 1"))
def peek(spark, sf):
    return flat(envelopes.peek(read_landed(spark, landed(spark, sf))))


@query("s02_new_fields", with_parts("SELECT 'mag_heading' AS field, count(*) AS reports FROM rp WHERE event_id%6=0"))
def new_fields(spark, sf):
    return flat(envelopes.new_fields(envelopes.to_bronze(read_landed(spark, landed(spark, sf)))))


@query("s02_widened_reports", with_parts("SELECT icao, ms AS snapshot_ms, CAST(10 AS DOUBLE) AS mag_heading FROM rp WHERE event_id%6=0"))
def widened_reports(spark, sf):
    landing = read_landed(spark, landed(spark, sf))
    fields = [r["field"] for r in envelopes.new_fields(envelopes.to_bronze(landing)).select("field").collect()]  # names of fields
    schema = envelopes.widened(envelopes.REPORT_SCHEMA, dict.fromkeys(fields, "double"))
    rows = envelopes.to_bronze(landing, report_schema=schema).where(F.col("report.mag_heading").isNotNull())
    return flat(rows.select(F.col("report.hex").alias("icao"), F.unix_millis("snapshot_ts").alias("snapshot_ms"), "report.mag_heading"))


# Two loads: the second one brings a text, a nested field and a list, has decimals where the first had whole numbers, and words where it had numbers.
_FIRST = {"ias": "event_id % 300", "grade": "CASE WHEN event_id % 2 = 0 THEN event_id % 7 END", "wind": "named_struct('dir', event_id % 360)"}
_SECOND = {"ias": "event_id % 300 + 0.5e0", "grade": "CASE WHEN event_id % 2 = 0 THEN concat('g', event_id % 7) END",
           "wind": "named_struct('dir', event_id % 360, 'speed', event_id % 50 + 0.25e0)", "note": "CASE WHEN event_id % 3 = 0 THEN concat('n', user_id) END",
           "modes": "array(event_id % 5, event_id % 9)"}
part("ev_load", "SELECT *, (ms-1704067200000)//864000000<2 AS early FROM rp")


def evolving(spark, sf):
    """Bronze with variants after both loads, each appended to one table, and the register they leave."""
    cat, register = catalog.Catalog(spark, fresh_path(spark, "catalog")), {}
    early = f"(ms - {td.EPOCH}000) div 864000000 < 2"
    for extra, where in ((_FIRST, early), (_SECOND, f"NOT {early}")):
        load = envelopes.with_variant(envelopes.to_bronze(read_landed(spark, landed(spark, sf, extra=extra, where=where))))
        cat.append("bronze", load, "snapshot_ts")
        register = envelopes.register_fields(register, load)
    return cat.read("bronze"), register


@query("s02_typed_fields", with_parts("""
SELECT 'mag_heading' AS field, 'double' AS type, count(*) FILTER (event_id%6=0) AS reports FROM ev_load UNION ALL SELECT 'ias', 'double', count(*) FROM ev_load
UNION ALL SELECT 'grade', 'variant', count(*) FILTER (event_id%2=0) FROM ev_load UNION ALL SELECT 'wind', 'struct<dir:bigint,speed:double>', count(*) FROM ev_load
UNION ALL SELECT 'note', 'string', count(*) FILTER (event_id%3=0 AND NOT early) FROM ev_load UNION ALL SELECT 'modes', 'array<bigint>', count(*) FILTER (NOT early) FROM ev_load"""))
def typed_fields(spark, sf):
    bronze, register = evolving(spark, sf)
    types = spark.createDataFrame([(n, t.simpleString()) for n, t in register.items()], "field string, type string")
    return flat(envelopes.field_types(bronze).drop("type").join(F.broadcast(types), "field").select("field", "type", "reports"))  # a row per field


@query("s02_typed_reports", with_parts("""
SELECT icao, ms AS snapshot_ms, CASE WHEN event_id%6=0 THEN 10e0 END AS mag_heading, event_id%300+CASE WHEN early THEN 0e0 ELSE 0.5e0 END AS ias,
 CASE WHEN event_id%2=0 THEN CASE WHEN early THEN '' ELSE 'g' END||(event_id%7) END AS grade, event_id%360 AS wind_dir, CASE WHEN NOT early THEN event_id%50+0.25e0 END AS wind_speed,
 CASE WHEN event_id%3=0 AND NOT early THEN 'n'||user_id END AS note, CASE WHEN NOT early THEN event_id%5+event_id%9 END AS modes_sum FROM ev_load"""))
def typed_reports(spark, sf):
    rows = envelopes.evolved(*evolving(spark, sf))
    return flat(rows.select(
        F.col("report.hex").alias("icao"), F.unix_millis("snapshot_ts").alias("snapshot_ms"), "mag_heading", "ias", F.col("grade").cast("string").alias("grade"),
        F.col("wind.dir").alias("wind_dir"), F.col("wind.speed").alias("wind_speed"), "note", (F.col("modes")[0] + F.col("modes")[1]).alias("modes_sum")))


@query("p01_silver", with_parts(_SILVER))
def silver(spark, sf):
    return silver_view(envelopes.to_silver(envelopes.to_bronze(read_landed(spark, landed(spark, sf)))))


@query("r02_deduplicated", with_parts(_SILVER))
def deduplicated(spark, sf):
    return silver_view(envelopes.to_silver(envelopes.to_bronze(read_landed(spark, landed(spark, sf, copies=2)))))


@query("p02_altitudes", with_parts("""
SELECT CASE event_id%7 WHEN 0 THEN 'ground' WHEN 1 THEN 'junk' WHEN 2 THEN 'GROUND' ELSE 'number' END AS kind, count(alt_ft) AS any_case,
 count(CASE WHEN event_id%7<>2 THEN alt_ft END) AS exact_case, CAST(sum(alt_ft) AS BIGINT) AS total_ft FROM rp GROUP BY 1"""))
def altitudes(spark, sf):
    text = F.col("report.alt_baro")
    rows = envelopes.to_bronze(read_landed(spark, landed(spark, sf))).select(
        F.when(text.rlike("^[0-9]+$"), "number").otherwise(text).alias("kind"), envelopes.altitude_ft(text).alias("a"),
        envelopes.altitude_ft(text, any_case=False).alias("b"))
    return flat(rows.groupBy("kind").agg(F.count("a").alias("any_case"), F.count("b").alias("exact_case"), F.sum("a").alias("total_ft")))


_BROKEN_RULES = """
SELECT count(*) AS "rows", count(*) FILTER (icao IS NULL) AS has_icao, CAST(0 AS BIGINT) AS plausible_altitude, count(*) FILTER (NOT (gs_kt BETWEEN 0 AND 700)) AS plausible_groundspeed FROM rp"""


@query("p04_expectations", with_parts(_BROKEN_RULES))
def expectations(spark, sf):
    rows = envelopes.typed(envelopes.to_bronze(read_landed(spark, landed(spark, sf))))
    return flat(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("icao").isNull()).alias("has_icao"), *envelopes.violation_counts()))


part("th_pick", """
SELECT ms//60000 AS m, min(ms) AS ms FROM (SELECT epoch_us(ts)//1000 AS ms FROM events) q
WHERE (ms//1000)%60<=25 AND ceil(((ms//60000)*60%86400)/90.0)*90<(ms//60000)*60%86400+60 AND ((ms//3600000)%24>=22 OR (ms//3600000)%24<=4) GROUP BY 1
""")


@query("s07_thinned", with_parts("""
SELECT e.event_id, strftime(make_timestamp(p.m*60000000),'%Y%m%d_%H%M') AS target_tag FROM th_pick p JOIN events e ON epoch_us(e.ts)//1000=p.ms"""))
def thinned(spark, sf):
    rows = td.table(spark, sf, "events").select("event_id", F.timestamp_millis(F.expr("unix_micros(cast(ts AS timestamp)) div 1000")).alias("snapshot_ts"))
    return flat(history.thin_snapshots(rows, interval_s=90, hours=(22, 4)).select("event_id", "target_tag"))


@query("s06_conformed", with_parts(f"""
SELECT icao, r.ms AS snapshot_ms, src_date, strftime(make_timestamp(p.m*60000000),'%Y%m%d_%H%M') AS target_tag, 'backfill' AS source FROM rp r JOIN th_pick p ON p.ms=r.ms
WHERE lat IS NOT NULL AND {nm('lat','lon','33.6407e0','(-84.4277e0)')}<=40"""))
def conformed(spark, sf):
    rows = history.conform_history(read_landed(spark, landed(spark, sf, unit=1)), AIRPORT_LAT, AIRPORT_LON, AIRPORT, radius_nm=40,
                                   interval_s=90, hours=(22, 4))
    return flat(rows.select(F.col("report.hex").alias("icao"), F.unix_millis("snapshot_ts").alias("snapshot_ms"), "src_date", "target_tag", "source"))


@query("s08_worklist", """
SELECT strftime(make_timestamp(m*60000000),'%Y%m%d_%H%M') AS target_tag, m*60 AS target_s FROM (SELECT DISTINCT d*1440+(s//60) AS m FROM (SELECT unnest(range(0,86400,60)) AS s) a
 CROSS JOIN (SELECT DISTINCT epoch_us(ts)//86400000000 AS d FROM events) b) q WHERE m NOT IN (SELECT epoch_us(ts)//60000000 FROM events)""")
def worklist(spark, sf):
    ev = td.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    wanted = history.targets(ev.select(F.to_date("ts").alias("date")).distinct())
    written = ev.select(F.date_format("ts", "yyyyMMdd_HHmm").alias("target_tag"))
    return flat(history.worklist(wanted, written))


@query("s09_landed_layout", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, strftime(ts,'%H') AS hh, count(*) AS n FROM events GROUP BY 1,2""")
def layout(spark, sf):
    path = fresh_path(spark, "layout")
    rows = td.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("snapshot_ts"))
    history.land(rows, path, files=2)
    back = spark.read.option("basePath", path).schema("event_id bigint, dt string, hh string").json(path)
    return flat(back.groupBy("dt", "hh").agg(F.count(F.lit(1)).alias("n")))


@query("s11_window_replaced", with_parts("""
SELECT seg_id, icao, ts AS snapshot_ts, CASE WHEN ts>=1704067200+7200 THEN 'new' ELSE 'old' END AS build FROM trk"""))
def window_replaced(spark, sf):
    cat = catalog.Catalog(spark, fresh_path(spark, "catalog"))
    rows = td.tracks(spark, sf).select("seg_id", "icao", "snapshot_ts")
    cat.replace("tracks", rows.withColumn("build", F.lit("old")), "snapshot_ts", ["icao", "snapshot_ts"])
    cat.replace_window("tracks", rows.withColumn("build", F.lit("new")), "snapshot_ts", "2024-01-01 02:00:00", ["icao", "snapshot_ts"])
    return flat(cat.read("tracks"))


@query("s12_widened_append", """
SELECT event_id, NULL::DOUBLE AS value FROM events WHERE event_type='view' UNION ALL SELECT event_id, round(value,6) FROM events WHERE event_type<>'view'""")
def widened(spark, sf):
    cat = catalog.Catalog(spark, fresh_path(spark, "catalog"))
    ev = td.table(spark, sf, "events")
    cat.append("runs", ev.where(F.col("event_type") == "view").select("event_id"))
    cat.append("runs", ev.where(F.col("event_type") != "view").select("event_id", "value"))
    return flat(cat.read("runs", widened=True))


@query("s13_pinned_version", "SELECT event_type, count(*) AS n FROM events WHERE event_type<>'view' GROUP BY 1")
def pinned(spark, sf):
    cat = catalog.Catalog(spark, fresh_path(spark, "catalog"))
    ev = td.table(spark, sf, "events").select("event_id", "event_type")
    cat.append_load("log", ev.where(F.col("event_type") != "view"), 1)
    cat.append_load("log", ev, 2)
    return flat(cat.read_load("log", 1).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("s14_reset", "SELECT 'history' AS \"table\", count(*) AS n FROM events UNION ALL SELECT 'live', 0")
def reset(spark, sf):
    cat = catalog.Catalog(spark, fresh_path(spark, "catalog"))
    ev = td.table(spark, sf, "events").select("event_id", "event_type")
    cat.replace("history", ev)
    cat.replace("live", ev)
    cat.reset(["live"], ["history"])
    counts = [cat.read(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name in ("history", "live")]
    return flat(counts[0].unionByName(counts[1]))


@query("s17_feedback", """
SELECT i.conv_id, i.turn, i.text AS answer, CASE WHEN u.turn IS NOT NULL THEN 'up'||u.turn END AS feedback FROM (SELECT * FROM conversations WHERE role='assistant') i
LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role='user') u ON u.conv_id=i.conv_id AND u.turn=i.turn+1""")
def feedback(spark, sf):
    conv = td.table(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    turns = conv.where(F.col("role") == "assistant").select(
        key.alias("turn_id"), "conv_id", "turn", F.col("text").alias("answer"), F.lit(None).cast("string").alias("feedback"),
        F.timestamp_seconds(F.col("turn")).alias("at"))
    asked = conv.where(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("turn_id"), F.concat(F.lit("up"), F.col("turn").cast("string")).alias("feedback"),
        F.timestamp_seconds(F.col("turn")).alias("at"))
    known = asked.join(turns.select("turn_id"), "turn_id", "left_semi")
    return flat(catalog.merge_updates(turns, known, "turn_id", "at").select("conv_id", "turn", "answer", "feedback"))


@query("u03_missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing(spark, sf):
    return flat(catalog.missing_keys(td.table(spark, sf, "customer"), td.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]))


@query("u03_missing_finished", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F' AND o_orderkey%3=0)")
def missing_finished(spark, sf):
    done = td.table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").withColumnRenamed("o_custkey", "c_custkey")
    return flat(catalog.missing_keys(td.table(spark, sf, "customer"), done, ["c_custkey"]))


# Streams: the same envelopes through two triggered hops; the result is the batch Silver.
def streamed(spark, sf, copies=1, max_files=None):
    path, root = landed(spark, sf, copies), fresh_path(spark, "medallion")
    bronze = medallion.with_day(envelopes.to_bronze(read_landed(spark, path, streaming=True, max_files=max_files)))
    medallion.write_available(bronze, f"{root}/bronze", f"{root}/_checkpoints/bronze", ["dt"])
    return root, bronze.schema


@query("r01_two_hop_stream", with_parts(_SILVER))
def two_hop(spark, sf):
    root, schema = streamed(spark, sf)
    return silver_view(medallion.run_silver(spark, root, schema))


@query("r04_stream_quality", with_parts(_BROKEN_RULES))
def stream_quality(spark, sf):
    root, schema = streamed(spark, sf)
    counts = medallion.observed_counts(medallion.refine(spark, root, schema)[1])
    return flat(spark.createDataFrame([counts]))


# Reports older than the last hour come by the batch path, twice; the stream takes the others.
@query("r03_backfill", with_parts(_SILVER))
def backfill(spark, sf):
    bronze, root = envelopes.to_bronze(read_landed(spark, landed(spark, sf))), fresh_path(spark, "medallion")
    newest = bronze.agg(F.unix_seconds(F.max("snapshot_ts")).alias("s")).first()["s"]
    live, old = medallion.split_by_age(bronze, newest, 3600)
    day = medallion.with_day(live)
    day.write.partitionBy("dt").parquet(f"{root}/bronze")
    silver = medallion.run_silver(spark, root, day.schema)
    medallion.run_backfill(spark, root, silver, old)
    return silver_view(medallion.run_backfill(spark, root, silver, old))


# Three loads by time, each one batch: what has arrived is dealt before the next one comes. A tenth of the first one's reports come with the last one, long after the watermark;
# some reports of the second come again with the third.
_LOADS = """CASE WHEN (ms-1704067200000)//864000000<1 THEN CASE WHEN event_id%10=0 THEN 2 ELSE 0 END WHEN (ms-1704067200000)//864000000<2 THEN 1 ELSE 2 END"""


def dealt_loads(spark, sf, deal):
    """Bronze loads by time with late and repeated reports. `deal(root, schema, n)` is called when load `n` has arrived; the root and the schema."""
    root = fresh_path(spark, "dealt")
    bronze = medallion.with_day(envelopes.to_bronze(read_landed(spark, landed(spark, sf))))
    bronze = catalog.stored(bronze.withColumn("event_id", F.col("report.alt_geom").cast("bigint")), "bronze")
    ten_days = F.floor((F.unix_seconds("snapshot_ts") - td.EPOCH) / 864000)
    load = F.when(ten_days < 1, F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)).when(ten_days < 2, 1).otherwise(2)
    again = bronze.where((load == 1) & (F.col("event_id") % 7 == 0)).withColumn("load", F.lit(2))
    every = bronze.withColumn("load", load).unionByName(again).drop("event_id")
    schema = every.drop("load").schema
    for n in range(3):
        every.where(F.col("load") == n).drop("load").write.mode("append").parquet(f"{root}/bronze")
        deal(root, schema, n)
    return root, schema


def dealt_silver(spark, root, schema):
    wanted = envelopes.to_silver(spark.createDataFrame([], schema).drop("dt")).schema
    return dealing.silver_of(spark, root, wanted)


def dealt(spark, sf):
    return dealt_loads(spark, sf, lambda root, schema, n: dealing.run_dealt(spark, root, schema))


@query("r03_late_rows", with_parts(_SILVER))
def late_rows(spark, sf):
    return silver_view(dealt_silver(spark, *dealt(spark, sf)))


def stopped_once(spark, sf):
    """Loads of which the second one's run stops between the batch's write and its commit; another run goes on."""
    def stop(batch):
        if batch == 1:
            raise RuntimeError("stopped before the commit")

    def deal(root, schema, n):
        if n == 1:
            try:
                dealing.run_dealt(spark, root, schema, before_commit=stop)
            except Exception as e:
                if "stopped before the commit" not in str(e):
                    raise
            else:
                raise AssertionError("the run was not stopped")
        dealing.run_dealt(spark, root, schema)

    return dealt_loads(spark, sf, deal)


@query("r05_replayed", with_parts(_SILVER))
def replayed(spark, sf):
    return silver_view(dealt_silver(spark, *stopped_once(spark, sf)))


# alt_geom stands for the event id, which the fixture takes modulo 41000.
@query("r05_ledger", with_parts(f"""
SELECT CAST(load AS BIGINT) AS batch, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late_rows FROM (
 SELECT load, load=2 AND (ms-1704067200000)//864000000<1 AS late FROM (SELECT ms, {_LOADS.replace('event_id', 'alt_geom_ft')} AS load FROM rp WHERE icao IS NOT NULL) q) q GROUP BY 1"""))
def replay_ledger(spark, sf):
    root, _ = stopped_once(spark, sf)
    return flat(dealing.ledger(spark, root).select("batch", "on_time", "late_rows"))


@query("s03_lineage", with_parts("SELECT CAST(1 AS BIGINT) AS has_file, CAST(1 AS BIGINT) AS has_time, count(*) AS n FROM rp"))
def lineage(spark, sf):
    root, schema = streamed(spark, sf)
    rows = spark.read.schema(schema).parquet(f"{root}/bronze")
    return flat(rows.groupBy(F.col("_ingest_file").contains("landing").cast("bigint").alias("has_file"),
                             F.col("_ingest_ts").isNotNull().cast("bigint").alias("has_time")).agg(F.count(F.lit(1)).alias("n")))


def positions_stream(spark, sf):
    """The position reports as a stream over a written table."""
    path = fresh_path(spark, "positions")
    rows = td.positions(spark, sf)
    # files in time order, so that a file never lies behind the watermark of the one before
    rows.repartitionByRange("snapshot_ts").sortWithinPartitions("snapshot_ts").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(spark, df, name):
    root = fresh_path(spark, name)
    medallion.write_available(df, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/out")


# A triggered run ends with the watermark 15 minutes before the newest report.
part("mark", "SELECT max(ts)-900 AS m FROM sil")


@query("r06_windowed_congestion", with_parts("SELECT * FROM cong WHERE minute_ts+60<=(SELECT m FROM mark)"))
def windowed(spark, sf):
    """Every measure of a01 from a stream of tracks."""
    path = fresh_path(spark, "tracks")
    rows = td.tracks(spark, sf)
    rows.repartitionByRange("snapshot_ts").sortWithinPartitions("snapshot_ts").write.parquet(path)
    return flat(drained(spark, medallion.windowed_measures(spark.readStream.schema(rows.schema).parquet(path)), "congestion"))


@query("r06_batch_measures", with_parts("SELECT * FROM cong"))
def batch_measures(spark, sf):
    return flat(medallion.windowed_measures(td.tracks(spark, sf)))


@query("r06_batch_congestion", with_parts("""
SELECT minute_ts, apt_icao, ring, n_aircraft FROM cong"""))
def windowed_batch(spark, sf):
    return flat(medallion.windowed_congestion(td.positions(spark, sf)))


@query("r07_session_segments", with_parts("""
SELECT icao, min(ts) AS seg_start_ts, max(ts) AS seg_end_ts, count(*) AS n_reports, round(min(dist_to_apt_nm),6) AS min_dist_nm FROM (
 SELECT *, sum(CASE WHEN gap<=180 THEN 0 ELSE 1 END) OVER (PARTITION BY icao ORDER BY ts) AS grp FROM paired) q GROUP BY icao, grp HAVING max(ts)+180<=(SELECT m FROM mark)"""))
def sessions(spark, sf):
    return flat(drained(spark, medallion.session_segments(positions_stream(spark, sf)), "sessions"))


@query("r08_stateful_tracks", with_parts("""
SELECT icao, ts AS snapshot_ts, seg_start AS seg_start_ts, dt_s, round(dist_to_apt_nm,6) AS dist_to_apt_nm, round(closure_kt,6) AS closure_kt, turn_deg, round(vrate_fpm,6) AS vrate_fpm,
 CAST(inbound_flag AS INT) AS inbound_flag FROM trk WHERE ts<=(SELECT m FROM mark)"""))
def stateful_tracks(spark, sf):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        return flat(drained(spark, stateful.stateful_tracks(positions_stream(spark, sf)), "stateful"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# Learning. The fixture spans three hours, so an hour stands for a day.
def learning_rows(spark, sf):
    rows = catalog.stored(td.training(spark, sf).withColumn("obs_day", F.hour("snapshot_ts")), "training")
    return learn.split_by_day(rows, "obs_day", 2)


def fitted(spark, sf, **kw):
    rows = learning_rows(spark, sf)
    model, info = learn.train_eta(rows, n_params=kw.get("n_params", 2), max_trees=kw.get("max_trees", 10))
    return model, rows


@query("m05_holdout_report")
def holdout(spark, sf):
    model, rows = fitted(spark, sf)
    return flat(learn.holdout_report(model, rows.where(F.col("part") == "test"))[0])


@query("m06_importances")
def importances(spark, sf):
    model, rows = fitted(spark, sf)
    return flat(learn.importances(model, rows))


@query("m08_scored_batch")
def scored(spark, sf):
    from glidepath.operators import features
    model, _ = fitted(spark, sf)
    live = features.scoring_rows(td.tracks(spark, sf), td.inbound(spark, sf))
    return flat(learn.score_batch(model, live, 1, F.timestamp_seconds(F.lit(td.EPOCH))))


@query("m15_feature_effects")
def effects(spark, sf):
    model, rows = fitted(spark, sf)
    return flat(learn.feature_effects(model, rows.where(F.col("part") == "test"), ["seg_id", "snapshot_ts"]))


@query("m09_hold_risk")
def hold_risk(spark, sf):
    ready = catalog.stored(td.tracks(spark, sf), "tracks")
    from glidepath.operators import features
    counted = features.with_inbound_count(ready, traffic.common_ring_inbound(traffic.congestion(ready)))
    held = events.holding(events.segment_summary(ready, FIELD_ELEV_FT), min_n=2, min_spread=0.0)
    rows = catalog.stored(learn.hold_rows(counted, held), "hold_rows")
    model, info = learn.train_hold_risk(rows, min_positive_groups=1, folds=2, trees=3)
    return flat(learn.hold_risk(model, rows).select("seg_id", "snapshot_ts", "is_held", "risk"))

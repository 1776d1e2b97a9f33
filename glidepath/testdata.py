"""Views over the test tables that have the shape of the engine's own tables.

`positions` turns the `events` table into position reports around one airport: 30 days of events
are compressed into three hours, so that the 180 s gap rule yields real segments. One user in ten
circles, one in ten approaches and climbs out, the others fly in and land every 45 minutes.

A folder named with `DENSE` behind it is read as the same events in another time: three mornings from half past four
on, ten days of events in each, and a report every 30 seconds for six minutes after every event. Segments then
span laps, approaches and the borders of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidepath.constants import AIRPORT, AIRPORT_LAT, AIRPORT_LON, FIELD_ELEV_FT
from glidepath.operators import demand, events, features, traffic
from glidepath.operators.tracks import enrich_tracks, point_features
from glidepath.sources.catalog import stored

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC, start of the events table
DENSE = "#dense"
REPORTS, STEP_S = 12, 30  # reports of a dense event, and the seconds between them


def _once(view):
    """Builds a view's plan once per session and folder. Only the plan is kept, never its rows."""
    plans: dict[tuple[int, str, str], tuple[SparkSession, DataFrame]] = {}

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (id(spark), spark.sparkContext.applicationId, sf_dir)
        if at not in plans:
            plans[at] = (spark, view(spark, sf_dir))  # the session is held, so its id is not reused
        return plans[at][1]
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.removesuffix(DENSE)}/{name}.parquet")


def _seconds(sf_dir: str) -> Column:
    """The compressed second that an event gives a report at, or the first one of a dense event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH * 1_000_000)
    if not sf_dir.endswith(DENSE):
        return F.floor(micros / F.lit(240_000_000)).cast("bigint")
    ten_days = 864_000_000_000
    return (F.floor(micros / ten_days) * 86400 + 16200 + F.floor((micros % ten_days) / 80_000_000)).cast("bigint")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `t`, the compressed second, one row per (user, t): the lowest event id wins.

    The reports of dense events lie half a minute apart, so only events whose first seconds agree modulo `STEP_S` can meet: events are
    dealt by that remainder and repeated behind the shuffle, not before it. An event meets the few others of its reach there, so its
    reports that a lower id takes are never made.
    """
    alarm = F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0)
    found = table(spark, sf_dir, "events").select("event_id", "user_id", _seconds(sf_dir).alias("t"), alarm.alias("alarm"))
    if sf_dir.endswith(DENSE):
        found = found.withColumn("_rest", F.pmod("t", F.lit(STEP_S))).repartition("user_id", "_rest")
    keys = [c for c in ("user_id", "_rest", "t") if c in found.columns]
    one = found.groupBy(*keys).agg(F.min("event_id").alias("event_id"), F.min_by("alarm", "event_id").alias("alarm"))
    return _repeated(one) if sf_dir.endswith(DENSE) else one


def _repeated(events: DataFrame) -> DataFrame:
    """The reports of events that are one per (user, t): where reports of two events meet, that of the lowest id stays, an event without id last."""
    reach = (REPORTS - 1) * STEP_S
    around = Window.partitionBy("user_id", "_rest").orderBy("t").rangeBetween(-reach, reach)
    own = F.struct(F.col("event_id").isNull().alias("none"), F.coalesce("event_id", F.lit(0)).alias("id"), F.col("t").alias("at"))
    near = events.withColumns({"_own": own, "_near": F.collect_list(own).over(around)})
    times = F.sequence(F.col("t"), F.col("t") + reach, F.lit(STEP_S).cast("bigint"))

    def taken(at: Column) -> Column:
        return F.exists("_near", lambda o: (o["at"] <= at) & (o["at"] >= at - reach) & (o < F.col("_own")))
    # an event without a time has one report without a time
    times = F.when(F.col("t").isNull(), F.array(F.col("t"))).when(F.size("_near") == 1, times).otherwise(F.filter(times, lambda at: ~taken(at)))
    return near.select("event_id", "user_id", "alarm", F.explode(times).alias("t")).select("user_id", "t", "event_id", "alarm")


_KINEMATICS = f"""
SELECT *, CASE WHEN kind = 'H' THEN 30e0 WHEN kind = 'G' AND c < 2000 THEN 40e0 * (2000 - c) / 2000e0
               WHEN kind = 'G' THEN 15e0 * (c - 2000) / 700e0 ELSE 100e0 * (2700 - c) / 2700e0 END AS r,
       kind = 'G' AND c >= 2000 AS climbing
FROM (SELECT *, (t + 97 * user_id) % 2700 AS c, (user_id * 29) % 360 AS brg, (t * 3) % 360 AS hang,
             CASE WHEN user_id % 10 = 0 THEN 'H' WHEN user_id % 10 = 1 THEN 'G' ELSE 'A' END AS kind FROM {{d}})
"""

_REPORT = {
    "icao": "concat('u', user_id)",
    "callsign": "concat('ABC', user_id)",
    "registration": "concat('N', user_id)",
    "ac_type": "element_at(array('A321', 'B738', 'B763', 'C172', 'CRJ9'), cast(user_id % 5 + 1 AS int))",
    "category": "CASE WHEN user_id % 5 = 2 THEN 'A5' ELSE 'A3' END",
    "apt_icao": f"'{AIRPORT}'",
    "snapshot_ts": f"timestamp_seconds({EPOCH} + t)",
    "lat": f"CASE WHEN kind = 'H' THEN {AIRPORT_LAT}e0 + (r * cos(radians(brg)) + 4 * cos(radians(hang))) / 60"
           f" ELSE {AIRPORT_LAT}e0 + r * cos(radians(brg)) / 60 END",
    "lon": f"CASE WHEN kind = 'H' THEN {AIRPORT_LON}e0 + (r * sin(radians(brg)) + 4 * sin(radians(hang))) / 50"
           f" ELSE {AIRPORT_LON}e0 + r * sin(radians(brg)) / 50 END",
    "alt_ft": "CASE WHEN kind = 'H' THEN 9000 WHEN kind = 'A' AND r < 1.5 THEN 0"
              " WHEN climbing THEN cast(2000 + floor(r * 400) AS int) ELSE cast(1026 + floor(r * 300) AS int) END",
    "gs_kt": "CASE WHEN kind = 'A' AND r < 1.5 THEN 40e0 ELSE 140e0 + 3 * r END",
    "track_deg": "cast(CASE WHEN kind = 'H' THEN (hang + 90) % 360 WHEN climbing THEN brg ELSE (brg + 180) % 360 END AS double)",
    "baro_rate_fpm": "cast(CASE WHEN event_id % 9 = 0 THEN NULL WHEN kind = 'H' THEN 0 WHEN climbing THEN 1500"
                     " ELSE -900 END AS double)",
    "geom_rate_fpm": "cast(NULL AS double)",
    "sel_altitude_ft": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 3000 END",
    "squawk": "CASE WHEN alarm = 1 THEN '7700' ELSE '1200' END",
    "emergency": "CASE WHEN event_id % 97 = 0 THEN 'lifeguard' ELSE 'none' END",
    "has_position": "true",
    "event_id": "event_id",
}


@_once
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed position reports without the point-wise features."""
    made = spark.sql(_KINEMATICS, d=_instants(spark, sf_dir)).selectExpr(*[f"{e} AS {n}" for n, e in _REPORT.items()])
    return made.withColumn("alt_geom_ft", F.col("alt_ft") + 50).withColumns({"apt_lat": F.lit(AIRPORT_LAT), "apt_lon": F.lit(AIRPORT_LON)})


@_once
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver-shaped position reports: typed columns plus the point-wise features."""
    return point_features(reports(spark, sf_dir))


@_once
def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the reports; the point-wise features are made behind the shuffle of the tracks."""
    return enrich_tracks(reports(spark, sf_dir), features=point_features)


@_once
def tracks_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with `dt`, in its order within tasks."""
    return enrich_tracks(reports(spark, sf_dir), features=point_features, by_day=True)


@_once
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.segment_summary(tracks(spark, sf_dir), FIELD_ELEV_FT)


@_once
def touchdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.touchdowns(summary(spark, sf_dir))


@_once
def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.common_ring_inbound(traffic.congestion(tracks(spark, sf_dir)))


def _run(ts: str):
    """Start of the ten-minute run a time belongs to."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 600) * 600)


def gold(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks and segment summary as written tables, for work that reads them several times. `columns`: those of the tracks that the work
    reads, the summary included; others are neither moved nor written."""
    rows = tracks(spark, sf_dir)
    rows = stored(rows.select(*columns) if columns else rows, "tracks")
    return rows, stored(events.segment_summary(rows, FIELD_ELEV_FT), "segments")


def predictions_of(rows: DataFrame) -> DataFrame:
    """Scoring runs every ten minutes: the newest inbound report of each aircraft, with the
    naive estimate as the prediction."""
    moving = rows.where(F.col("inbound_flag") & (F.col("gs_kt") > 40))
    cols = ["callsign", "ac_type", "apt_icao", "snapshot_ts", "lat", "lon", "dist_to_apt_nm", "alt_ft", "gs_kt", "vrate_fpm", "phase"]
    newest = (moving.groupBy("icao", _run("snapshot_ts").alias("scored_at"))
              .agg(F.max_by(F.struct(*cols), "snapshot_ts").alias("r")).select("icao", "scored_at", "r.*"))
    eta = features.naive_eta()
    arrive = F.timestamp_seconds(F.unix_seconds("snapshot_ts") + F.floor(eta * 60))
    return newest.withColumns({"model_version": F.lit(1).cast("bigint"), "predicted_eta_min": eta, "predicted_touchdown_ts": arrive})


@_once
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(tracks(spark, sf_dir))


def flags_of(irregular: DataFrame) -> DataFrame:
    """Flag runs: each irregular segment in the run of its event."""
    return irregular.select(
        _run("event_ts").alias("scored_at"), "apt_icao", "icao", "callsign", "ac_type", "kind",
        F.when(F.col("kind") == "holding", 2).otherwise(3).alias("severity"), F.col("dist_nm").alias("dist_to_apt_nm"), "alt_ft",
        "detail", F.col("event_ts").alias("snapshot_ts"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_of(events.irregularities(*gold(spark, sf_dir)))


@_once
def demand_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day frame of the real event times, taken as landings."""
    landings = table(spark, sf_dir, "events").select(F.lit(AIRPORT).alias("apt_icao"), F.col("ts").cast("timestamp").alias("touchdown_ts"))
    return demand.day_frame(demand.demand_series(landings))


def forecasts_of(spark: SparkSession, sf_dir: str, preds: DataFrame, landings: DataFrame) -> DataFrame:
    """A forecast at every scoring run, from the detected landings and the event profile."""
    moments = preds.select(F.col("apt_icao").alias("series"), "scored_at").distinct()
    asked = demand.score_requests(landings, moments)
    return demand.forecast(asked, demand.profile(demand_frame(spark, sf_dir)))


@_once
def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts_of(spark, sf_dir, predictions(spark, sf_dir), touchdowns(spark, sf_dir))


def serving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, forecasts and flags as written tables, made from written tracks, as the jobs do."""
    rows, segments = gold(spark, sf_dir)
    preds = stored(predictions_of(rows), "predictions")
    fc = stored(forecasts_of(spark, sf_dir, preds, events.touchdowns(segments)), "forecasts")
    return preds, fc, stored(flags_of(events.irregularities(rows, segments)), "flags")


@_once
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.arrival_training_set(tracks(spark, sf_dir), touchdowns(spark, sf_dir), inbound(spark, sf_dir))


@_once
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.training_rows(arrivals(spark, sf_dir), touchdowns(spark, sf_dir))

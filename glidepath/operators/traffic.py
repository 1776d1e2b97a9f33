"""Congestion and headline aggregates over tracks and silver reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidepath.constants import EMERGENCY_EVENTS, SQUAWK_EVENTS
from glidepath.functions.geo import sphere_cell
from glidepath.functions.numbers import settled


def ring(dist="dist_to_apt_nm", rings=(40, 100)) -> Column:
    """Distance ring label; an unknown distance falls in the outermost ring."""
    inner, outer = rings
    d = F.col(dist)
    return (F.when(d < inner, f"{0:02d}-{inner}").when(d < outer, f"{inner}-{outer}").otherwise(f"{outer}+"))


def aircraft_sums() -> list[Column]:
    """What an aircraft adds to a minute and ring: sums and counts, which any later grouping can add up."""
    inbound = F.col("inbound_flag")
    eta = F.when(inbound & (F.col("gs_kt") > 60), F.col("dist_to_apt_nm") / F.col("gs_kt") * 60)
    return [F.max(F.when(inbound, 1).otherwise(0)).alias("_in"), F.sum("alt_ft").alias("_alt"), F.count("alt_ft").alias("_alt_n"),
            F.sum("gs_kt").alias("_gs"), F.count("gs_kt").alias("_gs_n"), F.sum(eta).alias("_eta"), F.count(eta).alias("_eta_n")]


def congestion_measures() -> list[Column]:
    """The five measures of a minute and ring, from one row per aircraft."""
    return [F.count("icao").alias("n_aircraft"), F.sum("_in").alias("n_inbound"),
            settled(F.try_divide(F.sum("_alt"), F.sum("_alt_n"))).alias("mean_alt_ft"),
            settled(F.try_divide(F.sum("_gs"), F.sum("_gs_n"))).alias("mean_gs_kt"),
            settled(F.try_divide(F.sum("_eta"), F.sum("_eta_n")), 1).alias("mean_eta_min")]


def congestion(tracks: DataFrame, rings=(40, 100)) -> DataFrame:
    """Airborne traffic per minute, airport and ring.

    Grouped by aircraft first: exact distinct counts become plain counts of the second level,
    and both levels combine before their shuffle.
    """
    keys = ["minute_ts", "apt_icao", "ring"]
    airborne = tracks.where(~F.col("is_grounded")).withColumns({"minute_ts": F.date_trunc("minute", "snapshot_ts"), "ring": ring(rings=rings)})
    return airborne.groupBy(*keys, "icao").agg(*aircraft_sums()).groupBy(*keys).agg(*congestion_measures())


def common_ring_inbound(congested: DataFrame, rings=("00-40", "40-100")) -> DataFrame:
    """Inbound aircraft per minute over the rings that every source covers."""
    return (congested.where(F.col("ring").isin(*rings)).groupBy("minute_ts", "apt_icao")
            .agg(F.sum("n_inbound").alias("n_inbound_common")))


def kpis(silver: DataFrame, tracks: DataFrame, holds: DataFrame, td: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    seen = silver.groupBy("icao").agg(F.max("snapshot_ts").alias("_hi"), F.min("snapshot_ts").alias("_lo")).agg(
        F.max("_hi").alias("as_of_ts"), F.min("_lo").alias("_from"), F.count("icao").alias("aircraft_seen"))
    # the newest inbound count needs the newest time: keep both per timestamp, then take the last
    per_ts = tracks.groupBy("snapshot_ts", "icao").agg(F.max(F.when(F.col("inbound_flag"), 1).otherwise(0)).alias("_in"))
    now = (per_ts.groupBy("snapshot_ts").agg(F.sum("_in").alias("_n"))
           .agg(F.max_by("_n", "snapshot_ts").alias("inbound_now")))
    held = holds.agg(F.count(F.lit(1)).alias("holding_now"))
    landed = td.agg(F.count(F.lit(1)).alias("touchdowns_in_window"))
    span = (F.unix_seconds("as_of_ts") - F.unix_seconds("_from")) / 60.0
    return seen.crossJoin(now).crossJoin(held).crossJoin(landed).select(
        "as_of_ts", settled(span, 1).alias("window_minutes"), "aircraft_seen", "inbound_now", "holding_now",
        "touchdowns_in_window")


def fleet_kpis(silver: DataFrame) -> DataFrame:
    """One row about the whole window: aircraft, airlines, types, share airborne, emergencies."""
    fix, flagged = F.col("has_position"), F.col("emergency").isin(list(EMERGENCY_EVENTS))

    def distinct_of(value: Column, name: str) -> DataFrame:
        return silver.select(value.alias("_v")).where(F.col("_v").isNotNull()).distinct().agg(F.count("_v").alias(name))

    totals = silver.agg(
        F.count_if(fix).alias("position_reports"),
        settled(F.try_divide(F.count_if(F.col("alt_ft") > 0), F.count_if(fix)) * 100, 1).alias("pct_airborne"),
        F.min("snapshot_ts").alias("window_start"), F.max("snapshot_ts").alias("window_end"))
    per_icao = silver.groupBy("icao").agg(
        F.max(F.when(fix, 1).otherwise(0)).alias("_fix"), F.max(F.when(flagged, 1).otherwise(0)).alias("_em"))
    aircraft = per_icao.agg(F.sum("_fix").alias("aircraft_tracked"), F.count("icao").alias("raw_contacts"),
                            F.sum("_em").alias("emergency_aircraft"))
    return (aircraft.crossJoin(totals)
            .crossJoin(distinct_of(F.substring("callsign", 1, 3), "distinct_airlines"))
            .crossJoin(distinct_of(F.col("ac_type"), "distinct_types")))


def by_group(silver: DataFrame, keys: dict[str, Column], speed: bool = False, altitude: bool = False) -> DataFrame:
    """Reports, distinct aircraft and rounded means per group, by way of one row per aircraft."""
    fine = silver.select(*[e.alias(n) for n, e in keys.items()], "icao", "alt_ft", "gs_kt").groupBy(*keys, "icao").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("alt_ft").alias("_alt"), F.count("alt_ft").alias("_alt_n"),
        F.sum("gs_kt").alias("_gs"), F.count("gs_kt").alias("_gs_n"))
    aggs = [F.count("icao").alias("aircraft"), F.sum("_n").alias("position_reports")]
    if altitude:
        aggs.append(settled(F.try_divide(F.sum("_alt"), F.sum("_alt_n"))).alias("avg_alt_ft"))
    if speed:
        aggs.append(settled(F.try_divide(F.sum("_gs"), F.sum("_gs_n"))).alias("avg_ground_speed_kt"))
    return fine.groupBy(*keys).agg(*aggs)


def airline_activity(silver: DataFrame) -> DataFrame:
    """Activity per airline prefix of airline-shaped callsigns."""
    rows = silver.where(F.col("callsign").rlike("^[A-Z]{3}[0-9]"))
    return by_group(rows, {"airline_icao": F.substring("callsign", 1, 3)}, speed=True, altitude=True)


def type_mix(silver: DataFrame) -> DataFrame:
    return by_group(silver.where(F.col("ac_type").isNotNull() & (F.col("ac_type") != "")), {"ac_type": F.col("ac_type")})


def altitude_bands(silver: DataFrame) -> DataFrame:
    """Reports and aircraft per 5,000 ft band, with the band number to sort by."""
    band = F.floor(F.col("alt_ft") / 5000).cast("bigint")
    label = F.when(F.col("alt_ft") <= 0, "On ground").otherwise(
        F.concat((band * 5).cast("string"), F.lit("-"), (band * 5 + 5).cast("string"), F.lit("k ft")))
    return by_group(silver.where(F.col("alt_ft").isNotNull()), {"altitude_band": label, "band_sort": band})


def density(silver: DataFrame, level: int = 6) -> DataFrame:
    """Reports, aircraft and mean altitude per cell of the spherical grid."""
    rows = silver.where(F.col("has_position") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return by_group(rows, {"cell": sphere_cell("lat", "lon", level)}, altitude=True)


def special_squawks(silver: DataFrame) -> DataFrame:
    """Emergency contacts with event text and a confidence from the corroborating data."""
    keys = ["icao", "callsign", "ac_type", "registration", "squawk", "emergency"]
    text = F.when(F.lit(False), F.lit(""))
    for code, words in SQUAWK_EVENTS.items():
        text = text.when(F.col("squawk") == code, words)
    for value, words in EMERGENCY_EVENTS.items():
        text = text.when(F.col("emergency") == value, words)
    rows = silver.where(F.col("squawk").isin(list(SQUAWK_EVENTS)) | F.col("emergency").isin(list(EMERGENCY_EVENTS)))
    seen = F.col("has_position")
    return (
        rows.groupBy(*keys).agg(
            F.bool_or("has_position").alias("has_position"), F.min("snapshot_ts").alias("first_seen"),
            F.max("snapshot_ts").alias("last_seen"), F.count(F.lit(1)).alias("pings"),
            settled(F.avg("lat"), 3).alias("approx_lat"), settled(F.avg("lon"), 3).alias("approx_lon"))
        .withColumn("event_type", text.otherwise(F.concat(F.lit("Emergency: "), F.col("emergency"))))
        .withColumn("confidence", F.when(seen & F.col("callsign").isNotNull() & ~F.col("icao").startswith("~"), "high")
                    .when(seen | F.col("callsign").isNotNull(), "medium").otherwise("low"))
    )

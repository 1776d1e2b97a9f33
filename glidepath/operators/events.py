"""Landings, holding, go-arounds and emergencies, detected from tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidepath.constants import EMERGENCY_EVENTS, FIELD_ELEV_FT, SQUAWK_EVENTS
from glidepath.functions.geo import circular_spread
from glidepath.functions.numbers import settled
from glidepath.operators.slices import SLICE_S, interval_join, two_level

SQUAWKS = list(SQUAWK_EVENTS)
#: What the segment summary and the rules over it read of the tracks.
REPORT_COLUMNS = ["seg_id", "icao", "callsign", "ac_type", "apt_icao", "snapshot_ts", "lat", "lon", "alt_ft", "gs_kt", "track_deg",
                  "dist_to_apt_nm", "heading_err_deg", "is_grounded", "vrate_fpm", "squawk", "emergency"]


def _airborne() -> Column:
    return ~F.col("is_grounded")


def has_emergency_field() -> Column:
    return F.col("emergency").isNotNull() & ~F.lower("emergency").isin("none", "")


def is_emergency() -> Column:
    return F.col("squawk").isin(SQUAWKS) | has_emergency_field()


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total), F.col(count))


def _track_sums(cond: Column) -> dict[str, Column]:
    """Sums behind the circling measures, over the rows that satisfy `cond`."""
    heading = F.radians("track_deg")
    return {
        "_c_n": F.when(cond, 1).otherwise(0),
        "_c_alt": F.when(cond, F.col("alt_ft")),
        "_c_alt_n": F.when(cond & F.col("alt_ft").isNotNull(), 1).otherwise(0),
        "_c_dist": F.when(cond, F.col("dist_to_apt_nm")),
        "_c_dist_n": F.when(cond & F.col("dist_to_apt_nm").isNotNull(), 1).otherwise(0),
        "_c_lat": F.when(cond, F.col("lat")),
        "_c_lon": F.when(cond, F.col("lon")),
        "_c_cos": F.when(cond, F.cos(heading)),
        "_c_sin": F.when(cond, F.sin(heading)),
        "_c_gs": F.when(cond, F.col("gs_kt")),
        "_c_gs_n": F.when(cond & F.col("gs_kt").isNotNull(), 1).otherwise(0),
    }


def _track_extents(cond: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    mins = {"_lat_lo": F.when(cond, F.col("lat")), "_lon_lo": F.when(cond, F.col("lon")),
            "_first": F.when(cond, F.col("snapshot_ts"))}
    maxs = {"_lat_hi": F.when(cond, F.col("lat")), "_lon_hi": F.when(cond, F.col("lon")),
            "_last": F.when(cond, F.col("snapshot_ts"))}
    return mins, maxs


def _spread() -> Column:
    return settled(circular_spread(_mean("_c_cos", "_c_n"), _mean("_c_sin", "_c_n")), 2)


def _box(per_degree: float, digits: int) -> tuple[Column, Column]:
    ns = (F.col("_lat_hi") - F.col("_lat_lo")) * per_degree
    ew = (F.col("_lon_hi") - F.col("_lon_lo")) * per_degree * F.cos(F.radians(_mean("_c_lat", "_c_n")))
    return settled(ns, digits), settled(ew, digits)


def segment_summary(tracks: DataFrame, elev_ft: int = FIELD_ELEV_FT) -> DataFrame:
    """One row per segment with every measure the rules need, in one pass over the tracks.

    All measures are sums, minima and maxima, so they combine before the shuffle and a segment
    of any size costs one partial row per task.
    """
    circling = _airborne() & F.col("track_deg").isNotNull() & F.col("alt_ft").between(2000, 20000)
    final = (F.col("dist_to_apt_nm") < 8) & (F.col("alt_ft") <= elev_ft + 4000) & F.col("gs_kt").between(25, 250)
    low = ((F.col("dist_to_apt_nm") < 5) & (F.col("alt_ft") < elev_ft + 2500) & (F.col("vrate_fpm") < -250)
           & (F.col("heading_err_deg") < 50) & _airborne())
    ts = F.col("snapshot_ts")
    mins, maxs = _track_extents(circling)
    sums = _track_sums(circling) | {
        "_f_n": F.when(final, 1).otherwise(0),
        "_f_descents": F.when(final & (F.col("vrate_fpm") < -200), 1).otherwise(0),
    }
    mins |= {
        "min_dist": F.col("dist_to_apt_nm"),
        "_f_ground": F.when(final & F.col("is_grounded") & (F.col("dist_to_apt_nm") < 3), ts),
        "_f_dist": F.when(final, F.col("dist_to_apt_nm")),
        "_f_alt": F.when(final, F.col("alt_ft")),
        "appr_ts": F.when(low, ts),
        "emergency_ts": F.when(is_emergency(), ts),
    }
    maxs |= {
        "max_alt": F.col("alt_ft"),
        "_f_air": F.when(final & _airborne(), ts),
        "climb_last": F.when(_climbing_out(elev_ft), ts),
        "seg_end_ts": ts,
        "squawk_code": F.when(F.col("squawk").isin(SQUAWKS), F.col("squawk").try_cast("int")),
    }
    words = {"emergency_word": F.when(has_emergency_field(), F.col("emergency"))}
    return two_level(tracks, ["seg_id"], ["icao", "callsign", "ac_type", "apt_icao"], sums, mins, maxs, words)


def _climbing_out(elev_ft: int) -> Column:
    return (F.col("alt_ft") > elev_ft + 3500) & (F.col("vrate_fpm") > 300) & (F.col("dist_to_apt_nm") > 7)


def _circling_measures() -> dict[str, Column]:
    ns, ew = _box(60, 1)
    return {
        "n_reports": F.col("_c_n"), "first_ts": F.col("_first"), "last_ts": F.col("_last"),
        "mean_alt_ft": settled(_mean("_c_alt", "_c_alt_n")), "mean_dist_nm": settled(_mean("_c_dist", "_c_dist_n"), 1),
        "approx_lat": settled(_mean("_c_lat", "_c_n"), 4), "approx_lon": settled(_mean("_c_lon", "_c_n"), 4),
        "ns_nm": ns, "ew_nm": ew, "heading_spread": _spread(),
    }


def _holds(min_n: int, min_spread: float, max_box_nm: float, max_dist_nm: float) -> Column:
    return ((F.col("n_reports") >= min_n) & (F.col("heading_spread") >= min_spread) & (F.col("ns_nm") <= max_box_nm)
            & (F.col("ew_nm") <= max_box_nm) & (F.col("mean_dist_nm") <= max_dist_nm))


def holding(summary: DataFrame, min_n: int = 8, min_spread: float = 0.5, max_box_nm: float = 15,
            max_dist_nm: float = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Circling segments: headings spread over the compass inside a small box. `keep` names
    further segment columns to carry, here and in the other rules."""
    measures = _circling_measures()
    rows = summary.where(F.col("_c_n") > 0).withColumns(measures)
    return rows.where(_holds(min_n, min_spread, max_box_nm, max_dist_nm)).select(
        "seg_id", "icao", "callsign", "ac_type", "apt_icao", *measures, *keep)


def orbits(silver: DataFrame, min_n: int = 25, min_speed_kt: float = 120, min_spread: float = 0.5,
           max_box_km: float = 18, alt_range: tuple[int, int] = (1000, 45000)) -> DataFrame:
    """Circling per aircraft over the whole window, in km, with a speed floor."""
    rows = silver.where(F.col("has_position") & F.col("alt_ft").between(*alt_range) & F.col("track_deg").isNotNull())
    always = F.lit(True)
    mins, maxs = _track_extents(always)
    summary = two_level(rows, ["icao"], ["callsign", "ac_type"], _track_sums(always), mins, maxs)
    ns, ew = _box(111, 0)
    return (
        summary.select(
            "icao", "callsign", "ac_type", F.col("_c_n").alias("pings"),
            settled(_mean("_c_gs", "_c_gs_n")).alias("avg_speed_kt"), settled(_mean("_c_alt", "_c_alt_n")).alias("avg_alt_ft"),
            ns.alias("ns_km"), ew.alias("ew_km"), _spread().alias("heading_spread"),
            settled(_mean("_c_lat", "_c_n"), 3).alias("approx_lat"), settled(_mean("_c_lon", "_c_n"), 3).alias("approx_lon"))
        .where((F.col("pings") >= min_n) & (F.col("avg_speed_kt") >= min_speed_kt)
               & (F.col("heading_spread") >= min_spread) & (F.col("ns_km") <= max_box_km) & (F.col("ew_km") <= max_box_km))
    )


def _with_landing(summary: DataFrame, elev_ft: int) -> DataFrame:
    """Adds the landing gates to the segment row: `touchdown_ts` is null where nothing landed.

    The distance is rounded before it is compared; the published rows depend on that.
    """
    near, low = F.round("_f_dist", 2), F.col("_f_alt")
    at = F.coalesce("_f_ground", "_f_air")
    landed = (F.col("_f_n") > 0) & (near < 6) & (low <= elev_ft + 2000) & (F.col("_f_descents") >= 1)
    return summary.withColumns({"min_dist_nm": near, "touchdown_ts": F.when(landed, at)})


def touchdowns(summary: DataFrame, elev_ft: int = FIELD_ELEV_FT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landings: the first ground report near the field, else the last airborne report on final."""
    confirmed = (F.col("min_dist_nm") < 3) & (F.col("_f_alt") <= elev_ft + 500)
    return (
        _with_landing(summary, elev_ft).where(F.col("touchdown_ts").isNotNull())
        .select(
            "seg_id", "icao", "callsign", "ac_type", "apt_icao", "touchdown_ts", "min_dist_nm", F.col("_f_alt").alias("min_alt_ft"),
            F.col("_f_descents").alias("descent_reports"), F.col("_f_n").alias("n_short_final"),
            F.when(confirmed, "confirmed").otherwise("inferred").alias("touchdown_confidence"), *keep)
    )


def go_around_climbs(tracks: DataFrame, summary: DataFrame, elev_ft: int = FIELD_ELEV_FT,
                     slice_s: int = SLICE_S) -> DataFrame:
    """First climb-out after the first low approach of the same segment: `seg_id, climb_ts`."""
    low = (summary.where(F.col("climb_last") > F.col("appr_ts"))
           .select("seg_id", "appr_ts", "climb_last"))
    climbs = tracks.where(_climbing_out(elev_ft)).select("seg_id", "snapshot_ts")
    pairs = interval_join(climbs, low, ["seg_id"], "snapshot_ts", "appr_ts", "climb_last", slice_s)
    return pairs.where(F.col("snapshot_ts") > F.col("appr_ts")).groupBy("seg_id").agg(
        F.min("snapshot_ts").alias("climb_ts"))


def irregularities(tracks: DataFrame, summary: DataFrame, elev_ft: int = FIELD_ELEV_FT,
                   min_after_climb_s: int = 240, slice_s: int = SLICE_S, keep: tuple[str, ...] = ()) -> DataFrame:
    """Emergency, holding and go-around segments in one table, with whether the segment landed.

    All rules read one segment row and give up to three flags from it, so the segments are
    aggregated once and only go-around candidates look at single reports again.
    """
    rows = _with_landing(summary, elev_ft).withColumns(_circling_measures())
    rows = rows.join(go_around_climbs(tracks, summary, elev_ft, slice_s), "seg_id", "left")
    landed = F.col("touchdown_ts").isNotNull()
    after = F.unix_micros("touchdown_ts") > F.unix_micros("climb_ts") + F.lit(min_after_climb_s * 1_000_000)
    dist, alt = F.round("min_dist", 1), F.col("max_alt").cast("double")
    emergency_text = F.concat_ws(" ", F.concat(F.lit("squawk="), F.col("squawk_code").cast("string")),
                                 F.concat(F.lit("emergency="), F.col("emergency_word")))
    hold_text = F.format_string("circling: %d reports, spread of headings %s", "n_reports", F.col("heading_spread").cast("string"))
    plausible = (_holds(10, 0.5, 15, 60) & (F.col("mean_alt_ft") >= 6000) & (F.col("mean_dist_nm") >= 5))

    def flag(kind: str, at, d, a, text, sure) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(at).alias("event_ts"), d.alias("dist_nm"), a.alias("alt_ft"),
                        text.alias("detail"), sure.alias("confidence"))
    flags = F.array_compact(F.array(
        F.when(F.col("emergency_ts").isNotNull(), flag("emergency", "emergency_ts", dist, alt, emergency_text, F.lit(1.0))),
        F.when(plausible, flag("holding", "first_ts", F.col("mean_dist_nm"), F.col("mean_alt_ft"), hold_text,
                               F.least(F.lit(1.0), F.col("heading_spread") + 0.2))),
        F.when(F.col("climb_ts").isNotNull() & (~landed | after),
               flag("go_around", "climb_ts", dist, alt, F.lit("low on approach, later climbing outside 7 nm"), F.lit(0.6)))))
    return (
        rows.withColumn("_f", F.explode(flags))
        .select("seg_id", "icao", "callsign", "ac_type", "apt_icao", "_f.kind", "_f.event_ts", "_f.dist_nm", "_f.alt_ft",
                F.when(landed, 1).otherwise(0).alias("landed"), "_f.detail", "_f.confidence", *keep)
    )


def newest_minus(df: DataFrame, ts: str, minutes: float) -> Column:
    """A literal time `minutes` before the newest of `df`, so that a filter by it reaches the scan; null without rows.

    Runs one aggregate of one column now; Parquet answers it from footers where the table is a plain scan.
    """
    newest = df.agg(F.unix_micros(F.max(ts)).alias("m")).first()["m"]
    return F.lit(None).cast("timestamp") if newest is None else F.timestamp_micros(F.lit(newest - int(minutes * 60_000_000)))


def within_latest(df: DataFrame, ts: str, minutes: float, latest_of: DataFrame | None = None) -> DataFrame:
    """Rows no older than `minutes` before the newest data time (not the wall clock)."""
    since = newest_minus(latest_of if latest_of is not None else df, ts, minutes)
    return df.where(F.col(ts) >= since)


def live_flags(tracks: DataFrame, apt: str, fresh_min: int = 20, lookback_min: int = 30,
               elev_ft: int = FIELD_ELEV_FT) -> DataFrame:
    """The same three kinds judged on the last minutes, for aircraft still being reported."""
    here = tracks.where(F.col("apt_icao") == apt)
    since = newest_minus(here, "snapshot_ts", lookback_min)
    window = here.where(F.col("snapshot_ts") >= since)
    shape = _airborne() & F.col("track_deg").isNotNull()
    mins, maxs = _track_extents(shape)
    mins |= {"_appr": F.when(shape & (F.col("dist_to_apt_nm") < 5) & (F.col("alt_ft") < elev_ft + 2500)
                             & (F.col("vrate_fpm") < -200), F.col("snapshot_ts"))}
    maxs |= {"last_ts": F.col("snapshot_ts")}
    per_icao = two_level(window, ["icao"], [], _track_sums(shape), mins, maxs)
    ns, ew = _box(60, 1)
    fresh = F.unix_micros("last_ts") - F.unix_micros(since) >= (lookback_min - fresh_min) * 60_000_000
    geometry = per_icao.where(fresh).select(
        "icao", "last_ts", F.col("_c_n").alias("n"), _spread().alias("heading_spread"), ns.alias("ns_nm"), ew.alias("ew_nm"),
        _mean("_c_alt", "_c_alt_n").alias("mean_alt"), _mean("_c_dist", "_c_dist_n").alias("mean_dist"),
        F.col("_appr").alias("appr_ts"))
    now = (window.join(geometry, "icao").where(F.col("snapshot_ts") == F.col("last_ts")))
    # the current squawk is printed whenever the aircraft is in an emergency, special or not
    emergency_text = F.concat_ws(" ", F.concat(F.lit("squawk="), F.col("squawk")),
                                 F.when(F.col("emergency") != "none", F.concat(F.lit("emergency="), F.col("emergency"))))
    rules = F.array(
        F.when(is_emergency(), F.struct(F.lit("emergency").alias("kind"), F.lit(3).alias("severity"),
                                        emergency_text.alias("detail"))),
        F.when((F.col("snapshot_ts") > F.col("appr_ts")) & (F.col("alt_ft") > elev_ft + 2000) & (F.col("vrate_fpm") > 400),
               F.struct(F.lit("go_around").alias("kind"), F.lit(3).alias("severity"),
                        F.lit("low on approach lately, climbing now").alias("detail"))),
        F.when((F.col("n") >= 6) & (F.col("heading_spread") >= 0.5) & (F.col("ns_nm") <= 15) & (F.col("ew_nm") <= 15)
               & F.col("mean_alt").between(2000, 20000) & F.col("mean_dist").between(5, 60),
               F.struct(F.lit("holding").alias("kind"), F.lit(2).alias("severity"),
                        F.concat(F.lit("circling lately, spread of headings "),
                                 F.col("heading_spread").cast("string")).alias("detail"))))
    return (
        now.withColumn("_flag", F.explode(F.filter(rules, lambda r: r.isNotNull())))
        .select("apt_icao", "icao", "callsign", "ac_type", "snapshot_ts", F.round("dist_to_apt_nm", 1).alias("dist_to_apt_nm"),
                "alt_ft", "gs_kt", "lat", "lon", "_flag.kind", "_flag.severity", "_flag.detail")
    )


def genuine_holds(irr: DataFrame, tracks: DataFrame, td: DataFrame, land_within_min: int = 90,
                  max_same_day: int = 2) -> DataFrame:
    """Holding segments whose aircraft lands soon after and does not loiter: `seg_id`."""
    holds = irr.where(F.col("kind") == "holding").select("seg_id", "icao", F.to_date("event_ts").alias("_day"))
    # the ends of all segments: they combine before the shuffle, so no report moves
    ends = tracks.groupBy("seg_id").agg(F.max("snapshot_ts").alias("t_end"))
    per_day = holds.groupBy("icao", "_day").agg(F.count(F.lit(1)).alias("same_day_holds"))
    held = holds.join(ends, "seg_id").join(per_day, ["icao", "_day"]).where(F.col("same_day_holds") <= max_same_day)
    waits = held.withColumn("_by", F.timestamp_micros(F.unix_micros("t_end") + F.lit(land_within_min * 60_000_000)))
    landings = td.select("icao", "touchdown_ts")
    pairs = interval_join(landings, waits.select("icao", "seg_id", "t_end", "_by"), ["icao"], "touchdown_ts", "t_end", "_by")
    return pairs.where((F.col("touchdown_ts") > F.col("t_end")) & (F.col("touchdown_ts") < F.col("_by"))).select(
        "seg_id").distinct()

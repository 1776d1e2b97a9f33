"""Position reports to trajectories: gaps, segments, and per-report motion features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.functions.geo import angular_diff_deg, haversine_nm, initial_bearing_deg
from glidepath.operators.slices import SLICE_S, slice_of, with_halo


def grounded(alt="alt_ft", gs="gs_kt") -> Column:
    """On the ground: no altitude and slow. An unknown altitude stays unknown."""
    return (F.col(alt) <= 0) & (F.coalesce(F.col(gs), F.lit(0.0)) < 50)


def phase(on_ground: Column, vrate: Column, alt: Column) -> Column:
    """Point-wise flight phase, first rule wins."""
    return (F.when(on_ground, "ground").when(vrate > 400, "climb").when(vrate < -400, "descent")
            .when(alt >= 18000, "cruise").when(vrate.isNotNull(), "level").otherwise("unknown"))


def point_features(df: DataFrame, apt_lat="apt_lat", apt_lon="apt_lon") -> DataFrame:
    """Distance, bearing, heading error, vertical rate and phase of each single report."""
    fix = F.col("has_position")
    vrate = F.coalesce("baro_rate_fpm", "geom_rate_fpm")
    return (
        df.withColumns({
            "dist_to_apt_nm": F.when(fix, haversine_nm("lat", "lon", apt_lat, apt_lon)),
            "bearing_to_apt": F.when(fix, initial_bearing_deg("lat", "lon", apt_lat, apt_lon)),
            "vertical_rate_fpm": vrate,
            "vertical_rate_src": F.when(F.col("baro_rate_fpm").isNotNull(), "baro")
                                  .when(F.col("geom_rate_fpm").isNotNull(), "geom"),
            "is_grounded": grounded(),
        })
        .withColumns({
            "heading_err_deg": F.when(fix & F.col("track_deg").isNotNull(),
                                      angular_diff_deg("track_deg", "bearing_to_apt")),
            "phase": phase(F.col("is_grounded"), F.col("vertical_rate_fpm"), F.col("alt_ft")),
        })
    )


def _gaps(sliced: DataFrame, within: list[str], ts: str, min_gap_s: int, max_gap_s: int) -> tuple[DataFrame, Window]:
    """Whole-second gap to the previous report and whether it starts a new segment."""
    in_time = Window.partitionBy(*within).orderBy(ts)
    micros = F.unix_micros(F.col(ts))
    gap = F.expr(f"(unix_micros({ts}) - _prev_us) div 1000000")
    df = sliced.withColumn("_prev_us", F.lag(micros).over(in_time)).withColumn("_gap_s", gap)
    broken = F.col("_gap_s").isNull() | (F.col("_gap_s") < min_gap_s) | (F.col("_gap_s") > max_gap_s)
    df = df.withColumn("seg_break", F.when(broken, 1).otherwise(0))
    started = F.when((F.col("seg_break") == 1) & ~F.col("_halo"), F.col(ts))
    running = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_local_start", F.max(started).over(running)), in_time


def _slice_totals(gapped: DataFrame, key: str, within: list[str], ts: str, opening: DataFrame | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """One row per (key, slice): what a segment crossing the slice borders needs to know.

    A slice has a head (rows before its first break, which belong to a segment of an earlier
    slice), complete segments, and a tail (its last segment, which later slices may continue).
    A segment of `opening` stands in a slice before all others, as its tail.
    """
    local = Window.partitionBy(*within, "_local_start")
    head = F.col("_local_start").isNull()
    per_slice = (
        gapped.where(~F.col("_halo"))
        .select(*within, ts, "_local_start", F.count(F.lit(1)).over(local).alias("_n"))
        .groupBy(*within)
        .agg(F.max(F.when(head, F.col("_n"))).alias("_head_n"),
             F.max(F.when(head, F.col(ts))).alias("_head_end"),
             F.max("_local_start").alias("_tail_start"),
             F.max_by(F.when(~head, F.col("_n")), F.col(ts)).alias("_tail_n"),
             F.max(ts).alias("_last_ts"))
    )
    if opening is not None:
        per_slice = per_slice.unionByName(opening.select(
            key, (slice_of("last_ts", slice_s) - 1).alias("_slice"), F.col("seg_start_ts").alias("_tail_start"),
            F.col("seg_n_reports").alias("_tail_n"), F.col("last_ts").alias("_last_ts")), allowMissingColumns=True)
    by_key = Window.partitionBy(key).orderBy("_slice")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    crossing = Window.partitionBy(key, "_carry")
    return (
        per_slice
        .withColumns({"_carry": F.last("_tail_start", True).over(before),
                      "_carry_n": F.last("_tail_n", True).over(before)})
        .withColumns({"_later_n": F.sum("_head_n").over(crossing), "_later_end": F.max("_head_end").over(crossing)})
        .withColumns({"_next_n": F.lead("_later_n").over(by_key), "_next_end": F.lead("_later_end").over(by_key)})
        .select(
            *within, "_carry", "_tail_start",
            (F.col("_carry_n") + F.col("_later_n")).alias("_open_n"),
            F.col("_later_end").alias("_open_end"),
            (F.col("_tail_n") + F.coalesce("_next_n", F.lit(0))).alias("_tail_total"),
            F.coalesce("_next_end", "_last_ts").alias("_tail_end"))
    )


def _segmented(df: DataFrame, key: str, ts: str, min_gap_s: int, max_gap_s: int, slice_s: int, halo_s: int,
               lags: dict[str, str], step: Column | None, opening: DataFrame | None = None,
               features: Callable[[DataFrame], DataFrame] | None = None, by_day: bool = False) -> DataFrame:
    """Rows with their segment, the lagged columns, `_gap_s`, and `_steps`: how many of the last
    three reports of the segment satisfy `step`. Reports of `opening` come before the rows, as a halo.
    `features` adds columns to the rows once they lie in their slices, so that these do not move. `by_day`
    adds `_day`, and the rows of a task come ordered by it."""
    if by_day and (opening is not None or 86400 % slice_s):
        raise ValueError("tracks by day are made in full, of slices that a day is made of")
    within = ["_day", key, "_slice"] if by_day else [key, "_slice"]

    def sliced(rows: DataFrame) -> DataFrame:
        out = with_halo(rows, ts, slice_s, halo_s)
        if by_day:
            return out.withColumn("_day", F.date_from_unix_date(F.floor(F.col("_slice") / F.lit(86400 // slice_s)).cast("int")))
        if opening is None:
            return out
        past = opening.select(key, F.explode("recent").alias("_r")).select(key, "_r.*")
        past = past.select(*[c for c in past.columns if c in rows.columns])
        return out.unionByName(with_halo(past, ts, slice_s, halo_s).withColumn("_halo", F.lit(True)), allowMissingColumns=True)

    wide = sliced(df)
    if features is not None:
        wide = features(wide.repartition(*within))
    gapped, in_time = _gaps(wide, within, ts, min_gap_s, max_gap_s)
    thin, _ = _gaps(sliced(df.select(key, ts)), within, ts, min_gap_s, max_gap_s)
    totals = _slice_totals(thin, key, within, ts, opening, slice_s)
    same = F.col("seg_break") == 0
    rows = gapped.withColumns({n: F.lag(c).over(in_time) for n, c in lags.items()})
    rows = rows.withColumns({"_step": F.when(same & step, 1).otherwise(0) if step is not None else F.lit(0),
                             "_same": same.cast("int")})
    rows = rows.withColumns({"_same_1": F.lag("_same", 1, 0).over(in_time), "_step_1": F.lag("_step", 1, 0).over(in_time),
                             "_step_2": F.lag("_step", 2, 0).over(in_time)})
    local = Window.partitionBy(*within, "_local_start")
    if by_day:  # the order of the files as well
        local = local.orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.where(~F.col("_halo")).withColumns({"_n": F.count(F.lit(1)).over(local), "_end": F.max(ts).over(local)})
    head = F.col("_local_start").isNull()
    tail = F.col("_local_start") == F.col("_tail_start")
    return (
        rows.join(totals, within, "left")
        .withColumns({
            "seg_start_ts": F.coalesce("_local_start", "_carry"),
            "seg_n_reports": F.when(head, F.col("_open_n")).when(tail, F.col("_tail_total")).otherwise(F.col("_n")),
            "seg_end_ts": F.when(head, F.col("_open_end")).when(tail, F.col("_tail_end")).otherwise(F.col("_end")),
            "dt_s": F.when(same, F.col("_gap_s")),
            # a step never crosses a break, so the products stop the sum at the segment start
            "_steps": F.col("_step") + F.col("_same") * (F.col("_step_1") + F.col("_same_1") * F.col("_step_2")),
        })
        .withColumn("seg_id", F.concat_ws("-", F.col(key), F.unix_millis("seg_start_ts").cast("string")))
    )


def segment(df: DataFrame, key: str = "icao", ts: str = "snapshot_ts", min_gap_s: int = 1, max_gap_s: int = 180,
            slice_s: int = SLICE_S) -> DataFrame:
    """Cuts each key's reports into segments at gaps outside `min_gap_s..max_gap_s`.

    Adds `seg_id` (key and start in epoch milliseconds, so it does not depend on how much
    history is read), `seg_break`, `dt_s` (null at a break), and the segment's count, start, end.
    """
    out = _segmented(df, key, ts, min_gap_s, max_gap_s, slice_s, 3 * max_gap_s, {}, None)
    return out.select(*df.columns, "seg_id", "seg_break", "dt_s", "seg_n_reports", "seg_start_ts", "seg_end_ts")


def enrich_tracks(silver: DataFrame, vrate_gap_s: int = 600, max_closure_kt: float = 700, inbound_err_deg: float = 70,
                  min_gap_s: int = 1, max_gap_s: int = 180, slice_s: int = SLICE_S, opening: DataFrame | None = None,
                  features: Callable[[DataFrame], DataFrame] | None = None, by_day: bool = False) -> DataFrame:
    """Silver reports to tracks: segments plus closure, turn, vertical rate and the inbound flag.

    One shuffle of the full rows, on (icao, slice). A second, two-column pass finds the segments
    that cross slice borders; its result has one row per (icao, slice). `opening`, a register of
    open segments (see `open_segments`), continues the tracks of an earlier load. `features` makes
    the point-wise columns (`point_features`) of rows that lack them, behind that shuffle. `by_day`
    adds `dt`, the day (UTC), and the rows of a task come in its order, ready for day folders.
    """
    if features is not None and opening is not None:
        raise ValueError("reports of a register hold no columns to make features from")
    lags = {"_prev_alt": "alt_ft", "_prev_dist": "dist_to_apt_nm", "_prev_track": "track_deg"}
    halo_s = max(vrate_gap_s, 3 * max_gap_s)
    closer = F.col("_prev_dist") > F.col("dist_to_apt_nm")
    df = _segmented(silver.where(F.col("has_position")), "icao", "snapshot_ts", min_gap_s, max_gap_s, slice_s, halo_s,
                    lags, closer, opening, features, by_day)
    same = F.col("seg_break") == 0
    gap = F.col("_gap_s")
    climb = F.when(gap.between(1, vrate_gap_s), F.try_divide(F.col("alt_ft") - F.col("_prev_alt"), gap) * 60.0)
    closure = F.try_divide(F.col("_prev_dist") - F.col("dist_to_apt_nm"), gap) * 3600
    swing = F.abs(F.col("track_deg") - F.col("_prev_track"))
    return (
        df.withColumns({
            "_climb": climb,
            "closure_kt": F.when(same & (F.abs(closure) <= max_closure_kt), closure),
            "turn_deg": F.when(same & F.col("_prev_track").isNotNull(), F.least(swing, 360 - swing)),
        })
        .withColumns({
            "vrate_fpm": F.coalesce("vertical_rate_fpm", "_climb"),
            "vrate_src": F.coalesce("vertical_rate_src", F.when(F.col("_climb").isNotNull(), "delta")),
            "turn_rate_dps": F.try_divide(F.col("turn_deg"), F.col("dt_s")),
            "inbound_flag": (F.col("heading_err_deg") < inbound_err_deg) & F.col("alt_ft").between(500, 40000)
                            & ~F.col("is_grounded") & (F.col("_steps") >= 2),
        })
        .select(
            "seg_id", "icao", "callsign", "ac_type", "apt_icao", "snapshot_ts", "lat", "lon", "alt_ft", "alt_geom_ft",
            "gs_kt", "track_deg", "sel_altitude_ft", "dist_to_apt_nm", "bearing_to_apt", "heading_err_deg",
            "is_grounded", "phase", "squawk", "emergency", "dt_s", "closure_kt", "turn_deg", "vrate_fpm", "vrate_src",
            "turn_rate_dps", "seg_n_reports", "seg_start_ts", "seg_end_ts", "inbound_flag", *([F.col("_day").alias("dt")] if by_day else []))
    )


#: What the next load needs of a report: its time and what steps, climbs, closures and turns are computed from.
_CARRIED = ["snapshot_ts", "alt_ft", "dist_to_apt_nm", "track_deg"]
#: Reports of a segment that a step count reaches back over.
_REACH = 3


def _register(rows: DataFrame, end: Column, idle_s: int) -> DataFrame:
    """Newest reports per aircraft with the segment of the newest one; `rows` have `_CARRIED`, seg_start_ts and seg_n_reports."""
    newest = F.slice(F.sort_array(F.collect_list(F.struct(*_CARRIED, "seg_start_ts", "seg_n_reports")), asc=False), 1, _REACH)
    out = rows.groupBy("icao").agg(newest.alias("_r")).select(
        "icao", F.col("_r")[0]["snapshot_ts"].alias("last_ts"), F.col("_r")[0]["seg_start_ts"].alias("seg_start_ts"),
        F.col("_r")[0]["seg_n_reports"].alias("seg_n_reports"),
        F.transform("_r", lambda r: F.struct(*[r[c].alias(c) for c in _CARRIED])).alias("recent"))
    return out.where(F.unix_seconds("last_ts") >= F.unix_seconds(end) - F.lit(idle_s))


def open_segments(silver: DataFrame, end: str, vrate_gap_s: int = 600, min_gap_s: int = 1, max_gap_s: int = 180, slice_s: int = SLICE_S) -> DataFrame:
    """The register of a history that has none yet: aircraft whose last report before `end` (UTC text) a later one may continue.

    One row per such aircraft: start and count of its segment so far, and its last three reports. Segments are found over the whole
    history in a pass of two columns; other columns are read of the last minutes only.
    """
    at, idle_s = F.lit(end).cast("timestamp"), max(vrate_gap_s, max_gap_s)
    past = silver.where(F.col("has_position") & (F.col("snapshot_ts") < at))
    recent = F.unix_seconds("snapshot_ts") >= F.unix_seconds(at) - F.lit(idle_s + _REACH * max_gap_s)
    cut = segment(past.select("icao", "snapshot_ts"), min_gap_s=min_gap_s, max_gap_s=max_gap_s, slice_s=slice_s).where(recent)
    rows = past.where(recent).select("icao", *_CARRIED).join(cut.select("icao", "snapshot_ts", "seg_start_ts", "seg_n_reports"), ["icao", "snapshot_ts"])
    return _register(rows, at, idle_s)


def carried_on(opening: DataFrame, tracks: DataFrame, end: str, vrate_gap_s: int = 600, max_gap_s: int = 180) -> DataFrame:
    """The register after a load: `opening` and the load's `tracks` up to `end` (UTC text); only the load's last minutes are read."""
    at, idle_s = F.lit(end).cast("timestamp"), max(vrate_gap_s, max_gap_s)
    recent = F.unix_seconds("snapshot_ts") >= F.unix_seconds(at) - F.lit(idle_s + _REACH * max_gap_s)
    held = opening.select("icao", F.explode("recent").alias("_r"), "seg_start_ts", "seg_n_reports").select("icao", "_r.*", "seg_start_ts", "seg_n_reports")
    return _register(held.unionByName(tracks.where(recent).select(*held.columns)), at, idle_s)


def incremental_tracks(silver: DataFrame, cutoff: str, register: DataFrame, **kw) -> DataFrame:
    """Tracks with `snapshot_ts >= cutoff`, equal to those of a full build; `register` holds the segments open at the cutoff.

    Reads the rows from the cutoff on and the register, which has one row per aircraft of the last minutes; nothing before that, however
    long an open segment is.
    """
    return enrich_tracks(silver.where(F.col("snapshot_ts") >= F.lit(cutoff).cast("timestamp")), opening=register, **kw)

"""Model inputs, the training set, error tables by distance band, and causal windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.constants import DISTANCE_BANDS, ETA_FEATURES, ETA_LABEL, HEAVY_TYPES, PHASES
from glidepath.functions.numbers import settled
from glidepath.operators.events import within_latest
from glidepath.operators.quantiles import exact_quantiles
from glidepath.operators.slices import SLICE_S, interval_join, salted_left_join, slice_of

NUMERIC_FEATURES = [f for f in ETA_FEATURES if f != "phase"]


def _cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = value / period * (2 * math.pi)
    return F.sin(angle), F.cos(angle)


def eta_features(df: DataFrame) -> DataFrame:
    """Adds the derived model inputs; training and scoring share this one definition."""
    df = df.withColumns({"hour_utc": F.hour("snapshot_ts"), "dow": F.dayofweek("snapshot_ts")})
    hour_sin, hour_cos = _cycle(F.col("hour_utc"), 24)
    dow_sin, dow_cos = _cycle(F.col("dow") - 1, 7)
    return df.withColumns({
        "is_heavy": F.col("ac_type").isin(HEAVY_TYPES).cast("int"),
        "hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos,
        "bearing_sin": F.sin(F.radians("bearing_to_apt")), "bearing_cos": F.cos(F.radians("bearing_to_apt")),
        # ground speed along the bearing to the field: needs no previous report
        "closure_geom_kt": F.col("gs_kt") * F.cos(F.radians("heading_err_deg")),
    })


def with_inbound_count(df: DataFrame, inbound: DataFrame) -> DataFrame:
    """Adds the airport's inbound count of the report's minute, zero where none was inbound."""
    rows = df.withColumn("minute_ts", F.date_trunc("minute", "snapshot_ts"))
    joined = salted_left_join(rows, inbound, ["minute_ts", "apt_icao"], "icao")
    return joined.withColumn("airport_inbound_count", F.coalesce("n_inbound_common", F.lit(0))).drop(
        "minute_ts", "n_inbound_common")


def arrival_training_set(tracks: DataFrame, td: DataFrame, inbound: DataFrame, label_s=(30, 2400),
                         slice_s: int = SLICE_S) -> DataFrame:
    """Airborne reports of landing segments, labelled with the minutes left to touchdown."""
    least, most = label_s
    land_s = F.unix_seconds("touchdown_ts")
    goals = td.select("seg_id", "touchdown_ts").withColumns({
        "_from": F.timestamp_seconds(land_s - most), "_to": F.timestamp_micros((land_s - least + 1) * 1_000_000 - 1)})
    rows = tracks.where(~F.col("is_grounded") & F.col("dist_to_apt_nm").isNotNull())
    left_s = F.unix_seconds("touchdown_ts") - F.unix_seconds("snapshot_ts")
    pairs = interval_join(rows, goals, ["seg_id"], "snapshot_ts", "_from", "_to", slice_s).where(
        (F.col("snapshot_ts") < F.col("touchdown_ts")) & left_s.between(least, most))
    labelled = with_inbound_count(pairs.withColumn(ETA_LABEL, left_s / 60.0), inbound)
    return labelled.select(
        "seg_id", "icao", "callsign", "ac_type", "apt_icao", "snapshot_ts", "touchdown_ts", ETA_LABEL, "dist_to_apt_nm",
        "bearing_to_apt", "heading_err_deg", "alt_ft", "alt_geom_ft", "sel_altitude_ft", "gs_kt", "track_deg", "vrate_fpm",
        "turn_rate_dps", "closure_kt", "phase", F.hour("snapshot_ts").alias("hour_utc"),
        F.dayofweek("snapshot_ts").alias("dow"), "airport_inbound_count")


def naive_eta(dist="dist_to_apt_nm", gs="gs_kt") -> Column:
    """Minutes at the present speed straight to the field."""
    return F.try_divide(F.col(dist), F.col(gs)) * 60


def training_rows(arrivals: DataFrame, td: DataFrame) -> DataFrame:
    """Rows fit for training: confirmed landings, plausible label and speed; adds the baseline."""
    confirmed = td.where(F.col("touchdown_confidence") == "confirmed").select("seg_id")
    kept = arrivals.where(F.col(ETA_LABEL).between(0.5, 40) & F.col("dist_to_apt_nm").isNotNull() & F.col("alt_ft").isNotNull()
                          & (F.col("gs_kt") > 60))
    return eta_features(kept.join(confirmed, "seg_id", "left_semi")).withColumn("baseline_pred", naive_eta())


def scoring_rows(tracks: DataFrame, inbound: DataFrame, max_dist_nm: float = 120, fresh_min: float = 20) -> DataFrame:
    """Newest report of each aircraft seen lately, if it is inbound, airborne and moving."""
    fresh = within_latest(tracks, "snapshot_ts", fresh_min)
    newest = fresh.groupBy("icao").agg(F.max_by(F.struct(*fresh.columns), "snapshot_ts").alias("_r")).select("_r.*")
    live = newest.where(F.col("inbound_flag") & ~F.col("is_grounded") & (F.col("dist_to_apt_nm") <= max_dist_nm)
                        & (F.col("gs_kt") > 40))
    return eta_features(with_inbound_count(live, inbound))


def distance_band(dist="dist_to_apt_nm") -> Column:
    """Right-closed evaluation band, zero included; null outside."""
    d = F.col(dist)
    out, lower = None, d >= 0
    for label, upper in DISTANCE_BANDS:
        hit = lower & (d <= upper)
        out = F.when(hit, label) if out is None else out.when(hit, label)
        lower = d > upper
    return out


def error_stats(df: DataFrame, keys: list[str], error: str = "error", few_groups: bool = False) -> DataFrame:
    """Count, MAE, 90th percentile (interpolated) and bias of an error column."""
    rows = df.withColumn("_abs", F.abs(F.col(error)))
    high = exact_quantiles(rows, keys, "_abs", [0.9], few_groups=few_groups).select(*keys, F.col("q")[0].alias("_p90"))
    stats = rows.groupBy(*keys).agg(F.count(error).alias("n"), F.avg("_abs").alias("_mae"), F.avg(error).alias("_bias"))
    joined = stats.join(high, keys, "left") if keys else stats.crossJoin(high)
    return joined.select(*keys, "n", settled("_mae", 2).alias("MAE_min"), settled("_p90", 2).alias("P90_min"),
                         settled("_bias", 2).alias("bias_min"))


def band_report(df: DataFrame, pred: str, label: str = ETA_LABEL, dist: str = "dist_to_apt_nm") -> DataFrame:
    """Error by distance band, and over all rows under ALL."""
    rows = df.select((F.col(pred) - F.col(label)).alias("error"),
                     F.explode(F.array(distance_band(dist), F.lit("ALL"))).alias("band")).where(F.col("band").isNotNull())
    return error_stats(rows, ["band"], few_groups=True)


def overall_accuracy(df: DataFrame, pred: str, baseline: str, label: str = ETA_LABEL) -> DataFrame:
    """MAE and RMSE of a prediction and its improvement over a baseline, in percent."""
    miss, base = F.col(pred) - F.col(label), F.col(baseline) - F.col(label)
    return df.agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
                  F.avg(F.abs(base)).alias("baseline_mae")).withColumn(
        "improvement_pct", settled((F.col("baseline_mae") - F.col("mae")) / F.nullif(F.col("baseline_mae"), F.lit(0.0)) * 100, 1))


def prediction_errors(preds: DataFrame, td: DataFrame, within_min: int = 90, first_only: bool = False) -> DataFrame:
    """Predictions with the landings of the same aircraft in the next minutes, and the error.

    A prediction may meet several landings; `first_only` keeps the earliest.
    """
    until = F.timestamp_micros(F.unix_micros("snapshot_ts") + F.lit(within_min * 60_000_000))
    asked = preds.withColumn("_until", until)
    landings = td.select("icao", F.col("touchdown_ts").alias("actual_touchdown_ts"))
    pairs = interval_join(landings, asked.withColumnRenamed("snapshot_ts", "_asked"), ["icao"], "actual_touchdown_ts",
                          "_asked", "_until").withColumnRenamed("_asked", "snapshot_ts").drop("_until")
    if first_only:
        pairs = pairs.groupBy(*preds.columns).agg(F.min("actual_touchdown_ts").alias("actual_touchdown_ts"))
    wait = (F.unix_seconds("actual_touchdown_ts") - F.unix_seconds("snapshot_ts")) / 60.0
    return pairs.withColumn("actual_eta_min", wait).withColumn("error_min", F.col("predicted_eta_min") - wait)


def phase_index(column="phase") -> Column:
    """Position of the phase in the fixed order; unknown for anything else."""
    c = F.coalesce(F.col(column), F.lit("unknown"))
    at = F.array_position(F.array(*[F.lit(p) for p in PHASES]), c)
    return F.when(at > 0, at - 1).otherwise(PHASES.index("unknown")).cast("int")


def causal_windows(df: DataFrame, columns: list[str], key: str = "seg_id", ts: str = "snapshot_ts", length: int = 24,
                   max_gap_s: int = 180, slice_s: int = SLICE_S) -> DataFrame:
    """Adds `window` and `mask`: the last `length` reports of the segment up to this one, oldest
    first, padded with zeros at the left. No later report can enter.

    Consecutive reports of a segment are at most `max_gap_s` apart, so the history of a slice's
    rows lies in the slice itself and in the `length * max_gap_s` seconds before it.
    """
    halo_s = length * max_gap_s
    slice_s = max(slice_s, halo_s)
    own = slice_of(ts, slice_s)
    near_end = F.unix_seconds(F.col(ts)) + F.lit(halo_s) >= (own + 1) * F.lit(slice_s)
    rows = df.withColumn("_own", own).withColumn(
        "_slice", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    past = Window.partitionBy(key, "_slice").orderBy(ts).rowsBetween(-(length - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    zeros = F.array(*[F.lit(0.0)] * len(columns))
    pad = F.lit(length) - F.size("_real")
    return (
        rows.withColumn("_real", F.collect_list(step).over(past)).where(F.col("_slice") == F.col("_own"))
        .withColumns({
            "window": F.concat(F.array_repeat(zeros, pad), F.col("_real")),
            "mask": F.concat(F.array_repeat(F.lit(False), pad), F.array_repeat(F.lit(True), F.size("_real")))})
        .drop("_real", "_slice", "_own")
    )


def flat_window(window="window", mask="mask") -> Column:
    """One array per row: each step's values followed by its mask."""
    steps = F.zip_with(window, mask, lambda w, m: F.concat(w, F.array(m.cast("double"))))
    return F.flatten(steps)


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column, ignoring null and NaN; a constant or empty
    column gets deviation 1 and an empty one mean 0."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    one = df.agg(*[F.avg(v).alias(f"_m_{c}") for c, v in clean.items()], *[F.stddev_pop(v).alias(f"_s_{c}") for c, v in clean.items()])
    rows = [F.struct(F.lit(c).alias("feature"), F.coalesce(f"_m_{c}", F.lit(0.0)).alias("mean"),
                     F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0).alias("std")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def scaled(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised columns, missing values at the mean. `stats` is the one-row-per-column scaler."""
    wide = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))
    out = {}
    for c in columns:
        s = F.col("_s")[c]
        out[c] = F.coalesce(F.nanvl((F.col(c).cast("double") - s["mean"]) / s["std"], F.lit(0.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(wide)).withColumns(out).drop("_s")

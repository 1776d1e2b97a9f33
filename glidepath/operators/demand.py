"""Arrival demand: the 15-minute series, baselines, back-test, forecast and capacity checks.

After the first aggregate the data has one row per 15-minute bin, so everything below works on
at most 96 rows per series and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.constants import (ACCEPTANCE_PER_HOUR, BACKTEST_CUTS, BINS_PER_DAY, BLEND_WEIGHTS, HORIZON_BINS,
                                 QUANTILE_Z)
from glidepath.functions.numbers import settled

MODELS = ["climatological_mean", "climatological_dow", "seasonal_naive", "blended", "context_mean", "exp_smoothing"]
CANDIDATES = ["climatological_dow", "climatological_mean", "blended"]


def bin_counts(td: DataFrame, bin_s: int = 900) -> DataFrame:
    """Landings per airport and bin."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("touchdown_ts") / bin_s) * bin_s)
    return (td.where(F.col("touchdown_ts").isNotNull()).groupBy("apt_icao", start.alias("bin_start_ts"))
            .agg(F.count(F.lit(1)).alias("arrivals")))


def active_days(counts: DataFrame, min_per_day: int = 20) -> DataFrame:
    """Airport days with enough landings to be a day of collection."""
    return (counts.groupBy("apt_icao", F.to_date("bin_start_ts").alias("bin_date")).agg(F.sum("arrivals").alias("day_total"))
            .where(F.col("day_total") >= min_per_day))


def demand_series(td: DataFrame, bin_s: int = 900, min_per_day: int = 20) -> DataFrame:
    """Every bin of every active day, zero where nothing landed."""
    counts = bin_counts(td, bin_s)
    bins = 86400 // bin_s
    spine = active_days(counts, min_per_day).select(
        "apt_icao", "bin_date", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("slot"))
    start = F.timestamp_seconds(F.unix_date("bin_date").cast("bigint") * 86400 + F.col("slot") * bin_s)
    return (
        spine.withColumn("bin_start_ts", start).join(counts, ["apt_icao", "bin_start_ts"], "left")
        .select("apt_icao", "bin_start_ts", F.coalesce("arrivals", F.lit(0)).alias("arrivals"),
                F.hour("bin_start_ts").alias("hour_utc"), F.dayofweek("bin_start_ts").alias("dow"), "bin_date")
    )


def day_frame(series: DataFrame) -> DataFrame:
    """`series, date, slot 0..95, y, dow`; a slot the series lacks has a null `y`."""
    slot = F.hour("bin_start_ts") * 4 + F.floor(F.minute("bin_start_ts") / 15)
    known = series.select(F.col("apt_icao").alias("series"), F.col("bin_date").alias("date"), slot.cast("int").alias("slot"),
                          F.col("arrivals").cast("double").alias("y"))
    days = known.select("series", "date").distinct()
    grid = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(BINS_PER_DAY - 1))))
    return grid.join(known, ["series", "date", "slot"], "left").withColumn("dow", F.dayofweek("date"))


def reference_values(frame: DataFrame) -> DataFrame:
    """For every day and slot, what the other days say: mean, same-weekday mean, last other day.

    Leaving a day out is a subtraction from the totals, so no day is compared with every other.
    """
    others = Window.partitionBy("series", "slot")
    alike = Window.partitionBy("series", "slot", "dow")
    seen = F.when(F.col("y").isNotNull(), 1).otherwise(0)

    def without_self(w: Window) -> Column:
        total, n = F.coalesce(F.sum("y").over(w), F.lit(0.0)), F.sum(seen).over(w)
        return F.try_divide(total - F.coalesce("y", F.lit(0.0)), n - seen)

    by_date = Window.partitionBy("series", "slot").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    latest = F.last("date").over(by_date)
    before = F.lag("y").over(Window.partitionBy("series", "slot").orderBy("date"))
    return (
        frame.withColumns({
            "clim": without_self(others),
            "_same_dow": F.count(F.lit(1)).over(alike) - 1,
            "_dow_mean": without_self(alike),
            "_last_y": F.last("y").over(by_date),
            "naive": F.when(F.col("date") == latest, before).otherwise(F.last("y").over(by_date)),
            "n_days": F.count(F.lit(1)).over(others),
        })
        .withColumn("clim_dow", F.when(F.col("_same_dow") > 0, F.col("_dow_mean")).otherwise(F.col("clim")))
        .drop("_same_dow", "_dow_mean", "_last_y")
    )


def contexts(frame: DataFrame, cuts=BACKTEST_CUTS, alpha: float = 0.3) -> DataFrame:
    """Per day and cut: mean of the last 8 and 4 bins before the cut, and the smoothed level."""
    rows = frame.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).where(F.col("slot") < F.col("cut"))
    back = F.col("cut") - 1 - F.col("slot")
    weight = F.when(F.col("slot") == 0, F.pow(F.lit(1 - alpha), back)).otherwise(alpha * F.pow(F.lit(1 - alpha), back))
    return rows.groupBy("series", "date", "cut").agg(
        F.avg(F.when(back < 8, F.col("y"))).alias("ctx8"), F.avg(F.when(back < 4, F.col("y"))).alias("ctx4"),
        F.sum(weight * F.col("y")).alias("smoothed"))


def backtest_points(frame: DataFrame, cuts=BACKTEST_CUTS, horizon: int = HORIZON_BINS) -> DataFrame:
    """One row per day, cut and step with the actual value and each model's prediction."""
    usable = [c for c in cuts if c + horizon <= BINS_PER_DAY]
    refs = reference_values(frame).where((F.col("n_days") >= 2))
    steps = refs.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in usable]))).withColumn(
        "step", F.col("slot") - F.col("cut")).where(F.col("step").between(0, horizon - 1))
    nudge = F.lit(0.0)
    for i, w in enumerate(BLEND_WEIGHTS):
        nudge = F.when(F.col("step") == i, F.lit(w)).otherwise(nudge)
    return (
        steps.join(contexts(frame, usable), ["series", "date", "cut"])
        .withColumn("_w", nudge)
        .select("series", "date", "cut", "step", "slot", "dow", F.col("y").alias("actual"),
                F.col("clim").alias("climatological_mean"), F.col("clim_dow").alias("climatological_dow"),
                F.col("naive").alias("seasonal_naive"),
                ((1 - F.col("_w")) * F.col("clim_dow") + F.col("_w") * F.col("ctx4")).alias("blended"),
                F.col("ctx8").alias("context_mean"), F.greatest("smoothed", F.lit(0.0)).alias("exp_smoothing"))
    )


def _long(points: DataFrame, models: list[str]) -> DataFrame:
    """One row per point and model: `model, pred`, next to the actual and the naive value."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    return points.select("series", "date", "cut", "step", "actual", F.col("seasonal_naive").alias("naive"),
                         F.explode(each).alias("_m")).select("*", "_m.model", "_m.pred").drop("_m")


def quantile(mean: Column, z: float) -> Column:
    """Count spread around the mean, never below zero."""
    return F.greatest(mean + z * F.sqrt(F.greatest(mean, F.lit(1.0))), F.lit(0.0))


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    miss = actual - predicted
    return F.greatest(q * miss, (q - 1) * miss)


def ratio_to_naive(error: Column, naive_error: Column) -> Column:
    """Scaled error; null where the naive forecast is (almost) exact."""
    return F.when(naive_error > 1e-9, error / naive_error)


def backtest(frame: DataFrame, cuts=BACKTEST_CUTS, horizon: int = HORIZON_BINS, models=None) -> DataFrame:
    """MAE, MASE and weighted quantile loss of each model in each window."""
    long = _long(backtest_points(frame, cuts, horizon), models or MODELS)
    mean_loss = sum((pinball(F.col("actual"), quantile(F.col("pred"), z), q) for q, z in QUANTILE_Z), F.lit(0.0)) / len(QUANTILE_Z)
    spread = F.col("model").isin("climatological_mean", "climatological_dow")
    return (
        long.groupBy("series", "date", "cut", "model")
        .agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"),
             F.avg(F.abs(F.col("actual") - F.col("naive"))).alias("_naive"),
             F.sum(mean_loss).alias("_loss"), F.sum("actual").alias("_total"))
        .select("series", "date", "cut", "model", "mae", ratio_to_naive(F.col("mae"), F.col("_naive")).alias("mase"),
                F.when(spread, 2 * F.col("_loss") / F.greatest("_total", F.lit(1.0))).alias("wql"))
    )


def backtest_summary(windows: DataFrame) -> DataFrame:
    """Per model over all windows."""
    return windows.groupBy("model").agg(
        settled(F.avg("mae"), 3).alias("mae"), settled(F.stddev_samp("mae"), 3).alias("mae_sd"),
        settled(F.avg("mase"), 3).alias("mase"), settled(F.avg("wql"), 3).alias("wql"), F.count(F.lit(1)).alias("n"))


def best_model(windows: DataFrame, candidates=None) -> DataFrame:
    """The candidate with the lowest mean MAE."""
    scored = backtest_summary(windows.where(F.col("model").isin(candidates or CANDIDATES)))
    return scored.orderBy("mae", "model").limit(1).select("model", "mae", "mase")


def profile(frame: DataFrame) -> DataFrame:
    """Mean arrivals by slot for each weekday, and for all days under a null weekday."""
    known = frame.where(F.col("y").isNotNull())
    return (
        known.rollup("series", "slot", "dow").agg(F.avg("y").alias("mean"), F.grouping_id().alias("_g"))
        .where(F.col("_g").isin(0, 1)).drop("_g")
    )


def expected(requests: DataFrame, prof: DataFrame) -> DataFrame:
    """Adds `mean` to rows with `series, slot, dow`: the weekday's, else the slot's, else zero."""
    by_dow = prof.where(F.col("dow").isNotNull()).withColumnRenamed("mean", "_by_dow")
    by_slot = prof.where(F.col("dow").isNull()).select("series", "slot", F.col("mean").alias("_by_slot"))
    return (requests.join(by_dow, ["series", "slot", "dow"], "left").join(by_slot, ["series", "slot"], "left")
            .withColumn("mean", F.coalesce("_by_dow", "_by_slot", F.lit(0.0))).drop("_by_dow", "_by_slot"))


def with_quantiles(rows: DataFrame) -> DataFrame:
    """q10..q90 columns and the published mean, which is the median of the spread."""
    out = {f"q{round(q * 100)}": quantile(F.col("mean"), z) for q, z in QUANTILE_Z}
    return rows.withColumns(out).withColumn("predicted_mean", F.col("q50"))


def forecast(requests: DataFrame, prof: DataFrame, horizon: int = HORIZON_BINS, min_context: int = 4) -> DataFrame:
    """Next `horizon` bins for requests `series, date, current_slot, arrivals_so_far, scored_at`.

    A request with fewer than `min_context` elapsed bins is left out.
    """
    steps = requests.where(F.col("current_slot") >= min_context).withColumn(
        "horizon_step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    slot = (F.col("current_slot") + F.col("horizon_step")) % BINS_PER_DAY
    start = F.unix_date("date").cast("bigint") * 86400 + (F.col("current_slot") + F.col("horizon_step")) * 900
    rows = steps.withColumns({"slot": slot.cast("int"), "dow": F.dayofweek("date"), "bin_start_ts": F.timestamp_seconds(start)})
    return with_quantiles(expected(rows, prof)).select(
        "scored_at", F.col("series").alias("apt_icao"), "bin_start_ts", "horizon_step", "arrivals_so_far",
        F.col("q10").alias("predicted_q10"), F.col("q50").alias("predicted_q50"), F.col("q90").alias("predicted_q90"),
        "predicted_mean")


def score_requests(td: DataFrame, moments: DataFrame) -> DataFrame:
    """Forecast requests: arrivals of the same day before the current bin, zero when none were seen.

    `moments` has `series, scored_at`.
    """
    counts = bin_counts(td).select(F.col("apt_icao").alias("series"), F.to_date("bin_start_ts").alias("date"),
                                   (F.floor(F.unix_seconds("bin_start_ts") % 86400 / 900)).cast("int").alias("_slot"), "arrivals")
    now = moments.withColumns({
        "date": F.to_date("scored_at"),
        "current_slot": F.floor(F.unix_seconds("scored_at") % 86400 / 900).cast("int")})
    seen = F.when(F.col("_slot") < F.col("current_slot"), F.col("arrivals")).otherwise(0)
    return (now.join(counts, ["series", "date"], "left")
            .groupBy("series", "scored_at", "date", "current_slot")
            .agg(F.coalesce(F.sum(seen), F.lit(0)).cast("double").alias("arrivals_so_far")))


def horizon_bucket_mase(points: DataFrame, models: list[str], bucket_bins: int = 4) -> DataFrame:
    """MASE per hour of the horizon and over all of it, averaged over the windows."""
    long = _long(points, models)
    hour = F.floor(F.col("step") / bucket_bins).cast("int")
    label = F.concat(hour.cast("string"), F.lit("-"), (hour + 1).cast("string"), F.lit("h"))
    both = long.withColumn("bucket", F.explode(F.array(label, F.lit("ALL"))))
    per_window = both.groupBy("series", "date", "cut", "model", "bucket").agg(
        F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("_mae"), F.avg(F.abs(F.col("actual") - F.col("naive"))).alias("_naive"))
    return per_window.groupBy("model", "bucket").agg(
        F.avg(ratio_to_naive(F.col("_mae"), F.col("_naive"))).alias("mase"), F.count(F.lit(1)).alias("windows"))


def outlook(fc: DataFrame, per_hour: float = ACCEPTANCE_PER_HOUR) -> DataFrame:
    """Each bin of each run against capacity, with the totals of the next hour and the horizon."""
    cap = per_hour / 4
    totals = fc.groupBy("scored_at", "apt_icao").agg(
        settled(F.sum(F.when(F.col("horizon_step") < 4, F.col("predicted_mean")))).alias("next_hour_total"),
        settled(F.sum("predicted_mean")).alias("next_3h_total"))
    return fc.join(totals, ["scored_at", "apt_icao"]).select(
        "horizon_step", F.date_format("bin_start_ts", "HH:mm").alias("bin_start_utc"),
        settled("predicted_mean", 1).alias("predicted"), settled("predicted_q90", 1).alias("upper"),
        settled(F.lit(cap), 1).alias("cap_per_15min"), (F.col("predicted_mean") > cap).alias("over_cap"),
        (F.col("predicted_q90") > cap).alias("upper_over_cap"), "next_hour_total", "next_3h_total",
        F.col("arrivals_so_far").cast("bigint").alias("arrivals_seen_today"), "scored_at")


def stitched_curve(preds: DataFrame, fc: DataFrame, near_min: int = 45) -> DataFrame:
    """Arrivals per bin after each run: flights already in the air up to `near_min`, then the forecast."""
    ahead = (F.unix_seconds("predicted_touchdown_ts") - F.unix_seconds("scored_at")) / 60.0
    start = F.timestamp_seconds(F.floor(F.unix_seconds("predicted_touchdown_ts") / 900) * 900)
    flights = (
        preds.where((ahead >= 0) & (ahead < near_min))
        .groupBy("apt_icao", "scored_at", start.alias("bin_start_ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("expected")).withColumn("source", F.lit("flights")))
    later = (F.unix_seconds("bin_start_ts") - F.unix_seconds("scored_at")) / 60.0 >= near_min
    model = fc.where(later).select("apt_icao", "scored_at", "bin_start_ts", F.col("predicted_mean").alias("expected"),
                                   F.lit("forecast").alias("source"))
    return flights.unionByName(model)


def surge_alerts(points: DataFrame, model: str, threshold: float, lead_bins: int = 2) -> DataFrame:
    """Precision and recall of bins flagged above `threshold` at least `lead_bins` ahead."""
    flagged, surged = F.col(model) > threshold, F.col("actual") > threshold
    hits = points.where(F.col("step") >= lead_bins).agg(
        F.count_if(flagged).alias("flagged"), F.count_if(surged).alias("surges"), F.count_if(flagged & surged).alias("hits"))
    return hits.select("flagged", "surges", "hits", F.try_divide("hits", "flagged").alias("precision"),
                       F.try_divide("hits", "surges").alias("recall"))


def day_totals(series: DataFrame) -> DataFrame:
    """Bins, total and peak per day."""
    return series.groupBy("apt_icao", "bin_date").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("arrivals").alias("total"), F.max("arrivals").alias("peak"))

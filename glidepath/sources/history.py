"""Historical snapshots: which to take, how to conform them, and what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glidepath.functions.geo import haversine_nm
from glidepath.sources.envelopes import to_bronze

MAX_OFFSET_S = 25


def hour_in_range(hour: Column, low: int, high: int) -> Column:
    """Inclusive range of UTC hours that may wrap midnight."""
    return hour.between(low, high) if low <= high else (hour >= low) | (hour <= high)


def month_firsts(spark: SparkSession, last: str, n: int) -> DataFrame:
    """The first days of the last `n` months up to the day `last`, as `date`."""
    end = F.trunc(F.lit(last).cast("date"), "month")
    return spark.range(1).select(F.explode(F.sequence(F.add_months(end, -(n - 1)), end, F.expr("interval 1 month"))).alias("date"))


def _is_target(second_of_day: Column, interval_s: int) -> Column:
    """Whether a multiple of the interval lies in the minute."""
    minute = F.floor(second_of_day / 60) * 60
    return F.ceil(minute / interval_s) * interval_s < minute + 60


def _tag(minute_s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(minute_s), "yyyyMMdd_HHmm")


def targets(dates: DataFrame, interval_s: int = 60, hours: tuple[int, int] | None = None) -> DataFrame:
    """Target minutes of each `date`: `target_s` (epoch) and `target_tag`."""
    step = max(15, interval_s)
    second = F.explode(F.sequence(F.lit(0), F.lit(86399), F.lit(step)))
    rows = dates.select(F.unix_date("date").cast("bigint").alias("_d"), second.alias("_s"))
    minute = F.col("_d") * 86400 + F.floor(F.col("_s") / 60) * 60
    rows = rows.select(minute.alias("target_s")).distinct()
    if hours:
        rows = rows.where(hour_in_range(F.floor(F.col("target_s") % 86400 / 3600), *hours))
    return rows.withColumn("target_tag", _tag(F.col("target_s")))


def thin_snapshots(rows: DataFrame, ts: str = "snapshot_ts", interval_s: int = 60, hours: tuple[int, int] | None = None,
                   dates: list[str] | None = None, keep: bool = True) -> DataFrame:
    """Rows of the first snapshot at +0..25 s of each target minute, tagged with the target.

    The chosen times are one row per target; they are joined back on the time itself.
    """
    s = F.unix_seconds(F.col(ts))
    minute = F.floor(s / 60) * 60
    chosen = F.lit(True) & _is_target(s % 86400, max(15, interval_s)) & (s - minute <= MAX_OFFSET_S)
    if hours:
        chosen = chosen & hour_in_range(F.floor(s % 86400 / 3600), *hours)
    if dates:
        chosen = chosen & F.to_date(ts).isin([F.lit(d).cast("date") for d in dates])
    near = rows.where(chosen).withColumn("_m", minute)
    first = near.groupBy("_m").agg(F.min(ts).alias(ts))
    return near.join(first, ["_m", ts], "left_semi").withColumn("target_tag", _tag(F.col("_m"))).drop("_m") if keep else first


def worklist(wanted: DataFrame, written: DataFrame, cap: int | None = None) -> DataFrame:
    """Targets not written yet, oldest first; `cap` bounds one run, the next run takes the rest."""
    todo = wanted.join(written.select("target_tag").distinct(), "target_tag", "left_anti")
    return todo.orderBy("target_s").limit(cap) if cap else todo


def conform_history(envelopes: DataFrame, lat: float, lon: float, apt: str, radius_nm: float = 100, interval_s: int = 60,
                    hours: tuple[int, int] | None = None, dates: list[str] | None = None) -> DataFrame:
    """Archive envelopes (time in seconds) as Bronze rows of one airport.

    Reports without a fix or beyond the radius are dropped. Rows go straight to the Bronze shape;
    wrapping a snapshot's reports into one document again would put them into one row.
    """
    stamped = envelopes.withColumn("snapshot_ts", F.timestamp_millis((F.col("now") * 1000).cast("bigint")))
    taken = thin_snapshots(stamped, interval_s=interval_s, hours=hours, dates=dates).drop("snapshot_ts", "target_tag")
    rows = to_bronze(taken, now_in_seconds=True)
    near = haversine_nm("report.lat", "report.lon", lat, lon) <= radius_nm
    kept = rows.where(F.col("report.lat").isNotNull() & F.col("report.lon").isNotNull() & near)
    minute = F.floor(F.unix_seconds("snapshot_ts") / 60) * 60
    return kept.withColumns({
        "apt_icao": F.lit(apt), "apt_lat": F.lit(lat), "apt_lon": F.lit(lon), "radius_nm": F.lit(int(radius_nm)),
        "source": F.lit("backfill"), "target_tag": _tag(minute), "src_date": F.to_date("snapshot_ts").cast("string")})


def land(df: DataFrame, root: str, ts: str = "snapshot_ts", files: int = 16) -> None:
    """Writes rows under `dt=/hh=` folders. The rows of an hour go to `files` tasks by their content."""
    parts = df.withColumns({"dt": F.to_date(ts), "hh": F.date_format(ts, "HH")})
    (parts.repartition("dt", "hh", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("append").partitionBy("dt", "hh").json(root))

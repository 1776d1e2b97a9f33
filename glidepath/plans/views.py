"""Parameterised read views over the serving tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.constants import ACCEPTANCE_PER_HOUR
from glidepath.functions.numbers import settled
from glidepath.operators import demand


def latest_run(df: DataFrame, stamp: str = "scored_at", where: Column | None = None) -> DataFrame:
    """All rows of the newest run; `where` limits both the rows and the search for that run."""
    rows = df if where is None else df.where(where)
    newest = rows.agg(F.unix_micros(F.max(stamp)).alias("m")).first()["m"]  # a literal, so the filter reaches the scan
    return rows.where(F.lit(False) if newest is None else F.col(stamp) == F.timestamp_micros(F.lit(newest)))


def latest_rows(df: DataFrame, stamp: str, n: int = 1) -> DataFrame:
    return df.orderBy(F.desc(stamp)).limit(n)


def shown_name() -> Column:
    """Callsign, or the aircraft id where the callsign is blank."""
    return F.coalesce(F.nullif(F.trim("callsign"), F.lit("")), F.col("icao"))


def hhmm(ts: str) -> Column:
    return F.date_format(ts, "HH:mm")


def arrival_picture(preds: DataFrame) -> DataFrame:
    """Inbound counts of the latest run; no row where there is no run."""
    return latest_run(preds).agg(
        F.count(F.lit(1)).alias("inbound"), F.count_if(F.col("predicted_eta_min") <= 10).alias("within_10_min"),
        F.count_if(F.col("predicted_eta_min") <= 30).alias("within_30_min"), F.max("model_version").alias("model_version"),
        F.max("scored_at").alias("scored_at")).where(F.col("inbound") > 0)


def next_arrivals(preds: DataFrame, n: int) -> DataFrame:
    """The next `n` (1..20) aircraft of the latest run. Limited first, so the rank sees 20 rows."""
    soonest = latest_run(preds).orderBy("predicted_touchdown_ts", "icao").limit(min(max(n, 1), 20))
    # a window without partition, over at most 20 rows
    rank = F.row_number().over(Window.orderBy("predicted_touchdown_ts", "icao"))
    return soonest.select(
        rank.alias("rank"), shown_name().alias("callsign"), "ac_type", settled("predicted_eta_min", 1).alias("eta_min"),
        hhmm("predicted_touchdown_ts").alias("touchdown_utc"), settled("dist_to_apt_nm").alias("dist_nm"), "scored_at")


def aircraft(preds: DataFrame, name: str) -> DataFrame:
    """One aircraft of the latest run by callsign or id, in any case."""
    asked = F.trim(F.lit(name))
    hit = (F.upper(F.trim("callsign")) == F.upper(asked)) | (F.lower("icao") == F.lower(asked))
    return latest_run(preds).where(hit).select(
        shown_name().alias("callsign"), "ac_type", settled("predicted_eta_min", 1).alias("eta_min"),
        hhmm("predicted_touchdown_ts").alias("touchdown_utc"), settled("dist_to_apt_nm").alias("dist_nm"),
        settled(F.col("alt_ft").cast("double")).alias("alt_ft"), settled("gs_kt").alias("gs_kt"),
        settled("vrate_fpm").alias("vrate_fpm"), "phase", "scored_at")


def demand_outlook(fc: DataFrame, per_hour: float = ACCEPTANCE_PER_HOUR) -> DataFrame:
    return demand.outlook(latest_run(fc), per_hour)


def current_flags(flags: DataFrame, preds: DataFrame, apt: str, window_min: float = 15) -> DataFrame:
    """The latest flag run, unless it is more than `window_min` older than the newest predictions:
    a quiet run writes no flags, so an old run says that nothing is flagged now."""
    newest = preds.agg(F.max("scored_at").alias("_pred"))
    age = F.unix_micros("_pred") - F.unix_micros("scored_at")
    return (latest_run(flags, where=F.col("apt_icao") == apt).crossJoin(F.broadcast(newest))
            .where(age <= F.lit(int(window_min * 60_000_000))).drop("_pred"))


def irregularities(flags: DataFrame, preds: DataFrame, apt: str) -> DataFrame:
    """Current flags, most severe and nearest first, with the number of flags of each kind."""
    now = current_flags(flags, preds, apt)
    kinds = now.groupBy("kind").agg(F.count(F.lit(1)).alias("kind_count"))  # three kinds
    return now.join(F.broadcast(kinds), "kind").orderBy(F.desc("severity"), "dist_to_apt_nm").select(
        "kind", "kind_count", "severity", shown_name().alias("callsign"), "ac_type", settled("dist_to_apt_nm").alias("dist_nm"),
        settled(F.col("alt_ft").cast("double")).alias("alt_ft"), "detail", "scored_at")


def latest_briefing(briefings: DataFrame, apt: str) -> DataFrame:
    return latest_rows(briefings.where(F.col("apt_icao") == apt), "generated_at").select(
        "briefing", "source", "stale", "data_as_of", "generated_at")


def refresh_status(audit: DataFrame, apt: str) -> DataFrame:
    return latest_rows(audit.where(F.col("apt_icao") == apt), "checked_at").select(
        "status", settled("elapsed_min", 1).alias("elapsed_min"), "data_as_of", F.col("n_inbound").alias("inbound"),
        F.col("n_flags").alias("flagged"), "briefing_source", "reasons", "warnings", "checked_at")


def model_named(text: Column) -> Column:
    """The registered model that a free-text name means."""
    t = F.lower(text)
    return (F.when(t.rlike("model ?1|eta|touchdown|arrival.?time"), "eta_touchdown")
            .when(t.rlike("model ?2|demand|forecast"), "demand_forecast").otherwise(F.trim(text)))


def model_status(audit: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The last gate runs of the model a text names."""
    hits = audit.where(F.endswith("model_name", model_named(F.lit(name))))
    return latest_rows(hits, "audited_at", n).select(
        "model_name", "gate_verdict", "challenger_version", "champion_version_before", "applied", "reasons", "audited_at")


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "significant", 0).when(F.col(column) == "moderate", 1).otherwise(2)


def model_health(health: DataFrame) -> DataFrame:
    """The newest checks, most severe first."""
    return latest_run(health, "checked_at").orderBy(severity_rank(), "metric_name").select(
        "check_type", "metric_name", settled("value", 3).alias("value"), "severity", "detail", "checked_at")


def headline(fc: DataFrame, flags: DataFrame, preds: DataFrame, apt: str, per_hour: float = ACCEPTANCE_PER_HOUR) -> DataFrame:
    """One row: the horizon's total against capacity, headroom at the first busiest bin, alerts."""
    cap = per_hour / 4
    peak = F.max_by(F.struct("predicted_mean", "bin_start_ts"), F.struct("predicted_mean", -F.col("horizon_step")))
    run = latest_run(fc).agg(
        settled(F.sum("predicted_mean")).alias("next_3h"), (F.count(F.lit(1)) * cap).alias("capacity_3h"), peak.alias("_p"))
    kinds = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("emergency", "go_around", "holding")}
    alerts = current_flags(flags, preds, apt).agg(F.count(F.lit(1)).alias("alerts"), *kinds.values())
    inbound = latest_run(preds).agg(F.count(F.lit(1)).alias("inbound_now"))
    return run.crossJoin(alerts).crossJoin(inbound).select(
        "inbound_now", "next_3h", "capacity_3h", settled(cap - F.col("_p.predicted_mean"), 1).alias("peak_headroom"),
        hhmm("_p.bin_start_ts").alias("peak_utc"), "alerts", *kinds)


def eta_band(eta: str = "predicted_eta_min") -> Column:
    """Map class of a prediction."""
    return F.when(F.col(eta) <= 10, "≤ 10 min").when(F.col(eta) <= 25, "10–25 min").otherwise("> 25 min")


def oldest_stamp(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The oldest of the sources' newest stamps: the age of a picture made from all of them."""
    out = None
    for name, (df, stamp) in sources.items():
        one = df.agg(F.lit(name).alias("source"), F.max(stamp).alias("stamp"))
        out = one if out is None else out.unionByName(one)
    first = F.min(F.struct("stamp", "source"))  # one row per source
    return out.agg(first.alias("f")).select(F.col("f.stamp").alias("data_as_of"), F.col("f.source").alias("oldest_source"))


def decoded(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """A table of text cells in the declared types; a cell that does not parse becomes null."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def compacted(df: DataFrame, order: list, max_rows: int = 25) -> DataFrame:
    """The first rows of a result with its true row count and whether it was cut (a display report)."""
    n = df.agg(F.count(F.lit(1)).alias("row_count"))
    return df.orderBy(*order).limit(max_rows).crossJoin(F.broadcast(n)).withColumn(
        "truncated", F.col("row_count") > max_rows)

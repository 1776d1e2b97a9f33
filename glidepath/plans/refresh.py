"""The live refresh: Silver to tracks, rule tables, scores, flags, facts and the readiness verdict.

Steps hand over through written tables, so each one reads stored rows and a lost executor costs
only the running step.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.constants import ACCEPTANCE_PER_HOUR, FIELD_ELEV_FT
from glidepath.operators import demand, events, features, learn, runs, traffic
from glidepath.operators.tracks import carried_on, enrich_tracks, incremental_tracks, open_segments
from glidepath.plans import situation
from glidepath.sources.catalog import Catalog, stored

LIVE = ["predictions", "demand_forecast", "irregularity_flags"]
HISTORY = ["silver", "tracks", "touchdowns"]
_KEEP = ("seg_end_ts",)
#: Rules and scores look back half an hour at most.
LIVE_MINUTES = 60


def _rule_tables(tracks: DataFrame, segments: DataFrame, elev_ft: int) -> dict[str, DataFrame]:
    """The tables with one row per segment, each with the segment's end."""
    return {"holding": events.holding(segments, keep=_KEEP), "touchdowns": events.touchdowns(segments, elev_ft, keep=_KEEP),
            "irregularities": events.irregularities(tracks, segments, elev_ft, keep=_KEEP)}


def _kpis(cat: Catalog, silver: DataFrame) -> None:
    cat.replace("kpis", traffic.kpis(silver, cat.read("tracks"), cat.read("holding"), cat.read("touchdowns")))


def _load(moment: str) -> int:
    """A register goes by the second it stands for."""
    return int(datetime.fromisoformat(moment).replace(tzinfo=timezone.utc).timestamp())


def _opening(cat: Catalog, silver: DataFrame, cutoff: str) -> DataFrame:
    """The register of the load that ended at `cutoff`; without one, it is made from the history."""
    if cat.exists("open_segments"):
        held = cat.read_load("open_segments", _load(cutoff))
        if not held.isEmpty():
            return held
    return stored(open_segments(silver, cutoff), "open-segments")


def build_gold(cat: Catalog, silver: DataFrame, elev_ft: int = FIELD_ELEV_FT, end: str | None = None) -> None:
    """Full rebuild of tracks and everything derived from them. `end` (UTC text): where the next load begins; its register is kept."""
    if end:
        cat.append_load("open_segments", open_segments(silver, end), _load(end))
    cat.replace("tracks", enrich_tracks(silver), "snapshot_ts", ["icao", "snapshot_ts"])
    tracks = cat.read("tracks")
    cat.replace("segments", events.segment_summary(tracks, elev_ft), "seg_end_ts")
    cat.replace("congestion", traffic.congestion(tracks), "minute_ts")
    for name, df in _rule_tables(tracks, cat.read("segments"), elev_ft).items():
        cat.replace(name, df, "seg_end_ts")
    _kpis(cat, silver)


def update_gold(cat: Catalog, silver: DataFrame, cutoff: str, end: str | None = None, elev_ft: int = FIELD_ELEV_FT, max_gap_s: int = 180) -> None:
    """Serving mode: only rows from `cutoff` (UTC text) on are rebuilt; training tables are left alone.

    Segments open at the cutoff come from the register of the load before; with `end`, the one for the next load is kept. A load that is
    run again reads and writes the same registers.

    Segment tables are replaced by the segment's end, from `max_gap_s` before the cutoff: a segment
    that grows into the window ended no earlier than that, so no earlier row of it stays behind.
    The tracks of those segments are read from the oldest start among them, not from the beginning.
    """
    opening = _opening(cat, silver, cutoff)
    rows = silver.where(F.col("snapshot_ts") < F.lit(end).cast("timestamp")) if end else silver
    fresh = incremental_tracks(rows, cutoff, opening, max_gap_s=max_gap_s)
    cat.replace_window("tracks", fresh, "snapshot_ts", cutoff, ["icao", "snapshot_ts"])
    if end:
        done = cat.since("tracks", "snapshot_ts", datetime.fromisoformat(cutoff))
        cat.append_load("open_segments", carried_on(opening, done, end, max_gap_s=max_gap_s), _load(end))
    at = datetime.fromisoformat(cutoff)
    grown = at - timedelta(seconds=max_gap_s)
    near = cat.since("tracks", "snapshot_ts", grown)
    oldest = near.agg(F.min("seg_start_ts").alias("s")).first()["s"]  # one value, as a literal for the scan
    if oldest is None:
        return
    whole = cat.since("tracks", "snapshot_ts", oldest).join(near.select("seg_id").distinct(), "seg_id", "left_semi")
    segments = stored(events.segment_summary(whole, elev_ft), "segments")
    cat.replace_window("segments", segments, "seg_end_ts", grown.isoformat(" "))
    for name, df in _rule_tables(whole, segments, elev_ft).items():
        cat.replace_window(name, df, "seg_end_ts", grown.isoformat(" "))
    minute = at.replace(second=0, microsecond=0)
    cat.replace_window("congestion", traffic.congestion(cat.since("tracks", "snapshot_ts", minute)), "minute_ts", minute.isoformat(" "))
    _kpis(cat, silver)


def score(cat: Catalog, model: PipelineModel, version: int, now, profile: DataFrame, apt: str) -> None:
    """Appends one run of predictions, forecast and flags, all stamped `now`."""
    at = F.lit(now).cast("timestamp")
    # the longest look back of scoring and flags, and the minutes its rows lie in
    tracks = cat.recent("tracks", "snapshot_ts", LIVE_MINUTES)
    inbound = traffic.common_ring_inbound(cat.recent("congestion", "minute_ts", LIVE_MINUTES))
    cat.append("predictions", learn.score_batch(model, features.scoring_rows(tracks, inbound), version, at), "scored_at")
    moment = cat.spark.range(1).select(F.lit(apt).alias("series"), at.alias("scored_at"))
    # a forecast asks for the landings of its own day
    landings = cat.since("touchdowns", "seg_end_ts", datetime.fromisoformat(now).replace(hour=0, minute=0, second=0))
    asked = demand.score_requests(landings.where(F.col("apt_icao") == apt), moment)
    cat.append("demand_forecast", demand.forecast(asked, profile), "scored_at")
    cat.append("irregularity_flags", events.live_flags(tracks, apt).withColumn("scored_at", at), "scored_at")


def brief(cat: Catalog, now, apt: str, per_hour: float = ACCEPTANCE_PER_HOUR) -> None:
    """Appends the situation text of the moment, with the age of its data."""
    moment = cat.spark.range(1).select(F.lit(now).cast("timestamp").alias("now"))
    tables = [cat.newest_day(t) if cat.exists(t) else None for t in LIVE]
    facts = situation.facts_text(situation.situation_facts(*tables, apt, moment, per_hour))
    rows = facts.select(
        F.col("now").alias("generated_at"), F.lit(apt).alias("apt_icao"), F.col("text").alias("briefing"), F.lit("template").alias("source"),
        F.least("inbound_at", "demand_at", "flags_at").alias("data_as_of"), F.col("max_age_min"), "source_skew_min", "stale")
    cat.append("ops_briefings", rows)


def check(cat: Catalog, run_docs: DataFrame, run_id: int, now, apt: str, elapsed_min: float, max_age_min: float = 15,
          budget_min: float = 10) -> DataFrame:
    """Appends the readiness verdict of a refresh run and returns it."""
    at = F.lit(now).cast("timestamp")

    def age(name: str, stamp: str, label: str) -> DataFrame:
        newest = cat.read(name).agg(F.max(stamp).alias("_s")) if cat.exists(name) else cat.spark.range(1).select(
            F.lit(None).cast("timestamp").alias("_s"))
        return newest.select(((F.unix_micros(at) - F.unix_micros("_s")) / 6e7).alias(label))
    source = (cat.read("ops_briefings").agg(F.max_by("source", "generated_at").alias("briefing_source")) if cat.exists("ops_briefings")
              else cat.spark.range(1).select(F.lit(None).cast("string").alias("briefing_source")))
    inbound = (cat.newest_day("predictions").where(F.col("scored_at") == at) if cat.exists("predictions") else cat.spark.range(0)).agg(
        F.count(F.lit(1)).alias("n_inbound"))
    status = (age("tracks", "snapshot_ts", "gold_age_min").crossJoin(age("demand_forecast", "scored_at", "forecast_age_min"))
              .crossJoin(age("ops_briefings", "generated_at", "briefing_age_min")).crossJoin(source).crossJoin(inbound)
              .withColumns({"run_id": F.lit(run_id).cast("bigint"), "elapsed_min": F.lit(float(elapsed_min))}))
    steps = runs.step_timings(runs.parsed_runs(run_docs)).where(F.col("run_id") == run_id)
    verdict = runs.readiness(steps, status, max_age_min, budget_min).withColumns({"checked_at": at, "apt_icao": F.lit(apt)})
    cat.append("refresh_audit", verdict)
    return cat.read("refresh_audit").where(F.col("checked_at") == at)

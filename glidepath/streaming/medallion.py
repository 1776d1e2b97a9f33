"""Triggered streams: envelope files to Bronze to Silver, and windows on top of Silver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glidepath.operators.tracks import enrich_tracks
from glidepath.operators.traffic import aircraft_sums, congestion_measures, ring
from glidepath.sources.envelopes import read_envelopes, to_bronze, to_silver


def write_available(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Processes everything that has arrived, then stops. The checkpoint makes a rerun idempotent."""
    writer = (df.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def with_day(df: DataFrame, ts: str = "snapshot_ts") -> DataFrame:
    return df.withColumn("dt", F.to_date(ts))


def run_bronze(spark: SparkSession, landing: str, root: str, max_files: int | None = None, one_per_file: bool = True) -> DataFrame:
    """Ingests new envelope files into Bronze and returns the Bronze table."""
    raw = read_envelopes(spark, landing, streaming=True, one_per_file=one_per_file, max_files=max_files)
    bronze = with_day(to_bronze(raw))
    write_available(bronze, f"{root}/bronze", f"{root}/_checkpoints/bronze", ["dt"])
    return spark.read.schema(bronze.schema).parquet(f"{root}/bronze")


def bronze_stream(spark: SparkSession, root: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{root}/bronze")


def refine(spark: SparkSession, root: str, schema, max_files: int | None = None, watermark: str = "15 minutes") -> tuple[DataFrame, StreamingQuery]:
    """Refines new Bronze rows into Silver; the Silver table and the finished query, which holds the observed counts."""
    silver = with_day(to_silver(bronze_stream(spark, root, schema, max_files).drop("dt"), watermark, observe="silver"))
    query = write_available(silver, f"{root}/silver", f"{root}/_checkpoints/silver", ["dt"])
    return spark.read.schema(silver.schema).parquet(f"{root}/silver"), query


def run_silver(spark: SparkSession, root: str, schema, max_files: int | None = None, watermark: str = "15 minutes") -> DataFrame:
    """Refines new Bronze rows into Silver and returns the Silver table."""
    return refine(spark, root, schema, max_files, watermark)[0]


def run_medallion(spark: SparkSession, landing: str, root: str, max_files: int | None = None,
                  one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both hops over what has arrived; returns the Bronze and Silver tables."""
    bronze = run_bronze(spark, landing, root, max_files, one_per_file)
    return bronze, run_silver(spark, root, bronze.schema, max_files)


def split_by_age(bronze: DataFrame, newest_s: int, watermark_s: int = 900) -> tuple[DataFrame, DataFrame]:
    """Rows the live stream would accept, and older rows for the batch path: a stream drops what
    lies behind its watermark, so a backfill of old days must not go through it."""
    live = F.unix_seconds("snapshot_ts") >= newest_s - watermark_s
    return bronze.where(live), bronze.where(~live)


def merge_backfill(silver: DataFrame, old_bronze: DataFrame) -> DataFrame:
    """Silver with backfilled rows added; a report that is already there is not added again."""
    fresh = to_silver(old_bronze)
    new = fresh.join(silver.select("icao", "snapshot_ts"), ["icao", "snapshot_ts"], "left_anti")
    return silver.unionByName(new, allowMissingColumns=True)


def run_backfill(spark: SparkSession, root: str, silver: DataFrame, old_bronze: DataFrame) -> DataFrame:
    """Adds old rows beside a live stream, whose watermark would drop them, and returns Silver with them.

    They go to a folder of their own by day, since the stream's folder belongs to its log. Only days of the old rows are compared; a
    report that is already in Silver or was backfilled before is not added, so a rerun adds nothing. `silver` is the stream's table.
    """
    path = f"{root}/silver_backfill"
    fresh = with_day(to_silver(old_bronze)).select(*silver.columns)
    spark.createDataFrame([], silver.schema).write.mode("append").partitionBy("dt").parquet(path)
    both = silver.unionByName(spark.read.schema(silver.schema).parquet(path))
    days = old_bronze.agg(F.to_date(F.min("snapshot_ts")).alias("first"), F.to_date(F.max("snapshot_ts")).alias("last")).first()
    held = both.where(F.col("dt").between(F.lit(days["first"]), F.lit(days["last"]))).select("icao", "snapshot_ts")
    fresh.join(held, ["icao", "snapshot_ts"], "left_anti").select(*silver.columns).write.mode("append").partitionBy("dt").parquet(path)
    return silver.unionByName(spark.read.schema(silver.schema).parquet(path))


def observed_counts(query: StreamingQuery, name: str = "silver") -> dict[str, int]:
    """Rows and rule violations that a finished triggered query observed, summed over its batches.

    Spark keeps `spark.sql.streaming.numRecentProgressUpdates` reports; a run with more batches fails here rather than count too few.
    """
    reports = query.recentProgress
    if len(reports) >= int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates")):
        raise ValueError("more batches than kept progress reports; raise spark.sql.streaming.numRecentProgressUpdates")
    total: dict[str, int] = {}
    for report in reports:
        seen = report.observedMetrics.get(name)
        for rule, n in (seen.asDict() if seen is not None else {}).items():
            total[rule] = total.get(rule, 0) + n
    return total


def windowed_congestion(silver: DataFrame, watermark: str = "15 minutes") -> DataFrame:
    """Airborne aircraft per minute and ring, on a stream or a table.

    A stream cannot count distinct values exactly, so one row per aircraft, minute and ring is let
    through first. Both steps key on the minute window, so closed minutes leave their states.
    """
    rows = silver.withWatermark("snapshot_ts", watermark) if silver.isStreaming else silver
    keys = ["w", "apt_icao", "ring"]
    minutes = rows.where(~F.col("is_grounded")).withColumns({"ring": ring(), "w": F.window("snapshot_ts", "1 minute")})
    once = minutes.select(*keys, "icao").dropDuplicates([*keys, "icao"])
    return once.groupBy(*keys).agg(F.count("icao").alias("n_aircraft")).select(
        F.col("w.start").alias("minute_ts"), "apt_icao", "ring", "n_aircraft")


def windowed_measures(tracks: DataFrame, watermark: str = "15 minutes") -> DataFrame:
    """All measures of `traffic.congestion` per minute and ring, on a stream or a table of tracks.

    Two chained aggregates in one query: sums per aircraft, minute and ring, then the measures over aircraft, so distinct counts and
    averages are exact. A closed minute leaves the first state as one row per aircraft and the second one with it.
    """
    rows = tracks.withWatermark("snapshot_ts", watermark) if tracks.isStreaming else tracks
    airborne = rows.where(~F.col("is_grounded")).withColumn("ring", ring())
    each = airborne.groupBy(F.window("snapshot_ts", "1 minute").alias("w"), "apt_icao", "ring", "icao").agg(*aircraft_sums())
    minutes = each.groupBy(F.window(F.window_time("w"), "1 minute").alias("m"), "apt_icao", "ring").agg(*congestion_measures())
    return minutes.select(F.col("m.start").alias("minute_ts"), *[c for c in minutes.columns if c != "m"])


def session_segments(silver: DataFrame, gap: str = "180 seconds", watermark: str = "15 minutes") -> DataFrame:
    """Segments as session windows per aircraft: start, last report and count.

    A session closes `gap` after its last report and then leaves the state; on a stream only
    closed sessions are emitted. Reports exactly `gap` apart stay in one session, as in batch.
    """
    rows = silver.withWatermark("snapshot_ts", watermark) if silver.isStreaming else silver
    return rows.groupBy("icao", F.session_window("snapshot_ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.max("snapshot_ts").alias("seg_end_ts"), F.min("dist_to_apt_nm").alias("min_dist_nm")
    ).select("icao", F.col("w.start").alias("seg_start_ts"), "seg_end_ts", "n_reports", "min_dist_nm")


def batch_tracks(silver: DataFrame) -> DataFrame:
    """The batch twin of the stateful stream, and the source of truth."""
    return enrich_tracks(silver)

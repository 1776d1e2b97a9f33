"""Silver in one micro-batch step that loses no late row and commits every batch once.

A stream's own de-duplication drops what lies behind its watermark. Here each batch deals its rows by the watermark to two parts of the
Silver table, `late=false` and `late=true`, both without reports that Silver has already. A ledger holds one row per committed batch:
readers see committed batches only, and a batch that was written but not committed is written again over its own files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glidepath.sources.envelopes import to_silver
from glidepath.streaming.medallion import bronze_stream

LEDGER = "newest timestamp, mark timestamp, on_time bigint, late_rows bigint, batch bigint"
_PLACE = ["late", "dt", "batch"]
#: A day is written in parts of so many seconds, so no task holds a whole day and a file spans a stretch of it.
PART_S = 3 * 3600


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Committed batches: newest report so far, the watermark it was dealt by (null for the first), rows of either part."""
    path = f"{root}/ledger"
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _silver(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows written, with the columns of their place; `schema` is that of a Silver report."""
    path = f"{root}/silver_dealt"
    full = StructType([*schema.fields, *StructType.fromDDL("late boolean, dt date, batch bigint").fields])
    spark.createDataFrame([], full).write.mode("append").partitionBy(*_PLACE).parquet(path)
    return spark.read.schema(full).parquet(path)


def _committed(spark: SparkSession, root: str) -> tuple[int, object]:
    """Number of the last committed batch (-1: none) and the newest report up to it: one row of the ledger."""
    row = ledger(spark, root).agg(F.max("batch").alias("b"), F.max("newest").alias("n")).first()
    return (-1 if row["b"] is None else row["b"]), row["n"]


def silver_of(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The committed Silver table: on-time and late rows, `late` tells which."""
    last, _ = _committed(spark, root)
    return _silver(spark, root, schema).where(F.col("batch") <= last).drop("batch")


def deal(bronze: DataFrame, batch: int, root: str, delay_s: int = 900, before_commit: Callable[[int], None] | None = None) -> None:
    """Writes and commits one batch of Bronze rows; a batch that is committed already is left alone.

    The watermark is `delay_s` before the newest report of earlier batches. Rows are compared with Silver's day folders that they lie in,
    from the batch's first report on, which files sorted by time leave most of a day out for; two columns are read. One job writes both
    parts; a replay has the same rows, since it is dealt by the same ledger and compared with committed batches only.
    """
    spark = bronze.sparkSession
    last, newest = _committed(spark, root)
    if batch <= last:
        return
    rows = to_silver(bronze)
    schema = rows.schema
    mark = F.lit(None).cast("timestamp") if newest is None else F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay_s} SECONDS")
    dealt = rows.withColumns({"late": F.coalesce(F.col("snapshot_ts") < mark, F.lit(False)), "dt": F.to_date("snapshot_ts"),
                              "batch": F.lit(batch).cast("bigint")})
    if newest is not None:
        first = {r["dt"]: r["t"] for r in dealt.groupBy("dt").agg(F.min("snapshot_ts").alias("t")).collect()}  # days of one batch
        held = _silver(spark, root, schema).where(F.col("batch") <= last)
        if first:
            held = held.where(F.col("dt").isin(list(first)) & (F.col("snapshot_ts") >= F.lit(min(first.values()))))
        dealt = dealt.join(held.select("icao", "snapshot_ts"), ["icao", "snapshot_ts"], "left_anti")
    path = f"{root}/silver_dealt"
    part = F.floor(F.unix_seconds("snapshot_ts") / PART_S)
    (dealt.select(*schema.names, *_PLACE).repartition("late", "dt", part).sortWithinPartitions("late", "dt", "snapshot_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*_PLACE).parquet(path))
    if before_commit:
        before_commit(batch)
    mine = _silver(spark, root, schema).where(F.col("batch") == batch).agg(
        F.max("snapshot_ts").alias("n"), F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late_rows"))
    row = mine.select(F.greatest(F.col("n"), F.lit(newest).cast("timestamp")).alias("newest"), mark.alias("mark"), "on_time", "late_rows")
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch}")


def run_dealt(spark: SparkSession, root: str, schema: StructType, max_files: int | None = None, delay_s: int = 900,
              before_commit: Callable[[int], None] | None = None) -> None:
    """Deals the Bronze rows that have arrived, batch by batch, then stops; the next call goes on behind the last committed one.

    `before_commit` is called between a batch's write and its commit; tests stop a run there.
    """
    ledger(spark, root)
    stream = bronze_stream(spark, root, schema, max_files).drop("dt")
    query = (stream.writeStream.foreachBatch(lambda batch, n: deal(batch, n, root, delay_s, before_commit))
             .option("checkpointLocation", f"{root}/_checkpoints/dealt").trigger(availableNow=True).start())
    query.awaitTermination()

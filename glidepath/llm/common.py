"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidepath.session import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to a new folder under `spark.checkpoint.dir` and read again.

    Cuts the lineage with files that outlive any executor. Spark does not delete such folders; they go with the job's checkpoint folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def positions(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """`df` with `position`, its row number from 0 in the order of the columns `order`, and the number of rows.

    Range partitions are numbered on their own and shifted by the rows before them, so no task sees more than one partition.
    """
    spark = df.sparkSession
    n = partitions(spark)
    dealt = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    # One row per range partition: their number is a setting, not a property of the data.
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_inner", inner).join(F.broadcast(before), "_part")
    return out.withColumn("position", F.col("_before") + F.col("_inner") - 1).drop("_part", "_inner", "_before"), int(total)


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches that hold about `limit` bytes of text each (one row at least), with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(column).to_pylist()
            start = stop


_store: dict[str, Any] = {}


def worker_store(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps under `name`, made if it is not there.

    Spark reuses workers from stage to stage, so a worker keeps one store only: asking for another lets the last one go first, and a
    worker's memory is that of its largest store, not their sum.
    """
    if name not in _store:
        _store.clear()
        _store[name] = make()
    return _store[name]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))

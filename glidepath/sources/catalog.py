"""Tables as plain Parquet folders under one root: rebuild, window replace, widening append, numbered loads, reset.

A table with a time column is partitioned by its day, `dt`, so windows are read and replaced by
day folders. Spark stages every write and swaps folders at commit. Silver is the source of truth:
after a run that died while swapping, the same call with a cutoff at the start of the day builds
its window again. One writer per table at a time.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from glidepath.session import fresh_path


#: Of the files written here: a sixth smaller than Spark's default for reports, whose doubles hardly repeat.
CODEC = "zstd"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back, which cuts lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Catalog:
    """Tables under `root`. A day of a table is written as at most `files_per_day` files, unless its rows come dealt (see `replace`)."""

    def __init__(self, spark: SparkSession, root: str, files_per_day: int = 32):
        self.spark, self.root, self.files_per_day = spark, root.rstrip("/"), files_per_day

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def _days(self, name: str, widened: bool = False) -> DataFrame:
        return self.spark.read.option("mergeSchema", widened).parquet(self.path(name))

    def read(self, name: str, widened: bool = False) -> DataFrame:
        """The table. `widened` merges the schemas of all files: columns appended later are null in older rows."""
        return self._days(name, widened).drop("dt")

    def since(self, name: str, time_col: str, moment: datetime) -> DataFrame:
        """Rows at or after a moment (UTC); only the folders of its day and later ones are read."""
        at = F.lit(moment.isoformat(" ")).cast("timestamp")
        return self._days(name).where((F.col("dt") >= F.lit(moment.date())) & (F.col(time_col) >= at)).drop("dt")

    def days(self, name: str) -> list[str]:
        """The table's day folders in order, from the listing of its files; no file is opened."""
        found = {hit[1] for f in self._days(name).inputFiles() if (hit := re.search(r"/dt=(\d{4}-\d\d-\d\d)/", f))}
        return sorted(found)

    def newest_day(self, name: str) -> DataFrame:
        """Rows of the last day that has any; other day folders stay unread."""
        rows = self._days(name)
        for day in reversed(self.days(name)):  # an emptied day keeps a folder, so the first one usually ends the search
            last = rows.where(F.col("dt") == F.lit(day).cast("date")).drop("dt")
            if not last.isEmpty():
                return last
        return rows.where(F.lit(False)).drop("dt")

    def newest(self, name: str, stamp: str) -> datetime | None:
        """The newest stamp of a table (UTC), from its last day."""
        micros = self.newest_day(name).agg(F.unix_micros(F.max(stamp)).alias("m")).first()["m"]
        return None if micros is None else datetime(1970, 1, 1) + timedelta(microseconds=micros)

    def latest_run(self, name: str, stamp: str = "scored_at") -> DataFrame:
        """All rows with the newest stamp: day and stamp reach the scan as literals."""
        at = self.newest(name, stamp)
        if at is None:
            return self.newest_day(name)
        return self.since(name, stamp, at)

    def recent(self, name: str, time_col: str, minutes: float) -> DataFrame:
        """Rows no older than `minutes` before the newest one; days before that stay unread."""
        at = self.newest(name, time_col)
        if at is None:
            return self.newest_day(name)
        return self.since(name, time_col, at - timedelta(minutes=minutes))

    def _write(self, df: DataFrame, name: str, mode: str, time_col: str | None, cluster_by: list[str], days: str = "static", dealt: bool = False) -> None:
        """Each day goes to `files_per_day` tasks, chosen by the first cluster column (else by the
        whole row), so a hot day is spread and a key's rows stay together. Rows that come dealt stay in their tasks."""
        if time_col is None:
            (df.sortWithinPartitions(*cluster_by) if cluster_by else df).write.mode(mode).option("compression", CODEC).parquet(self.path(name))
            return
        if dealt:
            rows = df.sortWithinPartitions("dt", *cluster_by)
        else:
            plain = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]  # Spark hashes no others
            spread = F.pmod(F.xxhash64(*(cluster_by[:1] or plain)), F.lit(self.files_per_day))
            rows = df.withColumn("dt", F.to_date(time_col)).repartition("dt", spread).sortWithinPartitions("dt", *cluster_by)
        rows.write.mode(mode).option("partitionOverwriteMode", days).option("compression", CODEC).partitionBy("dt").parquet(self.path(name))

    def _no_rows(self, schema: StructType, name: str, day: str, mode: str) -> None:
        """Writes a day folder without rows; its file holds the schema."""
        self.spark.createDataFrame([], schema).write.mode(mode).parquet(f"{self.path(name)}/dt={day}")

    def replace(self, name: str, df: DataFrame, time_col: str | None = None, cluster_by: list[str] | None = None, dealt: bool = False) -> None:
        """Full rebuild. `df` must not read the table itself: Spark refuses that; write it with `stored` first.

        `dealt`: `df` has its day as `dt`, and its last shuffle keeps a key's rows of a few hours together (as tracks `by_day` do). They are
        written where they are, a file for each day in a task, which spares a shuffle and a sort of all rows; the files of a day are as many as
        the tasks that hold it.
        """
        self._write(df, name, "overwrite", time_col, cluster_by or [], dealt=dealt)
        if time_col:
            self._no_rows(df.drop("dt").schema if dealt else df.schema, name, "__HIVE_DEFAULT_PARTITION__", "append")  # a table without rows keeps its columns

    def append(self, name: str, df: DataFrame, time_col: str | None = None) -> None:
        """Adds rows; new columns widen the table."""
        if self.exists(name):
            self._write(df, name, "append", time_col, [])
        else:
            self.replace(name, df, time_col)

    def replace_window(self, name: str, df: DataFrame, time_col: str, cutoff: str, cluster_by: list[str] | None = None) -> None:
        """Rows at or after `cutoff` (UTC text) are replaced by those of `df`; earlier rows stay, as do rows without a time.

        Only days from that of the cutoff on are written: its earlier rows are carried over, and days that are left without rows are emptied.
        """
        if not self.exists(name):
            raise FileNotFoundError(f"table {name} is missing: build it in full first")
        moment = datetime.fromisoformat(cutoff)
        at, day = F.lit(moment.isoformat(" ")).cast("timestamp"), F.lit(moment.date())
        now = self._days(name)
        kept = now.where((F.col("dt") == day) & (F.col(time_col) < at)).drop("dt")
        # written first: a run that dies while folders are swapped leaves the whole window there
        window = stored(kept.unionByName(df.where(F.col(time_col) >= at), allowMissingColumns=True), f"{name}-window")
        # one row per calendar day since the cutoff
        was = {r["dt"] for r in now.where(F.col("dt") >= day).select("dt").distinct().collect()}
        held = {r["dt"] for r in window.select(F.to_date(time_col).alias("dt")).distinct().collect()}
        self._write(window, name, "overwrite", time_col, cluster_by or [], "dynamic")
        for empty in sorted(was - held):
            self._no_rows(window.schema, name, str(empty), "overwrite")

    def append_load(self, name: str, df: DataFrame, load: int) -> None:
        """Adds a full load under its number; the same number again replaces it."""
        df.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(self.path(name))

    def read_load(self, name: str, load: int) -> DataFrame:
        """One load, whatever was loaded since; only its folder is read."""
        return self.read(name).where(F.col("load") == load).drop("load")

    def reset(self, live: list[str], history: list[str]) -> None:
        """Empties the live tables, but only if every history table exists."""
        missing = [t for t in history if not self.exists(t)]
        if missing:
            raise RuntimeError("preflight failed, nothing was reset: missing " + ", ".join(missing))
        for name in live:
            if self.exists(name):
                rows = self._days(name, widened=True)
                empty = self.spark.createDataFrame([], rows.drop("dt").schema)
                if "dt" in rows.columns:
                    empty.withColumn("dt", F.lit(None).cast("date")).write.mode("overwrite").partitionBy("dt").parquet(self.path(name))
                    self._no_rows(empty.schema, name, "__HIVE_DEFAULT_PARTITION__", "append")
                else:
                    empty.write.mode("overwrite").parquet(self.path(name))

    def point(self, alias: str, model: str, version: int) -> None:
        """Moves a model alias; the pointer table keeps every move."""
        row = self.spark.range(1).select(F.lit(model).alias("model"), F.lit(alias).alias("alias"),
                                         F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("moved_at"))
        self.append("model_alias", row)

    def pointed(self, alias: str, model: str) -> int | None:
        """The version an alias points at."""
        if not self.exists("model_alias"):
            return None
        hit = (self.read("model_alias").where((F.col("model") == model) & (F.col("alias") == alias))
               .agg(F.max_by("version", "moved_at").alias("v")).first())
        return hit["v"]


def merge_updates(inserts: DataFrame, updates: DataFrame, key: str, stamp: str) -> DataFrame:
    """Inserted rows with later column updates applied: per key and column the newest non-null value."""
    columns = [c for c in inserts.columns if c not in (key, stamp)]
    log = inserts.unionByName(updates, allowMissingColumns=True)
    at = {c: F.when(F.col(c).isNotNull(), F.col(stamp)) for c in columns}
    return log.groupBy(key).agg(*[F.max_by(c, at[c]).alias(c) for c in columns], F.min(stamp).alias(stamp))


def schema_drift(expected: list[str], given: list[str]) -> dict[str, list[str]]:
    """Columns expected but absent, and given but not expected; `ordered` if the common order holds."""
    return {"missing": [c for c in expected if c not in given], "extra": [c for c in given if c not in expected],
            "ordered": [c for c in given if c in expected] == [c for c in expected if c in given]}


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `expected` that `present` lacks."""
    return expected.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


def latest_where(df: DataFrame, stamp: str, condition: Column) -> DataFrame:
    """Newest stamp among rows that satisfy a condition, as one row."""
    return df.where(condition).agg(F.max(stamp).alias(stamp))

"""JSON snapshot envelopes: files to Bronze rows to typed Silver reports, in batch or as a stream."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.operators.tracks import point_features

REPORT_SCHEMA = (
    "hex string, flight string, r string, t string, category string, lat double, lon double, alt_baro string, alt_geom double,"
    " gs double, track double, baro_rate double, geom_rate double, nav_altitude_mcp double, nav_heading double, squawk string,"
    " emergency string, nic int, rc int, seen double, seen_pos double")
CAPTURE_SCHEMA = ("struct<apt_icao: string, apt_lat: double, apt_lon: double, radius_nm: double, source: string, polled_at: string,"
                  " src_date: string, target_tag: string, backfilled_at: string>")
ENVELOPE_SCHEMA = f"now double, total int, ac array<string>, aircraft array<string>, capture {CAPTURE_SCHEMA}"
BRONZE_COLUMNS = ["snapshot_ts", "apt_icao", "apt_lat", "apt_lon", "radius_nm", "source", "src_date", "_ingest_file", "_ingest_ts",
                  "report", "report_json"]


def read_envelopes(spark: SparkSession, root: str, streaming: bool = False, one_per_file: bool = True,
                   max_files: int | None = None, pattern: str = "*.json") -> DataFrame:
    """Envelopes under `root` at any depth, with the file each came from.

    Text is read as it is and parsed against a declared schema, so a new field never breaks the
    reader: the raw report text keeps it. `one_per_file=False` reads one envelope per line.
    """
    reader = (spark.readStream if streaming else spark.read).format("text").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).option("wholetext", one_per_file)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.load(root).select("value", F.col("_metadata.file_path").alias("_ingest_file"), F.current_timestamp().alias("_ingest_ts"))
    return text.withColumn("e", F.from_json("value", ENVELOPE_SCHEMA)).select("e.*", "_ingest_file", "_ingest_ts")


def explode_reports(envelopes: DataFrame) -> DataFrame:
    """One row per report text. Envelopes without reports give no row; both list names are read."""
    # an inner explode would add a size filter that parses every envelope a second time
    each = envelopes.withColumn("report_json", F.explode_outer(F.coalesce("ac", "aircraft"))).drop("ac", "aircraft")
    return each.where(F.col("report_json").isNotNull())


def to_bronze(envelopes: DataFrame, now_in_seconds: bool = False, report_schema: str = REPORT_SCHEMA) -> DataFrame:
    """Bronze rows: one per aircraft and snapshot, the report parsed and as raw text.

    A schema from `widened` parses fields that came up after the declared one.
    """
    millis = F.col("now") * (1000 if now_in_seconds else 1)
    return explode_reports(envelopes).select(
        F.timestamp_millis(millis.cast("bigint")).alias("snapshot_ts"), "capture.apt_icao", "capture.apt_lat", "capture.apt_lon",
        F.col("capture.radius_nm").try_cast("int").alias("radius_nm"), "capture.source", "capture.src_date", "_ingest_file", "_ingest_ts",
        F.from_json("report_json", report_schema).alias("report"), "report_json")


def new_fields(bronze: DataFrame, known: str = REPORT_SCHEMA) -> DataFrame:
    """Report fields the schema lacks, with how many reports carry each: input for widening it."""
    names = [c.split()[0] for c in known.split(", ")]
    fields = bronze.select(F.explode(F.map_keys(F.from_json("report_json", "map<string,string>"))).alias("field"))
    return fields.where(~F.col("field").isin(names)).groupBy("field").agg(F.count(F.lit(1)).alias("reports"))


def widened(known: str, extra: dict[str, str]) -> str:
    """The report schema with more fields, for the next run."""
    return ", ".join([known, *[f"{n} {t}" for n, t in extra.items()]])


def with_variant(bronze: DataFrame) -> DataFrame:
    """Bronze with the whole report as a VARIANT, `report_v`: a column whose files stay readable together whatever fields and types come."""
    return bronze.withColumn("report_v", F.try_parse_json("report_json"))


def _column_type(found: str) -> str:
    """The column type for a type found in variants: decimals are doubles, fields that were only ever null are texts."""
    return re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def field_types(bronze: DataFrame, known: str = REPORT_SCHEMA) -> DataFrame:
    """Report fields that the schema lacks, with the type all their values share and how many reports carry each: field, type, reports.

    Types are merged as Spark merges variants: whole numbers and decimals to decimals, objects field by field, anything else that does not
    fit together to VARIANT. One hash aggregate by field; its result has a row per new field.
    """
    names = [c.split()[0] for c in known.split(", ")]
    each = with_variant(bronze).select("report_v").lateralJoin(bronze.sparkSession.tvf.variant_explode(F.col("report_v").outer()))
    return each.where(~F.col("key").isin(names)).groupBy(F.col("key").alias("field")).agg(
        F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("reports"))


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds values of both; VARIANT if nothing else does."""
    if a == b:
        return a
    numbers = (T.LongType, T.DoubleType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        both = {f.name: f.dataType for f in a}
        for f in b:
            both[f.name] = merged_type(both[f.name], f.dataType) if f.name in both else f.dataType
        return T.StructType([T.StructField(n, both[n]) for n in sorted(both)])
    return T.VariantType()


def register_fields(register: dict[str, T.DataType], bronze: DataFrame, known: str = REPORT_SCHEMA) -> dict[str, T.DataType]:
    """The register of new fields after another load of Bronze rows: fields are added, and types widened where the load asks for it."""
    out = dict(register)
    for row in field_types(bronze, known).collect():  # a row per new field
        found = T.StructType.fromDDL(f"c {_column_type(row['type'])}")["c"].dataType
        out[row["field"]] = merged_type(out[row["field"]], found) if row["field"] in out else found
    return out


def evolved(bronze: DataFrame, register: dict[str, T.DataType]) -> DataFrame:
    """Bronze rows (with `report_v`) and a typed column for each field of the register; null where a report lacks it.

    Rows of earlier loads are read by the types of now, so a widened field needs no rewrite.
    """
    return bronze.withColumns({n: F.try_variant_get("report_v", f'$["{n}"]', t.simpleString()) for n, t in register.items()})


def altitude_ft(text: Column, any_case: bool = True) -> Column:
    """Barometric altitude: `ground` is 0, a number is truncated to feet, anything else is null."""
    word = F.lower(text) if any_case else text
    return F.when(word == "ground", 0).otherwise(text.try_cast("double").try_cast("int"))


def typed(bronze: DataFrame) -> DataFrame:
    """Flat, typed and cleaned report columns."""
    def r(name: str) -> Column:
        return F.col(f"report.{name}")
    return bronze.select(
        "snapshot_ts", "apt_icao", r("hex").alias("icao"), F.trim(r("flight")).alias("callsign"), r("r").alias("registration"),
        r("t").alias("ac_type"), r("category").alias("category"), r("lat").alias("lat"), r("lon").alias("lon"),
        altitude_ft(r("alt_baro")).alias("alt_ft"), r("alt_geom").try_cast("int").alias("alt_geom_ft"), r("gs").alias("gs_kt"),
        r("track").alias("track_deg"), r("baro_rate").alias("baro_rate_fpm"), r("geom_rate").alias("geom_rate_fpm"),
        r("nav_altitude_mcp").try_cast("int").alias("sel_altitude_ft"), r("nav_heading").alias("sel_heading_deg"),
        r("squawk").alias("squawk"), F.coalesce(r("emergency"), F.lit("none")).alias("emergency"), r("nic").alias("nic"), r("rc").alias("rc"),
        r("seen").alias("seen_s"), r("seen_pos").alias("seen_pos_s"), r("lat").isNotNull().alias("has_position"), "apt_lat", "apt_lon")


# Count-only rules: a null value passes.
EXPECTATIONS = {
    "plausible_altitude": "alt_ft IS NULL OR alt_ft BETWEEN -1500 AND 60000",
    "plausible_groundspeed": "gs_kt IS NULL OR gs_kt BETWEEN 0 AND 700",
}


def violation_counts() -> list[Column]:
    return [F.count_if(~F.expr(rule)).alias(name) for name, rule in EXPECTATIONS.items()]


def observed(df: DataFrame, name: str | Observation = "silver") -> DataFrame:
    """Counts rows and rule violations as the data passes, without another job."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("icao").isNull()).alias("has_icao"), *violation_counts())


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest by its other columns (nulls first), so reruns agree.

    A rank limit drops all but one row of a key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    return df.withColumn("_turn", turn).where(F.col("_turn") == 1).select(*keys, *rest)


def to_silver(bronze: DataFrame, watermark: str = "15 minutes", observe: str | Observation | None = None) -> DataFrame:
    """Silver reports: typed, with an aircraft id, unique per (icao, snapshot), with point features.

    On a stream, copies are removed within the watermark; in batch, over everything.
    """
    rows = typed(bronze)
    if observe is not None:
        rows = observed(rows, observe)
    rows = rows.where(F.col("icao").isNotNull())
    keys = ["icao", "snapshot_ts"]
    unique = (rows.withWatermark("snapshot_ts", watermark).dropDuplicates(keys) if bronze.isStreaming else first_of_each(rows, keys))
    return point_features(unique).drop("apt_lat", "apt_lon")


def peek(envelopes: DataFrame) -> DataFrame:
    """Reports per source date."""
    return explode_reports(envelopes).groupBy("capture.src_date").agg(F.count(F.lit(1)).alias("n"))

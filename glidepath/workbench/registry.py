"""The catalogue of runnable queries, each with its SQL twin where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.functions.numbers import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `fn(spark, sf_dir)` under `name`, with the SQL that must return the same rows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output columns in comparable types: epoch seconds, 0/1 flags, rounded doubles."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_seconds(c)
        elif isinstance(field.dataType, T.DateType):
            c = F.unix_date(c).cast("bigint")
        elif isinstance(field.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = settled(c.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)

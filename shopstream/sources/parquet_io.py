"""Parquet sources and sinks: windowed export, sessions, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def export_window(events: DataFrame, *, start=None, end=None, limit: int | None = None,
                  time_col: str = "event_time", order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """Events in the half-open window [start, end); either bound optional.

    Both bounds are plain comparisons, so they reach the Parquet scan as
    ``PushedFilters``.  Without ``limit`` no sort is planned (order is only
    needed to decide which rows a limit keeps); with it, the earliest
    ``limit`` rows by ``order`` are kept (a bounded top-N, not a full sort).
    """
    df = events
    if start is not None:
        df = df.filter(F.col(time_col) >= F.to_timestamp_ntz(F.lit(str(start))))
    if end is not None:
        df = df.filter(F.col(time_col) < F.to_timestamp_ntz(F.lit(str(end))))
    if limit is not None:
        df = df.orderBy(*[F.col(c) for c in order]).limit(int(limit))
    return df


def write_export(df: DataFrame, path: str, *, partition_by: str | None = None,
                 time_col: str = "event_time") -> int:
    """Write an export and return its row count from an observed metric (no second scan)."""
    from pyspark.sql import Observation
    obs = Observation("export")
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = out.write.mode("overwrite")
    if partition_by == "event_date":
        out = out.withColumn("event_date", F.to_date(time_col))
        w = out.write.mode("overwrite").partitionBy("event_date")
    w.parquet(path)
    return int(obs.get["rows"])


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions as Parquet (plan cut, as the reference does after sessionising)."""
    sessions.write.mode("overwrite").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "user_session string, start_time timestamp_ntz, product_seq array<bigint>, session_len int").parquet(path)


def read_events(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read an existing Parquet export instead of a database, pruned to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df

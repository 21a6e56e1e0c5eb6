"""Bulk CSV ingest of raw events.

Comma separated, optional ``"`` quoting, header row skipped, time strings
like ``2019-10-01 00:00:00 UTC`` (suffix stripped, then parsed), blank
``category_code`` / ``brand`` become NULL.  A blank price is stored as NULL
too (open point: what the original store kept for a blank DECIMAL depends
on its SQL mode).  Malformed lines are kept in ``_corrupt_record`` and can
be split off with :func:`split_corrupt`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstream.schemas import RAW_CSV


def raw_reader(reader):
    """Options of the raw files on a batch or streaming reader."""
    schema = T.StructType(RAW_CSV.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
    return (reader.schema(schema)
            .option("header", True).option("sep", ",").option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record"))


def parse_raw(raw: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of raw rows: time without its suffix, blanks as NULL; ``keep`` passes further columns through."""
    # try_: a malformed time becomes NULL (flagged by split_corrupt) instead of failing the job (ANSI mode);
    # the session time zone is UTC, so the wall clock survives the cast to timestamp_ntz
    t = F.try_to_timestamp(F.substring_index(F.col("event_time"), " UTC", 1),
                           F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return raw.select(
        t.alias("event_time"), "event_type", "product_id", "category_id",
        F.nullif(F.col("category_code"), F.lit("")).alias("category_code"),
        F.nullif(F.col("brand"), F.lit("")).alias("brand"),
        "price", "user_id", "user_session", "_corrupt_record", *keep)


def read_events_csv(spark: SparkSession, path: str, *, with_id: bool = True) -> DataFrame:
    """Raw files as typed rows; ``with_id`` adds the content id of ``streaming.ingest``, malformed lines keep a NULL id.

    The id depends on the event and on its number among the equal events of its file only,
    so another load, or the same file under another name, gives the same ids.
    """
    from shopstream.streaming.ingest import with_content_ids
    raw = raw_reader(spark.read).csv(path)
    if not with_id:
        return parse_raw(raw)
    good, bad = split_corrupt(parse_raw(raw.select("*", F.col("_metadata.file_path").alias("_file")), keep=("_file",)))
    made = with_content_ids(good).withColumn("_corrupt_record", F.lit(None).cast("string"))
    return made.unionByName(bad.drop("_file").withColumn("event_id", F.lit(None).cast("long")))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, malformed lines).

    A line is malformed when Spark flagged it, or when a NOT NULL field
    (time, type, product, user, session) failed to parse.
    """
    bad_cond = (F.col("_corrupt_record").isNotNull() | F.col("event_time").isNull() | F.col("event_type").isNull()
                | F.col("product_id").isNull() | F.col("user_id").isNull() | F.col("user_session").isNull())
    good = df.filter(~bad_cond).drop("_corrupt_record")
    bad = df.filter(bad_cond)
    return good, bad

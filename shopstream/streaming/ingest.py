"""Append new event files to the events table, each event once, late ones too.

File source -> each micro-batch gives ids to events without one, keeps one row per key and
drops what the table already holds -> append as Parquet.  No watermark, so an event of any
age reaches the table; a batch that is retried after a failure adds only what is missing.
``trigger(availableNow=True)`` processes what is there and stops, so the job can run as a
scheduled batch; a rerun from the same checkpoint picks up only new files.

* Ids: an event without id gets one from its content and its number among the equal events
  of its file, so equal events of one file all stay, and a file that is loaded again (under
  any name, in any batch) adds nothing.
* Days: with ``time_col`` the sink is partitioned by ``event_date``, and a batch is compared
  with the days of its own events only.  That suits sources that repeat an event with its
  time; without ``time_col`` the id alone decides, against the whole table.
* The known keys pass a hashed bitmap of the batch's keys before the anti-join, so only
  about one in sixteen of the others is shuffled (batches up to ``BITMAP_KEYS`` keys; the
  bitmap has two bytes a key).  Larger batches join without it, with the same result.
* Rows travel as seldom as they can.  Raw files are dealt once, by ranges of their values in
  the order of the columns, time first: equal events meet in one range, so their numbers, the
  dates of the sink and its files need no shuffle of their own.  A batch meets the known
  table with its keys only; whole rows are joined when some, but not all, are known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shopstream.schemas import EVENTS

BITMAP_KEYS = 16_000_000
SLOTS = 16          # bitmap slots for each key
BUCKET = 32_768     # bits of one bitmap row (Spark's bitmap functions)
DAY = "event_date"
CSV_KEY = ("event_id", "product_id", "user_id")  # the ids are 64-bit hashes; equal hashes of other items or users stay apart


def content_id(columns: Sequence[str], number: str) -> Column:
    """64-bit id of an event's values (nulls marked) and its number among equal ones."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns], F.col(number))


def with_content_ids(events: DataFrame, *, file: str = "_file", id_col: str = "event_id") -> DataFrame:
    """Give every event without id (or all, where the column is absent) an id from its content.

    ``file`` names the file of a row and is dropped.  An event stays as often as it is in
    the file that has it most often: what other files repeat is taken as a replay.
    """
    columns = [c for c in events.columns if c not in (file, id_col)]
    if id_col in events.columns:
        known = events.where(F.col(id_col).isNotNull()).select(id_col, *columns)
        events = events.where(F.col(id_col).isNull())
    else:
        known = None
    # one shuffle and one sort: equal events meet in one range, the rows of each file together; a row stays if its
    # number in its file is beyond those of the files before
    floats = [c for c, t in events.dtypes if t in ("double", "float") and c in columns]
    events = events.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0).cast(events.schema[c].dataType)).otherwise(F.col(c)) for c in floats})
    events = events.withColumn("_source", F.xxhash64(file)).select(*columns, "_source")
    equal = Window.partitionBy(*columns).orderBy("_source")
    numbered = events.repartitionByRange(*columns).withColumn("_number", (F.row_number().over(equal) - F.rank().over(equal) + 1).cast("long"))
    before = F.max("_number").over(equal.rowsBetween(Window.unboundedPreceding, -1))
    made = numbered.withColumn("_before", before).where("_number > coalesce(_before, 0)").select(content_id(columns, "_number").alias(id_col), *columns)
    return made if known is None else known.unionByName(made)


def _slot(key: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("long")


def maybe_in(known: DataFrame, batch: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The rows of ``known`` whose key hashes to a slot that one of the ``n`` keys of ``batch`` has."""
    slot = _slot(key, max(BUCKET, n * SLOTS))
    bitmaps = (batch.select(slot.alias("_slot"))
               .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    probe = known.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).withColumn("_at", F.bitmap_bit_position("_slot"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.expr("shiftright(_byte, CAST(_at % 8 AS INT)) & 1") == 1
    return (probe.join(F.broadcast(bitmaps), "_bucket")  # two bytes a key of the batch, whose number was counted
            .withColumn("_byte", byte).where(has).select(*known.columns))


def fresh_rows(batch: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` (unique by ``key``) whose key is not in ``known``.

    The keys alone are counted first: a batch of which none or all is known needs no join of its rows.
    """
    known = known.select(*key)
    n = batch.count()
    if 0 < n <= BITMAP_KEYS:
        known = maybe_in(known, batch, key, n)
    repeated = batch.select(*key).join(known, list(key), "left_semi").count()
    if repeated in (0, n):
        return batch if repeated == 0 else batch.limit(0)
    return batch.join(known, list(key), "left_anti").select(*batch.columns)


def append_batch(batch: DataFrame, sink: str, *, key: Sequence[str] = ("event_id",), time_col: str | None = None,
                 grain: str = "day", partition_by: str | None = None, dealt: bool = False) -> DataFrame:
    """Append the rows of a batch that the table at ``sink`` lacks; returns them as written.

    ``dealt`` says that each partition of the batch holds a range of times and that its keys are
    made from whole rows: it is not shuffled to drop repeated keys or to gather its days.

    ``grain`` 'month' dates the partitions by the first day of the month, for tables with
    few events a day.

    The new rows are written once to the shared folder first, so that what is appended and
    what is returned (for a catalog, say) are the same rows.
    """
    from shopstream.session import shared_table
    spark = batch.sparkSession
    rows = batch if dealt else batch.dropDuplicates(list(key))
    if time_col:
        rows = rows.withColumn(DAY, {"day": F.to_date(time_col), "month": F.trunc(time_col, "month")}[grain])
        partition_by = DAY
    rows = shared_table(rows, "append-batch")
    if _exists(spark, sink):
        known = spark.read.schema(rows.schema).parquet(sink)
        if time_col:
            known = known.where(touched_days(rows))
        fresh = fresh_rows(rows, known, key)
        if fresh is not rows:
            rows, dealt = shared_table(fresh, "append-fresh"), False
    out = rows.hint("rebalance", partition_by) if partition_by and not dealt else rows  # few files a day, large days split
    w = out.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(sink)
    return rows


def touched_days(rows: DataFrame) -> Column:
    """Filter on the partition column: the days of these rows (a list of dates, pruned before any file is read)."""
    days = [r[DAY] for r in rows.select(DAY).distinct().collect()]
    dated = [d for d in days if d is not None]
    some = F.col(DAY).isin(dated) if dated else F.lit(False)
    return some | F.col(DAY).isNull() if None in days else some


def append_events(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, *,
                  schema: T.StructType, fmt: str = "parquet", key: str = "event_id",
                  partition_by: str | None = None, time_col: str | None = None, grain: str = "day", max_files_per_trigger: int | None = None,
                  on_append: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append files of typed events.  ``on_append`` gets the rows of each batch that were new, and the batch number."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        r = r.option("header", True)

    def add(batch: DataFrame, number: int) -> None:
        fresh = append_batch(with_content_ids(batch, id_col=key).select(*schema.fieldNames()), sink_dir, key=(key,), time_col=time_col, grain=grain,
                             partition_by=partition_by)
        if on_append:
            on_append(fresh, number)

    return (r.load(source_dir).select("*", F.col("_metadata.file_path").alias("_file")).writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_csv_events(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, *, rejects_dir: str | None = None,
                      grain: str = "day", max_files_per_trigger: int | None = None, on_append: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append raw CSV files (``csv_events``) to a table of EVENTS partitioned by day.

    Malformed lines go to ``rejects_dir``/batch=<number>, which a retried batch overwrites.
    """
    from shopstream.sources import csv_events
    r = csv_events.raw_reader(spark.readStream)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def add(batch: DataFrame, number: int) -> None:
        good, bad = csv_events.split_corrupt(csv_events.parse_raw(batch, keep=("_file",)))
        if rejects_dir:
            bad.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/batch={number}")
        fresh = append_batch(with_content_ids(good).select(*EVENTS.fieldNames()), sink_dir, key=CSV_KEY, time_col="event_time", grain=grain, dealt=True)
        if on_append:
            on_append(fresh, number)

    return (r.csv(source_dir).select("*", F.col("_metadata.file_path").alias("_file")).writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

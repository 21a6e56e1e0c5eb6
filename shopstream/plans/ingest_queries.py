"""Queries over appended event tables (S11) and raw CSV loads.

The loads are written from the test tables into the shared folder; they only hold rows in
the shape of the source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopstream.plans.registry import query
from shopstream.session import checkpoint_dir
from shopstream.sources import fixtures as fx
from shopstream.streaming.ingest import append_csv_events, append_events


def _folder(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/shopstream-ingest-{uuid.uuid4().hex}"


@query("events_append")
def events_append_q(spark, sf_dir):
    """Three loads: the second overlaps the first, the third repeats the first under another name."""
    ev = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    root = _folder(spark)
    for load, part in enumerate((ev.where("event_id % 3 <> 2"), ev.where("event_id % 3 <> 0"), ev.where("event_id % 3 <> 2"))):
        part.write.parquet(f"{root}/in/load-{load}")
        append_events(spark, f"{root}/in/*", f"{root}/table", f"{root}/progress", schema=ev.schema, time_col="ts").awaitTermination()
    return spark.read.parquet(f"{root}/table").select(*ev.columns)


@query("csv_append")
def csv_append_q(spark, sf_dir):
    """Two loads of raw files and the first of them once more; the ids come from the content."""
    raw = fx.raw_csv_events(spark, sf_dir)
    root = _folder(spark)
    layout = {"header": True, "quote": '"', "escape": '"'}
    for load in range(3):
        if load < 2:  # equal events of a session lie in one file, as in the source
            part = raw.where(f"user_session % 2 = {load}")
        else:  # a packed file is read whole by one task
            part = spark.read.options(**layout).schema(raw.schema).csv(f"{root}/in/load-0")
        part.write.options(**layout, compression="gzip").csv(f"{root}/in/load-{load}")
        append_csv_events(spark, f"{root}/in/*", f"{root}/table", f"{root}/progress", rejects_dir=f"{root}/rejects", grain="month").awaitTermination()
    return spark.read.parquet(f"{root}/table").select(
        "event_time", "event_type", "product_id", "category_id", "category_code", "brand", F.col("price").cast("double").alias("price"), "user_id", "user_session")

"""Appends: content ids, days, bitmaps; nothing lost, nothing twice."""

import datetime as dt
import os
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopstream.schemas import EVENTS
from shopstream.sources import csv_events
from shopstream.streaming import ingest

HEAD = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
SCHEMA = "event_id long, event_time timestamp_ntz, product_id long, note string"


def line(day, product=1, session="s", brand="b", price="1.50"):
    return f"2024-03-{day:02d} 10:00:00 UTC,view,{product},7,a.b,{brand},{price},5,{session}"


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join([HEAD, *lines]) + "\n")


def at(day, hour=0):
    return dt.datetime(2024, 3, day, hour)


def load_csv(spark, d, **more):
    ingest.append_csv_events(spark, f"{d}/in", f"{d}/table", f"{d}/ck", rejects_dir=f"{d}/bad", **more).awaitTermination()


def test_csv_loads_lose_and_repeat_nothing(spark, tmp_dir):
    first = [line(1), line(1), line(1), line(2, brand=""), "no event at all", line(2, product=9)]
    second = [line(3), line(1, product=4), line(1, product=4), line(40)]
    put(f"{tmp_dir}/in", "a.csv", first)
    load_csv(spark, tmp_dir)
    put(f"{tmp_dir}/in", "b.csv", second)
    load_csv(spark, tmp_dir)
    put(f"{tmp_dir}/in", "a-again.csv", first)      # the same events under another name
    put(f"{tmp_dir}/in", "c.csv", [line(1), line(5)])  # one of them again, with a new one
    load_csv(spark, tmp_dir)
    load_csv(spark, tmp_dir)
    out = spark.read.parquet(f"{tmp_dir}/table")
    got = Counter((r.event_time.day, r.product_id, r.brand) for r in out.collect())
    assert got == Counter({(1, 1, "b"): 3, (2, 1, None): 1, (2, 9, "b"): 1, (3, 1, "b"): 1, (1, 4, "b"): 2, (5, 1, "b"): 1})
    assert out.select("event_id").distinct().count() == 9 and out.where("event_id IS NULL").count() == 0
    assert set(EVENTS.fieldNames()) <= set(out.columns)
    assert {r._corrupt_record is not None or r.event_time is None for r in spark.read.parquet(f"{tmp_dir}/bad").collect()} == {True}
    assert spark.read.parquet(f"{tmp_dir}/bad").count() == 3  # "no event at all" in two files, the 40th of March


def test_result_does_not_depend_on_the_batches(spark, tmp_dir):
    files = {"a.csv": [line(1), line(1), line(2)], "b.csv": [line(1)] * 3, "c.csv": [line(2), line(3)]}
    tables = []
    for k, per_batch in enumerate((None, 1)):
        d = f"{tmp_dir}/{k}"
        for name, lines in files.items():
            put(f"{d}/in", name, lines)
        load_csv(spark, d, max_files_per_trigger=per_batch)
        tables.append(sorted((r.event_id, r.event_time) for r in spark.read.parquet(f"{d}/table").collect()))
    assert tables[0] == tables[1] and Counter(t.day for _, t in tables[0]) == {1: 3, 2: 1, 3: 1}


def test_csv_ids_are_the_same_for_every_load(spark, tmp_dir):
    put(tmp_dir, "x.csv", [line(1), line(1), line(2), "broken"])
    put(tmp_dir, "y.csv", [line(2), line(1), line(1)])
    a, b = (csv_events.split_corrupt(csv_events.read_events_csv(spark, f"{tmp_dir}/{n}.csv"))[0].select("event_id", "event_time") for n in "xy")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.select("event_id").distinct().count() == 3
    assert csv_events.read_events_csv(spark, f"{tmp_dir}/x.csv").where("event_id IS NULL").count() == 1


def test_nulls_do_not_make_equal_ids(spark):
    df = spark.createDataFrame([("x", None, "f"), (None, "x", "f"), (None, None, "f")], "a string, b string, _file string")
    assert ingest.with_content_ids(df).select("event_id").distinct().count() == 3


def test_null_ids_are_kept_and_not_repeated(spark, tmp_dir):
    rows = [(None, at(1), 1, "p"), (None, at(1), 1, "p"), (None, at(2), 1, None), (7, at(1), 1, "p"), (7, at(1), 1, "p")]
    for name in ("one", "two"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/in/{name}")
        ingest.append_events(spark, f"{tmp_dir}/in/*", f"{tmp_dir}/t", f"{tmp_dir}/ck", schema=spark.createDataFrame([], SCHEMA).schema, time_col="event_time").awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/t")
    assert Counter((r.event_time.day, r.note) for r in out.collect()) == Counter({(1, "p"): 3, (2, None): 1})
    assert out.where("event_id = 7").count() == 1


def test_a_retried_batch_adds_only_what_is_missing(spark, tmp_dir):
    batch = spark.createDataFrame([(i, at(1 + i % 3), i, "n") for i in range(30)], SCHEMA)
    ingest.append_batch(batch.where("event_id < 11"), f"{tmp_dir}/t", time_col="event_time")  # a part got through
    fresh = ingest.append_batch(batch, f"{tmp_dir}/t", time_col="event_time")
    assert sorted(r.event_id for r in fresh.collect()) == list(range(11, 30))
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/t").collect()) == list(range(30))


def test_only_touched_days_are_read(spark, tmp_dir):
    old = spark.createDataFrame([(i, at(1 + i % 20), i, "n") for i in range(200)], SCHEMA)
    ingest.append_batch(old, f"{tmp_dir}/t", time_col="event_time")
    shutil.rmtree(f"{tmp_dir}/t/event_date=2024-03-05")  # a day that no batch below touches: reading it would fail
    os.makedirs(f"{tmp_dir}/t/event_date=2024-03-05")
    with open(f"{tmp_dir}/t/event_date=2024-03-05/part-0.parquet", "w") as f:
        f.write("not a parquet file")
    batch = spark.createDataFrame([(1, at(2), 1, "n"), (500, at(2), 1, "n"), (501, at(7), 1, "n"), (502, None, 1, "n")], SCHEMA)
    rows = batch.withColumn(ingest.DAY, F.to_date("event_time"))
    known = spark.read.schema(rows.schema).parquet(f"{tmp_dir}/t").where(ingest.touched_days(rows))
    plan = known.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*event_date", plan) and "ReadSchema: struct<event_id:bigint>" in plan
    ingest.append_batch(batch, f"{tmp_dir}/t", time_col="event_time")
    ingest.append_batch(batch, f"{tmp_dir}/t", time_col="event_time")
    got = spark.read.schema(rows.schema).parquet(f"{tmp_dir}/t").where("event_date = DATE'2024-03-02' OR event_date = DATE'2024-03-07' OR event_date IS NULL")
    assert Counter(r.event_id for r in got.where("event_id >= 500 OR event_id = 1").collect()) == {1: 1, 500: 1, 501: 1, 502: 1}


@pytest.mark.parametrize("limit", [0, 16_000_000])
def test_bitmap_prunes_and_loses_nothing(spark, limit, monkeypatch):
    monkeypatch.setattr(ingest, "BITMAP_KEYS", limit)
    known = spark.range(0, 60_000).select((F.col("id") * 3).alias("event_id"))
    batch = spark.range(0, 9_000).select(F.col("id").alias("event_id"), F.lit("x").alias("v"))
    got = ingest.fresh_rows(batch, known, ["event_id"])
    assert sorted(r.event_id for r in got.collect()) == [i for i in range(9_000) if i % 3]
    left = ingest.maybe_in(known, batch, ["event_id"], 9_000)
    assert left.where("event_id < 9000").count() == 3_000 and left.count() < 3_000 + 57_000 // 10


def test_new_rows_reach_the_callback_once(spark, tmp_dir):
    seen = []
    for name, low in (("a", 0), ("b", 5)):
        spark.createDataFrame([(i, at(1), i, "n") for i in range(low, low + 10)], SCHEMA).write.parquet(f"{tmp_dir}/in/{name}")
        ingest.append_events(spark, f"{tmp_dir}/in/*", f"{tmp_dir}/t", f"{tmp_dir}/ck", schema=spark.createDataFrame([], SCHEMA).schema, time_col="event_time",
                             on_append=lambda rows, number: seen.append((number, sorted(r.event_id for r in rows.collect())))).awaitTermination()
    assert seen == [(0, list(range(10))), (1, list(range(10, 15)))]

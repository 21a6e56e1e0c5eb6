"""Streaming cart state: equal to the batch fold, rejects listed, order restored, state removed."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from shopstream import schemas
from shopstream.operators import cart
from shopstream.streaming.cart_state import cart_state_stream

T0 = dt.datetime(2024, 1, 1)


def commands(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice(["add", "add", "set", "del", "mul"]) if rng.random() < 0.95 else None
        cid = rng.choice(["c1", "c2", "c2", "x" * 40, None])
        out.append((seq, cid, op, rng.choice([1, 2, 9]), rng.choice([None, 0, 1, 3]), T0 + dt.timedelta(seconds=seq)))
    return out


def run(spark, tmp_dir, products, batches, **more):
    """All rows that the stream emits, a micro-batch a file."""
    rows = []
    src, ck = f"{tmp_dir}/in", f"{tmp_dir}/ck"
    for k, cmds in enumerate(batches):
        spark.createDataFrame(cmds, schemas.CART_COMMANDS).coalesce(1).write.parquet(f"{src}/{k}")
        stream = spark.readStream.schema(schemas.CART_COMMANDS).parquet(src + "/*")
        q = (cart_state_stream(stream, products, **more).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()))
             .outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start())
        assert q.awaitTermination(120)
    return rows


def test_stream_equals_batch(spark, tmp_dir):
    cmds = commands(random.Random(3), 150)
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    rows = run(spark, tmp_dir, products, [cmds[:60], cmds[60:61], cmds[61:]])
    last = {}
    for r in rows:
        last[r.cart_id, r.product_id] = r
    items, rejects, _ = cart.apply_cart_commands(spark.createDataFrame(cmds, schemas.CART_COMMANDS), products)
    want = {(r.cart_id, r.product_id): (r.quantity, r.added_at) for r in items.collect()}
    assert {k: (r.quantity, r.added_at) for k, r in last.items() if r.present} == want
    got = sorted((x.seq, x.op or "", x.reason) for r in rows for x in r.rejects)
    assert got == sorted((r.seq, r.op or "", r.reason) for r in rejects.collect())
    assert sorted(s for r in rows for s in r.rejected) == [s for s, _, _ in got]


def test_deleted_lines_leave_the_state(spark, tmp_dir):
    products = spark.range(1, 41).select(F.col("id").alias("product_id"))
    add = [(i, "c", "add", i, 1, T0) for i in range(1, 41)]
    run(spark, tmp_dir, products, [add, [(100 + i, "c", "del", i, None, T0) for i in range(1, 39)]])

    def kept(name):
        return (spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_dir}/ck").count())
    assert kept("line") == 2 and kept("gone") == 38
    rows = run(spark, tmp_dir + "/2", products, [add, [(100 + i, "c", "del", i, None, T0) for i in range(1, 39)], [(50, "c", "add", 3, 1, T0), (200, "c", "add", 4, 2, T0)]])
    late = [r for r in rows if r.product_id == 3][-1]
    assert not late.present and [(x.seq, x.reason) for x in late.rejects] == [(50, "late")]
    assert [r.quantity for r in rows if r.product_id == 4][-1] == 2


def test_commands_out_of_order_within_the_delay(spark, tmp_dir):
    products = spark.createDataFrame([(1,)], "product_id long")
    src = f"{tmp_dir}/in"
    cmds = [(5, "c", "del", 1, None, T0), (3, "c", "add", 1, 2, T0), (4, "c", "set", 1, 7, T0), (6, "c", "add", 1, 1, T0)]
    rows = []
    os.makedirs(src)
    stream = spark.readStream.schema(schemas.CART_COMMANDS).parquet(src + "/*")
    spark.createDataFrame(cmds[:1], schemas.CART_COMMANDS).write.parquet(f"{src}/0")
    q = (cart_state_stream(stream, products, delay=8).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()))
         .outputMode("update").option("checkpointLocation", f"{tmp_dir}/ck").trigger(processingTime="1 second").start())
    try:
        spark.createDataFrame(cmds[1:], schemas.CART_COMMANDS).coalesce(1).write.parquet(f"{src}/1")
        end = time.time() + 90
        while time.time() < end and not any(r.last_seq >= 6 for r in rows):
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows[-1].present and rows[-1].quantity == 1 and rows[-1].last_seq == 6
    assert [x for r in rows for x in r.rejects] == []

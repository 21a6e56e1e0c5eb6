"""One key holding a third of all rows: results stay exact when the work is split."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from shopstream.operators import cart
from shopstream.operators import sessions as sess
from shopstream.sources import fixtures as fx
from tests.test_cart import CMD, naive

T0 = dt.datetime(2024, 1, 1)


def test_gap_sessions_with_a_hot_user(spark, tmp_dir):
    rnd = random.Random(5)
    rows, t = [], {}
    for i in range(3000):
        u = 7 if i % 3 == 0 else rnd.randint(1, 40)  # user 7 holds a third of the events
        t[u] = t.get(u, T0) + dt.timedelta(minutes=rnd.choice([3, 30, 400, 719, 720, 721, 2000]))
        rows.append((i, t[u], u, "view", 1.0, json.dumps({"k": rnd.randint(0, 20)})))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    df.write.parquet(os.path.join(tmp_dir, "events.parquet"))
    got = {r.event_id: r.user_session for r in fx.clicks(spark, tmp_dir).collect()}
    exp, last, sid = {}, {}, {}
    for i, ts, u, *_ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if u not in last or ts - last[u] >= dt.timedelta(minutes=720):
            sid[u] = sid.get(u, 0) + 1
        last[u] = ts
        exp[i] = f"{u}-{sid[u]}"
    assert got == exp
    days = {r[1].date() for r in rows if r[2] == 7}
    assert len(days) > 20  # the hot user spans many (user, day) buckets


def test_hot_cart_line_over_many_buckets(spark):
    rnd = random.Random(9)
    cmds = []
    for seq in range(1, 1500):
        hot = seq % 3 == 0
        cid, pid = ("hot", 1) if hot else (rnd.choice(["a", "b"]), rnd.choice([1, 2, 3]))
        op = rnd.choice(["add", "add", "add", "set", "del"])
        q = rnd.choice([1, 2, 3, 0, -1]) if op != "del" else None
        cmds.append((seq, cid, op, pid, q, T0 + dt.timedelta(minutes=seq)))
    prods = spark.createDataFrame([(1,), (2,), (3,)], "product_id long")
    it, rej, _ = cart.apply_cart_commands(spark.createDataFrame(cmds, CMD), prods, bucket_rows=64)
    state = {(r.cart_id, r.product_id): (r.quantity, r.added_at) for r in it.collect()}
    rejects = sorted((r.seq, r.reason) for r in rej.collect())
    assert (state, rejects) == naive(cmds, {1, 2, 3})


def test_hot_session_is_capped_exactly(spark):
    rows = [("hot", T0 + dt.timedelta(seconds=i), i, i % 50) for i in range(3000)]
    rows += [(f"s{j}", T0, 10_000 + 3 * j + m, m) for j in range(2000) for m in range(3)]
    df = spark.createDataFrame(rows, "user_session string, event_time timestamp_ntz, event_id long, product_id long")
    out = {r.user_session: r for r in sess.build_sessions(df).collect()}
    assert out["hot"].session_len == 3  # p95 of lengths is 3
    assert list(out["hot"].product_seq) == [2997 % 50, 2998 % 50, 2999 % 50]
    assert out["hot"].start_time == T0
    assert sess.build_sessions(df).filter(F.col("session_len") != 3).count() == 0

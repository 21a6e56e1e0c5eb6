import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopstream.operators import sessions as sess

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_session string, event_time timestamp_ntz, event_id long, product_id long"


def ev(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def collect_sessions(df):
    return {r.user_session: (list(r.product_seq), r.start_time, r.session_len) for r in df.collect()}


def test_equal_timestamps_break_on_event_id(spark):
    rows = [("s", T0, 3, 30), ("s", T0, 1, 10), ("s", T0, 2, 20)]
    out = collect_sessions(sess.build_sessions(ev(spark, rows), percentile=None))
    assert out["s"][0] == [10, 20, 30]


def test_single_event_sessions_dropped_and_empty_input(spark):
    rows = [("a", T0, 1, 1), ("b", T0, 2, 2), ("b", T0 + dt.timedelta(seconds=1), 3, 3)]
    out = collect_sessions(sess.build_sessions(ev(spark, rows)))
    assert set(out) == {"b"}
    empty = sess.build_sessions(ev(spark, []))
    assert empty.count() == 0
    assert empty.columns == ["user_session", "start_time", "product_seq", "session_len"]


def test_cap_keeps_last_items_and_start_time_before_cap(spark):
    # lengths 2,3,4,10 -> p95 = 9.0999... -> cap 9
    rows = []
    eid = 0
    for s, n in [("a", 2), ("b", 3), ("c", 4), ("d", 10)]:
        for i in range(n):
            eid += 1
            rows.append((s, T0 + dt.timedelta(minutes=i), eid, 100 + i))
    out = collect_sessions(sess.build_sessions(ev(spark, rows)))
    assert out["d"][0] == list(range(101, 110))
    assert out["d"][2] == 9
    assert out["d"][1] == T0  # start_time from the dropped first event
    cap = sess.length_cap(sess.session_stats(ev(spark, rows))).first()
    assert cap.cap == 9 and abs(cap.length_percentile - 9.1) < 0.01


def test_pathological_session_is_capped(spark):
    rows = [("big", T0 + dt.timedelta(seconds=i), i, i % 7) for i in range(1000)]
    rows += [(f"s{j}", T0, 2000 + 2 * j, 1) for j in range(40)] + [(f"s{j}", T0, 2001 + 2 * j, 2) for j in range(40)]
    out = collect_sessions(sess.build_sessions(ev(spark, rows)))
    assert out["big"][2] == 2  # cap = max(int(p95), 2) = 2 since almost all sessions have length 2
    assert out["big"][0] == [998 % 7, 999 % 7]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 50), st.integers(0, 9)), min_size=0, max_size=40))
def test_matches_naive_python(spark, data):
    rows = [(f"s{s}", T0 + dt.timedelta(seconds=t), i, p) for i, (s, t, p) in enumerate(data)]
    got = collect_sessions(sess.build_sessions(ev(spark, rows), percentile=None))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    exp = {}
    for s, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        if len(rs) >= 2:
            exp[s] = ([r[3] for r in rs], min(r[1] for r in rs), len(rs))
    assert got == exp


def test_describe_and_profile(spark):
    rows = [("a", T0, 1, 1), ("a", T0, 2, 2), ("b", T0, 3, 1), ("c", T0, 4, 5), ("c", T0, 5, 5), ("c", T0, 6, 5)]
    s = sess.build_sessions(ev(spark, rows), percentile=None)
    d = sess.describe_lengths(s).first()
    assert (d.n, d.min, d.max, d.p50) == (2, 2, 3, 2.5)
    p = sess.dataset_profile(ev(spark, rows)).first()
    assert (p.events, p.sessions, p.one_event_sessions, p.usable_sessions, p.products, p.pairs_before_cap) == \
        (6, 3, 1, 2, 3, 3)
    assert s.filter(F.col("session_len") < 2).count() == 0

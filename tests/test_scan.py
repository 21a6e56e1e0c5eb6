import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopstream.functions.ordering import global_row_number
from shopstream.functions.scan import scan_before


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 20)), min_size=0, max_size=60), st.integers(1, 7))
def test_scan_before_matches_naive(spark, data, bucket):
    rows = [(k, i, v) for i, (k, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "k int, seq long, v int")
    out = scan_before(df, ["k"], ["seq"], F.floor(F.col("seq") / bucket),
                      [("mx", "max", F.when(F.col("v") > 0, F.col("v"))), ("sm", "sum", F.col("v"))])
    got = {r.seq: (r.mx, r.sm) for r in out.collect()}
    exp = {}
    for k, i, v in rows:
        before = [vv for kk, ii, vv in rows if kk == k and ii < i]
        pos = [x for x in before if x > 0]
        exp[i] = (max(pos) if pos else None, sum(before))
    assert got == exp
    inc = scan_before(df, ["k"], ["seq"], F.floor(F.col("seq") / bucket), [("sm", "sum", F.col("v"))], inclusive=True)
    assert {r.seq: r.sm for r in inc.collect()} == {i: exp[i][1] + v for _, i, v in rows}


@pytest.mark.parametrize("partitions", [1, 16, 64, 200])
def test_global_row_number_on_wide_rows(spark, partitions):
    n = 3_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", *[F.sha2(F.col("id").cast("string"), 256).alias(f"w{i}") for i in range(2)])
        out = global_row_number(df, ["k"], start=1)
        got = out.agg(F.count(F.lit(1)), F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()
        assert tuple(got) == (n, 1, n, n)
        prev = Window.orderBy("row_no")
        assert out.where("row_no <= 100000").withColumn("p", F.lag("k").over(prev)).where("p >= k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

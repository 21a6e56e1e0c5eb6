"""Adapters from the driver's test tables to the event schemas used here.

The test data has no clickstream with a session key, so these views map
the tables onto it (see FIXTURES.md).  They are plain lazy DataFrames over
``{sf_dir}/{table}.parquet``; nothing is regenerated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Gap that starts a new session in the click adapter.
SESSION_GAP_MINUTES = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events -> (user_session, event_time, event_id, event_type, user_id, product_id).

    A user's events form a new session whenever the gap to the previous
    event is at least 720 minutes.  Skew-safe two-level scan with day
    buckets: one window over (user, day) gives the previous time and the
    running count of gaps inside the day; a per-(user, day) summary (one row
    per bucket) scanned per user gives the carry-in (last time of earlier
    days, sessions started before the day).  A user with a third of all
    events is spread over one task per day; the events are shuffled once.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ev = ev.withColumn("_day", F.to_date("ts"))
    gap = F.expr(f"INTERVAL {SESSION_GAP_MINUTES} MINUTES")
    w = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
    prev = F.lag("ts").over(w)
    loc = ev.withColumn("_inner", F.when(prev.isNotNull() & (F.col("ts") - prev >= gap), 1).otherwise(0))
    loc = loc.withColumn("_lcnt", F.sum("_inner").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summ = loc.groupBy("user_id", "_day").agg(F.max("ts").alias("_bmax"), F.min("ts").alias("_bmin"),
                                              F.sum("_inner").alias("_bin"))
    w2 = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    cprev = F.max("_bmax").over(w2)
    carry = summ.select("user_id", "_day", "_bin",
                        F.when(cprev.isNull() | (F.col("_bmin") - cprev >= gap), 1).otherwise(0).alias("_first"))
    carry = carry.select("user_id", "_day", "_first",
                         F.coalesce(F.sum(F.col("_first") + F.col("_bin")).over(w2), F.lit(0)).alias("_csid"))
    j = loc.join(carry, ["user_id", "_day"], "inner")
    sid = F.col("_csid") + F.col("_first") + F.col("_lcnt")
    return j.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), sid.cast("string")).alias("user_session"),
        F.col("ts").alias("event_time"),
        "event_id",
        "event_type",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem joined with part -> events with category, brand and price.

    NULLs are injected by a fixed rule so that last-non-null logic is
    exercised.  ``price`` is decimal(10,2), as in the reference's events.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    # the category of a part is spelled once a part, before the join
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.concat(F.lower("p_type"), F.lit("."), F.split("p_name", " ").getItem(1)).alias("_code"))
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    ok_ln = F.col("l_orderkey") + F.col("l_linenumber")
    brand = F.when((ok_ln % 3 == 0) | (F.col("l_partkey") % 11 == 0), F.lit(None)).otherwise(F.col("p_brand"))
    code = F.when((ok_ln % 5 == 0) | (F.col("l_partkey") % 13 == 0), F.lit(None)).otherwise(F.col("_code"))
    price = F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(
        F.col("l_extendedprice").cast("decimal(10,2)"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("user_session"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_returnflag").alias("event_type"),
        price.cast("decimal(10,2)").alias("price"),
        code.alias("category_code"),
        brand.cast("string").alias("brand"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
    )


# Order keys that make every per-session / per-product order total.
CLICK_ORDER = ("event_time", "event_id")
BASKET_ORDER = ("event_time", "l_linenumber", "product_id")
BASKET_LATEST_ORDER = ("event_time", "l_linenumber", "product_id", "l_orderkey",
                       "l_suppkey", "l_extendedprice", "l_quantity")


def cart_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 read side: (cart_id, product_id, quantity, added_at) from orders x lineitem."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "inner")
    return (j.groupBy(F.col("o_custkey").cast("string").alias("cart_id"), F.col("l_partkey").alias("product_id"))
             .agg(F.sum("l_quantity").cast("int").alias("quantity"), F.min("o_orderdate").alias("added_at")))


def cart_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 command side: lineitems in ship order become add / set / del commands.

    ``seq`` is a dense order over the whole table.  It is computed as a
    distributed rank (range-partitioned sort, no single-partition window).
    Every 97th command names a product id that does not exist.
    """
    from shopstream.functions.ordering import global_row_number

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    numbered = global_row_number(j, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "seq")
    seq = F.col("seq")
    op = F.when(seq % 7 == 0, "del").when(seq % 5 == 0, "set").otherwise("add")
    qty = F.when(seq % 7 == 0, F.lit(None).cast("int")).when(seq % 5 == 0, (seq % 4).cast("int")).otherwise(
        F.col("l_quantity").cast("int"))
    pid = F.when(seq % 97 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    return numbered.select(
        seq.alias("seq"),
        F.col("o_custkey").cast("string").alias("cart_id"),
        op.alias("op"),
        pid.alias("product_id"),
        qty.alias("quantity"),
        F.col("l_shipdate").alias("at"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as item vectors keyed by product id."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("product_id"), "embedding")


def raw_csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem joined with part -> rows in the shape of the raw CSV files, all text.

    Times carry the `` UTC`` suffix, category and brand are blank by fixed rules, brands hold
    a comma and quotes.  The rows of a session lie in one partition; they travel there before
    they are spelled out.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner").drop("p_partkey").repartition("l_orderkey")
    brand = F.concat("p_brand", F.lit(', "'), "l_returnflag", F.lit('"'))
    return j.select(
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
        F.col("l_returnflag").alias("event_type"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_linenumber").cast("string").alias("category_id"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("p_type")).alias("category_code"),
        F.when(F.col("l_orderkey") % 5 != 0, brand).alias("brand"),
        F.col("l_extendedprice").cast("decimal(10,2)").cast("string").alias("price"),
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.col("l_orderkey").cast("string").alias("user_session"))

"""Explicit schemas of the event, session, vocabulary, product and cart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("event_time", T.TimestampNTZType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("category_code", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", T.DecimalType(10, 2), True),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("user_session", T.StringType(), False),
])

# Raw CSV columns (before parsing): time keeps its " UTC" suffix.
RAW_CSV = T.StructType([
    T.StructField("event_time", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("category_code", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", T.DecimalType(10, 2), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("user_session", T.StringType(), True),
])

SESSIONS = T.StructType([
    T.StructField("user_session", T.StringType(), False),
    T.StructField("start_time", T.TimestampNTZType(), True),
    T.StructField("product_seq", T.ArrayType(T.LongType()), False),
    T.StructField("session_len", T.IntegerType(), False),
])

VOCAB = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("token_id", T.IntegerType(), False),
    T.StructField("n", T.LongType(), False),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("category_code", T.StringType(), True),
    T.StructField("category_top", T.StringType(), True),
    T.StructField("category_leaf", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", T.DecimalType(10, 2), True),
    T.StructField("display_name", T.StringType(), False),
    T.StructField("image_ref", T.StringType(), False),
    T.StructField("event_count", T.LongType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

CART_COMMANDS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("cart_id", T.StringType(), True),
    T.StructField("op", T.StringType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("at", T.TimestampNTZType(), True),
])


def validate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One-row report: missing columns are an error; NOT NULL violations are counted.

    Returns a DataFrame (column, violations); the count is a single
    aggregate over the table, no driver-side scan.
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    nn = [f.name for f in schema.fields if not f.nullable]
    if not nn:
        from shopstream.functions.literals import literal_table
        return literal_table(df.sparkSession, [], "column string, violations long")
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nn])
    stack = ", ".join(f"'{c}', `{c}`" for c in nn)
    return agg.selectExpr(f"stack({len(nn)}, {stack}) AS (column, violations)")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to ``schema`` (extra columns dropped, missing ones NULL)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)

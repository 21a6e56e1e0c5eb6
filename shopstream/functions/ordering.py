"""Distributed ordering helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstream.session import shared_table

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | record number


def global_row_number(df: DataFrame, order_cols: Sequence[str | Column], name: str = "row_no",
                      start: int = 1) -> DataFrame:
    """Dense 1..N number over a total order, without a single-partition window.

    Range-partition and sort on the key (one shuffle), number rows inside each
    partition, and write partition and number with the rows to the shared folder.
    The row counts of earlier partitions come from that table too: a second range
    shuffle would sample boundaries of its own, so both branches must read one
    result.  The offsets have one row per partition of the shuffle.
    ``order_cols`` must form a total order, else the numbering of ties is
    arbitrary.
    """
    cols = list(order_cols)
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    local = shared_table(ranged.withColumn("_mid", F.monotonically_increasing_id()).select(
        "*", F.shiftright("_mid", _LOCAL_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_lrn")).drop("_mid"), "numbered")
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the cumulative window runs over #partitions rows only
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    out = local.join(F.broadcast(offsets), "_pid", "inner")
    return out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_lrn") + F.lit(start)).drop(
        "_pid", "_lrn", "_off")

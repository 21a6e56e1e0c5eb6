"""Skew-safe running aggregates ("everything before this row, within the key").

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key
to one task; if one key holds a third of the data, so does that task.
Here the scan is split in two levels:

1. rows are cut into buckets (``bucket`` must grow with the order: a day
   of the timestamp, ``seq // B``...); a window over (key, bucket) gives
   the running value inside the bucket, so a task sees at most one
   bucket of one key;
2. a per-(key, bucket) summary (partial + final aggregate, one row per
   bucket) is scanned per key over buckets (tiny) to get the carry-in from
   all earlier buckets, and joined back on (key, bucket).

Only ``max`` and ``sum`` are supported (both associative).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"max": F.max, "sum": F.sum}


def scan_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str | Column,
                aggs: Sequence[tuple[str, str, Column]], *, inclusive: bool = False) -> DataFrame:
    """Add one column per ``(name, kind, expr)``: ``kind`` of ``expr`` over the earlier rows of the key.

    ``order`` must be a total order inside a key and consistent with
    ``bucket`` (a later bucket never holds an earlier row).  With
    ``inclusive=True`` the current row is included.  ``sum`` of no rows is 0,
    ``max`` of no rows is NULL.  ``bucket`` may name an existing column
    (reused, so a second scan needs no new shuffle).
    """
    keys = list(keys)
    if isinstance(bucket, str) and bucket in df.columns:
        bk, d = bucket, df
    else:
        bk, d = "_bk", df.withColumn("_bk", bucket)
    for name, _, expr in aggs:
        d = d.withColumn(f"_v_{name}", expr)
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, bk).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = d.select("*", *[_AGG[k](f"_v_{n}").over(w).alias(f"_l_{n}") for n, k, _ in aggs])
    summ = d.groupBy(*keys, bk).agg(*[_AGG[k](f"_v_{n}").alias(f"_s_{n}") for n, k, _ in aggs])
    w2 = Window.partitionBy(*keys).orderBy(bk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*keys, bk, *[_AGG[k](f"_s_{n}").over(w2).alias(f"_c_{n}") for n, k, _ in aggs])
    j = local.join(carry, [*keys, bk], "left")
    out = []
    for n, k, _ in aggs:
        lcol, ccol = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k == "max":
            out.append(F.greatest(lcol, ccol).alias(n))
        else:
            out.append((F.coalesce(lcol, F.lit(0)) + F.coalesce(ccol, F.lit(0))).alias(n))
    drop = [f"_{p}_{n}" for n, _, _ in aggs for p in ("v", "l", "c")]
    res = j.select("*", *out).drop(*drop)
    return res if bk != "_bk" else res.drop("_bk")

"""Sessionisation: ordered item sequences per session, min-length filter, length cap.

Plan shape (one scan of the events):

* per-session length and start time: a partial + final hash aggregate, so a
  session holding a third of all events costs one small row per map task;
* the cap is a scalar (exact percentile over session lengths; Spark keeps a
  value->count map, bounded by the number of distinct lengths);
* ``row_number() <= cap`` over (session, time desc) becomes a
  ``WindowGroupLimit`` that runs before the shuffle as well, so no task
  ever receives more than ``cap`` rows per session per map partition;
* only then are the kept rows collected into an array and sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopstream.constants import MIN_SESSION_LEN, SESSION_LEN_PERCENTILE


def session_stats(events: DataFrame, *, session_col: str = "user_session", time_col: str = "event_time",
                  item_col: str = "product_id", order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """A1 without the list: (session, start_time, raw_len, last_item) for every session."""
    okey = F.struct(*[F.col(c) for c in order])
    return events.groupBy(session_col).agg(
        F.min(time_col).alias("start_time"),
        F.count(F.lit(1)).alias("raw_len"),
        F.max_by(F.col(item_col), okey).alias("last_item"),
    )


def length_cap(stats: DataFrame, *, min_len: int = MIN_SESSION_LEN,
               percentile: float = SESSION_LEN_PERCENTILE) -> DataFrame:
    """A2 as a one-row DataFrame: cap = max(int(p-th percentile of usable lengths), min_len)."""
    usable = stats.filter(F.col("raw_len") >= min_len)
    p = usable.agg(F.percentile(F.col("raw_len"), F.lit(percentile / 100.0)).alias("p"))
    return p.select(
        F.col("p").alias("length_percentile"),
        F.greatest(F.floor("p").cast("int"), F.lit(min_len)).alias("cap"))


def cap_value(stats: DataFrame, *, min_len: int = MIN_SESSION_LEN,
              percentile: float = SESSION_LEN_PERCENTILE) -> int:
    """The cap as a Python int (one scalar; lets the optimizer use a literal limit)."""
    row = length_cap(stats, min_len=min_len, percentile=percentile).first()
    if row is None or row["cap"] is None:
        return min_len  # empty input: no usable session, any cap gives an empty result
    return int(row["cap"])


def build_sessions(events: DataFrame, *, min_len: int = MIN_SESSION_LEN,
                   percentile: float | None = SESSION_LEN_PERCENTILE, cap: int | None = None,
                   session_col: str = "user_session", time_col: str = "event_time",
                   item_col: str = "product_id", order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """A1-A3: (user_session, start_time, product_seq array<bigint>, session_len int).

    ``order`` must be a total order inside a session (time plus a unique
    tie-breaker).  ``start_time`` is the minimum over all events of the
    session, including those dropped by the cap.  With ``percentile=None``
    and ``cap=None`` sequences are not capped (unbounded arrays; only for
    data whose sessions are known to be short).
    """
    ev = events.select(*{session_col, time_col, item_col, *order})
    stats = session_stats(ev, session_col=session_col, time_col=time_col, item_col=item_col, order=order)
    usable = stats.filter(F.col("raw_len") >= min_len).select(session_col, "start_time")
    if cap is None and percentile is not None:
        cap = cap_value(stats, min_len=min_len, percentile=percentile)
    kept = ev
    if cap is not None:
        w = Window.partitionBy(session_col).orderBy(*[F.col(c).desc() for c in order])
        kept = ev.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= F.lit(int(cap)))
    okey = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    seqs = kept.groupBy(session_col).agg(
        F.array_sort(F.collect_list(F.struct(*okey, F.col(item_col).alias("_item")))).alias("_evs"))
    out = usable.join(seqs, session_col, "inner")
    seq = F.transform("_evs", lambda e: e["_item"]).cast("array<bigint>")
    return out.select(
        F.col(session_col).alias("user_session"), "start_time",
        seq.alias("product_seq"), F.size(seq).cast("int").alias("session_len"))


def describe_lengths(sessions: DataFrame, col: str = "session_len") -> DataFrame:
    """A4: count, mean, std, min, quartiles, max of session lengths (one row)."""
    q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sessions.agg(
        F.count(F.col(col)).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), q.alias("_q"), F.max(col).alias("max"),
    ).select("n", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
             F.col("_q")[2].alias("p75"), "max")


def dataset_profile(events: DataFrame, *, session_col: str = "user_session", item_col: str = "product_id",
                    min_len: int = MIN_SESSION_LEN, exact: bool = True) -> DataFrame:
    """Events, distinct sessions, one-event sessions, usable sessions, products, pairs before cap."""
    lens = events.groupBy(session_col).agg(F.count(F.lit(1)).alias("n"))
    by_session = lens.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("n") == 1).alias("one_event_sessions"),
        F.count_if(F.col("n") >= min_len).alias("usable_sessions"),
        F.sum(F.when(F.col("n") >= min_len, F.col("n") - 1).otherwise(0)).alias("pairs_before_cap"),
        F.sum("n").alias("events"))
    distinct = F.count_distinct(item_col) if exact else F.approx_count_distinct(item_col)
    items = events.agg(distinct.alias("products"))
    return by_session.crossJoin(items).select(
        "events", "sessions", "one_event_sessions", "usable_sessions", "products", "pairs_before_cap")

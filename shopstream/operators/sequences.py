"""Sequence operators: training pairs, padding, eval prefixes, split, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.constants import MAX_SEQ_LEN, PAD_TOKEN, TEST_DAYS, VAL_DAYS
from shopstream.functions.arrays import last_n, pad_left


def training_pairs(encoded: DataFrame, *, max_len: int = MAX_SEQ_LEN, key: str = "user_session",
                   seq_col: str = "token_seq") -> DataFrame:
    """Q2: one row for each position from the second on: the item there as target, and
    up to ``max_len`` items that stand before it as prefix.

    The truncated window is built directly (slice of at most ``max_len``), so
    the output is linear in the number of pairs, never quadratic.
    ``pos`` is the 1-based index of the last prefix item.
    """
    s = encoded.filter(F.size(seq_col) >= 2)
    L = F.lit(max_len)
    seq = F.col(seq_col)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(seq) - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.slice(seq, F.greatest(i - L + 1, F.lit(1)), F.least(i, L)).alias("prefix"),
            F.element_at(seq, i + 1).alias("target")))
    return s.select(key, F.inline(pairs))


def padded_pairs(pairs: DataFrame, *, max_len: int = MAX_SEQ_LEN, pad: int = PAD_TOKEN) -> DataFrame:
    """Q3: prefixes left-truncated and left-padded to exactly ``max_len``."""
    return pairs.withColumn("prefix", pad_left("prefix", max_len, pad))


def eval_prefixes(encoded: DataFrame, *, key: str = "user_session", seq_col: str = "token_seq",
                  max_len: int | None = None) -> DataFrame:
    """Q4: last item is the target, the rest the prefix; sequences shorter than 2 are skipped."""
    s = encoded.filter(F.size(seq_col) >= 2)
    prefix = F.slice(seq_col, 1, F.size(seq_col) - 1)
    if max_len is not None:
        prefix = last_n(prefix, max_len)
    return s.select(key, prefix.alias("prefix"), F.element_at(seq_col, -1).alias("target"))


def pair_count(sessions: DataFrame, len_col: str = "session_len") -> DataFrame:
    """Q5: number of training pairs = sum(len - 1) over sessions of length >= 2."""
    return sessions.agg(F.coalesce(F.sum(F.when(F.col(len_col) >= 2, F.col(len_col) - 1)), F.lit(0))
                        .cast("bigint").alias("pairs"))


def time_split(sessions: DataFrame, *, test_days: float = TEST_DAYS, val_days: float = VAL_DAYS,
               time_col: str = "start_time") -> DataFrame:
    """Q6: add ``split`` in {train, val, test} from cutoffs below max(start_time).

    test: >= max - test_days; val: [test_cut - val_days, test_cut); train: earlier.
    Fractional days are exact to the microsecond.  The max is a one-row
    aggregate cross-joined (broadcast, 1 row) so the plan stays lazy.
    """
    mx = sessions.agg(F.max(time_col).alias("_max"))
    test_cut = F.col("_max") - F.make_dt_interval(secs=F.lit(float(test_days) * 86400.0))
    val_cut = test_cut - F.make_dt_interval(secs=F.lit(float(val_days) * 86400.0))
    j = sessions.crossJoin(F.broadcast(mx))
    split = (F.when(F.col(time_col) >= test_cut, "test")
              .when(F.col(time_col) >= val_cut, "val")
              .otherwise("train"))
    return j.withColumn("split", split).drop("_max")


def split_frames(sessions: DataFrame, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) views of ``time_split`` (one plan, three filters)."""
    s = time_split(sessions, **kw)
    return tuple(s.filter(F.col("split") == name).drop("split") for name in ("train", "val", "test"))


def rolling_window(events: DataFrame, *, days: float, time_col: str = "event_time", day_col: str | None = None) -> DataFrame:
    """Events within the last ``days`` before the latest event (inclusive bound).

    The latest time is one value, found first, so the bound is a literal that reaches the
    scan.  ``day_col`` names the partition column of a day-partitioned table: the latest time
    is then looked for in the last day only, and only the days of the window are read.
    """
    newest = events
    if day_col:
        last = events.where(F.col(time_col).isNotNull()).agg(F.max(day_col)).first()[0]
        newest = events.where(F.col(day_col) == F.lit(str(last)).cast("date")) if last else events
    start = F.max(time_col) - F.make_dt_interval(secs=F.lit(float(days) * 86400.0))
    cut, day = newest.agg(start.cast("string"), F.to_date(start).cast("string")).first()  # as text: no time zone of the driver
    if cut is None:
        return events.filter(F.lit(False))
    window = events.filter(F.col(time_col) >= F.lit(cut).cast(events.schema[time_col].dataType))
    return window.filter(F.col(day_col) >= F.lit(day).cast("date")) if day_col else window


def sample_key(key_col: str, seed: int):
    return F.md5(F.concat(F.col(key_col).cast("string"), F.lit(f":{seed}")))


def eval_sample(sessions: DataFrame, *, n: int, seed: int = 42, key: str = "user_session") -> DataFrame:
    """T4: deterministic sample of min(n, count) sessions, independent of partitioning."""
    return sessions.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def shuffle_key(df: DataFrame, seed: int, key: str, extra_key: str | None):
    parts = [key] + ([extra_key] if extra_key and extra_key in df.columns else [])
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts], F.lit(str(seed))))


def shuffle_rows(df: DataFrame, *, seed: int = 42, key: str = "user_session", num_partitions: int | None = None,
                 extra_key: str | None = "pos") -> DataFrame:
    """T5: seeded global shuffle: range-partition and sort on a hash of the row key."""
    d = df.withColumn("_h", shuffle_key(df, seed, key, extra_key))
    d = d.repartitionByRange(num_partitions, "_h") if num_partitions else d.repartitionByRange("_h")
    return d.sortWithinPartitions("_h").drop("_h")


def shuffled_positions(df: DataFrame, *, seed: int = 42, key: str = "user_session", extra_key: str | None = "pos") -> DataFrame:
    """T5: the rows with their place (``shuffled``, from 1) in the order of ``shuffle_rows``."""
    from shopstream.functions.ordering import global_row_number
    order = ["_h", key] + ([extra_key] if extra_key else [])
    return global_row_number(df.withColumn("_h", shuffle_key(df, seed, key, extra_key)), order, "shuffled").drop("_h")

"""Queries over the click adapter (X1): sessions, vocabulary, sequences, profile."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopstream.functions.arrays import seq_string
from shopstream.operators import sequences as seqops
from shopstream.operators import sessions as sess
from shopstream.operators import vocab as voc
from shopstream.plans.registry import query
from shopstream.schemas import EVENTS, conform, validate_schema
from shopstream.session import checkpoint_dir, cut_lineage, stored_once
from shopstream.sources import fixtures as fx
from shopstream.sources.parquet_io import export_window, read_sessions, write_sessions

# Query parameters for the fixture tables (FIXTURES.md X1): 100 distinct
# items, so a 60-token vocabulary exercises OTHER.
CLICK_VOCAB_SIZE = 60
CLICK_TEST_DAYS = 3
CLICK_VAL_DAYS = 3
EXPORT_START = "2024-01-05 00:00:00"
EXPORT_END = "2024-01-20 00:00:00"
EXPORT_LIMIT = 1000
ROLLING_DAYS = 7
EVAL_SAMPLE_N = 200
SHUFFLE_SEED = 42


def stored_clicks(spark, sf_dir):
    """The events of X1 with their session, stored: one pass over the source, read by everything that follows."""
    return stored_once(spark, "clicks", [f"{sf_dir}/events.parquet"], lambda: fx.clicks(spark, sf_dir))


def click_sessions(spark, sf_dir, *, materialize: bool = True):
    """Sessions of X1.  Queries that read them in several branches get them once,
    from a reliable checkpoint (plan cut after sessionising)."""
    s = sess.build_sessions(stored_clicks(spark, sf_dir), order=fx.CLICK_ORDER)
    return cut_lineage(s) if materialize else s


def click_vocab(spark, sf_dir, sessions=None):
    s = sessions if sessions is not None else click_sessions(spark, sf_dir)
    return voc.build_vocab(s, size=CLICK_VOCAB_SIZE)


def click_encoded(spark, sf_dir):
    s = click_sessions(spark, sf_dir)
    return voc.encode(s, click_vocab(spark, sf_dir, s))


@query("load_profile")
def load_profile(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.agg(F.count(F.lit(1)).alias("total_rows"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"))


@query("event_type_counts")
def event_type_counts(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("export_window")
def export_window_q(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return export_window(ev, start=EXPORT_START, end=EXPORT_END, time_col="ts")


@query("export_window_limit")
def export_window_limit_q(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return export_window(ev, start=EXPORT_START, end=None, limit=EXPORT_LIMIT, time_col="ts", order=("ts", "event_id"))


@query("sessions_raw")
def sessions_raw(spark, sf_dir):
    return sess.session_stats(fx.clicks(spark, sf_dir), order=fx.CLICK_ORDER)


@query("session_len_cap")
def session_len_cap(spark, sf_dir):
    return sess.length_cap(sess.session_stats(stored_clicks(spark, sf_dir), order=fx.CLICK_ORDER))


@query("sessions")
def sessions_q(spark, sf_dir):
    s = click_sessions(spark, sf_dir, materialize=False)
    return s.select("user_session", "start_time", seq_string("product_seq").alias("product_seq"), "session_len")


@query("session_len_describe")
def session_len_describe(spark, sf_dir):
    return sess.describe_lengths(click_sessions(spark, sf_dir, materialize=False)).select(
        "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "min", "p25", "p50", "p75", "max")


@query("dataset_profile")
def dataset_profile(spark, sf_dir):
    return sess.dataset_profile(stored_clicks(spark, sf_dir))


@query("item_counts")
def item_counts(spark, sf_dir):
    return voc.item_counts(click_sessions(spark, sf_dir, materialize=False))


@query("vocab")
def vocab_q(spark, sf_dir):
    return click_vocab(spark, sf_dir, click_sessions(spark, sf_dir, materialize=False))


@query("encode")
def encode_q(spark, sf_dir):
    e = click_encoded(spark, sf_dir)
    return e.select("user_session", seq_string("token_seq").alias("token_seq"))


@query("training_pairs")
def training_pairs_q(spark, sf_dir):
    p = seqops.training_pairs(click_encoded(spark, sf_dir))
    return p.select("user_session", "pos", seq_string("prefix").alias("prefix"), "target")


@query("padded_pairs")
def padded_pairs_q(spark, sf_dir):
    p = seqops.padded_pairs(seqops.training_pairs(click_encoded(spark, sf_dir)))
    return p.select("user_session", "pos", seq_string("prefix").alias("prefix"), "target")


@query("eval_prefixes")
def eval_prefixes_q(spark, sf_dir):
    p = seqops.eval_prefixes(click_encoded(spark, sf_dir), max_len=20)
    return p.select("user_session", seq_string("prefix").alias("prefix"), "target")


@query("pair_count")
def pair_count_q(spark, sf_dir):
    return seqops.pair_count(click_sessions(spark, sf_dir, materialize=False))


@query("time_split")
def time_split_q(spark, sf_dir):
    s = seqops.time_split(click_sessions(spark, sf_dir), test_days=CLICK_TEST_DAYS, val_days=CLICK_VAL_DAYS)
    return s.select("user_session", "start_time", "session_len", "split")


@query("eval_sample")
def eval_sample_q(spark, sf_dir):
    s = seqops.eval_sample(click_sessions(spark, sf_dir, materialize=False), n=EVAL_SAMPLE_N, seed=42)
    return s.select("user_session", "session_len")


@query("rolling_window")
def rolling_window_q(spark, sf_dir):
    r = seqops.rolling_window(stored_clicks(spark, sf_dir), days=ROLLING_DAYS)
    return r.select("user_session", "event_time", "event_id", "product_id")


@query("sessions_stored")
def sessions_stored_q(spark, sf_dir):
    """Sessions written and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/shopstream-sessions-{uuid.uuid4().hex}"
    write_sessions(click_sessions(spark, sf_dir, materialize=False), path)
    s = read_sessions(spark, path)
    return s.select("user_session", "start_time", seq_string("product_seq").alias("product_seq"), "session_len")


@query("vocab_stored")
def vocab_stored_q(spark, sf_dir):
    """The vocabulary written, read back, with its metadata."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/shopstream-vocab-{uuid.uuid4().hex}"
    voc.save_vocab(click_vocab(spark, sf_dir, click_sessions(spark, sf_dir, materialize=False)), path)
    v = voc.load_vocab(spark, path)
    meta = voc.vocab_metadata(v).first()  # one row
    return v.select("*", F.lit(meta["num_special_tokens"]).alias("num_special_tokens"), F.lit(meta["vocab_size"]).cast("long").alias("vocab_size"))


@query("schema_violations")
def schema_violations_q(spark, sf_dir):
    """Basket events, cast to the events schema, and their NOT NULL violations."""
    b = fx.baskets(spark, sf_dir)
    events = conform(b.select("user_session", "event_time", "event_type", "product_id", "category_code", "price", F.col("brand"),
                              F.col("l_suppkey").alias("user_id"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("event_id")), EVENTS)
    return validate_schema(events, EVENTS)


@query("shuffled_rows")
def shuffled_rows_q(spark, sf_dir):
    """T5: training pairs in seeded random order."""
    p = seqops.training_pairs(click_encoded(spark, sf_dir)).select("user_session", "pos", "target")
    return seqops.shuffled_positions(p, seed=SHUFFLE_SEED)

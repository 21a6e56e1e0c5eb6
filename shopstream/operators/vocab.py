"""Frequency vocabulary and sequence encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopstream.constants import NUM_SPECIAL_TOKENS, OTHER_TOKEN, VOCAB_SIZE


def item_counts(sessions: DataFrame, seq_col: str = "product_seq") -> DataFrame:
    """A5: (product_id, n) over all items of all sequences (partial + final hash agg)."""
    return (sessions.select(F.explode(seq_col).alias("product_id"))
            .groupBy("product_id").agg(F.count(F.lit(1)).alias("n")))


def build_vocab(sessions: DataFrame, *, size: int = VOCAB_SIZE, seq_col: str = "product_seq") -> DataFrame:
    """(product_id, token_id, n) for the ``size`` most frequent items.

    token ids start at 3 in (count desc, product_id asc) order.  The limit runs
    first (per-partition top-N, then a merge of at most N rows per partition),
    so the numbering window sees at most ``size`` rows: a single partition is
    fine there and bounded by the argument, not by the data.
    """
    counts = item_counts(sessions, seq_col)
    top = counts.orderBy(F.col("n").desc(), F.col("product_id").asc()).limit(size)
    w = Window.orderBy(F.col("n").desc(), F.col("product_id").asc())
    return top.select(
        "product_id",
        (F.row_number().over(w) + F.lit(NUM_SPECIAL_TOKENS - 1)).cast("int").alias("token_id"),
        "n")


def explode_positions(sessions: DataFrame, key: str = "user_session", seq_col: str = "product_seq") -> DataFrame:
    return sessions.select(key, F.posexplode(seq_col).alias("pos", "product_id"))


def encode(sessions: DataFrame, vocab: DataFrame, *, default: int = OTHER_TOKEN, key: str = "user_session",
           seq_col: str = "product_seq", out_col: str = "token_seq") -> DataFrame:
    """Map each item of ``seq_col`` to its token id, ``default`` (OTHER) when absent.

    Only (key, position, item) is exploded and joined with the vocabulary (the join is
    chosen from measured sizes), regrouped in position order and joined back to the
    sessions on ``key``, which must be unique.  Empty sequences come back as empty arrays.
    """
    pos = explode_positions(sessions, key, seq_col).withColumnRenamed("pos", "_pos").withColumnRenamed("product_id", "_item")
    v = vocab.select(F.col("product_id").alias("_item"), F.col("token_id").alias("_tok"))
    pair = F.struct(F.col("_pos").alias("pos"), F.coalesce(F.col("_tok"), F.lit(default)).cast("int").alias("tok"))
    grouped = pos.join(v, "_item", "left").groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("_pt"))
    out = sessions.join(grouped, key, "left")
    toks = F.coalesce(F.transform("_pt", lambda x: x["tok"]), F.array().cast("array<int>"))
    return out.select(*sessions.columns, toks.alias(out_col))


def encode_rows(sessions: DataFrame, vocab: DataFrame, *, default: int = OTHER_TOKEN, key: str = "user_session",
                seq_col: str = "product_seq") -> DataFrame:
    """Long form of ``encode``: (key, pos, product_id, token_id), no regrouping shuffle."""
    pos = explode_positions(sessions, key, seq_col)
    v = vocab.select("product_id", "token_id")
    return pos.join(v, "product_id", "left").select(
        key, "pos", "product_id", F.coalesce(F.col("token_id"), F.lit(default)).cast("int").alias("token_id"))


def save_vocab(vocab: DataFrame, path: str, *, json_path: str | None = None) -> None:
    """The vocabulary as Parquet (plus an optional JSON-lines copy)."""
    vocab.write.mode("overwrite").parquet(path)
    if json_path:
        vocab.write.mode("overwrite").json(json_path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("product_id bigint, token_id int, n bigint").parquet(path)


def vocab_metadata(vocab: DataFrame) -> DataFrame:
    """One-row metadata: special tokens and the number of real items."""
    from shopstream.constants import PAD_TOKEN, UNK_TOKEN
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size")).select(
        F.lit(PAD_TOKEN).alias("pad_token"), F.lit(UNK_TOKEN).alias("unk_token"),
        F.lit(OTHER_TOKEN).alias("other_token"), F.lit(NUM_SPECIAL_TOKENS).alias("num_special_tokens"),
        "vocab_size")

"""Ranking metrics: Recall@k, NDCG@k, popularity baseline, coverage, model selection."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.constants import EARLY_STOPPING_PATIENCE, NUM_SPECIAL_TOKENS

METRIC_DECIMALS = 9


def recall_ndcg(preds: DataFrame, targets: DataFrame, *, k: int = 10, key: str = "user_session") -> DataFrame:
    """M4: one row (sessions, recall, ndcg) over the target sessions.

    A hit is the target among the top ``k`` predictions; gain 1/log2(rank+1)
    (rank from 1).  Special tokens are not masked: OTHER can be a hit.  No
    target sessions -> 0.0 and 0.0.
    """
    p = preds.filter(F.col("rank") <= k).select(key, F.col("token_id").alias("target"), "rank")
    j = targets.select(key, "target").join(p, [key, "target"], "left")
    hit = F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return j.agg(F.count(F.lit(1)).alias("sessions"),
                 F.coalesce(F.round(F.avg(hit), METRIC_DECIMALS), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.round(F.avg(gain), METRIC_DECIMALS), F.lit(0.0)).alias("ndcg"))


def popularity_recall(targets: DataFrame, *, k: int = 10) -> DataFrame:
    """M5: share of targets among the ``k`` most frequent tokens (ids 3..k+2)."""
    hit = F.when(F.col("target").between(NUM_SPECIAL_TOKENS, NUM_SPECIAL_TOKENS + k - 1), 1.0).otherwise(0.0)
    return targets.agg(F.count(F.lit(1)).alias("sessions"),
                       F.coalesce(F.round(F.avg(hit), METRIC_DECIMALS), F.lit(0.0)).alias("recall"))


def coverage(preds: DataFrame, vocab: DataFrame, *, k: int = 10) -> DataFrame:
    """M8: distinct recommended real items / items in the vocabulary."""
    rec = preds.filter((F.col("rank") <= k) & (F.col("token_id") >= NUM_SPECIAL_TOKENS)).agg(
        F.count_distinct("token_id").alias("recommended_items"))
    voc = vocab.agg(F.count(F.lit(1)).alias("vocab_items"))
    return rec.crossJoin(voc).select(
        "recommended_items", "vocab_items",
        F.round(F.col("recommended_items") / F.col("vocab_items"), METRIC_DECIMALS).alias("coverage"))


def judge_trials(cube: DataFrame, prior: DataFrame, targets: DataFrame, trials: Sequence[tuple[int, float]], *, k: int = 10,
                 key: str = "user_session", prefix_col: str = "prefix") -> DataFrame:
    """M7: (trial, max_lag, decay, sessions, recall, ndcg) of all (max_lag, decay) settings, from one fit and in one plan.

    Each trial has its own sources: source s of trial t is t * 2^32 + s in the model and in
    the prefixes, so one ranking of (session, trial) keys judges them all.
    """
    from shopstream.operators.model import from_cube, normalize
    from shopstream.operators.ranking import build_postings, rank_sessions
    shift = lambda t, c: F.lit(t << 32) + F.col(c)
    models = [normalize(from_cube(cube, max_lag=lag, decay=decay)).select(shift(t, "src").alias("src"), "dst", "p") for t, (lag, decay) in enumerate(trials)]
    model = functools.reduce(DataFrame.unionByName, models)
    settings = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(lag).alias("max_lag"), F.lit(float(decay)).alias("decay")) for t, (lag, decay) in enumerate(trials)])
    rows = targets.select(key, prefix_col, "target", F.inline(settings))
    rows = rows.withColumn("tokens", F.transform(prefix_col, lambda s: F.col("trial").cast("long") * F.lit(1 << 32) + s)).withColumn("one", F.struct(key, "trial"))
    best = rank_sessions(rows.select("one", "tokens", "max_lag", "decay"), build_postings(model, prior), k=k, key="one", tokens="tokens",
                         max_lag=F.col("max_lag"), decay=F.col("decay"))
    hits = rows.select("one", "target", "trial", "max_lag", "decay").join(best.select("one", F.col("token_id").alias("target"), "rank"), ["one", "target"], "left")
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return hits.groupBy("trial", "max_lag", "decay").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), METRIC_DECIMALS).alias("recall"),
        F.round(F.avg(gain), METRIC_DECIMALS).alias("ndcg"))


def select_model(grid: Iterable[dict], evaluate: Callable[[dict], float], *,
                 patience: int = EARLY_STOPPING_PATIENCE) -> tuple[dict | None, float, list[tuple[dict, float]]]:
    """M7: walk ``grid`` in order, keep the best validation score (strict improvement),
    stop after ``patience`` trials without improvement.

    ``evaluate(params)`` runs one Spark job and returns one number (e.g. val
    Recall@10); only that scalar reaches the driver.
    """
    best, best_score, misses, history = None, float("-inf"), 0, []
    for params in grid:
        score = float(evaluate(params))
        history.append((params, score))
        if score > best_score:
            best, best_score, misses = params, score, 0
        else:
            misses += 1
            if misses >= patience:
                break
    return best, best_score, history

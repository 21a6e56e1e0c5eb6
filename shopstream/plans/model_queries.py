"""Model queries over the click adapter: fit, merge, score, recommend, evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopstream.operators import evaluate as ev
from shopstream.operators import model as mdl
from shopstream.operators import sequences as seqops
from shopstream.operators import vocab as voc
from shopstream.plans.catalog_queries import stored_catalog
from shopstream.plans.registry import query
from shopstream.plans.session_queries import CLICK_TEST_DAYS, CLICK_VAL_DAYS, CLICK_VOCAB_SIZE, click_sessions, stored_clicks
from shopstream.session import shared_table

K = 10
TRIALS = ((1, 0.5), (3, 0.5), (20, 0.5), (20, 0.8))  # (max_lag, decay)
NEGATIVES, NEGATIVE_SEED = 20, 42


def _parts(spark, sf_dir):
    # the vocabulary and the encoded sessions are read by several branches (counts, prior, recent items): written once
    s = click_sessions(spark, sf_dir)
    vocab = shared_table(voc.build_vocab(s, size=CLICK_VOCAB_SIZE), "vocab")  # fitted on all sessions (reference default)
    split = seqops.time_split(s, test_days=CLICK_TEST_DAYS, val_days=CLICK_VAL_DAYS)
    enc = shared_table(voc.encode(split, vocab), "encoded")
    return s, vocab, enc


def _train_model(enc):
    train = enc.filter(F.col("split") == "train")
    t = mdl.fit_transitions(train)
    return mdl.normalize(t), shared_table(mdl.fit_prior(train), "prior")


def _test_preds(spark, sf_dir):
    _, vocab, enc = _parts(spark, sf_dir)
    model, prior = _train_model(enc)
    targets = seqops.eval_prefixes(enc.filter(F.col("split") == "test"), max_len=mdl.DEFAULT_MAX_LAG)
    preds = mdl.score_sessions(targets, model, prior, k=K)
    return preds, targets, vocab


@query("transitions")
def transitions_q(spark, sf_dir):
    _, _, enc = _parts(spark, sf_dir)
    return mdl.fit_transitions(enc)


@query("transitions_merge")
def transitions_merge_q(spark, sf_dir):
    _, _, enc = _parts(spark, sf_dir)
    old = mdl.fit_transitions(enc.filter(F.col("split") != "test"))
    delta = mdl.fit_transitions(enc.filter(F.col("split") == "test"))
    return mdl.merge_transitions(old, delta, alpha=1.0)


@query("item_prior")
def item_prior_q(spark, sf_dir):
    _, _, enc = _parts(spark, sf_dir)
    return mdl.fit_prior(enc.filter(F.col("split") == "train"))


@query("recommend_eval")
def recommend_eval_q(spark, sf_dir):
    preds, _, _ = _test_preds(spark, sf_dir)
    return preds


@query("eval_metrics")
def eval_metrics_q(spark, sf_dir):
    preds, targets, _ = _test_preds(spark, sf_dir)
    return ev.recall_ndcg(preds, targets, k=K)


@query("eval_popularity")
def eval_popularity_q(spark, sf_dir):
    _, targets, _ = _test_preds(spark, sf_dir)
    return ev.popularity_recall(targets, k=K)


@query("eval_coverage")
def eval_coverage_q(spark, sf_dir):
    preds, _, vocab = _test_preds(spark, sf_dir)
    return ev.coverage(preds, vocab, k=K)


def _all_model(spark, sf_dir):
    s, vocab, enc = _parts(spark, sf_dir)
    t = mdl.fit_transitions(enc)
    return s, vocab, mdl.normalize(t), shared_table(mdl.fit_prior(enc), "prior")


@query("recommend")
def recommend_q(spark, sf_dir):
    s, vocab, model, prior = _all_model(spark, sf_dir)
    # sessions are capped to their last items; what was seen before the cut is excluded too
    return mdl.recommend(s, model, prior, vocab, k=K, history=stored_clicks(spark, sf_dir))


@query("recommend_enriched")
def recommend_enriched_q(spark, sf_dir):
    s, vocab, model, prior = _all_model(spark, sf_dir)
    recs = mdl.recommend(s, model, prior, vocab, k=K, history=stored_clicks(spark, sf_dir))
    return mdl.recommend_enriched(recs, stored_catalog(spark, sf_dir))


@query("trial_metrics")
def trial_metrics_q(spark, sf_dir):
    """All settings of a grid, judged on the validation sessions from one fit."""
    _, _, enc = _parts(spark, sf_dir)
    train = enc.filter(F.col("split") == "train")
    cube = shared_table(mdl.fit_cube(train), "cube")
    targets = seqops.eval_prefixes(enc.filter(F.col("split") == "val"), max_len=mdl.DEFAULT_MAX_LAG)
    return ev.judge_trials(cube, shared_table(mdl.fit_prior(train), "prior"), targets, TRIALS, k=K)


@query("negative_samples")
def negative_samples_q(spark, sf_dir):
    _, _, enc = _parts(spark, sf_dir)
    return mdl.sample_negatives(seqops.training_pairs(enc), CLICK_VOCAB_SIZE, n=NEGATIVES, seed=NEGATIVE_SEED)

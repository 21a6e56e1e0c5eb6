"""End-to-end training run: events -> sessions -> vocab -> split -> fit -> select -> test.

Each stage is a lazy DataFrame plan; sessions and the fitted counts are cut
with a reliable checkpoint (the plan boundaries of the original batch job).
Model selection walks a small grid of (max_lag, decay) settings with early
stopping on validation Recall@k; pairs are counted once, apart by lag, and all
settings are judged from these counts in one plan.  ``refresh`` is the warm start: fit only the new window with the old
vocabulary frozen and merge the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.constants import DEFAULT_TOP_K, EARLY_STOPPING_PATIENCE, TEST_DAYS, VAL_DAYS, VOCAB_SIZE
from shopstream.operators import evaluate as ev
from shopstream.operators import model as mdl
from shopstream.operators import sequences as seqops
from shopstream.operators import sessions as sess
from shopstream.operators import vocab as voc
from shopstream.session import cut_lineage

DEFAULT_GRID = ({"max_lag": 1, "decay": 0.5}, {"max_lag": 2, "decay": 0.5}, {"max_lag": 3, "decay": 0.5},
                {"max_lag": 5, "decay": 0.5}, {"max_lag": 10, "decay": 0.5}, {"max_lag": mdl.DEFAULT_MAX_LAG, "decay": 0.5},
                {"max_lag": mdl.DEFAULT_MAX_LAG, "decay": 0.8})


@dataclass
class TrainResult:
    params: dict
    val_recall: float
    test: dict
    popularity_recall: float
    history: list = field(default_factory=list)
    transitions: DataFrame | None = None
    prior: DataFrame | None = None
    vocab: DataFrame | None = None


def _metrics(enc: DataFrame, split: str, model: DataFrame, prior: DataFrame, params: dict, k: int) -> DataFrame:
    targets = seqops.eval_prefixes(enc.filter(F.col("split") == split), max_len=mdl.DEFAULT_MAX_LAG)
    preds = mdl.score_sessions(targets, model, prior, k=k, max_lag=params["max_lag"], decay=params["decay"])
    return ev.recall_ndcg(preds, targets, k=k)


def train(events: DataFrame, *, order=("event_time", "event_id"), vocab_size: int = VOCAB_SIZE,
          test_days: float = TEST_DAYS, val_days: float = VAL_DAYS, grid=DEFAULT_GRID,
          patience: int = EARLY_STOPPING_PATIENCE, k: int = DEFAULT_TOP_K, fit_on: str = "all",
          top_m: int | None = mdl.DEFAULT_TOP_M) -> TrainResult:
    """Fit on train, select on val, report on test (model and popularity on the same test set).

    ``fit_on='all'`` fits the vocabulary on every session (the original
    default, which lets val/test counts into it); ``'train'`` avoids that.
    """
    sessions = cut_lineage(sess.build_sessions(events, order=order))
    split = seqops.time_split(sessions, test_days=test_days, val_days=val_days)
    vocab_src = split if fit_on == "all" else split.filter(F.col("split") == "train")
    vocab = cut_lineage(voc.build_vocab(vocab_src, size=vocab_size))
    enc = cut_lineage(voc.encode(split, vocab))
    train_enc = enc.filter(F.col("split") == "train")
    prior = cut_lineage(mdl.fit_prior(train_enc))
    cube = cut_lineage(mdl.fit_cube(train_enc, max_lag=max(p["max_lag"] for p in grid)))
    if top_m is None:
        targets = seqops.eval_prefixes(enc.filter(F.col("split") == "val"), max_len=mdl.DEFAULT_MAX_LAG)
        judged = ev.judge_trials(cube, prior, targets, [(p["max_lag"], p["decay"]) for p in grid], k=k)
        recall = {r["trial"]: r["recall"] for r in judged.select("trial", "recall").collect()}  # a row a trial
    else:  # truncated models are ranked one by one
        recall = {}

    def fitted(params: dict) -> DataFrame:
        return mdl.from_cube(cube, max_lag=params["max_lag"], decay=params["decay"])

    def val_score(params: dict) -> float:
        if top_m is None:
            return recall.get(list(grid).index(params), 0.0)  # no validation sessions: no hits
        return _metrics(enc, "val", mdl.normalize(fitted(params), top_m=top_m), prior, params, k).first()["recall"]

    best, best_score, history = ev.select_model(grid, val_score, patience=patience)
    t = cut_lineage(fitted(best))
    test = _metrics(enc, "test", mdl.normalize(t, top_m=top_m), prior, best, k).first().asDict()
    pop = ev.popularity_recall(seqops.eval_prefixes(enc.filter(F.col("split") == "test")), k=k).first()["recall"]
    return TrainResult(best, best_score, test, pop, history, t, prior, vocab)


def refresh(old: TrainResult, new_events: DataFrame, *, order=("event_time", "event_id"), cap: int | None = None,
            alpha: float = 1.0) -> TrainResult:
    """Warm start: count the new window with the old vocabulary (new items stay OTHER) and merge.

    With ``alpha=1`` and a fixed ``cap`` this equals a refit on old + new
    sessions (sessions must not span the two windows).
    """
    s = sess.build_sessions(new_events, order=order, cap=cap, percentile=None if cap else 95)
    enc = voc.encode(s, old.vocab)
    p = old.params
    t = mdl.merge_transitions(old.transitions, mdl.fit_transitions(enc, max_lag=p["max_lag"], decay=p["decay"]),
                              alpha=alpha)
    pr = mdl.merge_prior(old.prior, mdl.fit_prior(enc), alpha=alpha)
    return TrainResult(p, old.val_recall, old.test, old.popularity_recall, old.history, cut_lineage(t), pr, old.vocab)

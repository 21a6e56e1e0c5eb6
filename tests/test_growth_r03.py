"""What must not grow with the input: shuffles of an append, joined units, batches and scans of a task."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopstream.llm import bpe, jaccard, toxicity
from shopstream.operators import cart_fold
from shopstream.session import configure
from shopstream.streaming import ingest

from .test_ingest import load_csv, line, put


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_and_scans_of_a_task_are_bounded(spark):
    for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.files.maxPartitionBytes"):
        spark.conf.unset(k)
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.redact_personal_data(spark, docs, "")  # a stage that is called alone
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304"
    configure(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_near_copies_meet_before_their_units_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    pairs, held = [], jaccard.shared_table

    def seen(df, name="table"):
        out = held(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "shared_table", seen)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}
    assert pairs[0] < 20, pairs


def test_chunks_may_span_batches_and_share_one(spark):
    import pyarrow as pa
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [("least", 1, 0, 1, " ".join(base)), ("least", 1, 0, 2, near), ("least", 1, 1, 3, near), ("second", 1, 1, 4, " ".join(base)), ("second", 1, 1, 5, near)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("by", "bucket", "chunk", "class", "text"), r)) for r in rows])
    for cuts in ([0, 5], [0, 1, 5], [0, 1, 2, 3, 4, 5]):
        out = list(jaccard._within_chunks(4, 85, 100)(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])))
        assert sorted((r["a"], r["b"]) for t in out for r in t.to_pylist()) == [(1, 2), (4, 5)]


def test_workers_that_stay_hold_small_caches():
    import inspect
    assert bpe.CACHE_PIECES <= 60_000
    assert inspect.signature(toxicity._Reader).parameters["limit"].default <= 75_000


def test_content_ids_take_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 0.0, "a", "f"), (1, -0.0, "a", "f"), (1, 0.0, "a", "g"), (2, None, None, "g")], "p long, v double, n string, _file string")
    assert plan(ingest.with_content_ids(rows.drop("v"))).count("Exchange") == 1
    made = ingest.with_content_ids(rows)
    assert made.count() == 3 and made.select("event_id").distinct().count() == 3


def test_csv_rows_known_wholly_partly_or_not(spark, tmp_dir, monkeypatch):
    names, held = [], ingest.append_batch

    def seen(batch, *a, **k):
        out = held(batch, *a, **k)
        names.append(out.count())
        return out

    monkeypatch.setattr(ingest, "append_batch", seen)
    put(f"{tmp_dir}/in", "a.csv", [line(1), line(1), line(2, brand="")])
    load_csv(spark, tmp_dir)
    put(f"{tmp_dir}/in", "b.csv", [line(3)])                      # none known
    load_csv(spark, tmp_dir)
    put(f"{tmp_dir}/in", "c.csv", [line(2, brand=""), line(1)])   # all known
    load_csv(spark, tmp_dir)
    put(f"{tmp_dir}/in", "d.csv", [line(1)] * 3 + [line(4)])      # some known
    load_csv(spark, tmp_dir)
    assert names == [3, 1, 0, 2]
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 6


@pytest.mark.parametrize("op, q", [("add", 3), ("set", 2), ("set", 0), ("del", None)])
def test_one_command_follows_a_transformer(spark, op, q):
    kinds = [(a, b) for a in (False, True) for b in (0, 1, 2, 3)]
    f = spark.createDataFrame([(a, 4 if a else None, b, 7 if b else None) for a, b in kinds], "ap boolean, aq int, pk int, pq int")
    at = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    t = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    f = f.select(F.struct("ap", "aq", F.when(F.col("ap"), t).alias("aat"), "pk", "pq", F.when(F.col("pk") == 3, t).alias("pat")).cast(cart_fold._T).alias("f"))
    args = F.lit(op), F.lit(q).cast("int"), at
    both = f.select(cart_fold.compose(F.col("f"), cart_fold.command_transformer(*args)).cast(cart_fold._T).alias("x"), cart_fold.then_command(F.col("f"), *args).alias("y"))
    assert all(r.x == r.y for r in both.collect())


def test_single_command_lines_are_not_folded_one_by_one(spark):
    cmds = spark.createDataFrame([(1, "c", "add", 1, 2, None), (2, "c", "del", 2, None, None)], "seq long, cart_id string, op string, product_id long, quantity int, at timestamp_ntz")
    final, rejects = cart_fold.fold_commands(cmds, None)
    assert [tuple(r) for r in final.collect()] == [("c", 1, 2, None)]
    assert [tuple(r) for r in rejects.collect()] == [(2, "c", 2, "del")]
    text = cart_fold._leaves(cmds, 256)._jdf.queryExecution().analyzed().toString()
    assert "size(_cmds" in text  # a leaf of one command is not replayed by a lambda


def test_fitting_toxicity_holds_words_and_gates_once():
    import tracemalloc
    import numpy as np
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = ["".join(letters[rng.integers(0, 26, 8)]) for _ in range(40_000)]
    sample = toxicity.Sample()
    for i in range(200):
        sample.add(i, " ".join(names[j] for j in rng.integers(0, len(names), 1500)), i % 2)
    words = len(sample.number)
    tracemalloc.start()
    try:
        assert toxicity.fit_sample(sample, epochs=3) is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    gates = 4 * 2 * words * 3 * toxicity.HIDDEN  # bytes
    assert peak < 6.6 * gates, peak / gates  # 7.3 with all windows and the gates twice

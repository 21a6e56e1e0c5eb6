"""What the driver has to hold while near duplicates and toxicity run: jobs, plans, counts."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import jaccard, toxicity


@pytest.fixture()
def jobs_of(spark):
    """Runs a function; its result and the number of jobs it took."""
    def run(fn):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "counted")
        try:
            out = fn()
            return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            spark.sparkContext.setLocalProperty("spark.job.description", None)
    return run


@pytest.fixture()
def iterated(spark, monkeypatch):
    """DataFrames read by toLocalIterator."""
    seen, kind = [], type(spark.range(0))
    whole = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **b: (seen.append(self), whole(self, *a, **b))[1])
    return seen


def test_links_that_are_stars_take_no_round(spark, jobs_of):
    links = spark.createDataFrame([(100 * c, 100 * c + i) for c in range(1, 20) for i in range(1, 9)], "a long, b long")
    comps, jobs = jobs_of(lambda: jaccard.components(links))
    assert {(r["id"], r["label"]) for r in comps.collect()} == {(100 * c + i, 100 * c) for c in range(1, 20) for i in range(9)}
    assert jobs <= 6, jobs  # 20 before: a round, and one more that found nothing to change


def test_stars_of_loops_rings_and_nothing(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    links = spark.createDataFrame([*ring, (50, 40), (40, 50), (50, 60), (60, 30), (30, 70), (8, 8)], "a long, b long")
    assert {tuple(r) for r in jaccard.stars(links).collect()} == {(i, 0) for i in range(1, 9)} | {(i, 30) for i in (40, 50, 60, 70)}
    assert jaccard.components(links.where("a = b")).count() == jaccard.components(links.limit(0)).count() == 0


def test_counts_reach_the_driver_in_few_bytes(spark, iterated):
    docs = spark.range(70_500).select(F.when(F.col("id") < 70_000, "a b c d").when(F.col("id") < 70_400, "e f g h").otherwise("i j k l m").alias("text"))
    sketch, mean = jaccard.count_sketch(docs, 4)
    shingles, counts = jaccard.Shingler(4), np.zeros(1 << jaccard.SKETCH_BITS, np.int32)
    for text, n in (("a b c d", 70_000), ("e f g h", 400), ("i j k l m", 100)):
        np.add.at(counts, jaccard._slot(shingles(text)), n)
    assert mean == counts.mean() and (sketch == jaccard.quantised(counts, mean)).all()
    sent = [len(r["counts"]) for r in iterated[0].collect()]
    assert len(sent) == jaccard.SLICES and sum(sent) < 1.2 * len(counts), sum(sent)  # 4 bytes a slot before


def test_sampled_ids_are_in_no_plan(spark, jobs_of, iterated):
    docs = spark.range(700_000, 700_600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.when(F.col("id") % 4 == 0, "foul").otherwise("fine"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    (model, share), jobs = jobs_of(lambda: toxicity.fit(docs, labels))
    assert model is not None and 0 < share < 1
    picked = docs.where(~toxicity.held_out(F.col("doc_id"))).limit(40).collect()
    plan = iterated[0]._jdf.queryExecution().toString()
    assert not any(str(r["doc_id"]) in plan for r in picked)
    assert jobs <= 30, jobs  # one for each slice, and more to pick ids

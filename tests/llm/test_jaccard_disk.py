"""What near duplicates leave on the disk: shuffles that are read no more, texts that cannot link."""

import os
import random
import time

import numpy as np
import pytest

from shopstream.llm import jaccard
from shopstream.session import DROP_SHUFFLES, shared_table


@pytest.fixture()
def shuffled(spark):
    """Shuffle files of the session."""
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_shuffles_of_a_shared_table_go_once_it_is_written(spark, shuffled):
    before, setting = shuffled(), spark.conf.get(DROP_SHUFFLES, None)
    table = shared_table(spark.range(10_000).selectExpr("id % 97 as k").groupBy("k").count().repartition(3, "k"))
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left, left
    assert table.count() == 97 and spark.conf.get(DROP_SHUFFLES, None) == setting


def test_texts_travel_only_where_members_may_link(spark, monkeypatch):
    between = jaccard._between_units

    def checked_between(*a):
        run = between(*a)

        def checked(batches):
            def looked_at():
                for b in batches:
                    assert not b.num_rows, "texts of units that cannot link"
                    yield b
            return run(looked_at())
        return checked

    monkeypatch.setattr(jaccard, "_between_units", checked_between)
    # copies of one text, each with eight words of its own; the last text has all of these words
    base, own = [f"w{i}" for i in range(300)], [[f"own{c}_{i}" for i in range(8)] for c in range(37)]
    rows = [(c, " ".join([*base[:8 * c], *own[c], *base[8 * c + 8:]])) for c in range(37)] + [(100, " ".join(sum(own, [])))]
    held, pairs = jaccard.shared_table, []
    monkeypatch.setattr(jaccard, "shared_table", lambda df, name="table": (out := held(df, name), pairs.append(out.where("u != v").count()) if name == "pairs" else None)[0])
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs[0] >= 1  # they share enough shingles, though none of the copies does alone
    assert {(r.doc_id, r.component_id) for r in got} == {(c, 0) for c in range(37)} | {(100, 100)}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 3), (1, 1)])
def test_members_that_link_are_never_left_out(num, den):
    rng, shingles = random.Random(7), jaccard.Shingler(4)
    cut = 0
    for n in (1, 3, 7, 40, 63, 130, 700):
        base = [f"w{rng.randrange(2000)}" for _ in range(n)]
        sets = []
        for i in range(16):
            words = [f"z{rng.randrange(900)}" for _ in range(rng.choice([n, 2 * n]))] if i % 4 == 3 else list(base)
            for _ in range(rng.randint(0, n // rng.choice([3, 10, 40]))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            sets.append(shingles(" ".join(words)))
        members = [{"class": i, "comp": i, "n": len(h), "bits": jaccard.parity_bits(h)} for i, h in enumerate(sets)]
        may = jaccard._possible(members, members, num, den)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                links = i != j and den * both >= num * (len(a) + len(b) - both)
                assert may[i, j] or not links
                cut += not may[i, j]
    assert cut > 300, cut
    assert not jaccard._possible([m | {"comp": 1} for m in members], [m | {"comp": 1} for m in members], num, den).any()  # connected already


def test_counts_of_tasks_are_shuffled_in_few_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i}_{j}" for j in range(400)),) for i in range(40)], "text string").coalesce(1)
    tasks, group = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *c: (tasks.append(self), group(self, *c))[1])
    jaccard.count_sketch(docs, 4)
    sent = sum(len(r["counts"]) for r in tasks[0].collect())
    assert sent < 1 << jaccard.SKETCH_BITS, sent  # 4 bytes a slot before

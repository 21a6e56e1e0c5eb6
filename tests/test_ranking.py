"""Bounded ranking: equal to ranking the whole fan-out, and how much of the model it reads."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopstream.operators import model as mdl
from shopstream.operators import ranking as rk
from shopstream.plans.oracle_sql import ORACLES

MODEL = "src int, dst int, p double"
PREFIX = "user_session string, prefix array<int>"


def test_sql_reads_as_many_items_as_the_library():
    for name in ("recommend", "recommend_eval", "eval_metrics", "transitions"):
        assert f"<= {mdl.DEFAULT_MAX_LAG})" in ORACLES[name] or f"BETWEEN 1 AND {mdl.DEFAULT_MAX_LAG}\n" in ORACLES[name]
    assert mdl.DEFAULT_MAX_LAG == 20


def test_the_twentieth_item_counts(spark):
    seq = list(range(3, 24))  # 21 items: the first is 21 places before what comes next
    prefixes = spark.createDataFrame([("s", seq)], PREFIX)
    model = spark.createDataFrame([(i, 100 + i, 1.0) for i in seq], MODEL)
    prior = spark.createDataFrame([(100 + i, 1) for i in seq], "dst int, prior_n long")
    want = {100 + i: round(0.5 ** (23 - i), 9) for i in seq[1:]}
    assert {r["dst"]: round(r["score"], 9) for r in mdl.candidate_scores(prefixes, model).collect()} == want
    got = {r["token_id"]: r["score"] for r in mdl.score_sessions(prefixes, model, prior, k=20).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) <= 1e-9 for d in want)  # halves round differently in Python


def test_block_numbers(spark):
    sizes = defaultdict(int)
    for r in spark.range(30_000).select(rk.block_number(F.col("id")).alias("b")).groupBy("b").count().collect():
        sizes[r["b"]] = r["count"]
    want = [64, 64, 128, 256, 512, 1024, 2048, 4096] + [4096] * 5
    assert [sizes[b] for b in range(13)] == want


def test_repeated_sources_add_their_weights(spark):
    df = spark.createDataFrame([("a", [9, 5, 7, 5]), ("b", [])], PREFIX)
    got = {(r["user_session"], r["src"]): r["weight"] for r in rk.recent_sources(df, "prefix", key="user_session", max_lag=3, decay=0.5).collect()}
    assert got == {("a", 5): 1.25, ("a", 7): 0.5}


def brute(sessions, model, prior, seen, *, k, mask, max_lag=20, decay=0.5):
    by_src = defaultdict(list)
    for s, d, p in model:
        by_src[s].append((d, p))
    pop = sorted(((-n, d) for d, n in prior.items() if not mask or d >= 3))
    out = []
    for key, tokens in sessions:
        score = defaultdict(float)
        for lag, s in enumerate(reversed(tokens[-max_lag:]), 1):
            for d, p in by_src[s]:
                score[d] += decay ** (lag - 1) * p
        own = seen.get(key, set())
        for _, d in pop[:k + len(own)]:
            score.setdefault(d, 0.0)
        cand = sorted((-round(v, 9), -prior.get(d, 0), d) for d, v in score.items() if d not in own and (not mask or d >= 3))[:k]
        out += [(key, i + 1, d, -s) for i, (s, _, d) in enumerate(cand)]
    return out


def same(got, want):
    got = sorted((r[0], r[1], r[2], r[3]) for r in got)
    want = sorted(want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    close = [g for g, w in zip(got, want) if g[2] != w[2] and abs(g[3] - w[3]) > 2e-9]
    assert not close
    assert sum(g[2] != w[2] for g, w in zip(got, want)) <= len(want) // 500  # sums in another order may tie otherwise
    assert all(abs(g[3] - w[3]) <= 2e-9 for g, w in zip(got, want))


def case(seed, n_items, n_sources, longest):
    rng = random.Random(seed)
    model = []
    for s in list(range(2, 2 + n_sources)):
        dsts = rng.sample(range(2, 2 + n_items), min(longest, rng.choice([1, 20, 64, 65, longest, longest])))
        w = [1.0 / (i + 1) ** rng.choice([0.0, 0.7, 1.5]) for i in range(len(dsts))]
        if rng.random() < 0.3:
            w = [round(x, 2) + 0.01 for x in w]  # many ties
        total = sum(w)
        model += [(s, d, x / total) for d, x in zip(dsts, w)]
    prior = {d: rng.randint(0, 50) for d in range(2, 2 + n_items) if rng.random() < 0.9}
    sessions = [(f"s{i}", [2 if rng.random() < 0.4 else rng.randint(2, 4 + n_sources) for _ in range(rng.choice([0, 1, 3, 20, 30]))]) for i in range(60)]
    seen = {key: set(rng.sample(range(3, 2 + n_items), rng.choice([0, 1, 5, n_items // 2]))) for key, _ in sessions if rng.random() < 0.7}
    return sessions, model, prior, seen


@pytest.mark.parametrize("seed, n_items, longest", [(1, 3000, 2500), (2, 300, 290), (3, 50, 40), (4, 12000, 11000)])
@pytest.mark.parametrize("mask", [False, True])
def test_equals_the_whole_fan_out(spark, seed, n_items, longest, mask):
    sessions, model, prior, seen = case(seed, n_items, 12, longest)
    if not mask:
        seen = {}
    postings = rk.build_postings(spark.createDataFrame(model, MODEL), spark.createDataFrame(list(prior.items()), "dst int, prior_n long"))
    assert (postings.tails is None) == (longest <= 64)
    df = spark.createDataFrame(sessions, PREFIX)
    seen_df = spark.createDataFrame([(key, d) for key, own in seen.items() for d in own], "user_session string, dst int") if seen else None
    got = rk.rank_sessions(df, postings, k=10, key="user_session", tokens="prefix", max_lag=20, decay=0.5, mask=mask, seen=seen_df)
    same(got.collect(), brute(sessions, model, prior, seen, k=10, mask=mask))


def test_reads_a_bounded_part_of_long_lists(spark):
    """20 sources with 40,000 destinations each: a session reads a small part of its 800,000 candidate rows."""
    n, n_src = 40_000, 20
    ids = spark.range(n).selectExpr("id + 3 AS dst")
    src = spark.range(n_src).selectExpr("CAST(id + 3 AS INT) AS src")
    rank = F.pmod(F.xxhash64("src", "dst"), F.lit(n)).alias("r")  # popularity of a destination after a source, by hash
    counts = src.crossJoin(ids).select("src", F.col("dst").cast("int").alias("dst"), (F.lit(1000.0) / (rank + 1)).alias("weight"))
    model = mdl.normalize(counts)
    prior = ids.select(F.col("dst").cast("int").alias("dst"), (F.lit(n + 3) - F.col("dst")).alias("prior_n"))
    rng = random.Random(7)
    sessions = [(f"s{i}", [rng.randint(3, n_src + 2) for _ in range(20)]) for i in range(30)] + [("one", [5]), ("none", [99_999])]
    df = spark.createDataFrame(sessions, PREFIX)
    postings = rk.build_postings(model, prior)
    recent = rk.recent_sources(df.withColumn("_need", F.lit(13)), "prefix", key="user_session", max_lag=20, decay=0.5, keep=("_need",))
    salts = rk.source_salts(recent)
    lists = rk._meet(recent, postings.heads, ["src"], salts, "user_session")
    bounds = rk.session_bounds(lists, key="user_session")
    rows = {r["user_session"]: r["n"] for r in rk.tail_entries(bounds, postings, salts, key="user_session").groupBy("user_session").agg(F.count("*").alias("n")).collect()}
    heads = {r["user_session"]: r["n"] for r in recent.groupBy("user_session").agg((F.count("*") * rk.HEAD).alias("n")).collect()}
    read = {key: rows.get(key, 0) + heads.get(key, 0) for key, _ in sessions}
    full = {key: len(set(tokens)) * n for key, tokens in sessions if tokens[0] < 99}
    assert max(read.values()) < 4000 and all(read[k] * 100 < full[k] for k in full), read
    got = rk.rank_sessions(df, postings, k=10, key="user_session", tokens="prefix", max_lag=20, decay=0.5, mask=True,
                           seen=spark.createDataFrame([("one", 5)], "user_session string, dst int"))
    plain = [(r["src"], r["dst"], r["p"]) for r in model.collect()]
    same(got.collect(), brute(sessions, plain, {d: n + 3 - d for d in range(3, n + 3)}, {"one": {5}}, k=10, mask=True))


def test_frequent_sources_get_salts(spark):
    recent = spark.createDataFrame([("k", 2)] * 700 + [("k", 3 + i % 300) for i in range(300)], "user_session string, src int")
    salts = rk.source_salts(recent)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert salts == {2: -(-700 * n // 1000)}
    left = spark.range(500).selectExpr("CAST(id AS STRING) AS user_session", "CAST(2 + id % 3 AS INT) AS src")
    right = spark.createDataFrame([(2, "a"), (3, "b")], "src int, v string")
    assert sorted(map(tuple, rk._meet(left, right, ["src"], salts, "user_session").select("user_session", "src", "v").collect())) == sorted(
        map(tuple, left.join(right, "src").select("user_session", "src", "v").collect()))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], MODEL)
    no_prior = spark.createDataFrame([], "dst int, prior_n long")
    postings = rk.build_postings(empty, no_prior)
    df = spark.createDataFrame([("a", [3]), ("b", [])], PREFIX)
    args = dict(k=5, key="user_session", tokens="prefix", max_lag=20, decay=0.5)
    assert rk.rank_sessions(df, postings, **args).count() == 0
    some = rk.build_postings(empty, spark.createDataFrame([(4, 9), (7, 9), (2, 1)], "dst int, prior_n long"))
    got = sorted(map(tuple, rk.rank_sessions(df, some, mask=True, **args).collect()))
    assert got == [(s, i, t, 0.0) for s in "ab" for i, t in ((1, 4), (2, 7))]
    assert rk.rank_sessions(df.limit(0), some, **args).count() == 0

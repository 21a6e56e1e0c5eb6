"""Threshold algorithm and rounds of centroids against plain loops; awkward rows."""
import hashlib
import random

import numpy as np
import pytest

from shopstream.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(x, cents):
    d = ((x[:, None, :].astype(object) - cents[None].astype(object)) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    k, width, size = int(rng.integers(1, 30)), int(rng.integers(1, 9)), int(rng.choice([2, 30, 2 ** 24]))
    cents = rng.integers(-size, size + 1, (k, width))
    if k > 3:
        cents[k - 1] = cents[0]  # a tie for every vector
    x = np.concatenate([rng.integers(-size, size + 1, (300, width)), cents, cents + 1])
    number, distance, taken = centroids.nearest(x, cents)
    want, least = brute(x, cents)
    assert (number == want).all() and (distance == least).all()
    assert (taken >= 1).all() and (taken <= k).all()


def test_walk_stops_before_all_centroids():
    cents = np.arange(1000)[:, None] * np.array([[100, 100]])
    _, _, taken = centroids.nearest(cents + 3, cents)
    assert taken.max() <= 4


def test_equal_frontier_goes_on():
    # the first centroid met is at distance 4; number 0 is as far and stands behind a frontier of exactly 4
    number, distance, _ = centroids.nearest(np.array([[0]]), np.array([[2], [-2]]))
    assert (number[0], distance[0]) == (0, 4)
    number, _, _ = centroids.nearest(np.array([[0]]), np.array([[-2], [2]]))
    assert number[0] == 0


def test_too_large_entries_are_an_error():
    with pytest.raises(ValueError):
        centroids.nearest(np.full((1, 64), 1 << 40), np.zeros((2, 64), dtype=np.int64))


def clustered(rows, k, rounds, width):
    """The contract in plain loops: (vec_id, cluster, distance) rows and the final centroids."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    cents = np.array([q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]], dtype=np.int64)
    x = np.array([q for _, q in kept])
    for _ in range(rounds):
        own, _ = brute(x, cents)
        cents = np.array([[int(s) // int((own == c).sum()) for s in x[own == c].sum(axis=0)] if (own == c).any() else cents[c] for c in range(len(cents))])
    own, distance = brute(x, cents)
    return [(i, int(c), int(d)) for (i, _), c, d in zip(kept, own, distance)], cents


def test_rounds_equal_plain_loops(spark):
    rng = random.Random(5)
    hot = [0.25, -0.5, 0.125]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    rows += [(5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (None, [0.0, 0.0, 0.0]), (900, None), (901, [1.0, None, 0.0]), (902, [float("nan")] * 3),
             (903, [float("inf"), 0.0, 0.0]), (904, [1.0]), (905, []), (906, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(5)
    for k in (7, 500):
        out, cents = centroids.cluster(df, k=k, rounds=3, width=3)
        want, centres = clustered(rows, k, 3, 3)
        got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
        assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
        assert (cents == centres).all()
    out, cents = centroids.cluster(df.limit(0), width=3)
    assert out.count() == 0 and len(cents) == 0


def test_query_on_an_empty_and_a_tiny_table(spark, tmp_dir):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    empty.write.parquet(f"{tmp_dir}/a/embeddings.parquet")
    assert centroids.op12_centroids(spark, f"{tmp_dir}/a").count() == 0
    spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.25] * 63)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_dir}/b/embeddings.parquet")
    rows = centroids.op12_centroids(spark, f"{tmp_dir}/b").collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in rows) == [(1, 0, 0), (2, 0, 0)]
    assert len({r["cluster"] for r in rows}) == 1 and rows[0]["centroid_sha256"] == hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest()

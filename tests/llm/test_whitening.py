"""Whitening: the polynomial, its roots and the components against independent computations; awkward rows."""
import random
from fractions import Fraction

import numpy as np
import pytest

from shopstream.llm import registered, whitening

SCHEMA = "vec_id long, embedding array<double>, n string, deviation string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def exact_polynomial(m):
    """Faddeev-LeVerrier with fractions."""
    d = len(m)
    m = [[Fraction(int(v)) for v in row] for row in m]
    out, work = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        work = [[sum(m[i][t] * work[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        prod = [[sum(m[i][t] * work[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(prod[i][i] for i in range(d)) / k)
    return [int(c) for c in out]


def polynomial(matrix):
    primes = whitening.enough_primes(matrix)
    return whitening.remaindered({p: whitening.residue_polynomial(matrix, p) for p in primes}), primes


def scatter(rng, rows, d, size):
    x = np.array([[rng.randint(-size, size) for _ in range(d)] for _ in range(rows)], dtype=object)
    return x.T @ x


def test_primes_are_prime():
    gen = whitening.primes_below_2_31()
    first = [next(gen) for _ in range(5)]
    assert first[0] == 2147483647
    assert all(all(p % q for q in range(2, 46341)) for p in first)


@pytest.mark.parametrize("seed", range(6))
def test_polynomial_is_exact(seed):
    rng = random.Random(seed)
    d = rng.randint(1, 7)
    m = scatter(rng, rng.randint(1, 9), d, rng.choice([1, 3, 10 ** 9]))
    assert polynomial(m)[0] == exact_polynomial(m)
    blocky = np.zeros((6, 6), dtype=object)  # zeros under the diagonal: no pivot in some columns
    blocky[:3, :3], blocky[3:, 3:] = scatter(rng, 4, 3, 5), np.diag([4, 4, 0]).astype(object)
    assert polynomial(blocky)[0] == exact_polynomial(blocky)


def test_block_products_are_exact():
    rng = np.random.default_rng(4)
    z = np.concatenate([rng.integers(-2 ** 61, 2 ** 61, (40, 3)), rng.integers(-3, 3, (9, 3)), np.array([[2 ** 61, -2 ** 61, 2 ** 19]])])
    got = sum((v * (1 << (20 * p)) for p, v in whitening.block_products(z).items()))
    assert (got == z.astype(object).T @ z.astype(object)).all()


def test_repeated_and_close_roots():
    # 9 three times, 4 twice, and two roots that differ by one part in 10^12
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], dtype=object)  # q q' = 4
    m = np.zeros((8, 8), dtype=object)
    m[:4, :4] = q @ np.diag([9, 9, 9, 4]).astype(object) @ q.T
    m[4, 4], m[5, 5], m[6, 6], m[7, 7] = 16, 10 ** 12, 10 ** 12 + 1, 0
    poly, primes = polynomial(m)
    assert poly == exact_polynomial(m)
    while not poly[-1]:
        poly.pop()
    simple = whitening.square_free(poly, primes)
    assert len(simple) - 1 == 4  # 10^12 + 1, 10^12, 36, 16
    found = [whitening.component(m, poly, simple, k) for k in range(1, 8)]
    assert [round(float(v)) for v, _ in found] == [10 ** 12 + 1, 10 ** 12, 36, 36, 36, 16, 16]
    vectors = np.array([v for _, v in found])
    assert np.abs(vectors @ vectors.T - np.eye(7)).max() < 1e-15
    for value, v in found:
        assert max(abs(a - float(value) * b) for a, b in zip(m.astype(float) @ v, v)) <= 1e-13 * max(1.0, float(value))
    assert vectors[0][6] == 1 and vectors[1][5] == 1  # not mixed, though close


def check(out, rows, components=32):
    """Rows of op11 against numpy's eigenvectors and exact sums."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    values, vectors = np.linalg.eigh(np.cov((np.array(x) - 1_000_000).T, bias=True).reshape(d, d))
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(components, int((values > 1e-9 * values[0]).sum()))
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["component"], r["deviation"], r["whitened"]) for r in out)
    assert len(got) == n * rank
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    want = []
    for (i, _), v, dev in zip(kept, x, deviation):
        w = (np.array([n * c - s for c, s in zip(v, sums)], dtype=float) / n) @ vectors[:, :rank] / np.sqrt(values[:rank])
        want += [(i if i is not None else -1, k + 1, dev, w[k]) for k in range(rank)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    by_component = {}
    for r in out:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        by_component.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], abs(r["whitened"])))
    for k in by_component:
        own = sorted((i, dev, abs(w)) for i, c, dev, w in want if c == k)
        for a, b in zip(sorted((i if i is not None else -1, dev, w) for i, dev, w in by_component[k]), own):
            assert abs(a[2] - b[2]) < 1e-7


def write(df, tmp_dir):
    df.write.parquet(f"{tmp_dir}/embeddings.parquet")
    return registered.QUERIES["op11_whitening"](df.sparkSession, tmp_dir).collect()


def test_whole_table_equals_numpy(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(registered.QUERIES["op11_whitening"](spark, d).collect(), rows)


def test_awkward_rows(spark, tmp_dir):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(3, 2), rng.gauss(0, 5), 0.5]) for i in range(60)]  # no variance in the last dimension
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 0.5]), (None, [1.0, 2.0, 3.0, 0.5]), (70, None), (71, [1.0, None, 1.0, 1.0]), (72, [float("nan")] * 4),
             (73, [float("-inf"), 0.0, 0.0, 0.0]), (74, [300.0, -300.0, 90.0, 0.5])]
    check(write(frame(spark, rows), tmp_dir), rows)


def test_short_vectors_are_padded(spark, tmp_dir):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.randint(0, 5))]) for i in range(80)]
    check(write(frame(spark, rows), tmp_dir), rows)


def test_without_variance_there_are_no_components(spark, tmp_dir):
    for k, rows in enumerate(([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, []), (2, [])])):
        assert write(frame(spark, rows), f"{tmp_dir}/{k}") == []


def test_equal_eigenvalues_whiten(spark, tmp_dir):
    rows = [(i, [s if j == i // 2 else 0.0 for j in range(4)]) for i, s in enumerate([1.0, -1.0] * 4)]
    out = write(frame(spark, rows), tmp_dir)
    assert len(out) == 32
    assert {round(r["explained"], 12) for r in out} == {0.25}
    assert max(r["identity_error"] for r in out) < 1e-12


def test_deviation_beyond_a_long_is_exact(spark):
    rows = whitening.integers(frame(spark, [(1, [1e9, 0.0]), (2, [-1e9, 3.0]), (3, [0.0, -3.0])]))
    model = whitening.fit(rows)
    x = {1: (64 * 10 ** 9, 0), 2: (-64 * 10 ** 9, 192), 3: (0, -192)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.transform(rows, model).collect()} == {i: 9 * (a * a + b * b) for i, (a, b) in x.items()}
    assert model.identity_error < 1e-9

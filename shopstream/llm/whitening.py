"""Embedding whitening through the exact characteristic polynomial of the integer scatter.

Vectors become integers, so the scatter matrix is an integer matrix too, and its
eigenvalues are the roots of an integer polynomial that is found without rounding:

1. Sums, then the scatter of the centred integers, by exact partial sums in the tasks
   (entries are cut into 20-bit digits whose block products a double holds exactly).
   With n rows, z = x - floor(mean): n * sum(z z') - sum(z) sum(z)' is n^2 times the
   covariance, exactly.
2. Characteristic polynomial: modulo many 31-bit primes (a Spark row each) the matrix is
   reduced to Hessenberg form, whose polynomial has a short recurrence; Chinese
   remaindering joins the residues.  Enough primes are taken for Maclaurin's bound on
   the coefficients, binomial(d, k) * (trace / d)^k.
3. Roots (a Spark row for each component): all roots of a scatter's polynomial are real,
   so the sign changes of p(x + a) are exactly the number of roots above a (Descartes).
   Bisection on that count isolates the component's root; the sign of the square-free
   part then refines it far below its distance from the other roots.
4. Components: null-space inverse iteration in decimal arithmetic of as many digits as
   that distance asks for.  A root of multiplicity m gives m orthonormal vectors.

What reaches the driver are the d x d scatter, the polynomial and the components, whose
size depends on the width d only.

Defined results: vectors that are null or hold null, NaN or infinite entries take no
part; a shorter vector counts as padded with zeros to the longest; repeated rows and
repeated or null ids are rows of their own; directions without any variance (exactly
zero eigenvalues) are no components, so a table of equal rows, or an empty one, gives no
rows; extra columns are ignored.  Domain: |scale * entry| below 2^62.  ``deviation`` is
exact at any size (decimal); the query's long holds it up to 2^63.
"""

from __future__ import annotations

import dataclasses
import decimal
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.llm.topk import usable
from shopstream.session import shared_table

OFFSET = 1_000_000
ROWS = 8192          # rows of one block product: 2^13 * (2^19)^2 stays below 2^53
DIGIT = 20
INTEGER = pa.decimal128(38, 0)
SUM_SCHEMA = "place int, i int, j int, value decimal(38,0)"


# ---- exact sums over the rows

def blocks(batches, width: int):
    """(column, int64 matrix of at most ROWS rows padded to ``width``) of Arrow batches with the column ``x``."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lists = part.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.full((part.num_rows, width), OFFSET, dtype=np.int64)
            x[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield part, x


def block_products(z: np.ndarray) -> dict[int, np.ndarray]:
    """z' z by place: the sum over places p of 2^(20 p) times the entry is exact."""
    digits, rest = [], z
    while True:
        low = ((rest + (1 << (DIGIT - 1))) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        digits.append(low.astype(np.float64))
        rest = (rest - low) >> DIGIT
        if not rest.any():
            break
    out: dict[int, np.ndarray] = {}
    for a, left in enumerate(digits):
        for b, right in enumerate(digits):
            product = (left.T @ right).astype(np.int64).astype(object)
            out[a + b] = out[a + b] + product if a + b in out else product
    return out


def _sum_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    place, i, j, value = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                       pa.array([Decimal(v) for v in value], INTEGER)], ["place", "i", "j", "value"])


def _column_sums(width: int):
    def run(batches):
        total = np.zeros(width, dtype=object)
        for _, x in blocks(batches, width):
            high = x >> 32  # two halves, so that no block sum overflows
            total = total + (high.sum(axis=0).astype(object) << 32) + (x - (high << 32)).sum(axis=0).astype(object)
        if width and any(total):
            yield _sum_batch([(0, i, 0, int(v)) for i, v in enumerate(total)])
    return run


def _scatter(centre: list[int]):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for _, x in blocks(batches, len(centre)):
            for place, product in block_products(x - np.array(centre, dtype=np.int64)).items():
                total[place] = total[place] + product if place in total else product
        for place, matrix in total.items():
            yield _sum_batch([(place, i, j, int(matrix[i, j])) for i in range(len(centre)) for j in range(i, len(centre))])
    return run


def _summed(rows: DataFrame, partial) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    sums = rows.mapInArrow(partial, SUM_SCHEMA).groupBy("place", "i", "j").agg(F.sum("value").alias("value"))
    for r in sums.collect():  # a few values for each of the d x d entries
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["value"]) << (DIGIT * r["place"]))
    return out


# ---- characteristic polynomial

def primes_below_2_31():
    """Odd primes from 2^31 downward (Miller-Rabin; bases 2, 3, 5, 7 decide below 3.2 * 10^9)."""
    for p in range((1 << 31) - 1, 3, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(_passes(p, base, odd, twos) for base in (2, 3, 5, 7)):
            yield p


def _passes(p: int, base: int, odd: int, twos: int) -> bool:
    y = pow(base, odd, p)
    if y in (0, 1, p - 1):
        return True
    for _ in range(twos - 1):
        y = y * y % p
        if y == p - 1:
            return True
    return False


def residue_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """det(x - matrix) modulo p, leading coefficient first: Hessenberg reduction and its recurrence."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        h[[m, i]] = h[[i, m]]
        h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)  # poly[k]: leading k x k block, constant first
    poly[0, 0] = 1
    for k in range(1, d + 1):
        weight, chain = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * chain % p
            if i:
                chain = chain * int(h[i, i - 1]) % p
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return [int(c) for c in poly[d][::-1]]


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least absolute value with these residues."""
    product = math.prod(residues)
    parts = [(product // p * pow(product // p % p, -1, p), own) for p, own in residues.items()]
    out = []
    for k in range(len(next(iter(residues.values())))):
        c = sum(weight * own[k] for weight, own in parts) % product
        out.append(c - product if 2 * c > product else c)
    return out


def enough_primes(matrix: np.ndarray) -> list[int]:
    """Primes whose product exceeds twice every coefficient, by Maclaurin's inequality for roots >= 0."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    bound = 4 * max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    out, product = [], 1
    for p in primes_below_2_31():
        if product > bound:
            return out
        out.append(p)
        product *= p
    raise ValueError("too wide for 31-bit primes")


def characteristic_polynomial(spark, matrix: np.ndarray) -> tuple[list[int], list[int]]:
    """det(x - matrix) and the primes used, for a symmetric matrix without negative eigenvalues."""
    primes = enough_primes(matrix)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"p": pdf["p"], "residues": [residue_polynomial(matrix, int(p)) for p in pdf["p"]]})
    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
            .mapInPandas(run, "p long, residues array<long>").collect())
    return remaindered({r["p"]: list(r["residues"]) for r in rows}), primes


def _gcd_with_slope(poly: list[int], p: int) -> list[int]:
    """Monic gcd of a polynomial and its derivative modulo p."""
    d = len(poly) - 1
    a, b = [c % p for c in poly], [c * (d - i) % p for i, c in enumerate(poly[:-1])]
    while b and not b[0]:
        b = b[1:]
    while b:
        inverse = pow(b[0], -1, p)
        while len(a) >= len(b):
            f = a[0] * inverse % p
            a = [(x - f * y) % p for x, y in zip(a, b)] + a[len(b):]
            a = a[1:]
        while a and not a[0]:
            a = a[1:]
        a, b = b, a
    inverse = pow(a[0], -1, p)
    return [c * inverse % p for c in a]


def _divided(poly: list[int], by: list[int]) -> tuple[list[int], list[int]]:
    out, rest = [], list(poly)
    while len(rest) >= len(by):
        out.append(rest[0])
        rest = [x - out[-1] * y for x, y in zip(rest, by)] + rest[len(by):]
        rest = rest[1:]
    return out, rest


def square_free(poly: list[int], primes: list[int]) -> list[int]:
    """The polynomial with each root once.  A factor's coefficients keep to the bound of the whole's, so the primes suffice."""
    found = {}
    for p in primes:
        own = _gcd_with_slope(poly, p)
        if len(own) == 1:
            return poly  # coprime modulo a prime, so coprime
        found[p] = own
    least = min(map(len, found.values()))
    common = remaindered({p: g for p, g in found.items() if len(g) == least})
    out, rest = _divided(poly, common)
    if any(rest):
        raise ArithmeticError("the gcd of the polynomial and its derivative was not found")
    return out


# ---- roots and components

def roots_above(poly: list[int], a: int, shift: int) -> int:
    """Roots above a / 2^shift of a polynomial with real roots only: sign changes of p(x + a)."""
    c = [v << (shift * k) for k, v in enumerate(poly)]
    d = len(c) - 1
    for last in range(d, 0, -1):
        carry = c[0]
        for i in range(1, last + 1):
            carry = c[i] = c[i] + carry * a
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int, shift: int) -> int:
    value = 0
    for k, c in enumerate(poly):
        value = value * a + (c << (shift * k))
    return (value > 0) - (value < 0)


@dataclasses.dataclass
class Root:
    """A root in (low, high] / 2^shift; ranks ``first`` to ``first + multiplicity - 1`` by falling value."""
    low: int
    high: int
    shift: int
    first: int
    multiplicity: int


def isolate(poly: list[int], simple: list[int], rank: int, bits: int = 90) -> Root:
    """The root of this rank (1: greatest), refined to 2^-bits of its size and of its distance from other roots."""
    low, high, shift = 0, -poly[1], 0
    above_low, above_high = len(poly) - 1, 0
    once_low, once_high = len(simple) - 1, 0
    while once_low - once_high > 1:
        if high - low < 2:
            low, high, shift = low << 8, high << 8, shift + 8
        mid = (low + high) // 2
        above = roots_above(poly, mid, shift)
        once = above if simple is poly else roots_above(simple, mid, shift)
        if above >= rank:
            low, above_low, once_low = mid, above, once
        else:
            high, above_high, once_high = mid, above, once
    low0, high0, shift0 = low, high, shift
    top = -1 if once_high % 2 else 1  # sign just above the root
    if _sign(simple, high, shift) == 0:
        low = high  # the end of the interval is the root itself: keep it as a point
    while low < high:
        ends = low0 << (shift - shift0), high0 << (shift - shift0)
        room = min(low - ends[0], ends[1] - high, low)
        if room > (high - low) << bits:
            break
        if high - low < 2:
            low, high, shift = low << 32, high << 32, shift + 32
        mid = (low + high) // 2
        s = _sign(simple, mid, shift)
        if s == 0:
            low = high = mid
        elif s == top:
            high = mid
        else:
            low = mid
    if low == high:  # an exact root: narrow an interval around it until it holds no other, then by 2^-bits more
        around = 1
        while roots_above(simple, low - around, shift) - roots_above(simple, low + around, shift) > 1:
            low, shift = low << 8, shift + 8
        low, high, shift = (low << bits) - around, (low << bits) + around, shift + bits
    return Root(low, high, shift, above_high + 1, above_low - above_high)


def null_space(matrix: np.ndarray, root: Root) -> tuple[Decimal, list[np.ndarray]]:
    """The root and orthonormal vectors of its space, by inverse iteration in decimal arithmetic."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    digits = int(((trace << root.shift) // max(1, root.high - root.low)).bit_length() * 0.302) + 40
    with decimal.localcontext(decimal.Context(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        value = Decimal(root.low + root.high) / Decimal(1 << (root.shift + 1))
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object)
        for i in range(d):
            a[i, i] = a[i, i] - value
        tiny = Decimal(max(1, trace)).scaleb(15 - digits)
        order = list(range(d))
        for k in range(d):
            i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
            if i != k:
                a[[k, i]] = a[[i, k]]
                order[k], order[i] = order[i], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - a[k + 1:, k][:, None] * a[k, k + 1:][None, :]

        def solve(b: np.ndarray) -> np.ndarray:
            y = b[order]
            for k in range(1, d):
                y[k] = y[k] - a[k, :k] @ y[:k]
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - (a[k, k + 1:] @ y[k + 1:] if k + 1 < d else 0)) / a[k, k]
            return y

        rng = np.random.default_rng(d)
        basis: list[np.ndarray] = [np.array([Decimal(int(v)) for v in rng.integers(1, 1 << 20, d)], dtype=object) for _ in range(root.multiplicity)]
        for _ in range(3):
            out: list[np.ndarray] = []
            for b in basis:
                y = solve(b)
                y = y / max(abs(v) for v in y)
                for _twice in range(2):
                    for o in out:
                        y = y - o * (o @ y)
                out.append(y / (y @ y).sqrt())
            basis = out
        return value, basis


def component(matrix: np.ndarray, poly: list[int], simple: list[int], rank: int) -> tuple[Decimal, list[float]]:
    """Eigenvalue and unit eigenvector of a rank; its entry of greatest size is positive."""
    root = isolate(poly, simple, rank)
    value, basis = null_space(matrix, root)
    vector = basis[rank - root.first]
    out = [float(v) for v in vector]
    flip = max(range(len(out)), key=lambda i: abs(out[i]))
    return value, [-v for v in out] if out[flip] < 0 else out


# ---- model and queries

@dataclasses.dataclass
class Whitening:
    n: int
    centre: list[int]         # floor of the mean of x, by dimension
    rest: list[int]           # sum of x - centre, by dimension
    values: list[float]       # n^2 times the eigenvalue, falling
    explained: list[float]
    vectors: list[list[float]]
    identity_error: float = 0.0


def integers(vectors: DataFrame, *, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the usable vectors, x the integers, written to the shared folder."""
    v = F.col(vector_col)
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(OFFSET))
    return shared_table(vectors.where(usable(v)).select(F.col(id_col).alias("vec_id"), x.alias("x")), "integers")


def _whiten_block(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, exact; whitened) of a block."""
    z = x - np.array(model.centre, dtype=np.int64)
    largest = int(np.abs(z).max(initial=0)) * model.n + max(map(abs, model.rest), default=0)
    exact = z * model.n - np.array(model.rest) if largest < 1 << 62 else z.astype(object) * model.n - np.array(model.rest, dtype=object)
    scaled = np.array(model.vectors).reshape(len(model.vectors), len(model.centre)).T / np.sqrt(model.values)
    return exact, exact.astype(np.float64) @ scaled


def fit(rows: DataFrame, *, components: int = 32) -> Whitening | None:
    """Whitening of the rows of ``integers`` by their first components; None without rows or variance."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not width:
        return None
    sums = _summed(rows, _column_sums(width))
    centre = [sums.get((i, 0), 0) // n for i in range(width)]
    rest = [sums.get((i, 0), 0) - centre[i] * n for i in range(width)]
    product = _summed(rows, _scatter(centre))
    matrix = np.zeros((width, width), dtype=object)
    for (i, j), v in product.items():
        matrix[i, j] = matrix[j, i] = n * v - rest[i] * rest[j]
    if not any(matrix[i, i] for i in range(width)):
        return None
    poly, primes = characteristic_polynomial(spark, matrix)
    while not poly[-1]:
        poly = poly[:-1]  # zero eigenvalues
    simple = square_free(poly, primes)
    found = min(components, len(poly) - 1)

    def run(frames):
        for pdf in frames:
            own = [component(matrix, poly, simple, int(k)) for k in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "value": [str(v) for v, _ in own], "vector": [v for _, v in own]})
    roots = sorted(spark.range(1, found + 1, 1, found).mapInPandas(run, "id long, value string, vector array<double>").collect())
    trace = Decimal(-poly[1])
    model = Whitening(int(n), centre, rest, [float(r["value"]) for r in roots], [float(Decimal(r["value"]) / trace) for r in roots], [list(r["vector"]) for r in roots])
    model.identity_error = measured_error(rows, model)
    return model


def measured_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    width, r = len(model.centre), len(model.vectors)

    def run(batches):
        product, total = np.zeros((r, r)), np.zeros(r)
        for _, x in blocks(batches, width):
            _, w = _whiten_block(x, model)
            product += w.T @ w
            total += w.sum(axis=0)
        i, j = np.indices((r, r + 1))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(np.column_stack([product, total]).ravel())], ["i", "j", "value"])
    sums = np.zeros((r, r + 1))
    for row in rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[row["i"], row["j"]] = row["value"]
    mean = sums[:, r] / model.n  # about zero: the whitened rows are centred already
    return float(np.abs(sums[:, :r] / model.n - np.outer(mean, mean) - np.eye(r)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal, whitened array) of each row of ``integers``."""
    width = len(model.centre)

    def run(batches):
        for part, x in blocks(batches, width):
            exact, w = _whiten_block(x, model)
            largest = int(np.abs(exact).max(initial=0))
            squares = exact * exact if largest * largest * max(1, width) < 1 << 62 else exact.astype(object) ** 2
            deviation = pa.array([Decimal(int(v)) for v in squares.sum(axis=1)], INTEGER)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, values], ["vec_id", "deviation", "whitened"])
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(rows)
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*map(F.lit, model.explained))
    return (transform(rows, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))).select(*names)

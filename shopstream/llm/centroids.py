"""Centroid clustering with nearest centroids found by the threshold algorithm.

For every dimension the centroids are kept in a list sorted by value.  A vector starts
between the two neighbours of its own value in each list and walks outward: each step
takes, in every dimension, the nearer one of the next centroids below and above.  A
centroid met for the first time gets its exact distance.  The frontier of a dimension is
the gap to its next centroid not yet taken; a centroid met in no dimension is at least
as far as the sum of squared frontiers, so the walk stops when that sum strictly exceeds
the best exact distance (at equality a smaller number could still tie).

A task walks a block of vectors at a time in numpy; the centroids (k x width integers)
travel with the task.  A round sends k x width partial sums from each task into one
aggregate; k x width totals reach the driver, which takes exact floors.

Defined results: vectors that are null, of another width, or hold null, NaN or infinite
entries take no part; repeated rows and repeated ids are rows of their own; start
vectors with equal hashes (equal ids) are taken in the order of their entries, rows
without an id last; fewer vectors than k give fewer centroids; equal distances go to the
smaller number; an empty centroid keeps its place; an empty table gives no rows; extra
columns are ignored.  Domain: the sum of squares must fit a long, which is checked and
is an error otherwise (|scale * entry| up to about 2^27 at width 64).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.llm.topk import quantise, usable
from shopstream.session import shared_table

ROWS = 2048
MAX = np.iinfo(np.int64).max


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact distances taken) of each row of ``x``."""
    n, width = x.shape
    k = len(centroids)
    far = math.isqrt(int(MAX) // max(1, width)) - 1  # a gap beyond all others, whose squares still add up in a long
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > far // 2:
        raise ValueError("vector entries are too large for exact squared distances")
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(width)
    best, number, taken = np.full(n, MAX), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.arange(n)  # rows still walking
    above = np.empty((n, width), dtype=np.int64)
    for j in range(width):
        above[:, j] = np.searchsorted(lists[:, j], x[:, j])
    below = above - 1
    seen = np.zeros((n, k), dtype=bool)

    def gaps(y):
        down = np.where(below >= 0, y - lists[np.maximum(below, 0), dims], far)
        up = np.where(above < k, lists[np.minimum(above, k - 1), dims] - y, far)
        return down, up

    y = x
    down, up = gaps(y)
    while len(left):
        lower = down <= up
        met = np.zeros_like(seen)
        met[np.arange(len(left))[:, None], order[np.where(lower, np.maximum(below, 0), np.minimum(above, k - 1)), dims]] = True
        met &= ~seen
        seen |= met
        row, cent = np.nonzero(met)
        exact = np.full((len(left), k), MAX)
        exact[row, cent] = ((y[row] - centroids[cent]) ** 2).sum(axis=1)
        taken[left] += met.sum(axis=1)
        own = exact.argmin(axis=1)
        distance = exact[np.arange(len(left)), own]
        better = (distance < best[left]) | ((distance == best[left]) & (distance < MAX) & (own < number[left]))
        best[left[better]], number[left[better]] = distance[better], own[better]
        below, above = below - lower, above + ~lower
        down, up = gaps(y)
        frontier = (np.minimum(down, up) ** 2).sum(axis=1)
        on = (frontier <= best[left]) & ~seen.all(axis=1)
        left, y, below, above, seen, down, up = left[on], y[on], below[on], above[on], seen[on], down[on], up[on]
    return number, best, taken


def _blocks(batches, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _partial_sums(centroids: np.ndarray):
    k, width = centroids.shape

    def run(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for _, x in _blocks(batches, width):
            number, _, _ = nearest(x, centroids)
            n += np.bincount(number, minlength=k)
            np.add.at(total, number, x)
        kept = np.flatnonzero(n)
        if len(kept):
            cluster, dim = np.repeat(kept, width), np.tile(np.arange(width), len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(n[cluster]), pa.array(total[cluster, dim])],
                                             ["cluster", "dim", "n", "total"])
    return run


def _assignments(centroids: np.ndarray):
    def run(batches):
        for part, x in _blocks(batches, centroids.shape[1]):
            number, distance, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def start_vectors(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:id``, in the order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([list(r["q"]) for r in first], dtype=np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: vectors to their nearest centroid, then the floor of the mean of each."""
    sums = (rows.mapInArrow(_partial_sums(centroids), "cluster int, dim int, n long, total long")
            .groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = centroids.copy()
    for r in sums.collect():  # k x width values
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector, and the final centroids."""
    v = F.col(vector_col)
    rows = shared_table(vectors.where(usable(v) & (F.size(v) == width)).select(F.col(id_col).alias("vec_id"), quantise(v, scale).alias("q")), "quantised")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    centroids = start_vectors(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    return shared_table(rows.mapInArrow(_assignments(centroids), schema), "clusters"), centroids


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: int(r["total"]) for r in
            assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a centroid
    digest = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(table), "cluster")  # as many rows as centroids
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _op12_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    nearest_sql = """a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c)
  GROUP BY r, vec_id, q)"""
    mean_sql = """c{j} AS MATERIALIZED (
  SELECT c, list(coalesce(t, old) ORDER BY i) AS q FROM (
    SELECT o.c, o.i, o.old, CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) AS t
    FROM (SELECT c, unnest(range(1, {w})) AS i, unnest(q) AS old FROM c{i}) o
    LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {w})) AS i, unnest(q) AS x FROM a{i}) GROUP BY c, i) s USING (c, i))
  GROUP BY c)"""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS INT) AS c, q FROM v QUALIFY c < {k})"""]
    for i in range(rounds):
        parts += [nearest_sql.format(i=i), mean_sql.format(i=i, j=i + 1, w=width + 1)]
    parts.append(nearest_sql.format(i=rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m USING (c)
"""


OP12_SQL = _op12_sql()

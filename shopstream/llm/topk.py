"""Exact top-k inner-product search with a bit-sliced index.

Vectors are quantised to integers.  Rows are dealt into blocks of about
``block_rows``; inside a block every attribute is kept as bit slices: one bitmap
over the block's rows for each bit of (value - block minimum).  A query adds the
slices with bitmap arithmetic: for each set bit of a weight, the attribute's slices
enter the column of their place value (complemented for a negative weight), and
carry-save adders reduce the columns to the slices of the score.  The top rows are
then picked from the most significant slice downward: rows that are surely in, and
rows still tied; what is tied at the end has equal scores exactly, and that boundary
is resolved by the smaller id.

Each (index block, chunk of queries) pair is one group of a cogroup, bounded by
``block_rows`` and ``query_rows``; it emits at most k rows per query, and a ranked
window keeps the best k over all blocks.  The stated query set meets every block, so
the work is (rows x queries) by definition, dealt evenly over the cluster.

Defined results: vectors that are null or hold null, NaN or infinite components take
no part; a shorter vector counts as padded with zeros; exactly repeated rows (id and
vector) count once, repeated ids with other vectors are rows of their own; a query
never returns rows with its own id; equal scores rank by smaller id; fewer than k
candidates give fewer rows; an empty table gives none.  Domain: quantised components
and scores fit 62 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEX_SCHEMA = "block int, n int, bits int, ids binary, low binary, slices binary"
HIT_SCHEMA = "query_key long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantise(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def build_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bit slices [attribute][bit][word] of one block, rows ordered by id."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = _matrix(pdf["q"].tolist())
    n, dims = x.shape
    low = x.min(axis=0) if dims else np.zeros(0, dtype=np.int64)
    u = (x - low).astype(np.uint64)
    bits = max(1, int(u.max()).bit_length()) if u.size else 1
    words = -(-n // 64)
    slices = np.zeros((dims, bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        slices[:, b, :packed.shape[1]] = packed
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [n], "bits": [bits],
                         "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()], "slices": [slices.tobytes()]})


def _score_slices(slices: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the score, least significant first: sum of |weight| times the (complemented) attributes."""
    dims, bits, words = slices.shape
    flip = np.where(weight < 0, ~np.uint64(0), np.uint64(0))
    signed = slices ^ flip[:, None, None]
    size = np.abs(weight).astype(np.uint64)
    places: list[list[np.ndarray]] = [[] for _ in range(bits + 65)]
    for a in range(int(size.max()).bit_length() if dims else 0):
        own = signed[((size >> np.uint64(a)) & np.uint64(1)).astype(bool)]
        if len(own):
            for b in range(bits):
                places[a + b].append(own[:, b])
    out = []
    for p in range(len(places)):
        if not places[p]:
            if not any(places[p:]):
                break
            out.append(np.zeros(words, dtype=np.uint64))
            continue
        rows = np.concatenate(places[p])
        while len(rows) > 2:
            m = len(rows) // 3
            x, y, z = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            half = x ^ y
            places[p + 1].append((x & y) | (half & z))
            rows = np.concatenate([half ^ z, rows[3 * m:]])
        if len(rows) == 2:
            places[p + 1].append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
    return out


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of one block; ties go to the smaller position."""
    tied, surely = allowed, np.zeros_like(allowed)
    if int(np.bitwise_count(allowed).sum()) <= k:
        return _positions(allowed)
    for s in reversed(score):
        upper = surely | (tied & s)
        n = int(np.bitwise_count(upper).sum())
        if n > k:
            tied = tied & s
        else:
            surely, tied = upper, tied & ~s
            if n == k:
                return _positions(surely)
    fixed = _positions(surely)
    return np.concatenate([fixed, _positions(tied)[:k - len(fixed)]])


def _search(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        for row in index.itertuples():
            ids, low = np.frombuffer(row.ids, np.int64), np.frombuffer(row.low, np.int64)
            words = -(-row.n // 64)
            slices = np.frombuffer(row.slices, np.uint64).reshape(len(low), row.bits, words)
            everyone = np.zeros(words * 8, dtype=np.uint8)
            packed = np.packbits(np.ones(row.n, dtype=np.uint8), bitorder="little")
            everyone[:len(packed)] = packed
            everyone = everyone.view(np.uint64)
            top = (1 << row.bits) - 1
            for key, qid, q in zip(queries["query_key"], queries["vec_id"], queries["q"]):
                w = np.zeros(len(low), dtype=np.int64)
                w[:min(len(q), len(low))] = q[:len(low)]
                base = int(np.where(w < 0, w * (low + top), w * low).sum())
                allowed = everyone.copy()
                lo, hi = np.searchsorted(ids, [qid, qid + 1])
                for i in range(lo, hi):
                    allowed[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
                score = _score_slices(slices, w)
                for i in top_rows(score, allowed, k):
                    s = base + sum(1 << p for p, bm in enumerate(score) if (int(bm[i >> 6]) >> (int(i) & 63)) & 1)
                    out.append((key, qid, int(ids[i]), s))
        return pd.DataFrame(out, columns=["query_key", "query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = 8192, query_rows: int = 192) -> DataFrame:
    """For each row where ``is_query``: its k best other rows (query_id, rank, vec_id, score)."""
    from shopstream.session import shared_table
    v = F.col(vector_col)
    rows = shared_table(
        vectors.where(usable(v) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), quantise(v, scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .groupBy("vec_id", "q").agg(F.max("is_query").alias("is_query"))
        .withColumn("query_key", F.xxhash64("vec_id", "q")), "vectors")
    n, n_query = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    n_block, n_chunk = max(1, -(-n // block_rows)), max(1, -(-n_query // query_rows))
    index = (rows.withColumn("block", F.pmod("query_key", F.lit(n_block)).cast("int")).select("block", "vec_id", "q")
             .groupBy("block").applyInPandas(build_block, INDEX_SCHEMA)
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunk - 1)))))
    queries = (rows.where("is_query").select("query_key", "vec_id", "q")
               .withColumn("chunk", F.pmod(F.xxhash64("query_key"), F.lit(n_chunk)).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_block - 1)))))
    hits = (index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk"))
            .applyInPandas(_search(k), HIT_SCHEMA))
    best = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

"""Removal of word passages that repeat across documents, by level-wise doubling.

A window of ``WINDOW`` consecutive words is removed from a document when the same words
also start in a document with a smaller id.  Two levels of windows, the second twice as
long as the first:

1. Windows of half the length.  In each long window the half-length window with the
   least hash speaks for it; equal long windows have equal speakers, wherever they
   stand, so only speakers need to be compared (about one for each thirteen words).
   A run is a stretch of long windows with one speaker.  Runs whose speaker occurs in
   one document alone end here.
2. Surviving runs are extended to the long windows: first as a whole.  A run whose full
   stretch of words occurs in a smaller document is covered entirely.  Of each distinct
   stretch, the run in the smallest document is left; where a speaker has several
   distinct stretches, the long windows of these are compared one by one, and those
   that a smaller document has too are covered.  When nothing survives, nothing is
   joined.

Keys are pairs of 64-bit hashes (speaker and stretch, or speaker and window), rolled
with numpy over a document's words.  A hot passage is reduced to its smallest document
by partial aggregation before any shuffle; joins are plain equi-joins, whose skewed
partitions adaptive execution splits.

Defined results: null or empty text has no words; documents with a null id take no part
(nothing of them is removed, and they cover nothing); rows that repeat an id do not cover
each other and each is returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.session import shared_table

WINDOW = 50
find_words = re.compile(r"[^\x20\x09-\x0d]+").findall

_U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so powers have inverses modulo 2^64


class _WordHashes(dict):
    """Hashes of words, filled on demand, forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


class _Roller:
    """Hashes of word windows: prefix sums of hash * base^i, brought back to exponent 0."""

    def __init__(self) -> None:
        self.known = _WordHashes()
        self.powers = [(np.ones(1, _U), np.ones(1, _U))] * 2

    def prefixes(self, words: list[str]) -> list[np.ndarray]:
        n = len(words)
        h = np.fromiter(map(self.known.__getitem__, words), _U, n)
        out = []
        for k, base in enumerate(BASES):
            if len(self.powers[k][0]) <= n:
                size = max(n + 1, 2 * len(self.powers[k][0]))
                up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
                up[0] = down[0] = 1
                self.powers[k] = (np.cumprod(up), np.cumprod(down))
            out.append(np.concatenate([np.zeros(1, _U), np.cumsum((h ^ _U(k * 0x5851F42D4C957F2D)) * self.powers[k][0][:n])]))
        return out

    def window(self, prefix: np.ndarray, k: int, starts: np.ndarray, length) -> np.ndarray:
        return _mixed((prefix[starts + length] - prefix[starts]) * self.powers[k][1][starts])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def speakers(roller: _Roller, prefix: list[np.ndarray], n: int, window: int) -> np.ndarray:
    """The speaker of each long window of a text with n >= window words."""
    half = window // 2
    return _sliding_min(roller.window(prefix[0], 0, np.arange(n - half + 1), half), window - half + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(window: int):
    def run(batches):
        roller = _Roller()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                words = find_words(text)
                n = len(words)
                if n < window:
                    continue
                prefix = roller.prefixes(words)
                speak = speakers(roller, prefix, n, window)
                start = np.flatnonzero(np.r_[True, speak[1:] != speak[:-1]])
                length = np.diff(np.r_[start, len(speak)])
                stretch = roller.window(prefix[1], 1, start, length + (window - 1)) ^ _mixed(length.astype(_U))
                for c, v in zip(cols, (np.full(len(start), key, np.int64), np.full(len(start), doc, np.int64),
                                       speak[start].view(np.int64), stretch.view(np.int64), start, length)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int32 if i > 3 else np.int64)) for i, c in enumerate(cols)],
                                                 names=["key", "doc_id", "speaker", "stretch", "start", "length"])
    return run


def _long_windows(window: int):
    def run(batches):
        roller = _Roller()
        for batch in batches:
            for key, doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text", "spans"))):
                words = find_words(text)
                prefix = roller.prefixes(words)
                speak = speakers(roller, prefix, len(words), window)
                at = np.unique(np.concatenate([np.arange(p >> 32, (p >> 32) + (p & 0xFFFFFFFF)) for p in spans]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), key, np.int64)), pa.array(np.full(len(at), doc, np.int64)), _signed(speak[at]),
                     _signed(roller.window(prefix[1], 1, at, window)), pa.array(at.astype(np.int32))],
                    names=["key", "doc_id", "speaker", "hash", "start"])
    return run


def _kept(window: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = find_words(text) if text else []
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for p in spans:
                        edge[p >> 32] += 1
                        edge[(p >> 32) + (p & 0xFFFFFFFF) + window - 1] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                    n_removed.append(int(gone.sum()))
                else:
                    kept.append(" ".join(words))
                    n_removed.append(0)
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def _packed(start, length):
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(length.cast("long"))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    taking_part = rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))
    runs = shared_table(taking_part.mapInArrow(
        _runs(window), "key long, doc_id long, speaker long, stretch long, start int, length int"), "runs")
    repeated = (runs.groupBy("speaker").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                            F.min("stretch").alias("one"), F.max("stretch").alias("other"))
                .where("low < high").select("speaker", (F.col("one") < F.col("other")).alias("several")))
    live = shared_table(runs.join(repeated, "speaker"), "live")
    owners = live.groupBy("speaker", "stretch").agg(F.min("doc_id").alias("owner"))
    judged = shared_table(live.join(owners, ["speaker", "stretch"]), "judged")
    whole = judged.where("owner < doc_id").select("key", _packed(F.col("start"), F.col("length")).alias("span"))
    open_ = (judged.where("owner = doc_id and several").groupBy("key")
             .agg(F.collect_set(_packed(F.col("start"), F.col("length"))).alias("spans")))
    windows = shared_table(taking_part.join(open_, "key").select("key", "doc_id", "text", "spans").mapInArrow(
        _long_windows(window), "key long, doc_id long, speaker long, hash long, start int"), "windows")
    first = windows.groupBy("speaker", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    single = (windows.join(first, ["speaker", "hash"]).where("first < doc_id")
              .select("key", _packed(F.col("start"), F.lit(1)).alias("span")))
    spans = whole.unionByName(single).groupBy("key").agg(F.collect_set("span").alias("spans"))
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        _kept(window), "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, hash(list_slice(w, p, p + 49)) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(p) WHERE len(w) >= 50),
first AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
bad AS (SELECT doc_id, p FROM win JOIN first USING (h) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM bad),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (
  SELECT words.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed,
         string_agg(x, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

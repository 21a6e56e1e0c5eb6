"""Quality rules read at host level.

Each document is measured and judged by rules; failures are counted for each host, the
hosts' failure rates are shrunk towards a common rate, and the verdict on a host is
joined back to its documents.

Rules (``RULES``): the two base rules (fewer than 50 words; more than half of the words in
repeated 3-word windows), more than one symbol for ten words, more than 30 % repeated
lines, a mean word length outside 3 to 10.  A document that fails any counts as a failure.

Shrinking: the failure rates of hosts are taken as draws from a beta distribution whose
mean is the overall rate and whose strength comes from how far the hosts differ beyond
what their document counts explain (the moment estimate of the correlation within hosts,
kept within 10^-6 and 1 - 10^-6).  A host's rate is the posterior mean
(failures + strength * mean) / (documents + strength): hosts with few documents stay near
the overall rate.

Verdicts: ``rejected`` (rate above 0.5): all documents of the host go; ``watched`` (rate
above 0.02): documents that fail any rule go; ``trusted``: only base failures go.

The texts are read once, in place; only the measures are written and shuffled.  Hosts
with more than a thousandth of all documents (so fewer than a thousand hosts) meet their
documents by broadcast, the others in a join on the host.

Defined results: null and empty texts have no words (a base failure); a null or empty
host has no evidence of its own and gets the overall rate; repeated rows and ids are rows
of their own and are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstream.session import shared_table

find_words = re.compile(r"[^\x20\x09-\x0d]+").findall
has_word = re.compile(r"[^\x20\x09-\x0d]").search
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
REJECTED, WATCHED = 0.5, 0.02
HEAVY = 1000  # a host with more than 1 / HEAVY of the documents is heavy

BASE_RULE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
RULES = {
    "few or repeated words": BASE_RULE,
    "symbols": "10 * n_symbols > n_words",
    "repeated lines": "10 * n_dup_lines > 3 * n_lines",
    "word length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[str, int] = {}
    w = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, n)
    size = len(numbers)
    pair = w[:-2] * size + w[1:-1]
    if size >= 1 << 20:  # numbers of pairs in place of the pairs, so that the next product fits too
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * size + w[2:], return_inverse=True, return_counts=True)
    repeated = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= repeated
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    if not text:
        return (0,) * len(MEASURES)
    words = find_words(text)
    lines = [line for line in text.split("\n") if has_word(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def _measure(batches):
    for batch in batches:
        rows = np.array([measures(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(batch.num_rows, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *map(pa.array, rows.T)], ["doc_id", "host", *MEASURES])


def measured(docs: DataFrame, *, host: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, measures, base_failed, failed) of each document; empty hosts become null."""
    own = F.nullif(F.col("source") if host is None else host, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), own.cast("string").alias("host"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    return (rows.mapInArrow(_measure, schema).withColumn("base_failed", F.expr(BASE_RULE))
            .withColumn("failed", F.expr(" OR ".join(f"({r})" for r in RULES.values()))))


def host_rates(rows: DataFrame) -> tuple[DataFrame, float, int]:
    """(host, n, n_failed, rate, verdict) of each host, the overall rate, and the number of documents."""
    hosts = shared_table(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed")), "hosts")
    total, failed = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_failed"), F.lit(0))).first()
    known = hosts.where("host IS NOT NULL")
    k, n, f, spread, squares = known.agg(F.count(F.lit(1)), F.sum("n"), F.sum("n_failed"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")),
                                         F.sum(F.col("n").cast("double") * F.col("n"))).first()
    mean = failed / total if total else 0.0
    strength = prior_strength(k, n or 0, f or 0, spread or 0.0, squares or 0.0)
    rate = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    return known.withColumn("rate", rate).withColumn("verdict", verdict(F.col("rate"))), mean, total


def prior_strength(hosts: int, n: int, failed: int, spread: float, squares: float) -> float:
    """a + b of the beta prior from sums over hosts: n, failures, failures^2 / n, n^2."""
    p = failed / n if n else 0.0
    noise = p * (1 - p)
    room = n - squares / n - (hosts - 1) if n else 0.0
    if not noise or room <= 0:  # no failures, only failures, or no host with documents to compare
        return 1.0
    correlation = (spread - n * p * p - noise * (hosts - 1)) / (noise * room)
    correlation = min(max(correlation, 1e-6), 1 - 1e-6)
    return 1 / correlation - 1


def verdict(rate: Column) -> Column:
    return F.when(rate > REJECTED, "rejected").when(rate > WATCHED, "watched").otherwise("trusted")


def judge(docs: DataFrame, *, host: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, measures, base_failed, failed, verdict, kept) of each document."""
    rows = shared_table(measured(docs, host=host, id_col=id_col, text_col=text_col), "measures")
    hosts, mean, total = host_rates(rows)
    verdicts = hosts.select("host", "n", "verdict")
    heavy = F.broadcast(verdicts.where(F.col("n") * HEAVY > F.lit(total)).drop("n"))  # fewer than HEAVY rows
    light = verdicts.where(F.col("n") * HEAVY <= F.lit(total)).drop("n")
    first = rows.join(heavy, "host", "left")
    out = (first.where("verdict IS NOT NULL OR host IS NULL")
           .unionByName(first.where("verdict IS NULL AND host IS NOT NULL").drop("verdict").join(light, "host")))
    out = out.withColumn("verdict", F.coalesce("verdict", verdict(F.lit(mean))))
    kept = ~F.col("base_failed") & (F.col("verdict") != "rejected") & ~((F.col("verdict") == "watched") & F.col("failed"))
    return out.withColumn("kept", kept).select("doc_id", "host", *MEASURES, "base_failed", "failed", "verdict", "kept")


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "verdict", "kept")


_FAILED_SQL = " OR ".join(f"({r})" for r in RULES.values())
OP13_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, nullif(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS word FROM repeated) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS MATERIALIZED (
  SELECT d.r, doc_id, host, len(words) AS n_words, coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
j AS MATERIALIZED (SELECT *, ({BASE_RULE}) AS base_failed, ({_FAILED_SQL}) AS failed FROM m),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS f FROM j WHERE host IS NOT NULL GROUP BY host),
total AS (SELECT count(*) FILTER (failed) / count(*) AS mean FROM j),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS p, sum(CAST(f AS DOUBLE) * f / n) AS spread, sum(CAST(n AS DOUBLE) * n) AS squares FROM hosts),
prior AS (
  SELECT mean, CASE WHEN coalesce(p * (1 - p), 0) = 0 OR n - squares / n - (k - 1) <= 0 THEN 1.0
    ELSE 1 / least(greatest((spread - n * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * (n - squares / n - (k - 1))), 1e-6), 1 - 1e-6) - 1 END AS strength
  FROM s, total),
rates AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, coalesce((f + strength * mean) / (hosts.n + strength), mean) AS rate
  FROM j CROSS JOIN prior LEFT JOIN hosts USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN rate > {REJECTED} THEN 'rejected' WHEN rate > {WATCHED} THEN 'watched' ELSE 'trusted' END AS verdict,
  NOT base_failed AND rate <= {REJECTED} AND NOT (rate > {WATCHED} AND failed) AS kept
FROM rates
"""

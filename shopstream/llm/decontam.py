"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only).

Texts become lower-case words (runs of letters and digits).  A fixed mask looks at
some of the words of a short stretch and ignores the others, so a substituted word
under a gap does not change the hash.  Hashes of all masks at all positions of the
documents are joined with those of the benchmark items; around each hit the whole
item is laid on the document along the hit's diagonal and the match is verified:

* items of at least ``WINDOW`` words: some ``WINDOW`` consecutive words of the item
  meet at least ``WINDOW - SUBSTITUTIONS`` equal words of the document;
* shorter items: all words equal (their masks are contiguous and as long as the item).

The masks are lossless: for each way to place ``SUBSTITUTIONS`` errors in ``WINDOW``
words some mask at some offset avoids them (tested by enumeration), so nothing that
the rule accepts is missed.

Only (id, position, hash) rows are exploded, in the scan's stage; the benchmark side is
broadcast when its counted seeds are within ``BROADCAST_SEEDS`` and joined by a shuffle
on the hash otherwise (large partitions are split by adaptive execution).  Hits are
reduced to distinct diagonals before the shuffle, and the words join them by document.

Defined results: null or word-less texts match nothing; repeated documents with one id
report once; repeated benchmark items report under each id; empty tables give no rows;
documents with a null id take no part; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstream.llm.chat import let

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ("1101111", "11101001001")
BROADCAST_SEEDS = 300_000


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def _seed(array: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(array, at + i) for i, c in enumerate(mask) if c == "1"])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its words), mask, at, seed: one row for each place where a mask fits."""
    items = benchmark.select("item_id", F.filter(words(F.col("text")), lambda w: w != "").alias("item")).where(F.size("item") > 0)
    n = F.size("item")
    masks = F.when(n < WINDOW, F.array(F.repeat(F.lit("1"), n))).otherwise(F.array(*[F.lit(m) for m in MASKS]))
    placed = items.withColumn("mask", F.explode(masks)).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("item") - F.length("mask"))))
    seed = F.lit(None).cast("long")
    for m in (*MASKS, *("1" * k for k in range(1, WINDOW))):
        seed = F.when(F.col("mask") == m, _seed(F.col("hashes"), F.col("at"), m)).otherwise(seed)
    return placed.withColumn("hashes", _word_hashes(F.col("item"))).withColumn("seed", seed).drop("hashes")


def document_seeds(docs: DataFrame, masks: list[str]) -> DataFrame:
    """doc_id, pos, seed for all masks at all positions; only these three are exploded, not the words."""
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", _word_hashes(words(F.col("text"))).alias("doc"))
    seeds = F.transform(F.sequence(F.lit(0), F.size("doc") - 1), lambda p: F.struct(
        *[_seed(F.col("doc"), p, m).alias(f"s{k}") for k, m in enumerate(masks)]))
    return (hashed.select("doc_id", F.posexplode(seeds).alias("pos", "at_pos"))
            .select("doc_id", "pos", F.explode(F.array(*[F.col("at_pos")[f"s{k}"] for k in range(len(masks))])).alias("seed")))


def _verified(diagonals: DataFrame) -> DataFrame:
    """Keep the diagonals on which the item really overlaps the document; count equal words."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def judged(equal: Column) -> Column:
        n = F.size(equal)
        near = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (WINDOW - 1))), lambda s: total(
            F.slice(equal, s, F.lit(WINDOW))) >= F.when(n < WINDOW, n).otherwise(WINDOW - SUBSTITUTIONS))
        return F.when(near, total(equal))

    return (diagonals.select("doc_id", "item_id", F.size("item").cast("long").alias("item_words"),
                             let(let(words(F.col("text")), lambda doc: F.transform("item", lambda w, i: F.when(
                                 w == F.get(doc, F.col("shift") + i), 1).otherwise(0))), judged).cast("long").alias("matched_words"))
            .where(F.col("matched_words").isNotNull()))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, item_words, matched_words (on the best diagonal) of each contaminated pair."""
    seeds = benchmark_seeds(benchmark)
    found = seeds.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()  # at most len(MASKS) + WINDOW - 1 rows
    masks = sorted(r["mask"] for r in found) or [MASKS[0]]
    keys = seeds.select("item_id", "at", "seed")
    if sum(r["n"] for r in found) <= broadcast_seeds:
        keys = F.broadcast(keys)
    diagonals = (document_seeds(docs, masks).join(keys, "seed")
                 .groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("hits")))
    lines = (docs.select("doc_id", "text")
             .join(diagonals, "doc_id").join(seeds.select("item_id", "item").distinct(), "item_id"))
    return (_verified(lines).groupBy("doc_id", "item_id", "item_words")
            .agg(F.max("matched_words").alias("matched_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones (rows with a null id are judged together)."""
    leaked = overlaps(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_leaked"]), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS doc FROM documents),
dw AS (SELECT doc_id, unnest(doc) AS w, unnest(range(len(doc))) AS pos FROM d),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS item FROM benchmark),
iw AS (SELECT item_id, len(item) AS item_words, unnest(item) AS w, unnest(range(len(item))) AS k FROM i),
m AS (SELECT DISTINCT doc_id, item_id, item_words, pos - k AS shift, k FROM dw JOIN iw USING (w)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near,
         count(*) OVER (PARTITION BY doc_id, item_id, shift) AS matched FROM m)
SELECT doc_id, item_id, item_words, max(matched) AS matched_words FROM c
WHERE near >= CASE WHEN item_words < 13 THEN item_words ELSE 11 END GROUP BY ALL
"""

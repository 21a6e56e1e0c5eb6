"""A cleaning pipeline over ``documents``: each stage reads what its predecessor wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``.

* toxicity: documents scored at or above the threshold go (none where the labels give no model);
* near duplicates: n-gram Jaccard join (five words, similarity 0.8); of each group the
  document with the smallest id stays (null ids last), documents without words all stay,
  rows that repeat id and text with words stay once;
* decontamination: documents that overlap a benchmark item go;
* personal data: spans are replaced by their kind, ``n_chars`` follows the text;
* tokens: byte-level BPE ids, and the digest of the bytes that the ids decode to; columns of
  these names (``n_tokens``, ``ids``, ``decoded_sha256``) that the documents had are replaced.

Other columns of documents pass through, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstream.llm import bpe, decontam, jaccard, pii, toxicity
from shopstream.session import configure, shared_table

ORACLE_SQL = None  # a trained network and a span classifier decide on rows: tested stage by stage instead


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _stage(fn):
    """A stage under the library's session settings, also when it is called alone."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, share = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    own = unused(docs, "own_score")  # a column that is called score as well waits under another name
    renamed = docs.withColumnRenamed("score", own) if unused(docs, "score") != "score" else docs
    kept = toxicity.score(renamed, model, share).where(F.col("score") < toxicity.THRESHOLD).drop("score")
    return kept.toDF(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by id and text, so that ids may be null or shared by different texts
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), shingle=5, num=4, den=5)
    grouped = shared_table(found.where("n_shingles > 0").select(F.col("doc_id").alias(key), "component_id").distinct(), "grouped")
    stays = (grouped.join(keyed.select(key, "doc_id").distinct(), key).groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("best")).select("component_id", F.col("best.key").alias("stays")))
    gone = shared_table(grouped.join(stays, "component_id").where(F.col("stays") != F.col(key)).select(key), "gone")
    repeated = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    repeated = shared_table(repeated.join(grouped.select(key), key), "repeated")
    left = keyed.join(gone, key, "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    once = left.join(repeated, key, "left_semi").dropDuplicates([key]).select(docs.columns)
    return left.join(repeated, key, "left_anti").select(docs.columns).unionByName(once)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # clean_documents judges by id; here each row is judged by its own text
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = decontam.overlaps(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.default_vocabulary()
    tokens = bpe.decode(bpe.encode(docs, *vocabulary), *vocabulary)
    return tokens.select(*[c for c in docs.columns if c.lower() not in ("text", "ids", "decoded", "n_tokens", "decoded_sha256")], F.size("ids").cast("long").alias("n_tokens"), "ids",
                         F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, f"stage-{i}")
    return docs

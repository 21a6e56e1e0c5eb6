"""Stored indexes over the products table: trigrams for search (P6), ranges of the listing for pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstream.constants import DEFAULT_PAGE_SIZE
from shopstream.operators.storefront import api_rows, listing_order, search_predicate, validate_listing

SEARCHED = ("display_name", "brand")
GRAM = 3


# ---- search

def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased text; empty for shorter ones."""
    low = F.lower(text)
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def pattern_trigrams(spark: SparkSession, term: str, *, literal: bool = False) -> list[str]:
    """Trigrams that every match of a search term holds: those of its pieces between wildcards."""
    pieces = [term] if literal else [p for p in re.split("[%_]", term) if p]
    # lower-cased by Spark, as the index and the match are
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in pieces])).alias("p")).select(F.explode(trigrams(F.col("p"))).alias("g")) if pieces else None
    return sorted(r["g"] for r in rows.distinct().collect()) if rows is not None else []


def write_search_index(products: DataFrame, path: str) -> None:
    """Posting table (gram, field, product_id), sorted by gram, so that a lookup reads few row groups."""
    rows = products.select("product_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), trigrams(F.col(f)).alias("grams")) for f in SEARCHED])).alias("x"))
    posting = rows.select(F.explode("x.grams").alias("gram"), F.col("x.field").alias("field"), "product_id")
    posting.repartitionByRange("gram", "product_id").sortWithinPartitions("gram").write.parquet(path)


def search_products(products: DataFrame, index: str, term: str, *, literal: bool = False) -> DataFrame:
    """The products that ``filter_products(search=term)`` finds; only those that hold all trigrams of the term are matched.

    ``%`` and ``_`` are wildcards unless ``literal``.  A term without a piece of three
    characters has no trigrams and is matched with every product.
    """
    validate_listing(1, 1, term)
    grams = pattern_trigrams(products.sparkSession, term, literal=literal)
    found = products if not grams else products.join(candidates(products.sparkSession, index, grams), "product_id", "left_semi")
    return found.filter(search_predicate(term, literal=literal))


def candidates(spark: SparkSession, index: str, grams: list[str]) -> DataFrame:
    """product_id of the products with all grams in one field."""
    posting = spark.read.schema("gram string, field string, product_id long").parquet(index)
    return (posting.where(F.col("gram").isin(grams)).groupBy("product_id", "field").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(grams)).select("product_id").distinct())


# ---- pages

@dataclass
class PageIndex:
    """A listing stored in ranges of its order, with the number of rows before each range."""
    path: str
    schema: T.StructType
    starts: list[tuple[int, int, int]]  # (range, rows before it, rows)

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.starts)


def write_page_index(products: DataFrame, path: str, *, ranges: int | None = None) -> PageIndex:
    """Store the products range by range in listing order; one pass, and one count a range reaches the driver."""
    order = listing_order()
    dealt = products.repartitionByRange(ranges, *order) if ranges else products.repartitionByRange(*order)
    dealt.withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("range").parquet(path)
    return read_page_index(products, path)


def read_page_index(products: DataFrame, path: str) -> PageIndex:
    """The index stored at ``path`` for a table of this schema."""
    index, before = PageIndex(path, T.StructType([*products.schema.fields, T.StructField("range", T.IntegerType())]), []), 0
    for r in sorted(_stored(products.sparkSession, index).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()):
        index.starts.append((r["range"], before, r["n"]))
        before += r["n"]
    return index


def _stored(spark: SparkSession, index: PageIndex) -> DataFrame:
    return spark.read.schema(index.schema).parquet(index.path)


def indexed_page(spark: SparkSession, index: PageIndex, *, page: int, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of the listing; only the ranges that hold its rows are read."""
    validate_listing(page, page_size, None)
    low, high = (page - 1) * page_size, page * page_size
    held = [(r, before) for r, before, n in index.starts if before < high and before + n > low]
    stored = _stored(spark, index)
    if not held:
        return api_rows(stored.where(F.lit(False)))
    rows = stored.where(F.col("range").isin([r for r, _ in held]))
    return api_rows(rows.orderBy(*listing_order()).offset(low - held[0][1]).limit(page_size))


def indexed_pages(spark: SparkSession, index: PageIndex, *, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Every page, numbered range by range (a window in each, plus the rows before it)."""
    validate_listing(1, page_size, None)
    stored = _stored(spark, index)
    if not index.starts:
        return stored.where(F.lit(False)).select(F.lit(1).alias("page_no"), F.lit(1).alias("page_pos"), "product_id")
    before = F.create_map(*[F.lit(v) for r, n, _ in index.starts for v in (r, n)])
    place = F.row_number().over(Window.partitionBy("range").orderBy(*listing_order())) + before[F.col("range")] - 1
    return stored.withColumn("_place", place.cast("long")).select(
        (F.floor(F.col("_place") / page_size) + 1).cast("int").alias("page_no"), (F.col("_place") % page_size + 1).cast("int").alias("page_pos"), "product_id")

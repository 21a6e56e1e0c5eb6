"""Storefront queries over the products table, answered for whole tables at once.

Listing order everywhere is (event_count desc, product_id asc), a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstream.constants import (
    DEFAULT_PAGE_SIZE,
    HOME_CATEGORIES,
    HOME_ROW_SIZE,
    MAX_PAGE_SIZE,
    MAX_SEARCH_LEN,
    RECENT_HISTORY,
    RELATED_FETCH,
    RELATED_SIZE,
)
from shopstream.functions.ordering import global_row_number



def listing_order():
    return (F.col("event_count").desc(), F.col("product_id").asc())

API_COLUMNS = ["product_id", "display_name", "brand", "category_top", "category_leaf",
               "category_code", "price", "image_ref"]


def validate_listing(page: int, page_size: int, search: str | None) -> None:
    """P10: parameter domains of the listing endpoint."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be in 1..{MAX_PAGE_SIZE}")
    if search is not None and not 1 <= len(search) <= MAX_SEARCH_LEN:
        raise ValueError(f"search must be 1..{MAX_SEARCH_LEN} characters")


def api_rows(products: DataFrame) -> DataFrame:
    """The product columns of the API, price as double at the edge."""
    return products.select(*[F.col(c).cast("double").alias(c) if c == "price" else F.col(c) for c in API_COLUMNS])


def search_predicate(term: str, *, literal: bool = False, accent_insensitive: bool = False) -> Column:
    """``display_name`` or ``brand`` contains ``term``, case-insensitively.

    By default ``%`` and ``_`` in the term act as wildcards (as the
    reference's unescaped LIKE); ``literal=True`` matches them literally.
    A NULL brand is unknown, not a match.
    """
    if accent_insensitive:
        t = F.lit(term)
        def m(c):
            return F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), t)
    elif literal:
        t = F.lower(F.lit(term))
        def m(c):
            return F.contains(F.lower(F.col(c)), t)
    else:
        pattern = "%" + term.replace("\\", "\\\\") + "%"  # a backslash is an ordinary character
        def m(c):
            return F.col(c).ilike(pattern)
    return m("display_name") | m("brand")


def filter_products(products: DataFrame, *, category: str | None = None, search: str | None = None,
                    literal: bool = False, accent_insensitive: bool = False,
                    case_sensitive_category: bool = False) -> DataFrame:
    """Conjunction of the supplied predicates; values bound as literals.

    The category match ignores case by default (the original store compared
    under a case-insensitive collation).  Where the table stores the folded name as
    ``category_key``, that column is compared, which the scan can do itself.
    """
    conds = []
    if category:
        if case_sensitive_category:
            conds.append(F.col("category_top") == F.lit(category))
        else:
            folded = F.col("category_key") if "category_key" in products.columns else F.lower(F.col("category_top"))
            conds.append(folded == F.lower(F.lit(category)))
    if search:
        conds.append(search_predicate(search, literal=literal, accent_insensitive=accent_insensitive))
    df = products
    for c in conds:
        df = df.filter(c)
    return df


def list_products(products: DataFrame, *, category: str | None = None, search: str | None = None,
                  page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, literal: bool = False) -> DataFrame:
    """One page in listing order (bounded top-N: offset + limit, no global sort)."""
    validate_listing(page, page_size, search)
    df = filter_products(products, category=category, search=search, literal=literal)
    return api_rows(df.orderBy(*listing_order()).offset((page - 1) * page_size).limit(page_size))


def page_info(products: DataFrame, *, category: str | None = None, search: str | None = None,
              page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, literal: bool = False) -> DataFrame:
    """Total matching rows and page count (0 pages when nothing matches)."""
    validate_listing(page, page_size, search)
    df = filter_products(products, category=category, search=search, literal=literal)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_items")).select(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "total_items",
        F.ceil(F.col("total_items") / F.lit(page_size)).cast("bigint").alias("total_pages"))


def all_pages(products: DataFrame, *, page_size: int = DEFAULT_PAGE_SIZE, category: str | None = None,
              search: str | None = None) -> DataFrame:
    """Every page at once: ``page_no`` and ``page_pos`` from a distributed global rank."""
    validate_listing(1, page_size, search)
    df = filter_products(products, category=category, search=search)
    ranked = global_row_number(df.withColumn("_neg", -F.col("event_count")), ["_neg", "product_id"], "_rn")
    return ranked.select(
        F.ceil(F.col("_rn") / F.lit(page_size)).cast("int").alias("page_no"),
        (((F.col("_rn") - 1) % page_size) + 1).cast("int").alias("page_pos"),
        *API_COLUMNS).drop("_neg")


def category_counts(products: DataFrame) -> DataFrame:
    """Products per non-NULL top category (ordered by count desc, then name)."""
    return (products.filter(F.col("category_top").isNotNull())
            .groupBy(F.col("category_top").alias("category"))
            .agg(F.count(F.lit(1)).alias("product_count"))
            .orderBy(F.desc("product_count"), "category"))


def lookup_products(products: DataFrame, ids: DataFrame, key: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """Bulk lookup -> (found product rows, requested ids not in the table)."""
    req = ids.select(key).distinct()
    found = products.join(req, key, "left_semi")
    missing = req.join(products.select(key), key, "left_anti")
    return found, missing


def _rank_in_category(products: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("category_top").orderBy(*listing_order())
    return (products.filter(F.col("category_top").isNotNull())
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))


def home_rows(products: DataFrame, *, n_categories: int = HOME_CATEGORIES, n: int = HOME_ROW_SIZE) -> DataFrame:
    """The ``n`` most popular products of each of the ``n_categories`` largest categories."""
    top = (category_counts(products).orderBy(F.col("product_count").desc(), F.col("category").asc())
           .limit(n_categories).select(F.col("category").alias("category_top"),
                                       F.col("product_count")))
    ranked = _rank_in_category(products.join(F.broadcast(top.select("category_top")), "category_top", "left_semi"), n)
    return ranked.join(F.broadcast(top), "category_top").select(
        "category_top", "product_count", "rank", *[c for c in API_COLUMNS if c != "category_top"])


def related_products(products: DataFrame, *, fetch: int = RELATED_FETCH, n: int = RELATED_SIZE) -> DataFrame:
    """Per product, the first ``n`` of its category's top ``fetch`` listing, itself removed.

    The per-category top list is cut before the join (``fetch`` rows per
    category), so the join emits at most ``fetch`` rows per product.
    Products without a category get no rows.
    """
    # the few categories are no key to deal products by: their top lists, one array each, are repeated once a
    # salt, and products go to (category, salt)
    salts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = (_rank_in_category(products, fetch).groupBy("category_top").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("product_id").alias("id")))).alias("_top"))
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    base = (products.filter(F.col("category_top").isNotNull()).select("product_id", "category_top")
            .withColumn("_salt", F.pmod(F.xxhash64("product_id"), F.lit(salts)).cast("int")))
    others = F.slice(F.filter(F.transform("_top", lambda x: x["id"]), lambda x: x != F.col("product_id")), 1, n)
    return (base.join(top, ["category_top", "_salt"]).select("product_id", F.posexplode(others).alias("pos", "related_id"))
            .select("product_id", (F.col("pos") + 1).cast("int").alias("pos"), "related_id"))


def recent_views(events: DataFrame, *, n: int = RECENT_HISTORY, key: str = "user_session",
                 order=("event_time", "event_id"), item_col: str = "product_id") -> DataFrame:
    """Last ``n`` distinct items per key; a repeat view moves the item to the end.

    Rows (key, pos, product_id), pos 1 = oldest kept.  Equal to folding the
    move-to-end rule over the views in order, because only each item's
    latest view decides its place.
    """
    okey = F.struct(*[F.col(c) for c in order])
    last = events.groupBy(key, item_col).agg(F.max(okey).alias("_last"))
    w = Window.partitionBy(key).orderBy(F.col("_last").desc())
    kept = last.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    w2 = Window.partitionBy(key).orderBy(F.col("_last").asc())
    return kept.withColumn("pos", F.row_number().over(w2)).select(key, "pos", item_col)

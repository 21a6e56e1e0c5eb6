"""Queries over the basket adapter (X2) and the catalog built from it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopstream.functions.text import category_label, humanize, price_label
from shopstream.operators import catalog as cat
from shopstream.operators import indexes as ix
from shopstream.operators import storefront as sf
from shopstream.plans.registry import query
from shopstream.session import checkpoint_dir, stored_path
from shopstream.sources import fixtures as fx

UPSERT_CUTOFF = "1999-01-01 00:00:00"
BATCH_CUTOFFS = ("1994-01-01 00:00:00", "1996-06-01 00:00:00", "1999-01-01 00:00:00")
FILTER_CATEGORY = "economy"
SEARCH_TERM = "ring"
WILDCARD_TERM = "brand#1_ g"
INFO_SEARCH = "brand#1"
PAGE, PAGE_SIZE = 2, 24
INDEXED_PAGE = 7

# Image pools for the fixture categories (FIXTURES.md X3): two leaf pools,
# four category pools, two categories left out on purpose, generic pool of 8.
FIXTURE_LEAF_POOLS = [("economy", "ring", 6), ("small", "bolt", 6)]
FIXTURE_CATEGORY_POOLS = [("economy", 8), ("small", 8), ("medium", 8), ("promo", 8), ("generic", 8)]


def catalog_sources(sf_dir):
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]


def catalog_store(spark, sf_dir):
    """The products table of X2, stored: built once an application and state of its source tables, then only scanned."""
    root = stored_path(spark, "catalog", catalog_sources(sf_dir),
                       lambda folder: cat.CatalogStore(spark, folder, order=fx.BASKET_LATEST_ORDER).add(fx.baskets(spark, sf_dir), 0))
    return cat.CatalogStore(spark, root)


def stored_catalog(spark, sf_dir):
    return catalog_store(spark, sf_dir).products()


def fixture_pools(spark):
    from shopstream.functions.literals import literal_table
    leaf = literal_table(spark, FIXTURE_LEAF_POOLS, "category_top string, category_leaf string, n int")
    pools = literal_table(spark, FIXTURE_CATEGORY_POOLS, "category_top string, n int")
    return leaf, pools


@query("parse_category")
def parse_category_q(spark, sf_dir):
    from shopstream.functions.text import category_leaf, category_top
    b = fx.baskets(spark, sf_dir).select("category_code").distinct()
    return b.select("category_code", category_top("category_code").alias("category_top"),
                    category_leaf("category_code").alias("category_leaf"))


@query("catalog_reduce")
def catalog_reduce_q(spark, sf_dir):
    r = cat.catalog_reduce(fx.baskets(spark, sf_dir), order=fx.BASKET_LATEST_ORDER)
    return r.select("product_id", "event_count", "category_code", "brand",
                    F.col("price").cast("double").alias("price"), "updated_at")


@query("catalog")
def catalog_q(spark, sf_dir):
    c = cat.build_catalog(fx.baskets(spark, sf_dir), order=fx.BASKET_LATEST_ORDER)
    return c.withColumn("price", F.col("price").cast("double"))


@query("catalog_null_stats")
def catalog_null_stats_q(spark, sf_dir):
    return cat.catalog_null_stats(stored_catalog(spark, sf_dir))


@query("catalog_upsert")
def catalog_upsert_q(spark, sf_dir):
    b = fx.baskets(spark, sf_dir)
    cut = F.to_timestamp_ntz(F.lit(UPSERT_CUTOFF))
    old = cat.build_catalog(b.filter(F.col("event_time") < cut), order=fx.BASKET_LATEST_ORDER)
    new = cat.build_catalog(b.filter(F.col("event_time") >= cut), order=fx.BASKET_LATEST_ORDER)
    out = cat.upsert(old, new, ["product_id"])
    return out.withColumn("price", F.col("price").cast("double"))


@query("catalog_incremental")
def catalog_incremental_q(spark, sf_dir):
    """The catalog of events that arrive in batches by time; one batch arrives twice."""
    b = fx.baskets(spark, sf_dir)
    cuts = [F.to_timestamp_ntz(F.lit(c)) for c in BATCH_CUTOFFS]
    t = F.col("event_time")
    parts = [b.where(t < cuts[0]), *[b.where((t >= low) & (t < high)) for low, high in zip(cuts, cuts[1:])], b.where((t >= cuts[-1]) | t.isNull())]
    store = cat.CatalogStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/shopstream-incremental-{uuid.uuid4().hex}", order=fx.BASKET_LATEST_ORDER)
    for number, part in enumerate(parts):
        store.add(part, number)
        if number == 1:
            store.add(part, number)
    return store.products().withColumn("price", F.col("price").cast("double"))


@query("image_assign")
def image_assign_q(spark, sf_dir):
    leaf, pools = fixture_pools(spark)
    imgs = cat.assign_images(stored_catalog(spark, sf_dir), leaf, pools)
    return imgs.select("product_id", "category_top", "category_leaf", "image_url")


@query("category_cover")
def category_cover_q(spark, sf_dir):
    _, pools = fixture_pools(spark)
    return cat.category_cover(sf.category_counts(stored_catalog(spark, sf_dir)), pools)


@query("leaf_share")
def leaf_share_q(spark, sf_dir):
    return cat.leaf_share(stored_catalog(spark, sf_dir))


@query("display_labels")
def display_labels_q(spark, sf_dir):
    c = stored_catalog(spark, sf_dir)
    return c.select("product_id", category_label("category_top").alias("category_label"),
                    price_label("price").alias("price_label"), humanize("brand").alias("brand_label"))


@query("product_filter")
def product_filter_q(spark, sf_dir):
    return sf.api_rows(sf.filter_products(catalog_store(spark, sf_dir).listing(), category=FILTER_CATEGORY))


@query("product_search")
def product_search_q(spark, sf_dir):
    return sf.api_rows(sf.filter_products(stored_catalog(spark, sf_dir), search=SEARCH_TERM))


@query("product_search_wildcard")
def product_search_wildcard_q(spark, sf_dir):
    return sf.api_rows(sf.filter_products(stored_catalog(spark, sf_dir), search=WILDCARD_TERM))


def search_index(spark, sf_dir):
    """Trigram index of the stored catalog, written once like it."""
    return stored_path(spark, "search-index", catalog_sources(sf_dir), lambda folder: ix.write_search_index(stored_catalog(spark, sf_dir), folder))


@query("product_search_indexed")
def product_search_indexed_q(spark, sf_dir):
    return sf.api_rows(ix.search_products(stored_catalog(spark, sf_dir), search_index(spark, sf_dir), SEARCH_TERM))


@query("product_search_wildcard_indexed")
def product_search_wildcard_indexed_q(spark, sf_dir):
    return sf.api_rows(ix.search_products(stored_catalog(spark, sf_dir), search_index(spark, sf_dir), WILDCARD_TERM))


def page_index(spark, sf_dir):
    """Page index of the stored catalog, written once like it."""
    products = stored_catalog(spark, sf_dir)
    return ix.read_page_index(products, stored_path(spark, "page-index", catalog_sources(sf_dir), lambda folder: ix.write_page_index(products, folder)))


@query("listing_page_indexed")
def listing_page_indexed_q(spark, sf_dir):
    return ix.indexed_page(spark, page_index(spark, sf_dir), page=INDEXED_PAGE, page_size=PAGE_SIZE)


@query("all_pages_indexed")
def all_pages_indexed_q(spark, sf_dir):
    return ix.indexed_pages(spark, page_index(spark, sf_dir), page_size=PAGE_SIZE)


@query("product_page")
def product_page_q(spark, sf_dir):
    return sf.list_products(catalog_store(spark, sf_dir).listing(), category=FILTER_CATEGORY, page=PAGE, page_size=PAGE_SIZE)


@query("page_info")
def page_info_q(spark, sf_dir):
    return sf.page_info(catalog_store(spark, sf_dir).listing(), category=FILTER_CATEGORY, search=INFO_SEARCH,
                        page=1, page_size=PAGE_SIZE)


@query("all_pages")
def all_pages_q(spark, sf_dir):
    return sf.all_pages(stored_catalog(spark, sf_dir), page_size=PAGE_SIZE).select(
        "page_no", "page_pos", "product_id")


@query("category_counts")
def category_counts_q(spark, sf_dir):
    return sf.category_counts(stored_catalog(spark, sf_dir))


def _command_ids(spark, sf_dir):
    return fx.cart_commands(spark, sf_dir).select("product_id")


@query("product_lookup")
def product_lookup_q(spark, sf_dir):
    found, _ = sf.lookup_products(stored_catalog(spark, sf_dir), _command_ids(spark, sf_dir))
    return sf.api_rows(found)


@query("product_lookup_missing")
def product_lookup_missing_q(spark, sf_dir):
    _, missing = sf.lookup_products(stored_catalog(spark, sf_dir), _command_ids(spark, sf_dir))
    return missing


@query("home_rows")
def home_rows_q(spark, sf_dir):
    return sf.home_rows(stored_catalog(spark, sf_dir)).withColumn("price", F.col("price").cast("double"))


@query("related_products")
def related_products_q(spark, sf_dir):
    return sf.related_products(stored_catalog(spark, sf_dir))

"""Incremental catalog: merging equals rebuilding, and the storefront reads the stored table only."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shopstream.operators import catalog as cat
from shopstream.plans import all_queries  # noqa: F401
from shopstream.plans.registry import QUERIES
from shopstream.streaming import ingest

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, event_time timestamp_ntz, product_id long, category_code string, brand string, price decimal(10,2)"


def events(spark, n, seed):
    import datetime as dt
    from decimal import Decimal
    rng = random.Random(seed)
    rows = [(i, dt.datetime(2024, 1, 1 + rng.randrange(20)), rng.choice([1, 1, 1, 2, 3, 50 + i % 9]), rng.choice([None, "a.b", "c.d.e", "x"]),
             rng.choice([None, "acme", "Zed"]), rng.choice([None, Decimal("1.50"), Decimal("9.99")])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("seed", range(3))
def test_merging_in_any_order_equals_rebuilding(spark, tmp_dir, seed):
    ev = events(spark, 300, seed)
    store = cat.CatalogStore(spark, f"{tmp_dir}/c")
    parts = [ev.where(F.col("event_id") % 4 == k) for k in random.Random(seed).sample(range(4), 4)]  # late events too
    for number, part in enumerate(parts):
        assert store.add(part, number)
        assert not store.add(part, number)  # a retry changes nothing
    assert rows_of(store.products()) == rows_of(cat.build_catalog(ev))
    assert not store.add(ev, 1)
    assert store.add(ev.limit(0), 9) and rows_of(store.products()) == rows_of(cat.build_catalog(ev))


def test_states_merge_like_reduces(spark):
    ev = events(spark, 200, 7)
    a, b, c = (cat.catalog_state(ev.where(F.col("event_id") % 3 == k)) for k in range(3))
    left, right = cat.merge_states(cat.merge_states(a, b), c), cat.merge_states(a, cat.merge_states(c, b))
    assert rows_of(left) == rows_of(right) == rows_of(cat.catalog_state(ev))


def test_old_versions_go_and_a_crashed_write_is_not_read(spark, tmp_dir):
    store = cat.CatalogStore(spark, f"{tmp_dir}/c", keep=2)
    with pytest.raises(FileNotFoundError):
        store.products()
    for number in range(4):
        store.add(events(spark, 20, number), number)
    assert sorted(os.listdir(f"{tmp_dir}/c")) == ["version=0000000003", "version=0000000004"]
    before = rows_of(store.products())
    os.makedirs(f"{tmp_dir}/c/version=0000000005")  # a write that never committed
    assert rows_of(store.products()) == before
    assert store.add(events(spark, 5, 9), 4)
    assert sorted(os.listdir(f"{tmp_dir}/c"))[-1] == "version=0000000006"


def test_merge_does_not_read_earlier_events(spark, tmp_dir):
    ev = events(spark, 100, 1)
    ev.where("event_id < 60").write.parquet(f"{tmp_dir}/one")
    ev.where("event_id >= 60").write.parquet(f"{tmp_dir}/two")
    store = cat.CatalogStore(spark, f"{tmp_dir}/c")
    store.add(spark.read.parquet(f"{tmp_dir}/one"), 0)
    for name in os.listdir(f"{tmp_dir}/one"):
        os.remove(f"{tmp_dir}/one/{name}")
    store.add(spark.read.parquet(f"{tmp_dir}/two"), 1)
    assert rows_of(store.products()) == rows_of(cat.build_catalog(ev))


def test_appended_events_keep_the_catalog_up_to_date(spark, tmp_dir):
    ev = events(spark, 120, 4)
    store = cat.CatalogStore(spark, f"{tmp_dir}/c")
    for name, part in (("a", ev.where("event_id < 50")), ("b", ev.where("event_id BETWEEN 30 AND 90")), ("c", ev.where("event_id > 80"))):
        part.write.parquet(f"{tmp_dir}/in/{name}")
        ingest.append_events(spark, f"{tmp_dir}/in/*", f"{tmp_dir}/t", f"{tmp_dir}/ck", schema=ev.schema, time_col="event_time", on_append=store.add).awaitTermination()
    assert rows_of(store.products()) == rows_of(cat.build_catalog(ev))


@pytest.mark.parametrize("name", ["product_search", "product_search_wildcard", "product_filter", "product_page", "page_info", "category_counts", "home_rows",
                                  "related_products", "leaf_share", "catalog_null_stats", "display_labels", "image_assign"])
def test_storefront_scans_the_products_table_only(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("shopstream-catalog-" in line for line in scans)
    assert "_state" not in plan.split("FileScan", 1)[1].split("ReadSchema", 1)[1].splitlines()[0]  # the mergeable state is not read


def test_stored_catalog_follows_its_sources(spark, tmp_dir):
    from shopstream.plans.catalog_queries import stored_catalog
    for t in ("lineitem", "part"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where("l_partkey % 2 = 0") if t == "lineitem" else df).write.parquet(f"{tmp_dir}/{t}.parquet")
    half = stored_catalog(spark, tmp_dir).count()
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_partkey % 2 = 1").write.mode("append").parquet(f"{tmp_dir}/lineitem.parquet")
    assert stored_catalog(spark, tmp_dir).count() > half


def test_category_filter_reaches_the_scan(spark):
    for name in ("product_filter", "product_page", "page_info"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(category_key,economy)" in plan, name


def test_large_pools_are_not_broadcast(spark, monkeypatch):
    from shopstream.plans.catalog_queries import fixture_pools
    leaf, pools = fixture_pools(spark)
    products = cat.build_catalog(events(spark, 60, 2))
    want = rows_of(cat.assign_images(products, leaf, pools))
    monkeypatch.setattr(cat, "POOL_ROWS", 1)
    got = cat.assign_images(products, leaf, pools)
    assert rows_of(got) == want
    assert "ResolvedHint (strategy=broadcast)" in cat.assign_images(products, leaf.limit(1), pools)._jdf.queryExecution().analyzed().toString()


def test_related_products_are_not_dealt_by_category(spark):
    plan = QUERIES["related_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(category_top" not in plan or "_salt" in plan

"""Search and page indexes: equal to the plain queries, and what they read."""

import random
import re

import pytest

from shopstream.operators import indexes as ix
from shopstream.operators import storefront as sf

COLS = "product_id long, display_name string, brand string, category_top string, category_leaf string, category_code string, price decimal(10,2), image_ref string, event_count long"


def products(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["Ring", "ÉCLAIR", "Straße", "bolt", "100%", "a_b", "\\path", "Ω mega", "ab", "x", "İstanbul", "RINGTONE", ""]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 3))), rng.choice([None, "Acme", "rin", "b%d", "Zed_x", ""]), "t", "l", "t.l", None, "t", rng.randint(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows, COLS)


@pytest.mark.parametrize("literal", [False, True])
def test_search_equals_the_scan(spark, tmp_dir, literal):
    p = products(spark, 400)
    ix.write_search_index(p, tmp_dir + "/i")
    for term in ("ring", "RING", "éclair", "strasse", "straße", "r_ng", "ri%ne", "100%", "%", "_", "a_b", "ab", "x", "\\path", "mega", "zed_x", "no such", "i̇stan", "ng b", "b%d"):
        got = sorted(r.product_id for r in ix.search_products(p, tmp_dir + "/i", term, literal=literal).collect())
        assert got == sorted(r.product_id for r in sf.filter_products(p, search=term, literal=literal).collect()), term


def test_only_candidates_are_matched(spark, tmp_dir):
    p = products(spark, 3000)
    ix.write_search_index(p, tmp_dir + "/i")
    grams = ix.pattern_trigrams(spark, "ri%gtone")
    assert grams == ["gto", "one", "ton"] and ix.pattern_trigrams(spark, "r%i_g") == [] and ix.pattern_trigrams(spark, "%") == []
    some = ix.candidates(spark, tmp_dir + "/i", grams)
    assert 0 < some.count() == p.where("display_name LIKE '%RINGTONE%'").count() < 1500
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


@pytest.mark.parametrize("n, ranges", [(0, 3), (1, 4), (500, 7), (500, None)])
def test_pages_equal_the_plain_listing(spark, tmp_dir, n, ranges):
    p = products(spark, n)
    index = ix.write_page_index(p, tmp_dir + "/p", ranges=ranges)
    assert index.total == n and ix.read_page_index(p, tmp_dir + "/p") == index
    for page in (1, 2, 3, 20, 21, 22):
        got = ix.indexed_page(spark, index, page=page, page_size=24).collect()
        assert got == sf.list_products(p, page=page, page_size=24).collect()
    want = sorted((r.page_no, r.page_pos, r.product_id) for r in sf.all_pages(p, page_size=24).collect())
    assert sorted(map(tuple, ix.indexed_pages(spark, index, page_size=24).collect())) == want
    with pytest.raises(ValueError):
        ix.indexed_page(spark, index, page=0)


def test_a_page_reads_its_ranges_only(spark, tmp_dir):
    index = ix.write_page_index(products(spark, 2000), tmp_dir + "/p", ranges=10)
    plan = ix.indexed_page(spark, index, page=40, page_size=24)._jdf.queryExecution().executedPlan().toString()
    held = re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan).group(1)
    assert "range" in held and len(re.findall(r"\d+", held.split("IN", 1)[-1].split("#", 1)[-1])) <= 4
    assert "Exchange rangepartitioning" not in plan  # no global sort

"""Queries for recent views, cold-start routing and nearest items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopstream.operators import similarity as sim
from shopstream.operators import storefront as sf
from shopstream.operators import vocab as voc
from shopstream.plans.registry import query
from shopstream.plans.session_queries import CLICK_VOCAB_SIZE, click_sessions, stored_clicks
from shopstream.sources import fixtures as fx

KNN_K = 5


def _click_vocab(spark, sf_dir):
    return voc.build_vocab(click_sessions(spark, sf_dir), size=CLICK_VOCAB_SIZE)


@query("recent_views")
def recent_views_q(spark, sf_dir):
    return sf.recent_views(stored_clicks(spark, sf_dir), order=fx.CLICK_ORDER)


@query("cold_start_route")
def cold_start_route_q(spark, sf_dir):
    return sim.cold_start_route(fx.item_vectors(spark, sf_dir), _click_vocab(spark, sf_dir))


@query("knn_items")
def knn_items_q(spark, sf_dir):
    items = fx.item_vectors(spark, sf_dir)
    route = sim.cold_start_route(items, _click_vocab(spark, sf_dir))
    cold = (items.join(route.filter(F.col("route") == "embedding"), "product_id", "left_semi")
            .select(F.col("product_id").alias("query_id"), "embedding"))
    return sim.knn(cold, items, k=KNN_K)

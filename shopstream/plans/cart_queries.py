"""Cart queries: X4 read side and the command log applied to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopstream.operators import cart
from shopstream.plans.catalog_queries import stored_catalog
from shopstream.plans.registry import query
from shopstream.sources import fixtures as fx


def _applied(spark, sf_dir):
    return cart.apply_cart_commands(fx.cart_commands(spark, sf_dir), stored_catalog(spark, sf_dir))


@query("cart_view")
def cart_view_q(spark, sf_dir):
    v = cart.cart_view(fx.cart_items(spark, sf_dir), stored_catalog(spark, sf_dir))
    return v.withColumn("price", F.col("price").cast("double")).withColumn("line_total", F.col("line_total").cast("double"))


@query("cart_lines")
def cart_lines_q(spark, sf_dir):
    """The lines of each cart in their order."""
    v = cart.numbered_lines(cart.cart_view(fx.cart_items(spark, sf_dir), stored_catalog(spark, sf_dir)))
    return v.select("cart_id", "line_no", "product_id", "quantity")


@query("cart_totals")
def cart_totals_q(spark, sf_dir):
    return cart.cart_totals(cart.cart_view(fx.cart_items(spark, sf_dir), stored_catalog(spark, sf_dir)))


@query("cart_apply")
def cart_apply_q(spark, sf_dir):
    items, _, _ = _applied(spark, sf_dir)
    return items


@query("cart_rejects")
def cart_rejects_q(spark, sf_dir):
    _, rejects, _ = _applied(spark, sf_dir)
    return rejects


@query("cart_apply_totals")
def cart_apply_totals_q(spark, sf_dir):
    items, _, carts = _applied(spark, sf_dir)
    return cart.cart_totals(cart.cart_view(items, stored_catalog(spark, sf_dir)), carts)

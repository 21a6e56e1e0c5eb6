"""Carts from a command log (add / set / del), re-aimed from one-request CRUD.

Rules (per cart and product):

* add q: product must exist and q >= 1; creates the line (added_at = command
  time) or adds q to the existing quantity;
* set q: the line must exist; q <= 0 deletes it, else quantity := q;
* del: the line must exist; deletes it (a later add makes a new line with a
  new added_at);
* a cart id must be 1..36 characters; a cart exists from its first valid add.

The log is folded as an associative composition of per-command state
transformers (``cart_fold``): leaves of neighbouring commands, then a tree of
transformers over them, every group bounded.  A (cart, product) with a third
of all commands is spread over many leaves and nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopstream.constants import MAX_CART_ID_LEN

KEY = ["cart_id", "product_id"]
ITEM_SCHEMA = "cart_id string, product_id bigint, quantity int, added_at timestamp_ntz"


def validate_commands(commands: DataFrame, products: DataFrame) -> DataFrame:
    """C4 (static part) / P10: adds ``reason`` (NULL when the command is well-formed)."""
    exists = products.select("product_id").distinct().withColumn("_exists", F.lit(True))
    c = commands.join(exists, "product_id", "left")
    op, q, cid = F.col("op"), F.col("quantity"), F.col("cart_id")
    reason = (F.when(cid.isNull() | (F.length(cid) < 1) | (F.length(cid) > MAX_CART_ID_LEN), "bad_cart_id")
               .when(~op.isin("add", "set", "del") | op.isNull(), "bad_op")
               .when((op == "add") & (q.isNull() | (q < 1)), "bad_quantity")
               .when((op == "set") & q.isNull(), "bad_quantity")
               .when((op == "add") & F.col("_exists").isNull(), "unknown_product"))
    return c.withColumn("reason", reason).drop("_exists")


def apply_cart_commands(commands: DataFrame, products: DataFrame, items: DataFrame | None = None, *,
                        materialize: bool = True, bucket_rows: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, rejects, carts) after applying ``commands`` to ``items``.

    ``commands``: (seq long, cart_id, op, product_id, quantity int, at timestamp);
    ``seq`` orders commands (unique).  ``items``: the initial lines, or None.
    The fold itself is :func:`shopstream.operators.cart_fold.fold_commands`
    (a tree over groups of at most ``bucket_rows`` commands).
    The validated log feeds three branches; with ``materialize`` it is written
    once to the checkpoint folder (reliable, survives executor loss).
    """
    from shopstream.operators.cart_fold import fold_commands
    checked = validate_commands(commands, products)
    if materialize:
        from shopstream.session import cut_lineage
        checked = cut_lineage(checked)
    valid = checked.filter(F.col("reason").isNull()).select("seq", *KEY, "op", "quantity", "at")
    final, stateful = fold_commands(valid, items, bucket_rows=bucket_rows)
    static = checked.filter(F.col("reason").isNotNull()).select("seq", *KEY, "op", "reason")
    rejects = static.unionByName(stateful.withColumn("reason", F.lit("not_in_cart")))
    carts = valid.filter(F.col("op") == "add").groupBy("cart_id").agg(F.min("at").alias("created_at"))
    if items is not None:
        carts = (carts.unionByName(items.groupBy("cart_id").agg(F.min("added_at").alias("created_at")))
                 .groupBy("cart_id").agg(F.min("created_at").alias("created_at")))
    return final.select(*KEY, F.col("quantity").cast("int").alias("quantity"), "added_at"), rejects, carts


def cart_view(items: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines joined with products; line_total = round(price * qty, 2), NULL price -> 0.

    Money stays decimal until the output edge.
    """
    p = products.select("product_id", "display_name", "brand", "price", "image_ref")
    j = items.join(p, "product_id", "inner")
    line = F.round(F.coalesce(F.col("price"), F.lit(0).cast("decimal(10,2)")) * F.col("quantity"), 2)
    return j.select("cart_id", "product_id", "display_name", "brand", "price", "image_ref",
                    "quantity", line.alias("line_total"), "added_at")


def ordered_lines(view: DataFrame) -> DataFrame:
    """Lines of each cart in (added_at, product_id) order, carts kept whole per partition.

    Hash-partitioned by cart and sorted inside partitions: no global sort.
    """
    return view.repartition("cart_id").sortWithinPartitions("cart_id", "added_at", "product_id")


def numbered_lines(view: DataFrame) -> DataFrame:
    """The lines with their place (``line_no``, from 1) in their cart, in (added_at, product_id) order.

    A cart's lines are distinct products, so a window holds one row a product at most.
    """
    w = Window.partitionBy("cart_id").orderBy("added_at", "product_id")
    return view.withColumn("line_no", F.row_number().over(w).cast("int"))


def cart_totals(view: DataFrame, carts: DataFrame | None = None) -> DataFrame:
    """Per cart total quantity and total price; carts without lines get zeros."""
    t = view.groupBy("cart_id").agg(
        F.sum("quantity").cast("bigint").alias("total_items"),
        F.round(F.sum("line_total"), 2).alias("total_price"))
    if carts is not None:
        t = carts.select("cart_id").join(t, "cart_id", "left").select(
            "cart_id", F.coalesce("total_items", F.lit(0)).cast("bigint").alias("total_items"),
            F.coalesce("total_price", F.lit(0).cast("decimal(10,2)")).alias("total_price"))
    return t.withColumn("total_price", F.col("total_price").cast("double"))

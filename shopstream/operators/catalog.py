"""Product catalog derived from events: last non-null attributes, names, images, upsert.

The reduce is one hash aggregate keyed by product: ``max_by`` keeps, per
attribute, the value of the latest event (by a total order key) among the
events where that attribute is not NULL.  It is partially aggregated on the
map side, so a product with a third of all events sends one row per map
task; no window, no sort of the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstream.constants import (
    CATEGORY_POOL_SIZE,
    DEFAULT_CATEGORY_POOLS,
    DEFAULT_LEAF_POOLS,
    GENERIC_CATEGORY,
    LEAF_POOL_SIZE,
)
from shopstream.functions.literals import literal_table
from shopstream.functions.text import category_leaf, category_top, display_name, image_ref

ATTRIBUTES = ("category_code", "brand", "price")
PRODUCT_COLUMNS = ["product_id", "display_name", "brand", "category_top", "category_leaf",
                   "category_code", "price", "image_ref"]


def _latest_non_null(c: str, okey):
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(c)


def catalog_reduce(events: DataFrame, *, order: Sequence[str] = ("event_time", "event_id"),
                   attributes: Sequence[str] = ATTRIBUTES, time_col: str = "event_time") -> DataFrame:
    """(product_id, event_count, <latest non-null attribute>..., updated_at)."""
    okey = F.struct(*[F.col(c) for c in order])
    return events.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        *[_latest_non_null(c, okey) for c in attributes],
        F.max(time_col).alias("updated_at"))


def catalog_state(events: DataFrame, *, order: Sequence[str] = ("event_time", "event_id"),
                  attributes: Sequence[str] = ATTRIBUTES, time_col: str = "event_time") -> DataFrame:
    """Mergeable form of ``catalog_reduce``: per attribute the order key and value of its latest non-null event.

    (product_id, event_count, <attribute> struct<at, value>..., updated_at)
    """
    at = F.struct(*[F.col(c) for c in order]).alias("at")
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("value")))).alias(c) for c in attributes]
    return events.groupBy("product_id").agg(F.count(F.lit(1)).alias("event_count"), *latest, F.max(time_col).alias("updated_at"))


def merge_states(old: DataFrame, new: DataFrame, *, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """State of the events of both (which share none): counts add up, of each attribute the later value stays."""
    both = old.unionByName(new)
    return both.groupBy("product_id").agg(F.sum("event_count").alias("event_count"), *[F.max(c).alias(c) for c in attributes],
                                          F.max("updated_at").alias("updated_at"))


def state_products(state: DataFrame, *, attributes: Sequence[str] = ATTRIBUTES, keep: Sequence[str] = ()) -> DataFrame:
    """Products table of a state; ``keep`` passes further columns through."""
    plain = state.select("product_id", "event_count", *[F.col(c)["value"].alias(c) for c in attributes], "updated_at", *keep)
    return derive_products(plain, keep=keep)


class CatalogStore:
    """A stored products table that new events are merged into, without reading earlier events again.

    One version directory holds, for each product, the mergeable state beside the derived
    product columns, so both change in one commit; readers of ``products`` read the product
    columns only.  ``add`` costs one aggregate over the new events and one over the state.
    Batches are numbered: one that was merged already (a retry) is left out.  The ``keep``
    newest versions stay, for readers that are still at work.
    """

    STATE, FOLDED = "_state", "category_key"

    def __init__(self, spark: SparkSession, root: str, *, order: Sequence[str] = ("event_time", "event_id"), keep: int = 2):
        self.spark, self.root, self.order, self.keep = spark, root, tuple(order), max(1, keep)

    def add(self, events: DataFrame, batch: int) -> bool:
        """Merge a batch of new events; False if this batch, or a later one, was merged before."""
        stored = read_latest(self.spark, self.root)
        state = catalog_state(events, order=self.order)
        if stored is not None:
            last = stored.agg(F.max("_batch")).first()[0]
            if last is not None and batch <= last:
                return False
            state = merge_states(stored.select("product_id", f"{self.STATE}.*"), state)
        own = [c for c in state.columns if c != "product_id"]
        held = state.select("product_id", F.struct(*own).alias(self.STATE))
        products = state_products(held.select("product_id", f"{self.STATE}.*", self.STATE), keep=(self.STATE,))
        products = products.withColumn(self.FOLDED, F.lower("category_top"))
        write_version(products.withColumn("_batch", F.lit(batch).cast("long")), self.root)
        drop_versions(self.spark, self.root, keep=self.keep)
        return True

    def listing(self) -> DataFrame:
        """The newest products table with the folded category, by which ``filter_products`` prunes the scan."""
        stored = read_latest(self.spark, self.root)
        if stored is None:
            raise FileNotFoundError(f"no catalog version at {self.root}")
        return stored.drop(self.STATE, "_batch")

    def products(self) -> DataFrame:
        """The newest products table."""
        return self.listing().drop(self.FOLDED)


def derive_products(reduced: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """F1-F4 over a reduced catalog: category parts, display name, image key."""
    return reduced.select(
        "product_id", "category_code",
        category_top("category_code").alias("category_top"),
        category_leaf("category_code").alias("category_leaf"),
        "brand", F.col("price").cast("decimal(10,2)").alias("price"),
        display_name("category_code", "brand", "product_id").alias("display_name"),
        image_ref("category_code").alias("image_ref"),
        F.col("event_count").cast("bigint").alias("event_count"), "updated_at", *keep)


def build_catalog(events: DataFrame, *, order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """Events -> products table (one row per product_id)."""
    return derive_products(catalog_reduce(events, order=order))


def catalog_null_stats(catalog: DataFrame) -> DataFrame:
    """Products with NULL category, NULL brand, and both NULL (unbranded fallback)."""
    cnull, bnull = F.col("category_code").isNull(), F.col("brand").isNull()
    return catalog.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(cnull).alias("null_category"), F.count_if(bnull).alias("null_brand"),
        F.count_if(cnull & bnull).alias("null_both"))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("product_id",), *,
           mode: str = "replace") -> DataFrame:
    """Rows of ``updates`` replace rows of ``base`` with the same key; others are kept.

    ``mode='replace'`` replaces every value column (the reference's
    ON DUPLICATE KEY UPDATE).  ``mode='ignore'`` keeps the base row on a clash.
    Of several update rows with one key the one with the latest ``updated_at`` (if there
    is such a column), then the greatest values, is taken, so keys stay unique.
    Lazy: anti join + union, no driver work.  Idempotent: upsert(upsert(b,u),u)
    equals upsert(b,u).
    """
    keys = list(keys)
    cols = base.columns
    values = [c for c in cols if c not in keys]
    first = [c for c in ("updated_at",) if c in values]
    updates = (updates.select(*cols).groupBy(*keys)
               .agg(F.max(F.struct(*first, *[c for c in values if c not in first])).alias("_one")).select(*keys, "_one.*")
               if values else updates.select(*cols).distinct())
    if mode == "replace":
        kept = base.join(updates.select(*keys).distinct(), keys, "left_anti")
        return kept.unionByName(updates.select(*cols))
    if mode == "ignore":
        new = updates.select(*cols).join(base.select(*keys), keys, "left_anti")
        return base.unionByName(new)
    raise ValueError(f"unknown upsert mode {mode!r}")


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version directory under ``root`` and return its path.

    Readers use :func:`read_latest`, which only sees versions whose write
    committed (``_SUCCESS`` present); the path being read is never overwritten.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    root_path = jvm.org.apache.hadoop.fs.Path(root)
    fs = root_path.getFileSystem(conf)
    existing = _versions(fs, root_path, committed=False)  # a crashed write keeps its number
    nxt = (max(existing) + 1) if existing else 1
    path = f"{root.rstrip('/')}/version={nxt:010d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def _versions(fs, root_path, committed: bool = True) -> list[int]:
    if not fs.exists(root_path):
        return []
    out = []
    for st in fs.listStatus(root_path):
        name = st.getPath().getName()
        if name.startswith("version=") and (not committed or fs.exists(st.getPath().suffix("/_SUCCESS"))):
            out.append(int(name.split("=", 1)[1]))
    return out


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    jvm = spark._jvm
    root_path = jvm.org.apache.hadoop.fs.Path(root)
    fs = root_path.getFileSystem(spark._jsc.hadoopConfiguration())
    vs = _versions(fs, root_path)
    if not vs:
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/version={max(vs):010d}")


def drop_versions(spark: SparkSession, root: str, *, keep: int) -> None:
    """Remove all but the ``keep`` newest committed versions (and older ones that never committed)."""
    root_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = root_path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = sorted(_versions(fs, root_path))[-keep:]
    for v in _versions(fs, root_path, committed=False):
        if newest and v < newest[0]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root_path, f"version={v:010d}"), True)


# --- images ------------------------------------------------------------------

def default_leaf_pools(spark: SparkSession) -> DataFrame:
    rows = [(top, leaf, LEAF_POOL_SIZE) for top, leaves in DEFAULT_LEAF_POOLS.items() for leaf in leaves]
    return literal_table(spark, rows, "category_top string, category_leaf string, n int")


def default_category_pools(spark: SparkSession) -> DataFrame:
    rows = [(top, CATEGORY_POOL_SIZE) for top in DEFAULT_CATEGORY_POOLS]
    return literal_table(spark, rows, "category_top string, n int")


POOL_ROWS = 10_000


def _small(pools: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted up to the limit, are few."""
    return F.broadcast(pools) if pools.limit(POOL_ROWS + 1).count() <= POOL_ROWS else pools


def _generic_count(pools: DataFrame) -> DataFrame:
    return pools.agg(F.max(F.when(F.col("category_top") == GENERIC_CATEGORY, F.col("n"))).alias("_gn"))


def assign_images(products: DataFrame, leaf_pools: DataFrame, pools: DataFrame) -> DataFrame:
    """Image path per product: leaf pool, else category pool, else generic pool, else icon.

    Pool tables of up to ``POOL_ROWS`` rows (a literal table has tens) are
    broadcast, so the products side is not shuffled; larger ones are joined plainly.
    """
    lp = _small(leaf_pools.select("category_top", "category_leaf", F.col("n").alias("_ln")))
    cp = _small(pools.select("category_top", F.col("n").alias("_cn")))
    gp = F.broadcast(_generic_count(pools))
    p = (products.join(lp, ["category_top", "category_leaf"], "left")
         .join(cp, "category_top", "left").crossJoin(gp))
    pid = F.col("product_id")
    url = (F.when(F.col("category_top").isNotNull() & F.col("category_leaf").isNotNull() & (F.col("_ln") > 0),
                  F.format_string("/images/%s/leaf-%s/%d.jpg", "category_top", "category_leaf", pid % F.col("_ln") + 1))
            .when(F.col("category_top").isNotNull() & (F.col("_cn") > 0),
                  F.format_string("/images/%s/%d.jpg", "category_top", pid % F.col("_cn") + 1))
            .when(F.col("_gn") > 0, F.format_string("/images/generic/%d.jpg", pid % F.col("_gn") + 1))
            .otherwise(F.lit("/icons/generic.svg")))
    return p.withColumn("image_url", url).drop("_ln", "_cn", "_gn")


def category_cover(categories: DataFrame, pools: DataFrame, top_col: str = "category") -> DataFrame:
    """cover image of a category tile: first image of its pool, else generic, else icon."""
    cp = _small(pools.select(F.col("category_top").alias(top_col), F.col("n").alias("_cn")))
    gp = F.broadcast(_generic_count(pools))
    c = categories.join(cp, top_col, "left").crossJoin(gp)
    url = (F.when(F.col(top_col).isNotNull() & (F.col("_cn") > 0), F.format_string("/images/%s/1.jpg", top_col))
            .when(F.col("_gn") > 0, F.lit("/images/generic/1.jpg"))
            .otherwise(F.lit("/icons/generic.svg")))
    return c.withColumn("cover_url", url).drop("_cn", "_gn")


def leaf_share(catalog: DataFrame) -> DataFrame:
    """Products per (top, leaf) and their share inside the top category."""
    from pyspark.sql import Window
    c = (catalog.filter(F.col("category_top").isNotNull())
         .groupBy("category_top", "category_leaf").agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("category_top"))
    return c.withColumn("share", F.col("n") / total)

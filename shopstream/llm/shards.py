"""K-d tree sharding with distributed weighted medians (DataFrame operations only).

Every document is a point of metadata dimensions (size, characters, language, source,
id).  A node of the tree stands for a run of shards; it is split along the dimension
that is widest relative to the whole table, at the weighted quantile that leaves each
child its share of the bytes, until a leaf holds one shard's target bytes.

The quantile is found by histogram refinement: all nodes of a level share one
aggregation per round over (node, bin), each round narrowing the interval to
the values of one bin.  Only (nodes x bins) sums reach the driver, both bounded by
parameters.  Points with equal values are cut by a hash of (id, text checksum), so a
source or a language with a third of the rows splits like any other; rows that repeat id
and text are told apart by their number in the stored table, so they split too.

The text is read once, for its size and checksum; afterwards only a narrow table in
the shared folder is read.  Slots are numbered within (shard, hash bucket), buckets
sized by the row count, plus the offset of the bucket, so no task numbers a whole shard.

Defined results: null text counts 0 bytes and has the checksum of the empty text; null
metadata sorts before all values; empty table gives no rows; repeated rows get slots of
their own; with fewer documents than shards some shards stay empty; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstream.session import shared_table

OVERHEAD_BYTES = 16
TIE_RANGE = 1 << 62
COPY_BITS = 20  # low bits of a tie, which differ between rows of one id and text


def _code(c: Column) -> Column:
    """A string dimension as a number: nulls first, equal strings together."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(-1)).cast("long")


def metadata_points(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + OVERHEAD_BYTES).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.array(size, F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)), _code(F.col("lang")), _code(F.col("source")),
                F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).alias("dims"))


class _Node:
    """A run of shards and, once searched, its cut: value and tie of the last point on the left."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards, self.left_shards = first, shards, shards // 2
        self.dim, self.value, self.tie, self.done = 0, 0, 0, True  # as a node without points stays

    def begin(self, bytes_: int, lows: Sequence[int], highs: Sequence[int], roots: Sequence[int]) -> None:
        spread = [(h - low) / r if r else 0.0 for low, h, r in zip(lows, highs, roots)]
        self.dim = max(range(len(spread)), key=spread.__getitem__)
        self.bytes, self.before, self.done = bytes_, 0, False
        self.target = bytes_ * self.left_shards / self.shards
        self.low, self.high, self.value, self.tie = lows[self.dim], highs[self.dim], None, None

    def step(self, bins: int) -> int:
        return -(-(self.high - self.low + 1) // bins)

    def narrow(self, sums: list[tuple[int, int, int]], slack: float) -> None:
        """sums: (least value, greatest value, bytes) of each bin that holds points."""
        run = self.before
        for low, high, bytes_ in sorted(sums):
            after = run + bytes_
            if after >= self.target:
                break
            run = after
        else:
            run = after - bytes_
        for cut, off in ((low - 1, self.target - run), (high, after - self.target)):
            if off <= slack:  # a bin boundary is near enough
                return self._settle(cut)
        self.low, self.high, self.before = low, high, run
        if low == high:
            if self.value is None:  # one value left: go on among its hashes
                self.value, self.low, self.high = low, 0, TIE_RANGE - 1
            else:  # one point left: put it on the side that it unbalances less
                self._settle(low if after - self.target < self.target - run else low - 1)

    def _settle(self, cut: int) -> None:
        if self.value is None:
            self.value, self.tie = cut, TIE_RANGE
        else:
            self.tie = cut
        self.done = True


def kd_shards(points: DataFrame, n_shards: int, *, bins: int = 4096, slack: float = 0.002) -> DataFrame:
    """``points`` (size, dims, doc_id, text_crc32) plus ``shard``.

    ``slack``: how far, in shares of one shard's bytes, a cut may be from its target
    before it is refined down to single documents.
    """
    n_dims = 5
    # node: index into the level's list of nodes; a finished leaf is -1 - shard
    own = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(TIE_RANGE >> COPY_BITS))
    copy = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << COPY_BITS))  # fixed once the table is written
    tagged = shared_table(points.withColumn("tie", F.shiftleft(own, COPY_BITS) + copy).withColumn(
        "node", F.lit(0 if n_shards > 1 else -1)), "level")
    nodes, roots, near = [_Node(0, n_shards)] if n_shards > 1 else [], None, 0.0
    while nodes:
        stats = {r["node"]: r for r in tagged.where("node >= 0").groupBy("node").agg(
            F.sum("size").alias("bytes"),
            F.array(*[F.min(F.col("dims")[i]) for i in range(n_dims)]).alias("lows"),
            F.array(*[F.max(F.col("dims")[i]) for i in range(n_dims)]).alias("highs")).collect()}
        if roots is None and stats:
            r = stats[0]
            roots = [h - low for low, h in zip(r["lows"], r["highs"])]
            near = slack * r["bytes"] / n_shards
        for i, x in enumerate(nodes):
            if i in stats:
                x.begin(stats[i]["bytes"], stats[i]["lows"], stats[i]["highs"], roots)
        while pending := {i: x for i, x in enumerate(nodes) if not x.done}:
            of = _lookup(len(nodes), pending)
            dim, value, low = of(lambda x: x.dim), of(lambda x: x.value), of(lambda x: x.low)
            seen = (tagged.where("node >= 0").withColumn("dim", dim).where(F.col("dim").isNotNull())
                    .withColumn("value", value).withColumn("on", F.get("dims", F.col("dim").cast("int")))
                    .where(F.col("value").isNull() | (F.col("on") == F.col("value")))
                    .withColumn("v", F.when(F.col("value").isNull(), F.col("on")).otherwise(F.col("tie")))
                    .withColumn("low", low).withColumn("step", of(lambda x: x.step(bins)))
                    .where(F.col("v").between(F.col("low"), of(lambda x: x.high)))
                    .groupBy("node", F.expr("(v - low) div step").alias("bin"))
                    .agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("size").alias("bytes")))
            sums: dict[int, list[tuple[int, int, int]]] = {}
            for r in seen.collect():
                sums.setdefault(r["node"], []).append((r["least"], r["most"], r["bytes"]))
            for i, x in pending.items():
                x.narrow(sums[i], near)
        of = _lookup(len(nodes), dict(enumerate(nodes)))
        on = F.get("dims", of(lambda x: x.dim).cast("int"))
        left = (on < of(lambda x: x.value)) | ((on == of(lambda x: x.value)) & (F.col("tie") <= of(lambda x: x.tie)))
        below, ids = [], []
        for x in nodes:
            for child in (_Node(x.first, x.left_shards), _Node(x.first + x.left_shards, x.shards - x.left_shards)):
                ids.append(len(below) if child.shards > 1 else -1 - child.first)
                if child.shards > 1:
                    below.append(child)
        child_of = F.array(*[F.lit(i) for i in ids])
        tagged = (tagged.withColumn("left", left)
                  .withColumn("node", F.when(F.col("node") < 0, F.col("node")).otherwise(
                      F.get(child_of, 2 * F.col("node") + F.when(F.col("left"), 0).otherwise(1)))).drop("left"))
        nodes = below
        if nodes:  # a level's rounds read a narrow table rather than the cuts of all levels above
            tagged = shared_table(tagged, "level")
    return tagged.withColumn("shard", -1 - F.col("node")).drop("node")


def _lookup(n: int, nodes: dict[int, _Node]):
    """Makes columns that hold an attribute of the row's node (null for other nodes); at most one literal a node."""
    def of(attribute) -> Column:
        values = [F.lit(attribute(nodes[i]) if i in nodes else None).cast("long") for i in range(n)]
        return F.get(F.array(*values), F.col("node"))
    return of


def with_slots(sharded: DataFrame, n_rows: int, n_shards: int, *, bucket_rows: int = 2000) -> DataFrame:
    """Gapless ``slot`` from 0 in each shard, ordered by (hash bucket, hash, id)."""
    n_bucket = max(1, -(-n_rows // (bucket_rows * n_shards)))
    rows = sharded.withColumn("bucket", F.pmod("tie", F.lit(n_bucket)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id", "text_crc32")
    return (rows.withColumn("no", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
            .withColumn("slot", F.col("offset") + F.col("no") - 1).drop("bucket", "no", "offset"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    sharded = shared_table(kd_shards(metadata_points(docs), n_shards), "shards")
    out = with_slots(sharded, sharded.count(), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)

"""Cart lines of any length: the tree of transformers against a plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shopstream.operators import cart_fold

CMD = "seq long, cart_id string, op string, product_id long, quantity int, at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def plain(cmds, items=()):
    """(final lines, rejected seqs) by applying the commands one by one."""
    lines = {(c, p): (q, at) for c, p, q, at in items}
    rejected = []
    for seq, c, op, p, q, at in sorted(cmds):
        old = lines.get((c, p))
        if op == "add":
            lines[c, p] = (old[0] + q, old[1]) if old else (q, at)
        elif old is None:
            rejected.append(seq)
        elif op == "del" or q <= 0:
            del lines[c, p]
        else:
            lines[c, p] = (q, old[1])
    return lines, sorted(rejected)


def run(spark, cmds, items=None, **sizes):
    init = None if items is None else spark.createDataFrame(items, "cart_id string, product_id long, quantity int, added_at timestamp_ntz")
    final, rejects = cart_fold.fold_commands(spark.createDataFrame(cmds, CMD), init, **sizes)
    return {(r.cart_id, r.product_id): (r.quantity, r.added_at) for r in final.collect()}, sorted(r.seq for r in rejects.collect())


def random_commands(rng, n, spread):
    seqs = rng.sample(range(spread), n)
    out = []
    for seq in seqs:
        op = rng.choice(["add", "set", "del", "del"])
        line = ("hot", 1) if rng.random() < 0.7 else (f"c{rng.randrange(5)}", rng.randrange(4))
        out.append((seq, line[0], op, line[1], rng.randint(1, 5) if op == "add" else rng.randint(0, 3) if op == "set" else None, T0 + dt.timedelta(seconds=seq % 1000)))
    return out


@pytest.mark.parametrize("seed, spread, sizes", [(1, 2_000, {"bucket_rows": 8, "fanout": 3}), (2, 10 ** 15, {"bucket_rows": 4, "fanout": 2}),
                                                 (3, 900, {"bucket_rows": 16, "fanout": 64}), (4, 10 ** 9, {"bucket_rows": 256, "fanout": 5})])
def test_tree_equals_plain_fold(spark, seed, spread, sizes):
    rng = random.Random(seed)
    cmds = random_commands(rng, 700, spread)
    items = [("hot", 1, 4, T0), ("c1", 2, 1, T0), ("quiet", 9, 7, T0)]
    for init in (None, items):
        assert run(spark, cmds, init, **sizes) == plain(cmds, init or ())


def test_empty_log(spark):
    assert run(spark, []) == ({}, [])
    assert run(spark, [], [("c", 1, 2, T0)]) == ({("c", 1): (2, T0)}, [])


def test_a_line_with_sparse_commands_and_many_rejects(spark):
    """300,000 commands of one line, far apart in seq; 65,536 of them find no line."""
    n, rejected = 300_000, 65_536
    op = F.when(F.col("id") < rejected, "del").otherwise("add")
    cmds = spark.range(n).select((F.col("id") * 1_000_003).alias("seq"), F.lit("hot").alias("cart_id"), op.alias("op"), F.lit(1).cast("long").alias("product_id"),
                                 F.when(F.col("id") >= rejected, 1).alias("quantity"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    final, rejects = cart_fold.fold_commands(cmds, None)
    assert [r.quantity for r in final.collect()] == [n - rejected]
    assert rejects.agg(F.count("*"), F.min("seq"), F.max("seq")).first() == (rejected, 0, (rejected - 1) * 1_000_003)


def test_no_array_grows_with_a_line(spark, monkeypatch):
    sizes = []
    real = cart_fold._children

    def watched(nodes, *by):
        out = real(nodes, *by)
        sizes.append(out.agg(F.max(F.size("_kids"))).first()[0])
        return out
    monkeypatch.setattr(cart_fold, "_children", watched)
    cmds = spark.range(20_000).select((F.col("id") * 977).alias("seq"), F.lit("hot").alias("cart_id"), F.lit("add").alias("op"), F.lit(1).cast("long").alias("product_id"),
                                      F.lit(1).alias("quantity"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    final, _ = cart_fold.fold_commands(cmds, None, bucket_rows=64, fanout=16)
    assert final.first().quantity == 20_000 and len(sizes) >= 3 and max(sizes) <= 16

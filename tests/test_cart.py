import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from shopstream.operators import cart

T0 = dt.datetime(2024, 1, 1)
CMD = "seq long, cart_id string, op string, product_id long, quantity int, at timestamp_ntz"


def naive(commands, existing, initial=None):
    state = dict(initial or {})
    rejects = []
    for seq, cid, op, pid, q, at in sorted(commands):
        key = (cid, pid)
        if cid is None or not 1 <= len(cid) <= 36:
            rejects.append((seq, "bad_cart_id")); continue
        if op not in ("add", "set", "del"):
            rejects.append((seq, "bad_op")); continue
        if op == "add" and (q is None or q < 1):
            rejects.append((seq, "bad_quantity")); continue
        if op == "set" and q is None:
            rejects.append((seq, "bad_quantity")); continue
        if op == "add" and pid not in existing:
            rejects.append((seq, "unknown_product")); continue
        if op == "add":
            if key in state:
                state[key] = (state[key][0] + q, state[key][1])
            else:
                state[key] = (q, at)
        elif key not in state:
            rejects.append((seq, "not_in_cart"))
        elif op == "del" or q <= 0:
            del state[key]
        else:
            state[key] = (q, state[key][1])
    return state, sorted(rejects)


def run(spark, cmds, existing, initial=None):
    prods = spark.createDataFrame([(p,) for p in existing], "product_id long")
    items = None
    if initial:
        items = spark.createDataFrame([(c, p, q, a) for (c, p), (q, a) in initial.items()], cart.ITEM_SCHEMA)
    it, rej, carts = cart.apply_cart_commands(spark.createDataFrame(cmds, CMD), prods, items)
    state = {(r.cart_id, r.product_id): (r.quantity, r.added_at) for r in it.collect()}
    return state, sorted((r.seq, r.reason) for r in rej.collect()), carts


def test_rules(spark):
    cmds = [(1, "c", "add", 1, 2, T0), (2, "c", "add", 1, 3, T0 + dt.timedelta(1)),
            (3, "c", "set", 1, 0, T0), (4, "c", "add", 1, 1, T0 + dt.timedelta(2)),
            (5, "c", "set", 2, 4, T0), (6, "c", "del", 2, None, T0), (7, "c", "add", 9, 1, T0),
            (8, "c", "add", 2, 0, T0), (9, "c", "add", 2, -1, T0), (10, "", "add", 1, 1, T0),
            (11, "c" * 37, "add", 1, 1, T0), (12, "c", "add", 3, 1, T0), (13, "c", "set", 3, -2, T0)]
    state, rejects, carts = run(spark, cmds, {1, 2, 3})
    assert state == {("c", 1): (1, T0 + dt.timedelta(2))}  # deleted by set 0, re-added with a new added_at
    assert rejects == [(5, "not_in_cart"), (6, "not_in_cart"), (7, "unknown_product"), (8, "bad_quantity"),
                       (9, "bad_quantity"), (10, "bad_cart_id"), (11, "bad_cart_id")]
    assert carts.count() == 1
    exp_state, exp_rej = naive(cmds, {1, 2, 3})
    assert (state, rejects) == (exp_state, exp_rej)


def test_initial_items(spark):
    init = {("c", 1): (5, T0), ("c", 2): (1, T0)}
    cmds = [(1, "c", "add", 1, 2, T0 + dt.timedelta(1)), (2, "c", "set", 2, 7, T0), (3, "d", "del", 1, None, T0)]
    assert run(spark, cmds, {1, 2}, init)[:2] == naive(cmds, {1, 2}, init)


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10_000))
def test_random_logs_match_naive_fold(spark, seed):
    rnd = random.Random(seed)
    cmds = []
    for seq in range(1, rnd.randint(1, 40)):
        op = rnd.choice(["add", "add", "set", "del", "bogus"])
        q = rnd.choice([None, -1, 0, 1, 2, 5])
        cmds.append((seq, rnd.choice(["a", "b", ""]), op, rnd.choice([1, 2, 3, 99]), q,
                     T0 + dt.timedelta(minutes=rnd.randint(0, 100))))
    got = run(spark, cmds, {1, 2, 3})[:2]
    assert got == naive(cmds, {1, 2, 3})


def test_view_and_totals(spark):
    from decimal import Decimal
    prods = spark.createDataFrame([(1, "P1", None, Decimal("1.10"), "i"), (2, "P2", "b", None, "i")],
                                  "product_id long, display_name string, brand string, price decimal(10,2), image_ref string")
    items = spark.createDataFrame([("c", 1, 3, T0), ("c", 2, 2, T0)], cart.ITEM_SCHEMA)
    carts = spark.createDataFrame([("c",), ("empty",)], "cart_id string")
    v = cart.cart_view(items, prods)
    lines = {r.product_id: float(r.line_total) for r in v.collect()}
    assert lines == {1: 3.3, 2: 0.0}
    t = {r.cart_id: (r.total_items, r.total_price) for r in cart.cart_totals(v, carts).collect()}
    assert t == {"c": (5, 3.3), "empty": (0, 0.0)}


def test_ordered_lines(spark):
    from decimal import Decimal
    prods = spark.createDataFrame([(p, f"P{p}", None, Decimal("1.00"), "i") for p in range(1, 6)],
                                  "product_id long, display_name string, brand string, price decimal(10,2), image_ref string")
    items = spark.createDataFrame([("c", p, 1, T0 + dt.timedelta(minutes=10 - p)) for p in range(1, 6)]
                                  + [("d", 1, 1, T0)], cart.ITEM_SCHEMA)
    rows = cart.ordered_lines(cart.cart_view(items, prods)).collect()
    assert [r.product_id for r in rows if r.cart_id == "c"] == [5, 4, 3, 2, 1]

"""Cart command log as an associative fold: a tree of transformers, every group bounded.

Every command is a state transformer for one cart line.  A transformer is
stored as two branches: the result when the line is absent (``ap`` present?,
``aq`` quantity, ``aat`` added_at) and the action when it is present
(``pk`` 0 remove, 1 add ``pq``, 2 set to ``pq``, 3 replace by a fresh line
``pq``/``pat``).  Composition of two transformers is again one, so:

1. commands are grouped by (line, seq range of ``bucket_rows``) and folded in seq order
   into one transformer a leaf; the leaves are written once;
2. lines with at most ``fanout`` leaves fold these from the initial state, which gives the
   state at the start of every leaf and the final state;
3. longer lines compose their leaves upward, ``fanout`` neighbours into one node, level by
   level until at most ``fanout`` nodes a line are left, fold those like the short lines,
   and hand start states down the same levels.  No array holds more than ``fanout``
   nodes, whatever the length of a line, and its nodes are spread over all tasks;
4. each leaf is folded once more from its start state to list the set/del
   commands that found no line (rejections).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstream.session import shared_table

KEY = ["cart_id", "product_id"]
_T = "struct<ap:boolean,aq:int,aat:timestamp_ntz,pk:int,pq:int,pat:timestamp_ntz>"
_S = "struct<present:boolean,qty:int,at:timestamp_ntz>"
_STARTS = f"array<struct<_b:bigint,s:{_S}>>"


def _lit_null(t: str) -> Column:
    return F.lit(None).cast(t)


def _t(ap, aq, aat, pk, pq, pat) -> Column:
    return F.struct(F.lit(ap).cast("boolean").alias("ap") if not isinstance(ap, Column) else ap.alias("ap"),
                    (aq if isinstance(aq, Column) else F.lit(aq)).cast("int").alias("aq"),
                    (aat if isinstance(aat, Column) else _lit_null("timestamp_ntz")).cast("timestamp_ntz").alias("aat"),
                    (pk if isinstance(pk, Column) else F.lit(pk)).cast("int").alias("pk"),
                    (pq if isinstance(pq, Column) else F.lit(pq)).cast("int").alias("pq"),
                    (pat if isinstance(pat, Column) else _lit_null("timestamp_ntz")).cast("timestamp_ntz").alias("pat"))


def _identity() -> Column:
    return _t(False, None, None, 1, 0, None)


def command_transformer(op: Column, q: Column, at: Column) -> Column:
    """The transformer of one valid command."""
    is_add = op == "add"
    is_rm = (op == "del") | ((op == "set") & (q <= 0))
    return (F.when(is_add, _t(F.lit(True), q, at, 1, q, None))
             .when(is_rm, _t(F.lit(False), None, None, 0, None, None))
             .otherwise(_t(F.lit(False), None, None, 2, q, None)))


def compose(f: Column, g: Column) -> Column:
    """Apply ``f`` then ``g``."""
    # absent branch: f makes a line (or not), then g's present action applies to it
    a_from_f = (F.when(g["pk"] == 0, _t(F.lit(False), None, None, 0, None, None))
                 .when(g["pk"] == 1, _t(F.lit(True), f["aq"] + g["pq"], f["aat"], 0, None, None))
                 .when(g["pk"] == 2, _t(F.lit(True), g["pq"], f["aat"], 0, None, None))
                 .otherwise(_t(F.lit(True), g["pq"], g["pat"], 0, None, None)))
    a = F.when(f["ap"], a_from_f).otherwise(g)
    # present branch
    p_after_rm = F.when(g["ap"], _t(F.lit(False), None, None, 3, g["aq"], g["aat"])).otherwise(
        _t(F.lit(False), None, None, 0, None, None))
    p_after_add = (F.when(g["pk"] == 0, _t(F.lit(False), None, None, 0, None, None))
                    .when(g["pk"] == 1, _t(F.lit(False), None, None, F.when(f["pk"] == 3, 3).otherwise(f["pk"]),
                                           f["pq"] + g["pq"], f["pat"]))
                    .when(g["pk"] == 2, _t(F.lit(False), None, None, F.when(f["pk"] == 3, 3).otherwise(2),
                                           g["pq"], f["pat"]))
                    .otherwise(_t(F.lit(False), None, None, 3, g["pq"], g["pat"])))
    p = F.when(f["pk"] == 0, p_after_rm).otherwise(p_after_add)
    return _t(a["ap"], a["aq"], a["aat"], p["pk"], p["pq"], p["pat"])


def then_command(f: Column, op: Column, q: Column, at: Column) -> Column:
    """``compose(f, command_transformer(op, q, at))``, written out so that each field is worked out once."""
    is_add = op == "add"
    is_rm = (op == "del") | ((op == "set") & (q <= 0))
    gone = f["pk"] == 0
    nothing = _lit_null("int")
    never = _lit_null("timestamp_ntz")
    return F.struct(
        F.when(is_add, True).when(is_rm, False).otherwise(f["ap"]).alias("ap"),
        F.when(is_add, F.when(f["ap"], f["aq"] + q).otherwise(q)).when(is_rm, nothing).otherwise(F.when(f["ap"], q)).alias("aq"),
        F.when(is_add, F.when(f["ap"], f["aat"]).otherwise(at)).when(is_rm, never).otherwise(F.when(f["ap"], f["aat"])).alias("aat"),
        F.when(is_add, F.when(gone, 3).otherwise(f["pk"])).when(is_rm, 0).otherwise(F.when(gone, 0).when(f["pk"] == 3, 3).otherwise(2)).alias("pk"),
        F.when(is_add, F.when(gone, q).otherwise(f["pq"] + q)).when(is_rm, nothing).otherwise(F.when(~gone, q)).alias("pq"),
        F.when(is_add, F.when(gone, at).otherwise(f["pat"])).when(is_rm, never).otherwise(F.when(~gone, f["pat"])).alias("pat")).cast(_T)


def apply_to(t: Column, s: Column) -> Column:
    """State after transformer ``t`` from state ``s``."""
    absent = F.struct(t["ap"].alias("present"), t["aq"].alias("qty"), t["aat"].alias("at"))
    present = (F.when(t["pk"] == 0, F.struct(F.lit(False).alias("present"), _lit_null("int").alias("qty"),
                                             _lit_null("timestamp_ntz").alias("at")))
                .when(t["pk"] == 1, F.struct(F.lit(True).alias("present"), (s["qty"] + t["pq"]).alias("qty"),
                                             s["at"].alias("at")))
                .when(t["pk"] == 2, F.struct(F.lit(True).alias("present"), t["pq"].alias("qty"), s["at"].alias("at")))
                .otherwise(F.struct(F.lit(True).alias("present"), t["pq"].alias("qty"), t["pat"].alias("at"))))
    out = F.when(F.coalesce(s["present"], F.lit(False)), present).otherwise(absent)
    return out.cast(_S)


def _leaves(valid: DataFrame, bucket_rows: int) -> DataFrame:
    """(line, _b, _cmds, _t): the commands of each leaf in order, and their transformer."""
    cmd = F.struct("seq", "op", F.col("quantity").alias("q"), "at")
    leaves = valid.groupBy(*KEY, F.floor(F.col("seq") / F.lit(bucket_rows)).alias("_b")).agg(F.sort_array(F.collect_list(cmd)).alias("_cmds"))
    one = F.col("_cmds")[0]
    folded = F.aggregate("_cmds", _identity().cast(_T), lambda acc, x: then_command(acc, x["op"], x["q"], x["at"]))
    return leaves.withColumn("_t", F.when(F.size("_cmds") == 1, command_transformer(one["op"], one["q"], one["at"]).cast(_T)).otherwise(folded))


def _children(nodes: DataFrame, *by) -> DataFrame:
    return nodes.groupBy(*KEY, *by).agg(F.sort_array(F.collect_list(F.struct("_b", "_t"))).alias("_kids"))


def _walk(kids: Column, start: Column) -> Column:
    """Struct of the state after all ``kids`` (``s``) and the state before each (``starts``)."""
    acc = F.struct(start.alias("s"), F.array().cast(_STARTS).alias("starts"))
    walked = F.aggregate(kids, acc, lambda a, x: F.struct(
        apply_to(x["_t"], a["s"]).alias("s"),
        F.concat(a["starts"], F.array(F.struct(x["_b"].alias("_b"), a["s"].alias("s")))).alias("starts")))
    one = F.struct(apply_to(kids[0]["_t"], start).alias("s"), F.array(F.struct(kids[0]["_b"].alias("_b"), start.alias("s"))).cast(_STARTS).alias("starts"))
    return F.when(F.size(kids) == 1, one).otherwise(walked)


def _handed_down(walked: DataFrame) -> DataFrame:
    return walked.select(*KEY, F.explode("_f.starts").alias("_st")).select(*KEY, F.col("_st._b").alias("_b"), F.col("_st.s").alias("_s0"))


def fold_commands(valid: DataFrame, items: DataFrame | None, *, bucket_rows: int = 256, fanout: int = 64) -> tuple[DataFrame, DataFrame]:
    """(final lines, stateful rejections) for statically valid commands."""
    leaves = shared_table(_leaves(valid, bucket_rows), "leaves")
    nodes = leaves.select(*KEY, "_b", "_t")
    # levels above the leaves of long lines; each node keeps its children for the way down
    levels: list[DataFrame] = []
    sizes = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fanout)
    long = shared_table(sizes.select(*KEY), "long-lines")
    short, tops = nodes, nodes
    if not long.isEmpty():
        short, level = nodes.join(long, KEY, "left_anti"), nodes.join(long, KEY, "left_semi")
        while True:
            parents = _children(level.withColumn("_up", F.floor(F.col("_b") / fanout)), "_up").withColumnRenamed("_up", "_b")
            parents = parents.withColumn("_t", F.aggregate("_kids", _identity().cast(_T), lambda acc, x: compose(acc, x["_t"]).cast(_T)))
            levels.append(shared_table(parents, "level"))
            level = levels[-1].select(*KEY, "_b", "_t")
            if level.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fanout).isEmpty():
                break
        tops = short.unionByName(level)
    lines = _children(tops)
    absent = F.struct(F.lit(False).alias("present"), _lit_null("int").alias("qty"),
                      _lit_null("timestamp_ntz").alias("at")).cast(_S)
    start = absent
    if items is not None:
        init = items.select(*KEY, F.struct(F.lit(True).alias("present"), F.col("quantity").cast("int").alias("qty"),
                                           F.col("added_at").cast("timestamp_ntz").alias("at")).cast(_S).alias("_init"))
        lines = lines.join(init, KEY, "full")
        start = F.coalesce(F.col("_init"), absent)
    kids = F.coalesce(F.col("_kids"), F.array().cast(f"array<struct<_b:bigint,_t:{_T}>>"))
    walked = lines.withColumn("_f", _walk(kids, start)).select(*KEY, "_f")
    if levels:
        walked = shared_table(walked, "walked")
    final = walked.filter(F.col("_f.s.present")).select(
        *KEY, F.col("_f.s.qty").alias("quantity"), F.col("_f.s.at").alias("added_at"))
    starts = _handed_down(walked)
    if levels:
        below = starts.join(long, KEY, "left_semi")
        for level in reversed(levels):
            below = _handed_down(level.join(below, [*KEY, "_b"]).select(*KEY, _walk(F.col("_kids"), F.col("_s0")).alias("_f")))
        starts = starts.join(long, KEY, "left_anti").unionByName(below)
    # rejections: replay each leaf from its start state
    replay = leaves.select(*KEY, "_b", "_cmds").join(starts, [*KEY, "_b"], "inner")
    # only whether the line is there counts: an add makes it, a removal ends it, another set leaves it as it is
    acc1 = F.struct(F.coalesce("_s0.present", F.lit(False)).alias("there"), F.array().cast("array<struct<seq:bigint,op:string>>").alias("rej"))
    is_rm = lambda x: (x["op"] == "del") | ((x["op"] == "set") & (x["q"] <= 0))
    missed = lambda x, there: x["op"].isin("set", "del") & ~there
    named = lambda x: F.array(F.struct(x["seq"].alias("seq"), x["op"].alias("op")))
    one = F.col("_cmds")[0]
    replayed = F.aggregate(
        "_cmds", acc1,
        lambda acc, x: F.struct(
            ((x["op"] == "add") | (acc["there"] & ~is_rm(x))).alias("there"),
            F.when(missed(x, acc["there"]), F.concat(acc["rej"], named(x))).otherwise(acc["rej"]).alias("rej")))["rej"]
    rep = replay.select(*KEY, F.when(F.size("_cmds") == 1, F.when(missed(one, F.coalesce("_s0.present", F.lit(False))), named(one))).otherwise(replayed).alias("_rej"))
    rejects = rep.select(*KEY, F.explode("_rej").alias("_x")).select("_x.seq", *KEY, "_x.op")
    return final, rejects

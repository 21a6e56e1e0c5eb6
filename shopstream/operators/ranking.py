"""Exact top-k ranking of next items that reads only the head of each source's list.

A session's score for an item is a sum over its recent items of weight * p(item | source).
``Postings`` keeps each source's destinations by falling p, cut into blocks: the first
``HEAD`` entries, then blocks that double up to ``WIDE`` entries.  A session reads

1. the head of every recent source's list.  The ``need``-th entry of one list (need = k plus
   the items that may be excluded) is a lower bound of the k-th best score;
2. of longer lists, the further blocks whose entries exceed a cut.  The cut is chosen by
   water-filling so that all unread contributions of a session together stay below a
   share (``SLACK``) of the bound: an item that was not read at all cannot reach it;
3. for items that can still reach the bound, the missing contributions, by joining
   (source, item) with the model.

Scores are ranked after rounding, so the bound is lowered by one rounding step; scores
that round to zero rank by popularity, and popular items are always candidates.  The result
equals ranking all destinations of all recent sources.

Frequent sources (OTHER, best sellers) are spread: a source with more than 1 / ``HOT`` of
all list reads gets salts in proportion to its share, and its rows of the model are
repeated once a salt, at most about as many in all as there are shuffle partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstream.constants import NUM_SPECIAL_TOKENS
from shopstream.session import shared_table

SCORE_DECIMALS = 9  # scores are rounded before ranking so engines agree on ties
HEAD = 64           # entries read of every list
WIDE = 4096         # most entries of one block (HEAD times a power of two)
SLACK = 0.5         # share of the bound that unread contributions may reach
HOT = 64
FILL = 64           # popular items kept as one array beyond k
ROUNDING = 1.1 * 10 ** -SCORE_DECIMALS
LEAST = 0.4 * 10 ** -SCORE_DECIMALS  # what is below rounds to zero

_DOUBLINGS = (WIDE // HEAD).bit_length() - 1


def block_number(rank0: Column) -> Column:
    """Block of an entry by its 0-based rank: HEAD entries, HEAD, 2 HEAD, ... WIDE, WIDE, WIDE ..."""
    doubled = F.length(F.bin(F.floor(rank0 / HEAD).cast("long")))
    return (F.when(rank0 < HEAD, 0).when(rank0 < 2 * WIDE, doubled)
            .otherwise(F.floor(rank0 / WIDE) + F.lit(_DOUBLINGS)).cast("int"))


@dataclass
class Postings:
    heads: DataFrame         # (src, head array<struct<dst, p, prior_n>>, tops array<double>: first p of each further block)
    tails: DataFrame | None  # (src, block, entries); None where no list is longer than HEAD
    entries: DataFrame       # (src, dst, p, prior_n)
    prior: DataFrame         # (dst, prior_n)


def build_postings(model: DataFrame, prior: DataFrame) -> Postings:
    """Posting blocks of a model (src, dst, p) with the prior counts of its destinations.

    One row a block, at most ``WIDE`` entries each; written once to the shared folder.
    """
    entries = model.join(prior.select("dst", "prior_n"), "dst", "left").select("src", "dst", "p", F.coalesce("prior_n", F.lit(0)).alias("prior_n"))
    falling = Window.partitionBy("src").orderBy(F.col("p").desc(), "dst")
    blocks = shared_table(
        entries.withColumn("r", F.row_number().over(falling) - 1).withColumn("block", block_number(F.col("r"))).groupBy("src", "block")
        .agg(F.array_sort(F.collect_list(F.struct("r", "dst", "p", "prior_n"))).alias("e"))
        .select("src", "block", F.transform("e", lambda x: F.struct(x["dst"].alias("dst"), x["p"].alias("p"), x["prior_n"].alias("prior_n"))).alias("entries")),
        "postings")
    heads = blocks.where("block = 0").select("src", F.col("entries").alias("head"))
    tails = blocks.where("block > 0")
    if tails.isEmpty():
        return Postings(heads.withColumn("tops", F.array().cast("array<double>")), None, entries, prior)
    tops = (tails.select("src", "block", F.element_at("entries", 1)["p"].alias("top")).groupBy("src")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "top"))), lambda x: x["top"]).alias("tops")))
    heads = heads.join(tops, "src", "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<double>")))
    return Postings(heads, tails, shared_table(entries, "entries"), prior)


def recent_sources(sessions: DataFrame, tokens: str, *, key: str, max_lag: int | Column, decay: float | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, src, weight, ...): weight sums decay^(lag-1) over the places of src among the last ``max_lag`` items."""
    max_lag, decay = (v if isinstance(v, Column) else F.lit(v) for v in (max_lag, decay))
    last = F.reverse(F.slice(tokens, F.greatest(F.size(tokens) - max_lag + 1, F.lit(1)), max_lag))
    rows = sessions.where(F.size(tokens) > 0).withColumn("_last", last)
    weighted = F.transform(F.array_distinct("_last"), lambda s: F.struct(
        s.alias("src"),
        F.aggregate(F.sequence(F.lit(1), F.size("_last")), F.lit(0.0),
                    lambda total, lag: total + F.when(F.element_at("_last", lag) == s, F.pow(decay.cast("double"), lag - 1)).otherwise(0.0)).alias("weight")))
    return rows.select(key, *keep, F.inline(weighted))


def source_salts(recent: DataFrame) -> dict[int, int]:
    """Salts of the frequent sources (fewer than HOT), in proportion to their share."""
    n = int(recent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = recent.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > F.lit(total)).collect()
    return {r["src"]: -(-r["n"] * n // total) for r in hot if r["n"] * n > total}


def _salts(salts: dict[int, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])[F.col("src")], F.lit(1))


def _meet(left: DataFrame, right: DataFrame, on: list[str], salts: dict[int, int], key: str) -> DataFrame:
    """Inner join on columns with src, frequent sources spread by their salts."""
    if not salts:
        return left.join(right, on)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(key), _salts(salts).cast("long")).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(salts) - 1)))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def session_bounds(lists: DataFrame, *, key: str) -> DataFrame:
    """(key, src, weight, blocks, cut, floor) of the lists longer than a head.

    ``blocks`` further blocks hold entries whose contribution exceeds ``cut``; an item
    whose read contributions are below ``floor`` cannot be among the best.
    """
    need, tops, head = F.col("_need"), F.col("tops"), F.col("head")
    after = block_number(need - 1) + 1  # the first block that starts after ``need`` entries
    entry = (F.when(need <= F.size(head), F.try_element_at(head, need)["p"])
             .when(after <= F.size(tops), F.try_element_at(tops, after)).otherwise(0.0))
    narrow = lists.select(key, "src", "weight", "tops", (F.col("weight") * entry).alias("low"))
    per = narrow.groupBy(key).agg(F.max("low").alias("low"), F.collect_list(F.when(F.size("tops") > 0, F.struct("src", "weight", "tops"))).alias("long"))
    per = per.where(F.size("long") > 0).withColumn("bound", F.greatest(F.col("low") - ROUNDING, F.lit(LEAST)))
    rest = F.transform("long", lambda x: x["weight"] * x["tops"][0])  # at most max_lag values
    start = F.struct((F.col("bound") * SLACK).alias("room"), F.size("long").cast("double").alias("n"))
    filled = F.aggregate(F.array_sort(rest), start, lambda s, v: F.when(
        v * s["n"] <= s["room"], F.struct((s["room"] - v).alias("room"), (s["n"] - 1).alias("n"))).otherwise(s))
    per = per.withColumn("_filled", filled).withColumn(
        "cut", F.when(F.col("_filled.n") > 0, F.col("_filled.room") / F.col("_filled.n")).otherwise(F.lit(float("inf"))))
    unread = F.aggregate(rest, F.lit(0.0), lambda total, v: total + F.least(v, F.col("cut")))
    per = per.select(key, "cut", (F.col("bound") - unread).alias("floor"), F.explode("long").alias("x"))
    return per.select(key, F.col("x.src").alias("src"), F.col("x.weight").alias("weight"),
                      F.size(F.filter("x.tops", lambda p: F.col("x.weight") * p > F.col("cut"))).alias("blocks"), "cut", "floor")


def tail_entries(bounds: DataFrame, postings: Postings, salts: dict[int, int], *, key: str) -> DataFrame:
    """(key, dst, c, prior_n) of the entries beyond the heads whose contribution exceeds the session's cut."""
    reads = bounds.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    above = F.filter("entries", lambda e: F.col("weight") * e["p"] > F.col("cut"))
    met = _meet(reads, postings.tails, ["src", "block"], salts, key).select(key, "weight", above.alias("above")).repartition(key)
    return met.select(key, "weight", F.inline("above")).select(key, "dst", (F.col("weight") * F.col("p")).alias("c"), "prior_n")


def _popular(postings: Postings, sessions: DataFrame, *, k: int, key: str, mask: bool) -> DataFrame:
    """(key, dst, prior_n): the most popular items, ``_fill`` for each session."""
    prior = postings.prior.where(F.col("dst") >= NUM_SPECIAL_TOKENS) if mask else postings.prior
    best = F.col("prior_n").desc(), F.col("dst").asc()
    first = (prior.orderBy(*best).limit(k + FILL).agg(F.array_sort(F.collect_list(F.struct((-F.col("prior_n")).alias("o"), "dst", "prior_n"))).alias("best"))
             .select(F.transform("best", lambda x: F.struct(x["dst"].alias("dst"), x["prior_n"].alias("prior_n"))).alias("best")))
    near = sessions.crossJoin(F.broadcast(first)).select(key, F.inline(F.slice("best", 1, F.least(F.col("_fill"), F.lit(k + FILL)))))  # one row
    if not mask:
        return near  # nothing is excluded: k items suffice
    ranks = prior.select("dst", "prior_n", F.row_number().over(Window.orderBy(*best)).alias("_r"))  # bounded by the vocabulary
    far = (sessions.where(F.col("_fill") > k + FILL).select(key, F.explode(F.sequence(F.lit(k + FILL + 1), F.col("_fill"))).alias("_r"))
           .join(ranks, "_r").select(key, "dst", "prior_n"))
    return near.unionByName(far)


def rank_sessions(sessions: DataFrame, postings: Postings, *, k: int, key: str, tokens: str, max_lag: int | Column, decay: float | Column,
                  mask: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """(key, rank, token_id, score): the ``k`` best items of each session (``key`` is unique).

    Items that follow none of the recent items have score 0 and rank by popularity.
    Rank order: rounded score desc, prior desc, token asc.  ``mask`` leaves out special
    tokens, ``seen`` (key, dst) what a session is not to be shown.  ``max_lag`` and ``decay``
    may be columns of ``sessions``.
    """
    rows = sessions
    own = F.lit(0)
    if seen is not None:
        seen = seen.select(key, "dst").distinct()
        rows = rows.join(seen.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_own")), key, "left")
        own = F.coalesce("_own", F.lit(0))
    rows = rows.withColumn("_fill", (own + k).cast("int")).withColumn("_need", F.col("_fill") + (NUM_SPECIAL_TOKENS if mask else 0))
    recent = recent_sources(rows, tokens, key=key, max_lag=max_lag, decay=decay, keep=("_need",))
    zero = F.lit(0.0)
    # all candidates are dealt by session while they are still arrays (or one row a session), so that neither the
    # union, nor the sums by (session, item), nor the ranking shuffle them again; a session has at most a vocabulary of them
    fill = _popular(postings, rows.select(key, "_fill").repartition(key), k=k, key=key, mask=mask).select(key, "dst", zero.alias("done"), zero.alias("open"), "prior_n", F.lit(0).alias("seen"), F.lit(1).alias("fill"))
    if postings.tails is None:
        lists, bounds, salts = recent.join(postings.heads, "src"), None, {}
    else:
        recent = shared_table(recent, "recent")
        salts = source_salts(recent)
        lists = shared_table(_meet(recent, postings.heads, ["src"], salts, key), "lists")
        bounds = shared_table(session_bounds(lists, key=key), "bounds")
    c = F.col("weight") * F.col("p")
    is_open = F.col("_open")
    reads = (lists.select(key, "weight", (F.size("tops") > 0).alias("_open"), "head").repartition(key).select(key, "weight", "_open", F.inline("head"))
             .select(key, "dst", F.when(is_open, 0.0).otherwise(c).alias("done"), F.when(is_open, c).otherwise(0.0).alias("open"), "prior_n", F.lit(0).alias("seen"), F.lit(0).alias("fill")))
    if bounds is not None:
        reads = reads.unionByName(tail_entries(bounds, postings, salts, key=key).select(
            key, "dst", zero.alias("done"), F.col("c").alias("open"), "prior_n", F.lit(0).alias("seen"), F.lit(0).alias("fill")))
    if mask:
        reads = reads.where(F.col("dst") >= NUM_SPECIAL_TOKENS)
    reads = reads.unionByName(fill)
    if seen is not None:
        reads = reads.unionByName(seen.repartition(key).select(key, "dst", zero.alias("done"), zero.alias("open"), F.lit(0).cast("long").alias("prior_n"), F.lit(1).alias("seen"), F.lit(0).alias("fill")))
    found = reads.groupBy(key, "dst").agg(F.sum("done").alias("done"), F.sum("open").alias("open"), F.max("prior_n").alias("prior_n"),
                                          F.max("seen").alias("seen"), F.max("fill").alias("fill")).where("seen = 0").drop("seen")
    scored = found.withColumn("score", F.col("done")) if bounds is None else complete_scores(found, bounds, postings, salts, key=key)
    rounded = F.round("score", SCORE_DECIMALS)
    best = Window.partitionBy(key).orderBy(rounded.desc(), F.col("prior_n").desc(), F.col("dst").asc())
    return (scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
            .select(key, "rank", F.col("dst").alias("token_id"), rounded.alias("score")))


def complete_scores(found: DataFrame, bounds: DataFrame, postings: Postings, salts: dict[int, int], *, key: str) -> DataFrame:
    """(key, dst, prior_n, score): exact scores of the items that can be among the best, and of popular ones."""
    floors = bounds.groupBy(key).agg(F.first("floor").alias("floor"))  # one value a key
    held = shared_table(found.join(floors, key, "left").where("floor IS NULL OR fill = 1 OR done + open >= floor"), "contenders")
    asked = held.where("floor IS NOT NULL AND done + open >= floor").select(key, "dst").join(bounds.select(key, "src", "weight"), key)
    looked = (_meet(asked, postings.entries.select("src", "dst", "p"), ["src", "dst"], salts, key)
              .select(key, "dst", F.lit(0).cast("long").alias("prior_n"), (F.col("weight") * F.col("p")).alias("score")))
    own = F.col("done") + F.when(F.col("floor").isNull(), F.col("open")).otherwise(0.0)
    return (held.select(key, "dst", "prior_n", own.alias("score")).unionByName(looked)
            .groupBy(key, "dst").agg(F.max("prior_n").alias("prior_n"), F.sum("score").alias("score")))

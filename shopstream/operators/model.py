"""Next-item model from transition counts (re-aimed from a single-machine network).

Training counts, for every ordered pair of items at most ``max_lag`` apart
inside a session, a weight ``decay ** (lag - 1)``.  The pairs are generated
per session with array expressions (bounded by ``max_lag`` per item, never
all pairs of a session) and summed by a partial + final hash aggregate, so
hot items (OTHER, best sellers) are pre-aggregated before the shuffle.

The stored model keeps untruncated counts plus each source's total weight;
``truncate`` keeps the top ``top_m`` destinations per source for scoring.
Merging two models is a union + sum, exactly equal to a refit on the union
of the sessions when the vocabulary is frozen (``alpha=1``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstream.constants import DEFAULT_TOP_K, MAX_SEQ_LEN, NUM_SPECIAL_TOKENS
from shopstream.operators.ranking import build_postings, rank_sessions

DEFAULT_MAX_LAG = MAX_SEQ_LEN  # the last items of a session that count
DEFAULT_DECAY = 0.5
DEFAULT_TOP_M = None  # all destinations; a number is an explicit choice to truncate the model


def lag_pairs(encoded: DataFrame, *, max_lag: int = DEFAULT_MAX_LAG, seq_col: str = "token_seq") -> DataFrame:
    """(src, dst, lag) for every item pair at most ``max_lag`` apart (linear in session length)."""
    s = encoded.filter(F.size(seq_col) >= 2)
    seq = F.col(seq_col)
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size(seq)),
        lambda j: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(max_lag), j - 1)),
            lambda lag: F.struct(F.element_at(seq, j - lag).alias("src"), F.element_at(seq, j).alias("dst"),
                                 lag.alias("lag")))))
    return s.select(F.inline(pairs))


def fit_transitions(encoded: DataFrame, *, max_lag: int = DEFAULT_MAX_LAG, decay: float = DEFAULT_DECAY,
                    seq_col: str = "token_seq") -> DataFrame:
    """M1: (src, dst, weight, n) summed over all sessions (untruncated)."""
    p = lag_pairs(encoded, max_lag=max_lag, seq_col=seq_col)
    return p.groupBy("src", "dst").agg(
        F.sum(F.pow(F.lit(float(decay)), F.col("lag") - 1)).alias("weight"),
        F.count(F.lit(1)).alias("n"))


def fit_cube(encoded: DataFrame, *, max_lag: int = DEFAULT_MAX_LAG, seq_col: str = "token_seq") -> DataFrame:
    """M7: (src, dst, lag, n): pair counts kept apart by lag, from which any smaller lag and any decay follow."""
    return lag_pairs(encoded, max_lag=max_lag, seq_col=seq_col).groupBy("src", "dst", "lag").agg(F.count(F.lit(1)).alias("n"))


def from_cube(cube: DataFrame, *, max_lag: int, decay: float) -> DataFrame:
    """The transitions that ``fit_transitions`` counts with these settings."""
    return cube.where(F.col("lag") <= max_lag).groupBy("src", "dst").agg(
        F.sum(F.col("n") * F.pow(F.lit(float(decay)), F.col("lag") - 1)).alias("weight"), F.sum("n").alias("n"))


def fit_prior(encoded: DataFrame, *, seq_col: str = "token_seq") -> DataFrame:
    """Item prior: (dst, prior_n) = how often a token is a next item (positions >= 2)."""
    s = encoded.filter(F.size(seq_col) >= 2)
    return (s.select(F.explode(F.slice(seq_col, 2, F.size(seq_col))).alias("dst"))
            .groupBy("dst").agg(F.count(F.lit(1)).alias("prior_n")))


def merge_transitions(old: DataFrame, delta: DataFrame, *, alpha: float = 1.0) -> DataFrame:
    """M6: weights alpha*old + delta (counts likewise), keyed by (src, dst).

    Union + one aggregate; the old vocabulary must be kept frozen for the
    delta so that token ids mean the same items.
    """
    a = F.lit(float(alpha))
    o = old.select("src", "dst", (F.col("weight") * a).alias("weight"), F.col("n").cast("double").alias("n"))
    d = delta.select("src", "dst", "weight", F.col("n").cast("double").alias("n"))
    m = o.unionByName(d).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    if alpha == 1.0:
        m = m.withColumn("n", F.col("n").cast("bigint"))
    return m


def merge_prior(old: DataFrame, delta: DataFrame, *, alpha: float = 1.0) -> DataFrame:
    o = old.select("dst", (F.col("prior_n") * F.lit(float(alpha))).alias("prior_n"))
    m = o.unionByName(delta.select("dst", F.col("prior_n").cast("double"))).groupBy("dst").agg(
        F.sum("prior_n").alias("prior_n"))
    return m.withColumn("prior_n", F.col("prior_n").cast("bigint")) if alpha == 1.0 else m


def normalize(transitions: DataFrame, *, top_m: int | None = DEFAULT_TOP_M) -> DataFrame:
    """(src, dst, p): p = weight / total weight of src, then the top ``top_m`` dst per src.

    The per-source total is a keyed aggregate joined back (no window over a
    hot source); the top-M cut is a ``row_number <= M`` window that Spark
    turns into a partial ``WindowGroupLimit`` before the shuffle.
    """
    tot = transitions.groupBy("src").agg(F.sum("weight").alias("_tot"))
    p = transitions.join(tot, "src").select("src", "dst", (F.col("weight") / F.col("_tot")).alias("p"),
                                            "weight")
    if top_m is not None:
        w = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst").asc())
        p = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_m).drop("_r")
    return p.select("src", "dst", "p")


def _recent(prefixes: DataFrame, key: str, prefix_col: str, max_lag: int) -> DataFrame:
    """(key, src, lag) for the last ``max_lag`` items; lag 1 = most recent."""
    last = F.reverse(F.slice(prefix_col, F.greatest(F.size(prefix_col) - max_lag + 1, F.lit(1)), max_lag))
    return prefixes.select(key, F.posexplode(last).alias("_i", "src")).select(
        key, "src", (F.col("_i") + 1).alias("lag"))


def candidate_scores(prefixes: DataFrame, model: DataFrame, *, key: str = "user_session",
                     prefix_col: str = "prefix", max_lag: int = DEFAULT_MAX_LAG, decay: float = DEFAULT_DECAY) -> DataFrame:
    """(key, dst, score): sum over recent items of decay^(lag-1) * p(dst | src), for all destinations.

    The whole fan-out; ``rank_sessions`` gives the best of them without it.
    """
    recent = _recent(prefixes, key, prefix_col, max_lag)
    j = recent.join(model, "src")  # the join is chosen from measured sizes
    contrib = F.pow(F.lit(float(decay)), F.col("lag") - 1) * F.col("p")
    return j.groupBy(key, "dst").agg(F.sum(contrib).alias("score"))


def score_sessions(prefixes: DataFrame, model: DataFrame, prior: DataFrame, *, k: int = DEFAULT_TOP_K,
                   key: str = "user_session", prefix_col: str = "prefix", max_lag: int = DEFAULT_MAX_LAG,
                   decay: float = DEFAULT_DECAY) -> DataFrame:
    """M2: top ``k`` tokens per session: (key, rank, token_id, score).

    The ranking equals that of ``candidate_scores`` plus the ``k`` most popular tokens
    (score 0) as back-off, so every session gets ``k`` rows when the vocabulary allows;
    how little of the model is read is up to ``ranking``.  Rank order: rounded score
    desc, prior desc, token asc.  Special tokens are not masked (as in offline eval).
    """
    return rank_sessions(prefixes, build_postings(model, prior), k=k, key=key, tokens=prefix_col, max_lag=max_lag, decay=decay)


def recommend(sessions: DataFrame, model: DataFrame, prior: DataFrame, vocab: DataFrame, *,
              k: int = DEFAULT_TOP_K, key: str = "user_session", seq_col: str = "product_seq",
              max_lag: int = DEFAULT_MAX_LAG, decay: float = DEFAULT_DECAY, overfetch: int | None = None,
              history: DataFrame | None = None) -> DataFrame:
    """M3: top ``k`` products per session, never a special token nor an item already in the session.

    ``sessions``: (key, product_seq oldest->newest).  Empty sessions get no
    rows.  With ``overfetch=None`` (default) exclusion happens before ranking,
    so every session gets ``k`` rows when enough items exist.  ``overfetch=4``
    mimics the serving path: only the top ``min(4k, V)`` tokens are looked
    at, then filtered, so fewer than ``k`` may remain.
    ``history``: (key, product_id) of all items of the sessions, where ``sessions`` holds
    capped sequences; without it the sequences are the history.
    Returns (key, rank, product_id, score).
    """
    from shopstream.constants import MAX_TOP_K
    from shopstream.operators.vocab import encode
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"k must be in 1..{MAX_TOP_K}")
    s = sessions.filter(F.size(seq_col) >= 1).select(key, seq_col)
    enc = encode(s, vocab, key=key, seq_col=seq_col, out_col="_tok")
    items = s.select(key, F.explode(seq_col).alias("product_id")) if history is None else (
        history.select(key, "product_id").join(s.select(key), key, "left_semi"))
    seen = (items.join(vocab.select("product_id", F.col("token_id").alias("dst")), "product_id")
            .select(key, "dst").distinct())
    postings = build_postings(model, prior)
    if overfetch is None:
        ranked = rank_sessions(enc, postings, k=k, key=key, tokens="_tok", max_lag=max_lag, decay=decay, mask=True, seen=seen)
    else:
        top = rank_sessions(enc, postings, k=k * overfetch, key=key, tokens="_tok", max_lag=max_lag, decay=decay)
        top = top.filter(F.col("token_id") >= NUM_SPECIAL_TOKENS).join(
            seen.withColumnRenamed("dst", "token_id"), [key, "token_id"], "left_anti")
        w = Window.partitionBy(key).orderBy("rank")
        ranked = top.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    v = vocab.select("product_id", F.col("token_id"))
    return ranked.join(v, "token_id").select(key, "rank", "product_id", "score")


def recommend_enriched(recs: DataFrame, products: DataFrame, key: str = "user_session") -> DataFrame:
    """Recommendations joined with product rows, rank kept; ids missing from products vanish."""
    from shopstream.operators.storefront import api_rows
    return recs.join(api_rows(products), "product_id", "inner").select(
        key, "rank", "product_id", "display_name", "brand", "category_top", "price", "image_ref")


STEPS = (2654435761, 2246822519, 3266489917, 4294967291)  # primes above 2^31, coprime to every octave's size


def octaves(domain: int, n: int) -> list[tuple[int, int, int]]:
    """(first rank, size, draws) of each octave of 0 .. domain-1: equal draws from each, small octaves whole.

    Octave j holds the ranks 2^j - 1 to 2^(j+1) - 2, which a log-uniform draw hits equally
    often; what a small octave cannot give is drawn from the larger ones.  The draws add up
    to min(n, domain).
    """
    sizes, first = [], 0
    while first < domain:
        sizes.append(min(first + 1, domain - first))
        first += sizes[-1]
    left, out = min(n, domain), []
    order = sorted(range(len(sizes)), key=lambda j: (sizes[j], j))
    draws = [0] * len(sizes)
    for done, j in enumerate(order):
        draws[j] = min(sizes[j], left // (len(order) - done))
        left -= draws[j]
    first = 0
    for size, d in zip(sizes, draws):
        out.append((first, size, d))
        first += size
    return out


def sample_negatives(pairs: DataFrame, vocab_size: int, *, n: int = 100, seed: int = 42,
                     include_special: bool = False, key: str = "user_session") -> DataFrame:
    """Per training pair, ``n`` distinct negative token ids, log-uniform over ranks, never the target.

    Token ids are frequency-ordered, so log-uniform draws favour popular items.  The ranks
    without the target's are split into ``octaves``; within each the draws are the first
    values of a permutation keyed by (pair, octave, seed): x -> (step * x + shift) mod size,
    which is one as the steps are primes beyond any size.  So draws are distinct without
    rejection: exactly ``n`` of them, or all other ids where there are fewer.
    ``include_special=True`` draws over 0..V+2 like a sampler over the whole output layer.
    Returns (key, pos, target, i, neg), i from 0.
    """
    base = 0 if include_special else NUM_SPECIAL_TOKENS
    ranks = vocab_size + (NUM_SPECIAL_TOKENS if include_special else 0)
    own = F.col("target") - base  # the target's rank, outside the domain for special targets
    inside = own.between(0, ranks - 1)

    def plan(domain: int) -> Column:
        rows, done = [], 0
        for j, (first, size, draws) in enumerate(octaves(domain, n)):
            if draws:
                rows.append(F.struct(*[F.lit(v).cast("long").alias(c) for c, v in (("j", j), ("first", first), ("size", size), ("draws", draws), ("done", done))]))
                done += draws
        return F.array(*rows) if rows else F.array().cast("array<struct<j:bigint,first:bigint,size:bigint,draws:bigint,done:bigint>>")

    digest = lambda o: F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string"), o["j"].cast("string"), F.lit(str(seed))))
    number = lambda d, a: F.conv(F.substring(d, a, 8), 16, 10).cast("long")
    step = lambda d: F.element_at(F.array(*[F.lit(s) for s in STEPS]), (number(d, 9) % len(STEPS) + 1).cast("int"))
    drawn = F.flatten(F.transform(F.when(inside, plan(ranks - 1)).otherwise(plan(ranks)), lambda o: F.transform(
        F.sequence(F.lit(0).cast("long"), o["draws"] - 1),
        lambda x: F.struct((o["done"] + x).cast("int").alias("i"), (o["first"] + (step(digest(o)) * x + number(digest(o), 1)) % o["size"]).alias("r")))))
    rows = pairs.select(key, "pos", "target", F.inline(drawn))
    skipped = F.when(inside & (F.col("r") >= own), F.col("r") + 1).otherwise(F.col("r"))
    return rows.select(key, "pos", "target", "i", (skipped + base).cast("int").alias("neg"))

"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set holds the hashes of its distinct word shingles.  Shingles are ordered
from rare to frequent by a counting sketch over all documents (fixed size, summed over
the tasks), then by hash.  Two sets of n and m shingles whose overlap is large enough
share at least k shingles of their k-prefixes, for every k, a k-prefix being the first
n - ceil(t n) + k shingles.  Each document picks its k by estimated cost: a longer
prefix is joined more often but asks for more shared shingles before a pair is verified.

Copies and near copies are not expanded into pairs:

* documents with equal sets form one class;
* first round: classes with the same least hash meet in chunks of bounded size, each
  chunk also with the bucket's first class; so do those with the same least second hash,
  where these differ in the first, so that few near copies stay apart; links found give
  first components;
* second round, which alone is complete: classes are gathered into units, chunks of a
  first component or of unlinked classes of one bucket.  Prefix shingles are joined
  unit with unit, units of one first component are left out.  Of pairs of units that
  share enough shingles, a parity bit for each slot of a set (a bit a shingle or two)
  tells which members cannot link: sets differ in as many shingles at least as in bits.
  Only the texts of the others travel; they are verified all at once (incidence
  matrices), returning only links between documents not yet connected.

Components are found with alternating star contractions on the links.

Defined results: null or word-less text has an empty set and links with nothing; fewer
words than a shingle make one shingle; repeated rows are returned each and link with each
other; a null id never becomes a component id unless all ids of the component are null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.llm.substring_dedup import BASES, _mixed
from shopstream.llm.workers import lean
from shopstream.session import shared_table

SKETCH_BITS, SLICES = 22, 64
STEPS = 4
EXCESS = 2.0 ** (np.arange(256) / STEPS) - 1
SIZE_STEP = 1 << 12  # codes of a token: sizes of its unit above, level and matches below
UNIT_DOCS, UNIT_SHINGLES = 64, 60_000
MAX_MATCHES, VERIFY_COST = 8, 16
KNOWN_SHINGLES = 1 << 20  # of texts that a task has read and may meet again


class _ByteWords:
    """64-bit hashes of a text's words, from prefix sums over its bytes (no word is built).

    Each byte has a random value, A-Z that of a-z; a word's hash is the sum of value *
    base^i over its bytes, brought back to exponent 0 and mixed.
    """

    def __init__(self) -> None:
        self.value = np.random.default_rng(20_240).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, BASES[0], np.uint64), np.full(size, pow(BASES[0], -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        out = [self._part(data[a:b]) for a, b in self._parts(data)]
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _parts(self, data: np.ndarray, size: int = 1 << 22):
        """Stretches of about ``size`` bytes cut at spaces, so a huge text needs no huge arrays."""
        a = 0
        while len(data) - a > size:
            spaces = np.flatnonzero(self.space[data[a + size:]][:size])
            if not len(spaces):
                break
            yield a, a + size + int(spaces[0])
            a += size + int(spaces[0])
        yield a, len(data)

    def _part(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.powers(n)
        edge = np.flatnonzero(np.diff(self.space[data].astype(np.int8), prepend=1, append=1))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=total[1:])
        return _mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


class Shingler:
    def __init__(self, size: int):
        self.size, self.words = size, _ByteWords()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        h = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):  # order matters: each step mixes before the next word comes in
            out = _mixed(out ^ h[i:i + len(out)])
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """How many documents hold a shingle of each slot, beyond the mean of all 2^SKETCH_BITS slots, and that mean.

    Counts of all documents; the excess is kept as one byte, a step of 1 / STEPS of a doubling.
    """
    slots = 1 << SKETCH_BITS
    part = slots // SLICES

    def packed(some: np.ndarray) -> bytes:
        return zlib.compress(some.astype(np.min_scalar_type(some.max())).tobytes(), 1)  # few counts of a task take a byte

    def run(batches):
        shingles, total, seen, held = Shingler(size), np.zeros(slots, np.int32), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.append(_slot(shingles(text)))
                held += len(seen[-1])
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(seen), minlength=slots).astype(np.int32)
                    seen, held = [], 0
        if seen:
            total += np.bincount(np.concatenate(seen), minlength=slots).astype(np.int32)
        for i in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(total[i * part:(i + 1) * part])], pa.binary())], names=["slice", "counts"])

    def sum_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.int64)
        for c in pdf["counts"]:
            c = zlib.decompress(c)
            total += np.frombuffer(c, f"u{len(c) // part}")
        total = np.minimum(total, np.iinfo(np.int32).max)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [total.astype(np.min_scalar_type(total.max())).tobytes()]})  # few bytes a slot

    counts = np.zeros(slots, np.int32)
    sums = docs.select("text").mapInArrow(lean(run), "slice int, counts binary").groupBy("slice").applyInPandas(sum_slice, "slice int, counts binary")
    for r in shared_table(sums, "sketch").toLocalIterator():  # 2^SKETCH_BITS counts, a few slices at a time
        counts[r["slice"] * part:(r["slice"] + 1) * part] = np.frombuffer(r["counts"], f"u{len(r['counts']) // part}")
    return quantised(counts, mean := float(counts.mean())), mean


def quantised(counts: np.ndarray, mean: float) -> np.ndarray:
    out = np.empty(len(counts), np.uint8)
    for a in range(0, len(counts), 1 << 18):
        out[a:a + (1 << 18)] = np.rint(STEPS * np.log2(1 + np.maximum(counts[a:a + (1 << 18)] - mean, 0)))
    return out


def rarity_class(excess: np.ndarray, mean: float) -> np.ndarray:
    """0 for what the sketch cannot tell from noise, then one class for each doubling.

    A slot's other shingles number ``mean``, give or take its root, so that frequencies
    beyond some four roots of the mean stand out: what does not grows with the root of the
    corpus only.
    """
    return np.maximum(0, np.log2(np.maximum(excess, 1) / (4 * np.sqrt(mean) + 4))).astype(np.int8)


def adaptive_prefix(h: np.ndarray, sketch: np.ndarray, mean: float, num: int, den: int) -> tuple[np.ndarray, int]:
    """The chosen prefix (rare shingles first) and the number of shared shingles it asks for."""
    n = len(h)
    need = -(-num * n // den)
    excess = EXCESS[sketch[_slot(h)]]
    rarity = rarity_class(excess, mean)
    order = np.argsort(rarity, kind="stable") if rarity.any() else slice(None)  # h is sorted: ties stay in hash order
    h, excess = h[order], excess[order]
    reach = n - need + min(MAX_MATCHES, need)
    others = np.cumsum(np.maximum(excess[:reach], 0.5))
    ks = np.arange(1, min(MAX_MATCHES, need) + 1)
    joined = others[n - need + ks - 1]
    k = int(ks[np.argmin(joined + VERIFY_COST * joined / ks)])
    return h[:n - need + k], k


SECOND = np.uint64(0x9E3779B97F4A7C15)


def _least_second(h: np.ndarray) -> int:
    return int(_mixed(h ^ SECOND).min().view(np.int64))


def parity_bits(h: np.ndarray) -> bytes:
    """Whether an odd number of the set's shingles fall into a slot, for a power of two slots, one a shingle at least."""
    slots = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bits as those of fewer slots."""
    while bits.shape[1] > width:
        bits = bits[:, :bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2:]
    return bits


def document_table(docs: DataFrame, size: int, sketch: np.ndarray, mean: float, num: int, den: int) -> DataFrame:
    """key, doc_id, n, class (of equal sets), least (hash), second (least second hash), matches, prefix, spare (n - need), bits (of parity)."""

    def run(batches):
        shingles = Shingler(size)
        for batch in batches:
            n, cls, least, second, matches, prefix, spare, bits = [], [], [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingles(text)
                n.append(len(h))
                if len(h):
                    p, k = adaptive_prefix(h, sketch, mean, num, den)
                    cls.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                    least.append(int(h[:1].view(np.int64)[0]))
                    second.append(_least_second(h))
                    matches.append(k)
                    prefix.append(p.view(np.int64))
                    spare.append(len(h) - -(-num * len(h) // den))
                    bits.append(parity_bits(h))
                else:
                    for c in (cls, least, second, matches, prefix, spare, bits):
                        c.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(least, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(matches, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(spare, pa.int32()), pa.array(bits, pa.binary())],
                names=["key", "doc_id", "n", "class", "least", "second", "matches", "prefix", "spare", "bits"])

    return docs.select("key", "doc_id", "text").mapInArrow(
        lean(run), "key long, doc_id long, n long, class long, least long, second long, matches int, prefix array<long>, spare int, bits binary")


class _Sets:
    """Members' sets of shingles and who is already connected."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _links(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]], sets: _Sets, num: int, den: int) -> list[tuple[int, int]]:
    """New connections between members of a and b (the same list: within)."""
    if len(a) == len(b) == 1 and a is not b:
        (x, hx), (y, hy) = a[0], b[0]
        both = len(hx) + len(hy) - len(np.union1d(hx, hy))
        return [(x, y)] if den * both >= num * (len(hx) + len(hy) - both) and sets.join(x, y) else []
    vocabulary = np.unique(np.concatenate([h for _, h in (a if a is b else a + b)]))

    def incidence(side):
        m = np.zeros((len(side), len(vocabulary)), np.float32)
        for i, (_, h) in enumerate(side):
            m[i, np.searchsorted(vocabulary, h)] = 1
        return m

    ma = incidence(a)
    mb = ma if a is b else incidence(b)
    both = (ma @ mb.T).astype(np.int64)
    union = np.array([len(h) for _, h in a])[:, None] + np.array([len(h) for _, h in b])[None, :] - both
    out = []
    for i, j in zip(*np.nonzero(den * both >= num * union)):
        if a[i][0] != b[j][0] and sets.join(a[i][0], b[j][0]):
            out.append((a[i][0], b[j][0]))
    return out


def _within_chunk(size: int, num: int, den: int):
    shingles = None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nonlocal shingles
        shingles = shingles or Shingler(size)
        members = [(int(c), shingles(t)) for c, t in zip(pdf["class"], pdf["text"])]
        found = _links(members, members, _Sets(), num, den)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def _within_chunks(size: int, num: int, den: int):
    """Links within each chunk; the rows of a chunk come one after another."""
    links = _within_chunk(size, num, den)

    def run(batches):
        at, members = None, []

        def found() -> pa.RecordBatch:
            both = links(pd.DataFrame(members, columns=["class", "text"])) if len(members) > 1 else {"a": [], "b": []}
            return pa.RecordBatch.from_arrays([pa.array(both[c], pa.int64()) for c in ("a", "b")], names=["a", "b"])

        for batch in batches:
            for *chunk, c, t in zip(*(batch.column(n).to_pylist() for n in ("by", "bucket", "chunk", "class", "text"))):
                if chunk != at:
                    if len(members) > 1:
                        yield found()
                    at, members = chunk, []
                members.append((c, t))
        yield found()
    return run


def _possible(a: list[dict], b: list[dict], num: int, den: int) -> np.ndarray:
    """For each member of a and b, whether the two may link; those of one first component need not.

    Sets of n and m shingles that link differ in (n + m) (den - num) / (den + num) shingles at
    most, and their parity bits in no more slots than that.
    """
    out = np.zeros((len(a), len(b)), bool)
    widths: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        widths.setdefault(len(y["bits"]), []).append(j)
    for js in widths.values():
        n, comp = (np.array([b[j][c] for j in js], np.int64) for c in ("n", "comp"))
        theirs = np.frombuffer(b"".join(b[j]["bits"] for j in js), np.uint64).reshape(len(js), -1)
        for i, x in enumerate(a):
            near = (comp != x["comp"]) & (num * np.maximum(n, x["n"]) <= den * np.minimum(n, x["n"]))
            if near.any():
                own = np.frombuffer(x["bits"], np.uint64)[None, :]
                width = min(own.shape[1], theirs.shape[1])
                differ = np.bitwise_count(_folded(theirs[near], width) ^ _folded(own, width)).sum(1, dtype=np.int64)
                near[near] = differ * (den + num) <= (n[near] + x["n"]) * (den - num)
                out[i, js] = near
    return out


def _members_alike(num: int, den: int):
    """Of pairs of units, the classes that may link with one of the other unit; pairs without any go."""
    def run(batches):
        for batch in batches:
            out = []
            for u, v, left, right in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "left", "right"))):
                near = _possible(left, right, num, den)
                if near.any():
                    out.append((u, v, *([side[i]["class"] for i in np.flatnonzero(near.any(axis))] for side, axis in ((left, 1), (right, 0)))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.int64()] * 2 + [pa.list_(pa.int64())] * 2)], names=["u", "v", "left", "right"])
    return run


def _between_units(size: int, num: int, den: int):
    def run(batches):
        shingles, known, held = Shingler(size), {}, 0

        def members(rows):
            nonlocal held
            out = []
            for r in rows:
                if (h := known.get(r["class"])) is None:
                    h = known[r["class"]] = shingles(r["text"])
                    held += len(h)
                out.append((r["class"], r["comp"], h))
            while held > KNOWN_SHINGLES:
                held -= len(known.pop(next(iter(known))))
            return out

        for batch in batches:
            out = []
            for u, v, left, right in zip(*(batch.column(c) for c in ("u", "v", "left", "right"))):
                a = members(left.as_py())
                b = a if u == v else members(right.as_py())
                sets = _Sets()
                for c, comp, _ in a + b:  # classes of one first component are connected already
                    sets.parent.setdefault(c, c)
                first: dict[int, int] = {}
                for c, comp, _ in a + b:
                    sets.join(c, first.setdefault(comp, c))
                x = [(c, h) for c, _, h in a]
                out += _links(x, x if u == v else [(c, h) for c, _, h in b], sets, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex has either one lower neighbour or only higher ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("id"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("id"), F.lit(0).alias("up")))).alias("end"))
    return not ends.groupBy("end.id").agg(F.sum("end.up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up = 1 and n > 1)").count()


def stars(links: DataFrame) -> DataFrame:
    """hi, lo: the least id ``lo`` of its component for every other id in ``links`` (a, b).

    Half a round is one short plan over a stored table: the driver keeps and describes a plan
    for each of its stages, and a thread for each of its exchanges.
    """
    edges = shared_table(links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # an edge to the least neighbour is kept by every vertex, so that nothing is disconnected
        large = shared_table(both.join(low, "u").where("v > u or v = m").select(F.greatest("u", "v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = shared_table(large.join(least, "hi").select(F.when(F.col("lo") != F.col("m"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
    return edges


def components(links: DataFrame) -> DataFrame:
    """id, label (least id of its component) of every id in ``links`` (a, b)."""
    edges = stars(links)
    roots = edges.select(F.col("lo").alias("id")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: links at Jaccard >= num / den, components over links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    sketch, mean = count_sketch(rows, shingle)
    table = shared_table(document_table(rows, shingle, sketch, mean, num, den), "documents")
    full = table.where("n > 0")
    classes = shared_table(full.groupBy("class").agg(
        F.min("doc_id").alias("first_doc"), F.min(F.struct("key", "n", "least", "second", "matches", "spare")).alias("one")).select("class", "first_doc", "one.*"), "classes")

    n_chunk = F.greatest(F.ceil(F.col("members") / UNIT_DOCS), F.ceil(F.col("weight") / UNIT_SHINGLES)).cast("int")
    # one text and one row of its set a key: rows may repeat id and text, and copies of a text with a null id share a key
    texts, prefixes, bits = rows.select("key", "text"), full.select("key", "prefix"), full.select("key", "bits")
    repeated = shared_table(full.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    if not repeated.isEmpty():
        texts = shared_table(texts.groupBy("key").agg(F.min("text").alias("text")).join(classes.select("key"), "key", "left_semi"), "texts")
        prefixes = prefixes.groupBy("key").agg(F.min("prefix").alias("prefix"))
        bits = bits.groupBy("key").agg(F.min("bits").alias("bits"))

    # first round: chunks of one bucket, each with the bucket's first class; a bucket of the second hash meets only if it holds several of the first
    def chunks(by: str, where: str) -> DataFrame:
        sizes = classes.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.min("class").alias("head"),
                                        F.min("least").alias("low"), F.max("least").alias("high")).where(where)
        placed = classes.join(sizes, by).select("class", "key", "head", F.lit(by).alias("by"), F.col(by).alias("bucket"), n_chunk.alias("n_chunk"))
        heads = placed.where("class = head").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunk") - 1)))
        return placed.where("class != head").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("n_chunk")).cast("int")).unionByName(heads)

    met = chunks("least", "members > 1").unionByName(chunks("second", "low != high")).select("by", "bucket", "chunk", "class", "key")
    chunk = ["by", "bucket", "chunk"]
    together = met.join(texts, "key").repartition(*chunk).sortWithinPartitions(*chunk)
    first = shared_table(together.mapInArrow(lean(_within_chunks(shingle, num, den)), "a long, b long"), "links")
    comps = components(first)

    # second round: units, joined on their prefixes
    labelled = classes.join(comps.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("label", "class"))
    grouped = labelled.withColumn("home", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("label")))
    room = grouped.groupBy("home", F.col("label").isNull().alias("alone")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    units = shared_table(grouped.withColumn("alone", F.col("label").isNull()).join(room, ["home", "alone"]).withColumn("n_chunk", n_chunk).select(
        "class", "key", "comp", "n", "matches", "spare", F.xxhash64("home", "alone", F.pmod(F.xxhash64("class"), F.col("n_chunk"))).alias("unit")), "units")
    shape = units.groupBy("unit").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count(F.lit(1)).alias("members"),
                                      F.sum("n").alias("weight"), F.min("matches").alias("asked"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    shape = shared_table(shape, "shape")
    # one row for each prefix shingle, dealt by shingle once and read by both sides of the join; a unit
    # asks for as many shared shingles as its least demanding member, so its longer prefixes are cut to that
    # the sizes in a unit, as classes that step by the similarity: sets whose classes lie further apart than one cannot link
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num * (1 + 1e-6)))) if num < den else n
    span = F.least(size_class(F.col("least_n")), F.lit(1023)) * 1024 + F.least(size_class(F.col("most_n")), F.lit(1023))
    spread = (units.join(shape, "unit").select("key", "unit", "spare", "asked", F.when(F.col("low") == F.col("high"), F.col("low")).alias("whole"), span.cast("long").alias("span"))
              .join(prefixes, "key")
              .select("unit", "asked", "whole", "span", F.explode(F.transform(
                  F.slice("prefix", F.lit(1), F.least(F.size("prefix"), F.col("spare") + F.col("asked"))),
                  lambda t, i: F.struct(t.alias("token"), F.greatest(F.lit(1), i - F.col("spare") + 1).alias("level")))).alias("p"))
              .select("p.token", "unit", (F.col("span") * SIZE_STEP + F.col("p.level") * 16 + F.col("asked")).alias("code"), "whole"))
    tokens = spread.repartition("token").groupBy("token", "unit").agg(F.min("code").alias("code"), F.first("whole").alias("whole"))
    x, y = tokens.alias("x"), tokens.alias("y")
    asked = F.least(F.col("x.code") % 16, F.col("y.code") % 16)
    level = lambda side: F.floor(F.col(f"{side}.code") % SIZE_STEP / 16)
    least = lambda side: F.floor(F.col(f"{side}.code") / (SIZE_STEP * 1024))
    most = lambda side: F.floor(F.col(f"{side}.code") / SIZE_STEP) % 1024
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.unit") < F.col("y.unit"))
                    & ~F.coalesce(F.col("x.whole") == F.col("y.whole"), F.lit(False))
                    & (F.greatest(level("x"), level("y")) <= asked)
                    & (least("x") <= most("y") + 1) & (least("y") <= most("x") + 1))
             .groupBy(F.col("x.unit").alias("u"), F.col("y.unit").alias("v"))
             .agg(F.count(F.lit(1)).alias("shared"), F.first(asked).alias("asked")).where("shared >= asked").select("u", "v"))
    sizes_of = lambda side: shape.select(F.col("unit").alias(side), F.col("least_n").alias(f"least_{side}"), F.col("most_n").alias(f"most_{side}"), F.col("weight").alias(f"weight_{side}"))
    pairs = (pairs.join(sizes_of("u"), "u").join(sizes_of("v"), "v")
             .where((num * F.col("least_u") <= den * F.col("most_v")) & (num * F.col("least_v") <= den * F.col("most_u")))
             # the texts of the smaller unit travel to the larger one
             .select(F.when(F.col("weight_u") <= F.col("weight_v"), F.col("u")).otherwise(F.col("v")).alias("u"),
                     F.when(F.col("weight_u") <= F.col("weight_v"), F.col("v")).otherwise(F.col("u")).alias("v")))
    inside = shape.where("members > 1 and low != high").select(F.col("unit").alias("u"), F.col("unit").alias("v"))
    pairs = shared_table(pairs.unionByName(inside), "pairs")
    wanted = pairs.select(F.col("u").alias("unit")).unionByName(pairs.select(F.col("v").alias("unit"))).distinct()

    def laid(pairs: DataFrame, members: DataFrame) -> DataFrame:
        return (pairs.join(members.select(F.col("unit").alias("u"), F.col("members").alias("left")), "u")
                .join(members.select(F.col("unit").alias("v"), F.col("members").alias("right")), "v"))

    signs = shared_table(units.join(wanted, "unit").select("key", "unit", "class", "comp", "n").join(bits, "key")
                         .groupBy("unit").agg(F.collect_list(F.struct("class", "comp", "n", "bits")).alias("members")), "signs")
    alike = shared_table(laid(pairs, signs).select("u", "v", "left", "right").mapInArrow(
        lean(_members_alike(num, den)), "u long, v long, left array<long>, right array<long>"), "alike")
    read = alike.select(F.col("u").alias("unit"), F.explode("left").alias("class")).unionByName(alike.select(F.col("v").alias("unit"), F.explode("right").alias("class"))).distinct()
    blobs = shared_table(units.join(read, ["unit", "class"]).select("key", "unit", "class", "comp").join(texts, "key")
                         .groupBy("unit").agg(F.collect_list(F.struct("class", "comp", "text")).alias("members")), "units")
    some = lambda members, classes: F.filter(members, lambda m: F.array_contains(classes, m["class"]))
    asked_for = alike.withColumnsRenamed({"left": "from_u", "right": "from_v"})
    texts_of = (asked_for.join(blobs.select(F.col("unit").alias("u"), F.col("members").alias("left")), "u").withColumn("left", some("left", F.col("from_u"))).drop("from_u")
                .join(blobs.select(F.col("unit").alias("v"), F.col("members").alias("right")), "v").withColumn("right", some("right", F.col("from_v"))))
    second = texts_of.select("u", "v", "left", "right").mapInArrow(lean(_between_units(shingle, num, den)), "a long, b long")
    final = stars(first.unionByName(second))

    named = classes.select("class", "first_doc").join(final.withColumnRenamed("hi", "class"), "class", "left").withColumn("label", F.coalesce("lo", "class"))
    least_doc = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = named.join(least_doc, "label").select("class", "component_id")
    return table.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, p, p + 3)) AS h FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS nb FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * nb >= 85 * (a.n + b.n - nb)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

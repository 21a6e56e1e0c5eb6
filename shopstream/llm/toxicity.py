"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is cut into lower-case words; every window of ``WINDOW`` words at steps of
``STRIDE`` is scored, together covering the whole text, and a document's score is that
of its most toxic window.  A word's input is its own embedding (zero if unknown) beside
the mean embedding of its hashed character 4-grams, so inflected forms that training
never saw still carry a signal.  Runs of more than ``LONGEST`` letters (scripts without
spaces, text without its spaces) are read as overlapping pieces, each a word of its own.

The network is plain numpy: forward and backward passes below, Adam.  It is fitted on
the driver on a bounded sample of labelled rows (``per_class`` toxic and
``CLEAN_SHARE`` times as many clean ones, chosen by a hash of the id; of long texts a bounded
number of stretches at hashed places) and is sent to the tasks,
which score all documents where they are read: no shuffle of texts.  Fitting is
multiple-instance: first each window has its document's label, then only the highest
scoring windows of each document speak for it.

Defined results: a null, empty or word-less text scores the share of toxic rows in the
training labels; without labels of both classes that share is every document's score (0 without any); a null id counts as the text
'' in the split; repeated labels of one id count once, with the greatest label; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstream.llm.workers import lean
from shopstream.session import shared_table

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
CHAR_BUCKETS, GRAMS = 16_384, 16
LONGEST, PIECE, STEP = 17, 12, 6  # longer runs of letters are cut into pieces of PIECE letters, one every STEP
CHUNK = 4096
ROWS = 500  # texts scored at once in a task
SLICES = 12  # parts in which the driver reads the training texts
DOCS = 200  # training documents whose words are counted at once
CLEAN_SHARE = 4  # sampled clean documents for each toxic one
THRESHOLD = 0.7

find_words = re.compile(r"[^\W\d_]+").findall


def pieces(run: str) -> list[str]:
    """Overlapping words that hold every 4-gram of a long run of letters, and every word of up to
    ``PIECE - STEP + 1`` letters in it."""
    if len(run) <= LONGEST:
        return [run]
    return [run[a:a + PIECE] for a in (*range(0, len(run) - PIECE, STEP), len(run) - PIECE)]


def words_of(text: str | None) -> list[str]:
    words = find_words(text.lower()) if text else []
    if words and max(map(len, words)) > LONGEST:
        return [p for w in words for p in pieces(w)]
    return words


def char_grams(word: str) -> np.ndarray:
    """Hashed character 4-grams of a word of at most ``LONGEST`` letters with marked ends, zero padded."""
    marked = f"<{word}>"
    out = np.zeros(GRAMS, dtype=np.int32)
    for i in range(max(1, len(marked) - 3)):
        out[i] = 1 + zlib.crc32(marked[i:i + 4].encode()) % (CHAR_BUCKETS - 1)
    return out


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def windows(ids: np.ndarray) -> np.ndarray:
    """[window, WINDOW] word numbers; number 0 pads a text shorter than a window."""
    if len(ids) < WINDOW:
        ids = np.concatenate([ids, np.zeros(WINDOW - len(ids), dtype=ids.dtype)])
    return ids[np.asarray(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, n_words: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        wide = WORD_DIM + CHAR_DIM
        self.p = {
            "word": init(n_words, WORD_DIM, k=0.03), "char": init(CHAR_BUCKETS, CHAR_DIM, k=0.03),
            "wx": init(wide, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "u": init(2, HIDDEN, 3 * HIDDEN),
            "wa": init(2 * HIDDEN, HIDDEN), "va": init(HIDDEN), "wo": init(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.p["char"][0] = 0

    def inputs(self, known: np.ndarray, grams: np.ndarray):
        """Vectors of words from their numbers (0: unknown) and char_grams."""
        count = np.maximum(1, (grams > 0).sum(axis=1, keepdims=True)).astype(np.float32)
        chars = self.p["char"][grams].sum(axis=1) / count
        return np.concatenate([self.p["word"][known], chars], axis=1), count

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions: [2, words, 3 * HIDDEN]."""
        g = vectors @ self.p["wx"] + self.p["bx"]
        return np.ascontiguousarray(g.reshape(len(g), 2, 3 * HIDDEN).transpose(1, 0, 2))

    def forward(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` [n, t], given the gate inputs of the words they refer to."""
        n, t = at.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, t, n, HIDDEN), np.float32)
        tape = []
        for s in range(t):
            x = np.stack([gates[0][at[:, s]], gates[1][at[:, t - 1 - s]]])
            hu = np.matmul(h, self.p["u"])
            zr = _sigmoid(x[..., :2 * HIDDEN] + hu[..., :2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            cand = np.tanh(x[..., 2 * HIDDEN:] + r * hu[..., 2 * HIDDEN:])
            new = cand + z * (h - cand)
            if keep:
                tape.append((h, z, r, cand, hu[..., 2 * HIDDEN:]))
            h = new
            states[0, s], states[1, t - 1 - s] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2).transpose(1, 0, 2)  # n, t, 2H
        hidden = np.tanh(both @ self.p["wa"])
        score = np.where(mask, hidden @ self.p["va"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.matmul(weight[:, None, :], both)[:, 0]
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (tape, both, hidden, weight, pooled)) if keep else logit

    def backward(self, dlogit, at, cache, vectors, count, known, grams):
        tape, both, hidden, weight, pooled = cache
        p, t, H = self.p, at.shape[1], HIDDEN
        g = {"wo": pooled.T @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["wo"]
        dboth = weight[..., None] * dpool[:, None, :]
        dweight = np.matmul(both, dpool[..., None])[..., 0]
        dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nth->h", dscore, hidden)
        dhid = dscore[..., None] * p["va"] * (1 - hidden ** 2)
        g["wa"] = both.reshape(-1, 2 * H).T @ dhid.reshape(-1, H)
        dboth = dboth + dhid @ p["wa"].T
        g["u"] = np.zeros_like(p["u"])
        dgates = np.zeros((2, len(vectors), 3 * H), np.float32)
        dh = np.zeros((2, len(at), H), np.float32)
        for s in range(t - 1, -1, -1):
            h, z, r, cand, hun = tape[s]
            dh = dh + np.stack([dboth[:, s, :H], dboth[:, t - 1 - s, H:]])
            dcand = dh * (1 - z) * (1 - cand ** 2)
            dz = dh * (h - cand) * z * (1 - z)
            dr = dcand * hun * r * (1 - r)
            dx = np.concatenate([dz, dr, dcand], axis=2)
            dhu = np.concatenate([dz, dr, dcand * r], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), dhu)
            dh = dh * z + np.matmul(dhu, p["u"].transpose(0, 2, 1))
            np.add.at(dgates[0], at[:, s], dx[0])
            np.add.at(dgates[1], at[:, t - 1 - s], dx[1])
        flat = dgates.transpose(1, 0, 2).reshape(len(vectors), 6 * H)
        g["wx"], g["bx"] = vectors.T @ flat, flat.sum(axis=0)
        dvec = flat @ p["wx"].T
        g["word"] = (known, dvec[:, :WORD_DIM])
        chars = np.repeat(dvec[:, None, WORD_DIM:] / count[:, None], grams.shape[1], axis=1)
        g["char"] = (grams.ravel(), chars.reshape(-1, CHAR_DIM))
        return g


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict) -> None:
        self.step += 1
        fix = np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            rows = slice(None)
            if isinstance(g, tuple):  # gradients of some rows of a table
                rows, inverse = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(total, inverse, g[1])
                total[rows == 0] = 0  # padding and unknown words stay zero
                g = total
            m, v = self.m[k], self.v[k]
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            self.p[k][rows] -= self.rate * fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)


class Model:
    """Vocabulary, network, the score of texts without words, and the map from a document's
    greatest window logit to its score."""

    def __init__(self, vocab: dict[str, int], net: Network, prior: float):
        self.vocab, self.net, self.prior = vocab, net, prior
        self.slope, self.offset = 1.0, 0.0

    def calibrate(self, logit: np.ndarray, y: np.ndarray, share: float) -> None:
        """Fit slope and offset on documents unseen in training, weighted to the share of toxic rows."""
        weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a weak pull to slope 1, offset 0
            p = _sigmoid(a * logit + b)
            err, curve = weight * (p - y), weight * p * (1 - p)
            g = np.array([(err * logit).sum() + (a - 1), err.sum() + 0.1 * b])
            h = np.array([[(curve * logit ** 2).sum() + 1, (curve * logit).sum()], [(curve * logit).sum(), curve.sum() + 0.1]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = max(0.1, a - step[0]), b - step[1]
        self.slope, self.offset = float(a), float(b)

    def reader(self) -> "_Reader":
        return _Reader(self)


class _Reader:
    """Scores texts; keeps the gate inputs of words seen, up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 75_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.fresh: list[str] = []
        vectors, _ = self.model.net.inputs(np.zeros(1, np.int32), np.zeros((1, GRAMS), np.int32))
        self.gates = self.model.net.project(vectors)  # row 0: padding

    def _learn(self) -> None:
        if self.fresh:
            known = np.array([self.model.vocab.get(w, 0) for w in self.fresh], np.int32)
            parts = [self.gates]
            for a in range(0, len(known), 20_000):
                grams = np.stack([char_grams(w) for w in self.fresh[a:a + 20_000]])
                parts.append(self.model.net.project(self.model.net.inputs(known[a:a + 20_000], grams)[0]))
            self.gates, self.fresh = np.concatenate(parts, axis=1), []

    def logits(self, at: np.ndarray) -> np.ndarray:
        self._learn()
        return np.concatenate([self.model.net.forward(self.gates, at[a:a + CHUNK], at[a:a + CHUNK] > 0) for a in range(0, len(at), CHUNK)])

    def numbers(self, words: list[str]) -> np.ndarray:
        number, fresh = self.number, self.fresh
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
                fresh.append(w)
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

    def scores(self, texts) -> np.ndarray:
        out, waiting, held = [], [], 0

        def flush():
            if waiting:
                full = [w for w in waiting if w is not None]
                best = np.zeros(0, np.float32)
                if full:
                    starts = np.cumsum([0, *(len(w) for w in full[:-1])])
                    best = np.maximum.reduceat(self.logits(np.concatenate(full)), starts)
                it = iter(_sigmoid(self.model.slope * best.astype(np.float64) + self.model.offset))
                out.extend(self.model.prior if w is None else float(next(it)) for w in waiting)
                waiting.clear()
            if len(self.number) > self.limit:
                self._reset()

        for text in texts:
            words = words_of(text)
            waiting.append(windows(self.numbers(words)) if words else None)
            held += 0 if waiting[-1] is None else len(waiting[-1])
            if held >= 2 * CHUNK:
                flush()
                held = 0
        flush()
        return np.array(out, np.float64)


class Sample:
    """Labelled texts, kept as word numbers: a text is dropped once it is cut into words."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}  # words in order of appearance
        self.rows: list[tuple] = []  # (key, word numbers, label)
        self.labels: list[int] = []

    def add(self, key, text: str | None, label: int) -> None:
        self.labels.append(label)
        words = words_of(text)
        if words:
            self.rows.append((key, np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int32, len(words)), label))


def fit_texts(texts: list[str], labels: list[int], **more) -> Model | None:
    """``fit_sample`` on texts in their order."""
    sample = Sample()
    for i, (t, label) in enumerate(zip(texts, labels)):
        sample.add(i, t, label)
    return fit_sample(sample, **more)


def fit_sample(sample: Sample, *, share: float | None = None, vocab_words: int = 20_000, epochs: int = 8, seed: int = 0,
               batch: int = 512, rate: float = 0.01) -> Model | None:
    """Train on a sample, in the order of its keys, which is used up; None unless both classes have words."""
    sample.rows.sort(key=lambda r: r[0])
    docs, y = [r[1] for r in sample.rows], np.array([r[2] for r in sample.rows], np.float32)
    sample.rows.clear()
    if not len(y) or y.min() == y.max():
        return None
    share = float(np.mean(sample.labels)) if share is None else share
    test = np.zeros(len(docs), bool)  # a quarter of each class is kept for calibration
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        test[own[3::4]] = True
    names = list(sample.number)
    sample.number = {}
    unseen = [(docs[i], float(y[i])) for i in np.flatnonzero(test)]
    docs, y = [docs[i] for i in np.flatnonzero(~test)], y[~test]
    counts = np.zeros(len(names), np.int64)
    for a in range(0, len(docs), DOCS):
        counts += np.bincount(np.concatenate(docs[a:a + DOCS]), minlength=len(names))
    ranked = np.array(sorted(np.flatnonzero(counts).tolist(), key=names.__getitem__), np.int32)
    ranked = ranked[np.argsort(-counts[ranked], kind="stable")]  # by count, then by name
    place = np.zeros(len(names), np.int32)
    place[ranked] = np.arange(1, len(ranked) + 1)
    grams = np.zeros((len(ranked) + 1, GRAMS), np.uint16)  # below CHAR_BUCKETS
    for i, w in enumerate(ranked):
        grams[i + 1] = char_grams(names[w])
    # word numbers of all documents one after another, short ones padded to a window; windows are cut from these when they are read
    flat = np.zeros(sum(max(len(numbers), WINDOW) for numbers in docs), np.int32)
    starts, owner, end = [], [], 0
    for d, numbers in enumerate(docs):
        flat[end:end + len(numbers)] = place[numbers]
        starts.append(np.asarray(window_starts(len(numbers))) + end)
        owner.append(np.full(len(starts[-1]), d, np.int32))
        end += max(len(numbers), WINDOW)
        docs[d] = None
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    n_known = min(vocab_words, len(ranked)) + 1
    net, rng = Network(n_known, seed), np.random.default_rng(seed + 1)
    adam = Adam(net.p, rate)
    model = Model({names[w]: i + 1 for i, w in enumerate(ranked[:n_known - 1])}, net, share)
    gates = np.empty((2, len(grams), 3 * HIDDEN), np.float32)

    def windows_at(chosen):
        return flat[chosen[:, None] + np.arange(WINDOW)]

    def known_of(ids):
        return np.where(ids < n_known, ids, 0).astype(np.int32)

    def all_logits():
        for a in range(0, len(grams), 20_000):
            gates[:, a:a + 20_000] = net.project(net.inputs(known_of(np.arange(a, min(a + 20_000, len(grams)))), grams[a:a + 20_000])[0])
        parts = (windows_at(starts[a:a + CHUNK]) for a in range(0, len(starts), CHUNK))
        return np.concatenate([net.forward(gates, at, at > 0) for at in parts])

    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    positive_windows = np.flatnonzero(y[owner] > 0)
    for epoch in range(epochs):
        if epoch < 2:  # all windows, of each class alike many
            negative = rng.permutation(np.flatnonzero(y[owner] == 0))[:max(2 * len(positive_windows), 4 * batch)]
            chosen = np.concatenate([positive_windows, negative])
        else:  # the windows that speak for their document, and others of clean documents
            score = all_logits()
            rank = np.empty(len(score), np.int32)
            order = np.lexsort((-score, owner))
            rank[order] = np.arange(len(score)) - first[owner[order]]
            speak = np.where(y[owner] > 0, rank < 1, rank < 3)
            other = (y[owner] == 0) & (rng.random(len(owner)) < 0.02)
            chosen = np.flatnonzero(speak | other)
        rng.shuffle(chosen)
        size = min(batch, max(16, len(chosen) // 60))  # small samples still get enough steps
        adam.rate = rate * (1.0 if epoch < 4 else 0.4 if epoch < 6 else 0.15)
        target = y[owner[chosen]]
        balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
        for a in range(0, len(chosen), size):
            win = windows_at(starts[chosen[a:a + size]])
            used, inverse = np.unique(win, return_inverse=True)
            local = inverse.reshape(win.shape)
            known = known_of(used)
            known[rng.random(len(known)) < 0.5] = 0  # half of the words speak by their characters alone
            vectors, count = net.inputs(known, grams[used])
            logit, cache = net.forward(net.project(vectors), local, win > 0, keep=True)
            d = (_sigmoid(logit) - target[a:a + size]) * balance[a:a + size] / len(win)
            adam.update(net.backward(d.astype(np.float32), local, cache, vectors, count, known, grams[used]))
    del flat, starts, owner, grams, gates
    if unseen:
        raw = np.clip(model.reader().scores(" ".join(names[i] for i in numbers) for numbers, _ in unseen), 1e-12, 1 - 1e-12)
        model.calibrate(np.log(raw / (1 - raw)), np.array([c for _, c in unseen], np.float64), min(max(share, 0.01), 0.99))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def excerpt(text: Column, doc_id: Column, chars: Column, stretch: int = 1000) -> Column:
    """The text, or of a longer one than ``chars`` that many characters: from each of equal parts one stretch at a hashed place."""
    n = F.greatest(F.floor(chars / stretch), F.lit(1)).cast("int")
    part = F.floor(F.length(text) / n).cast("int")
    taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(
        text, (i * part + F.pmod(F.xxhash64(doc_id, i), F.greatest(part - stretch + 1, F.lit(1))) + 1).cast("int"), F.lit(stretch)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(taken, " "))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, max_chars: int = 6000) -> tuple[Model | None, float]:
    """The model (None without both classes) and the share of toxic rows among the training labels."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")))
    share = known.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    there = (docs.where(F.col("text").isNotNull()).select("doc_id").join(known, "doc_id")
             .select("doc_id", "y", F.xxhash64("doc_id").alias("h")).distinct())
    chosen = [there.where(F.col("y") == y).orderBy("h", "doc_id").limit(n).select("doc_id", "y") for y, n in ((1, per_class), (0, CLEAN_SHARE * per_class))]
    # the ids stay in a table: as a list in a condition they would be part of every plan and task that the driver describes
    picked = shared_table(chosen[0].unionByName(chosen[1]), "picked")
    if picked.select("y").distinct().count() < 2:
        return None, share
    # the fewer toxic documents may be longer, as only a passage of them need be toxic
    chars = F.when(F.col("y") > 0, CLEAN_SHARE * max_chars).otherwise(max_chars)
    # about 2 * CLEAN_SHARE * per_class * max_chars characters at most, which come in SLICES parts, one at a time
    texts = (docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
             .select("doc_id", "y", excerpt(F.col("text"), F.col("doc_id"), chars).alias("text")).repartition(SLICES, "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    sample = Sample()
    for r in texts.toLocalIterator():
        sample.add(r["doc_id"], r["text"], r["y"])
    return fit_sample(sample, share=share), share


def score(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """All columns of ``docs`` plus ``score`` double."""
    if model is None:
        return docs.withColumn("score", F.lit(float(share)))
    if "score" in docs.columns:
        docs = docs.drop("score")

    def run(batches):
        reader = model.reader()
        for batch in batches:
            found = reader.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(lean(run, ROWS), docs.withColumn("score", F.lit(0.0).cast("double")).schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, share = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, share).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Rules, brute-force comparisons and awkward inputs of the operators; whole tables against SQL."""
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import chat, decontam, jaccard, registered, shards, substring_dedup, topk, toxicity

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_whole_table_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(registered.ORACLES[name])
    cols = [c[0] for c in want.description]
    df = registered.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    assert got == sorted(map(repr, want.fetchall()))


# ---- chat

def test_chat_escapes_and_reads_back(spark):
    nasty = ["<|im_end|>\n", "&lt;", "&amp;lt;", "<", "[INST]", "<|im_sep|>", "", None, "a&nl;b", "é🙂<", "\n", "<|im_start|>assistant\nx"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice(nasty), "clash") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "null ids", "x"), (7, 0, "user", "repeated", "x"), (7, 0, "user", "repeated", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    key = lambda r: (r[1] is not None, r[1] or 0, chat_escape(r[2] or "", True), chat_escape(r[3] or ""))
    for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=key)
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x[2] or "", x[3] or "") for x in own]
        masked = [chat_unescape(r["formatted"][s["start"]:s["start"] + s["length"]]) for s in r["loss_spans"]]
        assert masked == [x[3] or "" for x in own if x[2] == "assistant"]
        assert r["n_turns"] == len(own)
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def chat_escape(s, role=False):
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lb;")
    return s.replace("\n", "&nl;") if role else s


def chat_unescape(s):
    return s.replace("&nl;", "\n").replace("&lb;", "[").replace("&lt;", "<").replace("&amp;", "&")


def test_running_total_and_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", "x" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert [s["length"] for s in r["loss_spans"]] == [i % 5 for i in range(3000) if i % 3]
    starts = [s["start"] for s in r["loss_spans"]]
    assert starts == sorted(starts) and starts[-1] < len(r["formatted"])


# ---- top-k

def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, rng.integers(1, 5)) / 8]) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.5]) for i in range(80)] + [(5, [0.25, 0.5]), (5, [0.25, 0.5]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")]),
                                                           (2003, [float("inf")]), (2004, []), (None, [1.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=64, query_rows=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    assert set(got) == {i for i, _ in ok if i % 20 == 0}
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id in (20, 21, 22)"), F.col("vec_id") == 20).count() == 2


# ---- shards

def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 200) if i % 3 else "same text of a hot group") for i in range(3000)] + [(None, None), (1, ""), (1, "")]
    df = docs_of(spark, rows)
    out = shards.shard_documents(df, 7).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(7))
    target = sum(r["size"] for r in out) / 7
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - target) <= 3 * 1016
    assert shards.shard_documents(df.limit(0), 7).count() == 0
    assert shards.shard_documents(df.limit(3), 7).count() == 3
    assert {r["shard"] for r in shards.shard_documents(df.limit(30), 1).collect()} == {0}


def test_repeated_rows_are_split_over_shards(spark):
    rows = [(i, "w" * (60 + i % 80)) for i in range(2000)] + [(None, "one text with a null id" * 4)] * 1500
    out = shards.shard_documents(docs_of(spark, rows), 10).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    target = sum(r["size"] for r in out) / 10
    assert sorted(by) == list(range(10))
    for own in by.values():
        assert abs(sum(r["size"] for r in own) - target) <= 3 * 160
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


# ---- decontamination

def test_masks_are_lossless():
    for subs in itertools.combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(all(c == "0" or at + i not in subs for i, c in enumerate(m))
                   for m in decontam.MASKS for at in range(decontam.WINDOW - len(m) + 1)), subs


def test_overlaps_tolerate_substitutions_on_both_paths(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(20)]
    rows, want = [], set()
    for i in range(60):
        words = list(item[rng.randint(0, 7):][:13])
        for p in rng.sample(range(13), i % 4):
            words[p] = "other"
        rows.append((i, "Lead in, " + " ".join(w.upper() for w in words) + "; tail."))
        if i % 4 <= 2:
            want.add((i, 1))
    rows += [(100, "short one HERE"), (101, "short two here"), (102, None), (103, ""), (104, "..."), (104, "x short one here y"), (None, "short one here")]
    want |= {(100, 2), (104, 2)}
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short, one here!"), (3, None), (4, "")], "item_id long, text string")
    df = docs_of(spark, rows)
    for bound in (decontam.BROADCAST_SEEDS, 0):
        got = decontam.overlaps(df, bench, broadcast_seeds=bound).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = decontam.clean_documents(df, bench).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0


# ---- substring dedup

def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    passages = [[f"p{k}_{i}" for i in range(70)] for k in range(3)] + [["same"] * 80]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 15)
            words += p[a:a + rng.randint(40, 70)] if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 60), "\t ".join(words)))
    rows += [(3, None), (None, rows[0][1]), (61, rows[5][1]), (61, rows[5][1]), (62, "")]
    window = 50
    first = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                x = tuple(w[p:p + window])
                first[x] = min(first.get(x, i), i)
    want = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert substring_dedup.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


# ---- n-gram join

def _components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[root(a)] = min(low.get(root(a), i), i)
    return sorted(((i, len(s), low.get(root(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_DOCS", 5)
    rng = random.Random(8)
    base = [[f"b{k}_{i}" for i in range(rng.choice([30, 60, 120]))] for k in range(5)]
    rows = []
    for i in range(140):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words).upper() if i % 2 else " ".join(words)))
    rows += [(200, "a b c"), (201, "A  b\nc"), (202, "a b"), (203, ""), (204, None), (205, "A b c d"), (17, rows[17][1]), (None, rows[3][1]), (206, "É é x"), (207, "é é x")]
    got = jaccard.near_duplicates(docs_of(spark, rows), shingle=4, num=85, den=100).collect()
    assert sorted(map(tuple, got), key=repr) == _components(rows, 4, 85, 100)
    assert jaccard.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    assert jaccard.near_duplicates(docs_of(spark, [(1, ""), (2, None)])).count() == 2


def test_prefix_length_follows_the_estimated_cost():
    import numpy as np
    h = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    counts = np.full(1 << jaccard.SKETCH_BITS, 9, np.int64)
    slots = jaccard._slot(h)

    def chosen(common):
        c = counts.copy()
        c[slots[:len(h) - common]] += 1
        c[slots[len(h) - common:]] += 5_000  # the others are in thousands of documents
        return jaccard.adaptive_prefix(h, jaccard.quantised(c, 9.0), 9.0, 85, 100)
    # with enough rare shingles more shared ones are asked for; where only frequent ones could be added, fewer
    ks = {common: chosen(common)[1] for common in (0, 165, 168, 170, 190)}
    assert ks[0] > 1 and ks[168] < ks[0] and len(set(ks.values())) >= 3, ks
    prefix, k = chosen(165)
    assert len(prefix) == 200 - 170 + k
    rare = set(h[:35].tolist())
    assert set(prefix[:35].tolist()) == rare or len(prefix) < 35  # rare shingles come first


def test_frequent_shingles_stand_out_of_the_sketch():
    import numpy as np
    for mean in (0.5, 10.0, 1000.0, 1e6):
        counts = np.array([0, int(mean), int(mean + 3 * mean ** 0.5), int(mean + 20 * mean ** 0.5 + 20), 2 ** 31 - 1], np.int32)
        classes = jaccard.rarity_class(jaccard.EXCESS[jaccard.quantised(counts, mean)], mean).tolist()
        assert classes[:3] == [0, 0, 0] and 1 <= classes[3] < classes[4]


def test_repeated_rows_reach_the_joins_once(spark, monkeypatch):
    within, between = jaccard._within_chunk, jaccard._between_units

    def checked_within(*a):
        run = within(*a)

        def checked(pdf):
            assert pdf["class"].is_unique, "copies in a chunk"
            return run(pdf)
        return checked

    def checked_between(*a):
        run = between(*a)

        def checked(batches):
            def looked_at():
                for b in batches:
                    for side in ("left", "right"):
                        for rows in b.column(side).to_pylist():
                            assert len(rows) == len({r["class"] for r in rows}), "copies in a unit"
                    yield b
            return run(looked_at())
        return checked

    monkeypatch.setattr(jaccard, "_within_chunk", checked_within)
    monkeypatch.setattr(jaccard, "_between_units", checked_between)
    rng = random.Random(5)
    texts = [" ".join(f"{g}w{rng.randrange(500)}" for _ in range(120)) for g in "abc"]
    near = [" ".join(["changed", *t.split()[1:]]) for t in texts]
    rows = [(1, texts[0])] * 3000 + [(None, texts[1])] * 3000 + [(2, near[0]), (3, near[1]), (4, texts[2]), (None, near[2])] + [(5, near[2])] * 50
    got = {}
    for r in jaccard.near_duplicates(docs_of(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["component_id"]), []).append(r["n_shingles"])
    assert {k: len(v) for k, v in got.items()} == {(1, 1): 3000, (2, 1): 1, (None, 3): 3000, (3, 3): 1, (4, 4): 1, (None, 4): 1, (5, 4): 50}


def test_components_of_a_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r["id"], r["label"]) for r in jaccard.components(links).collect()} == {(i, 0) for i in range(n)} | {(100, 100), (101, 100)}


# ---- toxicity

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(6, seed=3)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) * (v.ndim > 1) for k, v in net.p.items()}
    known, grams = np.array([0, 1, 2, 3]), rng.integers(0, 50, (4, toxicity.GRAMS))
    at, target = rng.integers(0, 4, (3, 7)), np.array([1.0, 0.0, 1.0])
    mask = np.ones(at.shape, bool)

    def loss():
        vec, _ = net.inputs(known, grams)
        z = net.forward(net.project(vec), at, mask)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * target).sum())
    vec, count = net.inputs(known, grams)
    z, cache = net.forward(net.project(vec), at, mask, keep=True)
    g = net.backward(toxicity._sigmoid(z) - target, at, cache, vec, count, known, grams)
    for name in ("wx", "u", "wa", "va", "wo", "bo", "bx"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-2, name


def test_windows_cover_every_word():
    for n in (1, 5, 31, 32, 33, 48, 49, 100, 1000):
        w = toxicity.windows(np.arange(1, n + 1))
        assert w.shape[1] == toxicity.WINDOW and set(w.ravel()) - {0} == set(range(1, n + 1))


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(9)
    plain, bad = [f"word{i}" for i in range(200)], ["blorkish", "blorkest", "blorkly", "blorked", "vrinful"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, ""), (2001, None), (None, "word1 word2"), (2002, "word3 " * 20_000), (2003, "1 2 3")]
    df = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, share = toxicity.fit(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df, model, share).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    for i in range(900):
        assert got[i]["held"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(got[i]["score"] >= toxicity.THRESHOLD, i % 4 == 0) for i in range(900) if got[i]["held"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[2000]["score"] == got[2001]["score"] == got[2003]["score"] < toxicity.THRESHOLD
    assert toxicity.score(df.limit(0), model, share).count() == 0
    none, zero = toxicity.fit(df, lab.limit(0))
    assert none is None and zero == 0.0 and toxicity.score(df, none, zero).where("score != 0").count() == 0


def test_toxic_word_inside_a_long_run():
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    plain, bad = [make() for _ in range(200)], ["zyxwqt", "zyxwqs", "qvzyxw"]
    texts, labels = [], []
    for i in range(800):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words) if i % 8 < 4 else "".join(words))
        labels.append(int(i % 4 == 0))
    reader = toxicity.fit_texts(texts, labels).reader()
    clean = [[rng.choice(plain) for _ in range(33)] for _ in range(40)]
    runs = ["".join(w) for w in clean]  # 198 letters
    dirty = ["".join([*w[:at], bad[at % 3], *w[at + 1:]]) for at, w in zip(itertools.cycle(range(10, 23)), clean)]
    assert sum(reader.scores(dirty) >= toxicity.THRESHOLD) >= 36 and sum(reader.scores(runs) >= toxicity.THRESHOLD) <= 2


def test_pieces_hold_every_gram():
    grams = lambda s: {s[i:i + 4] for i in range(len(s) - 3)}
    for n in (1, 16, 17, 18, 19, 24, 25, 200):
        run = "".join(chr(0x4e00 + i) for i in range(n))
        cut = toxicity.words_of(run)
        assert set().union(*map(grams, cut)) == grams(run) and "".join(sorted(set("".join(cut)))) == run
        assert max(map(len, cut)) <= toxicity.LONGEST and len(cut) <= n // toxicity.STEP + 1


def test_long_documents_train_too(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(240):  # all toxic documents are longer than 6,000 characters
        words = [rng.choice(plain) for _ in range(1200 if i % 4 == 0 else 100)]
        if i % 4 == 0:
            words[::20] = [rng.choice(["zyxwqt", "zyxwqs", "qvzyxw"]) for _ in words[::20]]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    df, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, share = toxicity.fit(df, lab)
    assert model is not None
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(df, model, share).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(240)) >= 220


def test_excerpts_are_bounded(spark):
    text = "".join(chr(0x4e00 + i) for i in range(15_000))
    rows = spark.createDataFrame([(i, text[:n]) for i, n in enumerate((0, 5999, 6000, 6001, 15_000))], "doc_id long, text string")
    got = [r[0] for r in rows.orderBy("doc_id").select(toxicity.excerpt(F.col("text"), F.col("doc_id"), F.lit(6000))).collect()]
    assert [len(g) for g in got[:3]] == [0, 5999, 6000] and all(len(g) == 6005 and g.count(" ") == 5 for g in got[3:])
    assert all(p in text for p in got[4].split(" "))

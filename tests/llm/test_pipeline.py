import re

import corpus_pipeline
from shopstream.llm import bpe, pii

DIR = "/root/testdata/sf0.01"


def _shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        from shopstream.session import shared_table
        docs = shared_table(stage(spark, docs, DIR))
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before = seen["start"]
    clean = [r for r in before if labels.get(r["doc_id"]) == 0]
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert sum(r["doc_id"] in kept for r in clean) >= 0.97 * len(clean)

    # near duplicates against all pairs
    rows = seen["toxicity"]
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {i for i in sets if not sets[i] or root(i) == i}
    assert {r["doc_id"] for r in seen["near duplicates"]} == want

    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in seen["decontamination"]}
    for r in seen["near duplicates"]:
        text = " " + " ".join(re.findall(r"[^\W_]+", r["text"].lower())) + " "
        if any(f" {' '.join(i)} " in text for i in items):
            assert r["doc_id"] not in left
    assert len(left) >= 0.9 * len(want)

    for r in seen["personal data"]:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    own = bpe.codec(*bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in seen["personal data"]}
    assert len(seen["tokens"]) == len(texts)
    for r in seen["tokens"]:
        assert own.decode(list(r["ids"])).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_without_a_model_no_document_is_dropped_as_toxic(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, "some words", None, "s", 10) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 9


def test_rows_are_judged_by_id_and_text(spark, tmp_path):
    words = lambda tag: " ".join(f"{tag}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (2, a + " end"), (2, b), (None, c), (None, c + " end"), (None, c), (3, b + " end"), (3, "other words stay here"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    got = sorted((str(r["doc_id"]), r["text"].removesuffix(" end")) for r in left)
    assert got == sorted([("1", a), ("2", b), ("None", c), ("3", "other words stay here"), ("4", ""), ("4", "")])
    spark.createDataFrame([(1, c[:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r["text"] for r in kept) == sorted(t for _, t in rows if not t.startswith(c))


def test_columns_of_any_name_pass_through(spark, tmp_path):
    """Names that the stages use inside stay the documents' own; the last stage's results replace columns of their names."""
    from pyspark.sql import functions as F
    own = ["_key", "row_key", "Row_Key_", "score", "_score", "own_score", "_salt", "n_shingles", "component_id", "y", "label"]
    last = ["n_tokens", "ids", "decoded_sha256", "decoded"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in own + last])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(out.columns) == len(set(out.columns)) and set(own) <= set(out.columns)
    rows = out.collect()
    assert len(rows) > 500
    for r in rows:
        assert all(r[c] == f"{c}:{r['doc_id']}" for c in own)
        assert r["n_tokens"] == len(r["ids"])
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()}

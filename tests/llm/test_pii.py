import hashlib
import random
import re

import numpy as np

from shopstream.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_rules_equal_plain_regular_expressions():
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "x", "a.b", "%+-", " ", "1", "25", "255", "256", "+1 ", "(555) ", "-", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "@d.e", "0"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a." * 100_000, "1." * 100_000, "+1" * 50_000, "1 " * 100_000, "a" * 200_000 + "@", "@" * 100_000):
        pii.base_spans(text)
        pii.candidate_spans(text, [])


def test_reliability_and_classifier_follow_the_votes():
    patterns = np.array([[1, 1, 1, 1, 2], [1, 1, 1, 2, 2], [0, 0, 2, 2, 0], [0, 0, 1, 2, 2], [0, 1, 1, 1, 2]])
    table, post = pii.estimate_reliability(patterns, np.array([50.0, 200.0, 300.0, 150.0, 20.0]))
    assert post[0] > 0.95 and post[1] > 0.95 and post[2] < 0.05 and post[3] < 0.3
    assert table[1, 0, pii.YES] > table[0, 0, pii.YES]


def test_query(spark):
    texts = [(1, "mail a.b@c.org or 10.0.0.300 and 10.0.0.3, card 4111 1111 1111 1111, call +1 (555) 123-4567"), (2, None), (3, ""),
             (3, ""), (None, "x@y.z"), (4, "plain words only")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.digest(pii.detect(docs, pii.fit(docs))).collect()), key=str)
    want = []
    for i, t in texts:
        base = brute(t or "")
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *[sum(k == x for x, _, _ in base) for k in pii.BASE], hashlib.sha256(s.encode()).hexdigest()))
    assert [g[:-1] for g in got] == sorted(want, key=str)
    assert pii.detect(docs.limit(0), None).count() == 0 and pii.fit(docs.limit(0)) is None
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs, None).collect()}
    assert red[1] == "mail <EMAIL> or 10.0.0.300 and <IP>, card <CARD>, call <PHONE>" and red[2] is None


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op8_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        base = brute(r["text"] or "")
        have = got[r["doc_id"]]
        assert have["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [have[f"n_{k}"] for k in pii.BASE] == [sum(k == x for x, _, _ in base) for k in pii.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(have["spans"].split(",")) | {""}


def test_reliability_does_not_depend_on_size():
    rng = np.random.default_rng(2)
    patterns, counts = rng.integers(0, 3, (12, len(pii.LABELERS))), rng.integers(1, 9, 12).astype(float)
    table, post = pii.estimate_reliability(patterns, counts)
    for times in (0.1, 10, 1000):
        again, post_again = pii.estimate_reliability(patterns, counts * times)
        assert np.allclose(table, again) and np.allclose(post, post_again)

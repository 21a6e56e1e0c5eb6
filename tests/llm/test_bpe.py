import hashlib
import random

import pytest
import tiktoken

from shopstream.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=own.ranks, special_tokens={})


def _random_texts(n, seed):
    rng = random.Random(seed)
    alphabets = ["ab ", "a", " \n\t\r\x1c\x85 　", "'relsvtdm ", "aé漢字🙂́ ", "0123456789 .,", "abc'S \n-_<|>", "​﻿x y"]
    for _ in range(n):
        text = ""
        while len(text) < rng.choice([3, 30, 300]):
            a = rng.choice(alphabets)
            text += "".join(rng.choice(a) for _ in range(rng.choice([1, 5, 60])))
        yield text


def test_every_token_encodes_to_itself(own):
    assert own.reducible


def test_small_leaves_equal_the_public_encoder(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 4)
    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    monkeypatch.setattr(bpe, "LEAF_IDS", 3)
    for text in _random_texts(1500, 7):
        own.cache.clear()
        ids = own.encode(text).tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_long_pieces(own, reference):
    for text in ("a" * 20_000, "ab" * 9_000, "=" * 5_000 + "é" * 5_000, " " * 9_999 + "x", "'re" * 8_000):
        assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_query_on_a_table(spark, own, reference):
    rows = [(1, ""), (2, None), (3, "plain text, twice"), (3, "plain text, twice"), (4, "<|endoftext|> ids"), (None, "é" * 3)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    v = bpe.default_vocabulary()
    out = bpe.digest(bpe.decode(bpe.encode(df, *v), *v)).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.encode(df.limit(0), *v).count() == 0


def test_whole_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_a_piece_met_again_is_not_worked_out_again(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    codec = bpe.Codec(own.ranks, bpe.default_vocabulary()[1])
    worked_out = []
    monkeypatch.setattr(codec, "tokens", lambda data, plain=codec.tokens: worked_out.append(data) or plain(data))
    text = "".join(f" anteréfou{chr(97 + i % 26)}{chr(97 + i // 26)}q thlyestion" for i in range(600))
    assert codec.encode(text).tolist() == reference.encode_ordinary(text)
    for word in text.split(" ")[1:]:
        codec.encode(" " + word)
    assert worked_out.count(b" thlyestion") == 1
    assert len(codec.cache) <= 50 and len(codec.older) <= 50


def test_what_two_tokens_make_is_kept(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)
    codec = bpe.Codec(own.ranks, bpe.default_vocabulary()[1])
    merged = []
    monkeypatch.setattr(codec, "merge", lambda data, plain=codec.merge: merged.append(data) or plain(data))
    words = [" " + "".join(c) for c in ("thlyestion", "inonathain", "éleéelle", "thlyestioninonathain", "aaaaaaaaaaaaaaaaa")]
    for word in words * 3:
        codec.cache.clear()
        codec.older.clear()
        assert codec.encode(word).tolist() == reference.encode_ordinary(word)
    for (a, b), inner in [((k >> 32, k & 0xFFFFFFFF), v) for k, v in codec.seams.items()]:
        assert list(inner or (a, b)) == reference._encode_single_piece(own.bytes_of[a] + own.bytes_of[b])
    once = len(merged)
    for word in words:
        codec.cache.clear()
        codec.older.clear()
        codec.encode(word)
    assert len(merged) == once

"""Quality rules by host: measures against plain loops, shrinking, verdicts, awkward rows."""
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstream.llm import quality

SCHEMA = "doc_id long, text string, source string, n_words string, verdict string, host string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#", "é🙂", " ", "\n", "\t", " ", "\x0b", "|x", "\r"]), max_size=60).map("".join))
def test_measures_equal_plain_loops(text):
    assert quality.measures(text) == plain(text)


def test_many_distinct_words():
    words = [str(i) for i in range((1 << 20) + 5)] + ["1", "2", "3", "4"]
    assert quality.repeated_words(words) == 8


def good(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, h, "clash", "clash", "clash") for i, t, h in rows], SCHEMA)


def expected(rows):
    """host -> shrunk rate, by the docstring's formulas; None: the overall rate."""
    def failed(t):
        n, chars, symbols, lines, dup, rep = plain(t)
        return n < 50 or 2 * rep > n or 10 * symbols > n or 10 * dup > 3 * lines or chars < 3 * n or chars > 10 * n
    n, f = Counter(), Counter()
    for _, t, h in rows:
        n[h or None] += 1
        f[h or None] += failed(t)
    mean = sum(f.values()) / sum(n.values())
    hosts = [h for h in n if h]
    total, bad = sum(n[h] for h in hosts), sum(f[h] for h in hosts)
    p = bad / total
    noise = p * (1 - p)
    strength = 1.0
    room = total - sum(n[h] ** 2 for h in hosts) / total - (len(hosts) - 1)
    if noise and room > 0:
        rho = (sum(n[h] * (f[h] / n[h] - p) ** 2 for h in hosts) - noise * (len(hosts) - 1)) / (noise * room)
        strength = 1 / min(max(rho, 1e-6), 1 - 1e-6) - 1
    return {h: (f[h] + strength * mean) / (n[h] + strength) for h in hosts} | {None: mean}, failed


def test_verdicts_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for h, share, n in (("clean", 0.0, 400), ("hot", 0.05, 900), ("bad", 0.9, 300), ("one bad", 1.0, 1), ("one good", 0.0, 1), ("", 0.3, 9), (None, 0.3, 300)):
        rows += [(len(rows) + k, good(rng) + (" # | %" * 10 if k < share * n else ""), h) for k in range(n)]
    rows += [(None, None, "clean"), (3, "", "hot"), (3, "", "hot"), (4, good(rng, 5000) + "\n" * 9, "hot")]
    want, failed = expected(rows)
    for heavy in (1000, 3):  # nearly all hosts by broadcast; most of them by the join
        monkeypatch.setattr(quality, "HEAVY", heavy)
        out = quality.judge(frame(spark, rows).repartition(7)).collect()
        assert len(out) == len(rows)
        by_host = {}
        for r in out:
            by_host.setdefault(r["host"], set()).add(r["verdict"])
        assert by_host == {h: {"rejected" if r > 0.5 else "watched" if r > 0.02 else "trusted"} for h, r in want.items()}
        assert by_host["bad"] == {"rejected"} and by_host["clean"] == {"trusted"} and by_host["one bad"] != by_host["clean"]
        base = lambda t: plain(t)[0] < 50 or 2 * plain(t)[5] > plain(t)[0]
        kept = Counter((i, not base(t) and want[h or None] <= 0.5 and not (want[h or None] > 0.02 and failed(t))) for i, t, h in rows)
        assert Counter((r["doc_id"], r["kept"]) for r in out) == kept
        assert Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in out) == Counter((i, *plain(t)) for i, t, _ in rows)


@pytest.mark.parametrize("sums, strength", [((0, 0, 0, 0.0, 0.0), 1.0), ((1, 10, 3, 0.9, 100.0), 1.0), ((4, 40, 0, 0.0, 400.0), 1.0), ((4, 40, 40, 40.0, 400.0), 1.0)])
def test_prior_without_evidence(sums, strength):
    assert quality.prior_strength(*sums) == strength


def test_prior_follows_how_far_hosts_differ():
    alike = quality.prior_strength(10, 1000, 100, 10 * 10 * 10 / 100, 10 * 100.0 ** 2)
    apart = quality.prior_strength(10, 1000, 500, 5 * 100.0, 10 * 100.0 ** 2)
    assert alike > 1e5 and apart < 1e-3


def test_empty_tables_and_only_null_hosts(spark):
    assert quality.judge(frame(spark, [(1, "x", "h")]).limit(0)).count() == 0
    out = quality.judge(frame(spark, [(1, "x", None), (2, None, None), (3, good(random.Random(1)), "")])).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in out) == [(1, False), (2, False), (3, False)]  # overall rate 2/3: rejected

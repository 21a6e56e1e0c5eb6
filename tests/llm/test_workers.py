"""What a Python worker holds during a task and after it."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopstream.llm import bpe, pii, workers


@pytest.fixture()
def in_worker(spark, monkeypatch):
    """The functions that an operator hands to mapInArrow."""
    seen, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, *a, **b: (seen.append(fn), plain(self, fn, *a, **b))[1])
    return seen


def test_all_rows_pass_a_few_at_a_time(monkeypatch):
    given = []
    monkeypatch.setattr(workers, "give_back", lambda: given.append(1))
    sizes = []

    def run(batches):
        for batch in batches:
            sizes.append(batch.num_rows)
            yield batch
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 7), (7, 7), (7, 10))]
    out = [x for batch in workers.lean(run, 3)(iter(batches)) for x in batch.column("x").to_pylist()]
    assert out == list(range(10)) and sizes == [3, 3, 1, 3]
    assert len(given) == 5
    assert list(workers.lean(run)(iter([]))) == []


def test_operators_handle_few_texts_at_a_time(spark, in_worker):
    docs = spark.createDataFrame([(i, f"mail {i}@example.com word") for i in range(8)], "doc_id long, text string")
    vocabulary = bpe.default_vocabulary()
    pii.detect(docs, None), pii.redact(docs, None), bpe.decode(bpe.encode(docs, *vocabulary), *vocabulary)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": ["write to a@b.com or +49 30 1234567"] * 2000})
    detect, redact, encode, decode = in_worker
    for fn in (detect, redact, encode):
        out = list(fn(iter([batch])))
        assert sum(b.num_rows for b in out) == 2000 and max(b.num_rows for b in out) <= workers.ROWS  # 2000 before
    back = list(decode(iter(list(encode(iter([batch]))))))
    assert [x for b in back for x in b.column("decoded").to_pylist()] == [b"write to a@b.com or +49 30 1234567"] * 2000


def test_patterns_are_counted_once_a_task(spark, in_worker):
    docs = spark.range(1).select(F.lit("a@b.com").alias("text"))
    pii.count_patterns(docs)
    batch = pa.RecordBatch.from_pydict({"text": ["write to a@b.com", None, ""] * 300})
    out = list(in_worker[0](iter([batch, batch])))
    assert len(out) == 1 and out[0].column("n").to_pylist() == [600]
    assert sum(b.num_rows for b in in_worker[0](iter([]))) == 0


HELD = """
import re, sys
import pyarrow as pa
from shopstream.llm import workers

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    kept = []
    for batch in batches:
        texts = [t + "x" for t in batch.column("text").to_pylist()]
        kept.append("k" * 600)  # a cache's entry behind them keeps the heap from shrinking by itself
        yield batch

batches = lambda: iter([pa.RecordBatch.from_pydict({"text": ["y" * 2000] * 20_000})])
before = held()
for batch in (workers.lean(run) if sys.argv[1] == "lean" else run)(batches()):
    del batch
print(held() - before)
"""


def test_free_memory_is_not_held():
    grown = {how: float(subprocess.run([sys.executable, "-c", HELD, how], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2]).stdout) for how in ("lean", "plain")}
    assert grown["lean"] < grown["plain"] / 2, grown

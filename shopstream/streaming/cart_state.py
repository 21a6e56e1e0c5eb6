"""Cart lines kept as streaming state per (cart, product).

The same rules as :mod:`shopstream.operators.cart`, applied as commands arrive
(``transformWithStateInPandas``):

* static checks (cart id, op, quantity, product exists) are a stream-static join; commands that
  fail them go through the state operator as well, change nothing and are listed as rejected;
* commands wait ``delay`` seconds (processing time, a timer) in a list state and are then applied
  in ``seq`` order, so what arrives out of order within the delay is put in order; a command with a
  ``seq`` at or below the last applied one is rejected as ``late``.  Without delay each micro-batch
  is applied at once;
* a line that is deleted leaves the line state; only its last ``seq`` is kept, in a state with a time
  to live of ``retention`` seconds, so state shrinks with the carts.  A command older than
  a deletion that comes after that time is no longer recognised as late.

Output mode ``update``: one row for every key touched, with the line after it (``present = false``
means the line is gone) and all commands rejected.  Uses the RocksDB state store, which timers and
time to live need.  Batches without data are run only where timers wait for one (``delay``): otherwise
an ``availableNow`` run would not end.  Both are session settings, made here, that a query reads when it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from shopstream.operators.cart import validate_commands

OUTPUT_SCHEMA = ("cart_id string, product_id long, present boolean, quantity int, added_at timestamp_ntz, "
                 "last_seq long, rejected array<long>, rejects array<struct<seq:long,op:string,reason:string>>")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CartLine(StatefulProcessor):
    """One cart line: ``line`` while it is present, ``gone`` (last seq) for a while after, ``waiting`` commands."""

    def __init__(self, delay: float, retention: float):
        self.delay, self.retention = int(delay * 1000), int(retention * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "quantity int, added_at timestamp_ntz, last_seq long")
        self.gone = handle.getValueState("gone", "last_seq long", self.retention)
        self.waiting = handle.getListState("waiting", "seq long, op string, quantity int, at timestamp_ntz")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commands, rejects = [], []
        for pdf in rows:
            for seq, op, q, at, reason in zip(pdf["seq"], pdf["op"], pdf["quantity"], pdf["at"], pdf["reason"]):
                seq, op = int(seq), None if pd.isna(op) else op
                if not pd.isna(reason):
                    rejects.append((seq, op, reason))
                else:
                    commands.append((seq, op, None if pd.isna(q) else int(q), None if pd.isna(at) else pd.Timestamp(at).to_pydatetime()))
        if self.delay and commands:
            for c in commands:
                self.waiting.appendValue(c)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay)
            commands = []
        if commands or rejects:
            yield self.apply(key, commands, rejects)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        commands = list(self.waiting.get())
        self.waiting.clear()  # a later timer finds what came after
        if commands:
            yield self.apply(key, commands, [])

    def apply(self, key, commands: list[tuple], rejects: list[tuple]) -> pd.DataFrame:
        present = self.line.exists()
        quantity, added_at, last = self.line.get() if present else (0, None, -1)
        if not present and self.gone.exists():
            last = self.gone.get()[0]
        for seq, op, q, at in sorted(commands, key=lambda c: c[0]):
            if seq <= last:
                rejects.append((seq, op, "late"))
                continue
            last = seq
            if op == "add":
                quantity, added_at, present = (quantity + q, added_at, True) if present else (q, at, True)
            elif not present:
                rejects.append((seq, op, "not_in_cart"))
            elif op == "del" or q <= 0:
                quantity, added_at, present = 0, None, False
            else:
                quantity = q
        if present:
            self.line.update((quantity, added_at, last))
            self.gone.clear()
        elif commands:
            self.line.clear()
            self.gone.update((last,))
        return pd.DataFrame({"cart_id": [key[0]], "product_id": [key[1]], "present": [present], "quantity": [quantity], "added_at": [added_at],
                             "last_seq": [last], "rejected": [[seq for seq, _, _ in rejects]],
                             "rejects": [[{"seq": s, "op": o, "reason": r} for s, o, r in rejects]]})

    def close(self) -> None:
        pass


def cart_state_stream(commands: DataFrame, products: DataFrame, *, delay: float = 0.0, retention: float = 7 * 86_400.0) -> DataFrame:
    """Streaming DataFrame of cart line states (update mode); ``delay`` and ``retention`` in seconds."""
    conf = commands.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true" if delay else "false")
    checked = validate_commands(commands, products).select("seq", "cart_id", "op", "product_id", "quantity", "at", "reason")
    return checked.groupBy("cart_id", "product_id").transformWithStateInPandas(
        CartLine(delay, retention), OUTPUT_SCHEMA, "update", "ProcessingTime")

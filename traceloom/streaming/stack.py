"""A live call stack for every trace of an event stream: depth at each event, calls as they close, and what is open when a trace goes quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "trace string, kind string, seq long, ts timestamp, function_name string, depth long, took long"
EVENT = StructType([StructField("ts", TimestampType()), StructField("order_id", LongType()), StructField("event_type", StringType()), StructField("function_name", StringType())])
CALL = StructType([StructField("function_name", StringType()), StructField("seq", LongType())])
#: depth: calls minus returns, never below 0; seq: events so far; last: milliseconds of the last one.
TOLD = StructType([StructField("depth", LongType()), StructField("seq", LongType()), StructField("last", LongType())])


def millis(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class CallStack(StatefulProcessor):
    """State of a trace: events that the watermark has not passed, calls that are open, depth and number of events.

    Events wait until the watermark has passed them, so they are taken in the order of time, however they arrive. A trace without events for
    ``gap_ms`` beyond its last one ends: its open calls come out and its state goes.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open, self.told = handle.getListState("waiting", EVENT), handle.getListState("open", CALL), handle.getValueState("told", TOLD)

    @staticmethod
    def unclosed(trace: str, calls, last: int, depth: int) -> list[tuple]:
        return [(trace, "open", at, pd.Timestamp(last, unit="ms"), name, depth, None) for name, at in calls]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        for batch in rows:
            self.waiting.appendList([(r.ts.to_pydatetime(), r.order_id, r.event_type, r.function_name) for r in batch.itertuples()])
            for at in {*map(millis, batch["ts"])}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        due = [e for e in waiting if millis(e[0]) <= now]
        depth, seq, last = self.told.get() if self.told.exists() else (0, 0, now)
        out = []
        if due:
            stack = [tuple(c) for c in self.open.get()]
            for ts, _, kind, name in due:
                if seq and millis(ts) - last >= self.gap_ms:
                    out += self.unclosed(key[0], stack, last, depth)
                    depth, seq, stack = 0, 0, []
                took = None
                if kind == "call":
                    depth += 1
                    stack.append((name, seq))
                elif kind == "return":
                    depth = max(0, depth - 1)
                    if stack and stack[-1][0] == name:
                        took = seq - stack.pop()[1]
                out.append((key[0], "event" if took is None else "closed", seq, ts, name, depth, took))
                seq, last = seq + 1, millis(ts)
            for state, rows in ((self.waiting, [tuple(e) for e in waiting[len(due) :]]), (self.open, stack)):
                state.put(rows) if rows else state.clear()  # no empty list can be put
            self.told.update((depth, seq, last))
            self.handle.registerTimer(last + self.gap_ms)
        elif now >= last + self.gap_ms and self.told.exists():
            out = self.unclosed(key[0], self.open.get(), last, depth)
            for state in (self.open, self.told):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"took": "Int64"})

    def close(self) -> None:
        pass


def live_stack(events: DataFrame, late: str = "1 hour", gap: str = "1 day") -> DataFrame:
    """trace, kind, seq, ts, function_name, depth, took of a stream of trace, ts, order_id, event_type (call, return, other), function_name.

    kind: `event`; `closed` for a return that closes the innermost open call, as its name is the same, ``took`` events after it; `open` for a call
    that is open when its trace has been quiet for ``gap``. depth is that of ``sequences.depths``. Events later than the watermark
    are dropped. Equal times are ordered by order_id. Needs the state store of STATE_STORE, which the caller sets on the session.
    """
    rows = events.select(F.col("trace").cast("string").alias("trace"), F.col("ts").cast("timestamp").alias("ts"), F.col("order_id").cast("long").alias("order_id"), "event_type", "function_name")
    quiet = pd.Timedelta(gap) // pd.Timedelta(milliseconds=1)
    return rows.withWatermark("ts", late).groupBy("trace").transformWithStateInPandas(CallStack(quiet), OUT, "append", "eventTime")

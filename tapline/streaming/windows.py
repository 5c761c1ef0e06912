"""Streaming scoring windows: per key the context is kept as counts per distinct time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .frames import plain_text


class ContextProcessor(StatefulProcessor):
    """Emits scoring intervals as events pass their ends; refuses events older than the last one.

    When event time has left a key behind, its remaining context comes out once and its state is removed.
    """

    def __init__(self, context: int, interval: int, columns: list[str]):
        self.context, self.interval, self.columns = context, interval, columns

    def init(self, handle):
        self.handle = handle
        self.slots = handle.getListState("slots", "t long, n long")
        self.clock = handle.getValueState("clock", "due long, last long")

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        held = np.array(list(self.slots.get()) if self.slots.exists() else [], dtype=np.int64).reshape(-1, 2)
        return held[:, 0], held[:, 1]

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq_no", ignore_index=True)
        t, seq = batch["at_us"].to_numpy(np.int64), batch["seq_no"].to_numpy(np.int64)
        due, last = self.clock.get() if self.clock.exists() else (int(t[0]) + self.interval, int(t[0]))
        before = np.maximum.accumulate(np.concatenate([[last], t]))
        good = t >= before[:-1]
        out = [(*key, None, None, int(a), int(b), None, "Window events must be timestamp-ordered") for a, b in zip(t[~good], seq[~good])]
        t, seq = t[good], seq[good]
        past, counts = self._held()
        times, total = np.concatenate([past, t]), np.concatenate([[0], np.cumsum(np.concatenate([counts, np.ones(len(t), np.int64)]))])
        # An event passes as many ends as whole intervals lie between the next end and itself, less those passed before.
        passed = np.maximum(0, (t - due) // self.interval + 1)
        fresh = np.diff(np.concatenate([[0], passed]))
        for i in np.flatnonzero(fresh):
            held = total[len(past) + i + 1] - total[np.searchsorted(times, t[i] - self.context)]
            for k in range(passed[i] - fresh[i], passed[i]):
                end = int(due + k * self.interval)
                out.append((*key, end - self.interval, end, int(t[i]), int(seq[i]), int(held), None))
        last = int(before[-1])
        due += int(passed[-1]) * self.interval if len(passed) else 0
        distinct, first = np.unique(times, return_index=True)
        numbers = np.diff(np.concatenate([total[first], total[-1:]]))
        keep = distinct >= last - self.context
        self.slots.clear()
        self.slots.put([(int(a), int(b)) for a, b in zip(distinct[keep], numbers[keep])])
        self.clock.update((due, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-last // 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, last = self.clock.get()
        held = int(self._held()[1].sum())
        self.slots.clear()
        self.clock.clear()
        yield self._frame([(*key, last, last, last, None, held, None)])

    def _frame(self, rows):
        out = pd.DataFrame(rows, columns=self.columns)
        whole = ["start_us", "end_us", "triggered_us", "trigger_seq", "context_count"]
        return plain_text(out).astype({c: "Int64" for c in whole})

    def close(self):
        pass


def context_windows_stream(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, context: float, interval: float, forget_seconds: float | None = None
) -> DataFrame:
    """Emissions of a stream whose events are in time order per key; refused events carry a reason.

    A key is flushed and forgotten when the stream's event time is ``forget_seconds`` (by default the context, at
    least) past its last event: its remaining context comes out with equal start and end, and a later event opens a
    new series. Events older than that are dropped. Needs the RocksDB state store.
    """
    by = list(by)
    forget = max(context, interval) if forget_seconds is None else forget_seconds
    if forget <= 0:
        raise ValueError("state needs an end: forget_seconds must be positive")
    prepared = df.select(
        *by, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(seq).cast("long").alias("seq_no"), F.col(ts).cast("timestamp").alias("event_time"),
    ).withWatermark("event_time", f"{forget} seconds")
    columns = [*by, "start_us", "end_us", "triggered_us", "trigger_seq", "context_count", "reject_reason"]
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, start_us long, end_us long, triggered_us long, trigger_seq long, context_count long, reject_reason string"
    processor = ContextProcessor(int(round(context * 1e6)), int(round(interval * 1e6)), columns)
    return prepared.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime"
    )

"""Streaming reorder: each key keeps its unreleased rows and the largest event time it has seen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .frames import plain_text


def release_at(marks: np.ndarray, times: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Position of the first arrival, not before a row's own, whose watermark reaches the row's time.

    ``marks`` never falls, so it is one search; ``len(marks)`` stands for not yet.
    """
    return np.maximum(np.searchsorted(marks, times, side="left"), own)


class ReorderProcessor(StatefulProcessor):
    """Releases the rows of a key in (time, arrival) order once the key's own watermark allows.

    Spark's watermark moves between micro-batches for the whole query; this rule moves with every
    arrival of the key, so the largest time is kept in state. Unreleased rows are a map by (time,
    arrival): a batch adds and removes only what changes, and reads the map only if the watermark has reached the
    least time in it. A timer of event time drains keys that went quiet, and forgets them.
    """

    def __init__(self, lateness: int, late: str, columns: list[str]):
        self.lateness, self.late, self.columns = lateness, late, columns

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t long, arrival long", "late boolean, payload string")
        self.clock = handle.getValueState("clock", "seen long, released long, least long")

    def _held(self) -> pd.DataFrame:
        rows = [(*k, *v) for k, v in self.waiting.iterator()] if self.waiting.exists() else []
        return pd.DataFrame(rows, columns=["t", "arrival", "late", "payload"])

    def _frame(self, key, rows: pd.DataFrame, released: int) -> tuple[pd.DataFrame, int]:
        """Output rows in release order; those without a position stay unnumbered."""
        rows = rows.sort_values(["at", "t", "arrival"], ignore_index=True)
        numbered = rows["numbered"].to_numpy(bool)
        number = pd.Series(np.cumsum(numbered) + released, dtype="Int64").where(pd.Series(numbered))
        out = {c: [k] * len(rows) for c, k in zip(self.columns, key, strict=False)}
        out |= {c: rows[c] for c in ("arrival", "payload", "late", "too_late")} | {"release_seq": number}
        return plain_text(pd.DataFrame(out, columns=self.columns)), released + int(numbered.sum())

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).sort_values("arrival_no", ignore_index=True)
        seen, released, least = self.clock.get() if self.clock.exists() else (None, 0, None)
        t = new["at_us"].to_numpy(np.int64)
        top = np.maximum.accumulate(np.concatenate([[t[0] if seen is None else seen], t]))
        marks = top[1:] - self.lateness
        own = np.arange(len(t))
        fresh = pd.DataFrame({"t": t, "arrival": new["arrival_no"], "payload": new["payload_text"], "late": t < top[:-1], "too_late": t < marks})
        fresh["at"] = np.where(fresh["too_late"], own, release_at(marks, t, own))
        fresh["numbered"] = ~fresh["too_late"] | (self.late == "release")
        due = least is not None and least <= marks[-1]
        held = self._held() if due else pd.DataFrame(columns=["t", "arrival", "late", "payload"])
        held["too_late"], held["numbered"] = False, True
        held["at"] = release_at(marks, held["t"].to_numpy(np.int64), np.zeros(len(held), np.int64))
        for row in held[held["at"] < len(marks)].itertuples():
            self.waiting.removeKey((int(row.t), int(row.arrival)))
        for row in fresh[fresh["at"] >= len(marks)].itertuples():
            self.waiting.updateValue((int(row.t), int(row.arrival)), (bool(row.late), row.payload))
        both = pd.concat([held, fresh], ignore_index=True) if len(held) else fresh
        out, released = self._frame(key, both[both["at"] < len(marks)], released)
        waiting = both.loc[both["at"] >= len(marks), "t"]
        least = min([int(waiting.min())] if len(waiting) else [], default=None) if due or least is None else min([least, *map(int, waiting)])
        self.clock.update((int(top[-1]), released, least))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-int(top[-1]) // 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        _, released, _ = self.clock.get()
        held["too_late"], held["numbered"], held["at"] = False, True, 0
        out, _ = self._frame(key, held, released)
        self.waiting.clear()
        self.clock.clear()
        yield out

    def close(self):
        pass


def reorder_stream(
    df: DataFrame, by: Sequence[str], ts: str, seq: str, lateness: float, late: str = "quarantine", forget_seconds: float = 600.0
) -> DataFrame:
    """Streaming reorder per key. Rows come out with their columns as JSON in ``payload``.

    Quarantined rows have a null ``release_seq`` and ``too_late`` set; split them off in ``foreachBatch``. A key whose last
    event the stream's event time has left ``forget_seconds`` behind is drained and forgotten; rows older than that are
    dropped, and the key's next row starts anew, with its own clock and numbers. Needs the RocksDB state store.
    """
    by = list(by)
    if forget_seconds < lateness:
        raise ValueError("forget_seconds must cover the lateness")
    prepared = df.select(
        *by, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(seq).cast("long").alias("arrival_no"),
        F.to_json(F.struct(*df.columns)).alias("payload_text"), F.col(ts).cast("timestamp").alias("event_time"),
    ).withWatermark("event_time", f"{forget_seconds} seconds")
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    columns = [*by, "arrival", "payload", "late", "too_late", "release_seq"]
    schema = f"{keys}, arrival long, payload string, late boolean, too_late boolean, release_seq long"
    return prepared.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=ReorderProcessor(int(round(lateness * 1e6)), late, columns),
        outputStructType=schema, outputMode="append", timeMode="EventTime",
    )

"""Streaming DNS context: per stream the last 20 records are kept."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.features import dns_base_features
from ..operators.rolling import EXFIL_FEATURES, HISTORY
from .frames import plain_text

BASE = tuple(dict.fromkeys(name.rsplit("_", 2)[0] for name in EXFIL_FEATURES))


class ExfilProcessor(StatefulProcessor):
    """Rolls over the stored history followed by the micro-batch, so results do not depend on its size."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle):
        self.handle = handle
        self.history = handle.getListState("history", ", ".join(f"`{c}` double" for c in BASE))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq_no")
        stored = list(self.history.get()) if self.history.exists() else []
        past = pd.DataFrame(stored, columns=list(BASE), dtype=float)
        values = pd.concat([past, batch[list(BASE)].astype(float)], ignore_index=True)
        before = values.shift(1)
        mean = before.rolling(HISTORY, min_periods=1).mean().fillna(0.0)
        std = before.rolling(HISTORY, min_periods=2).std().fillna(0.0)
        stats = {"mean": mean, "std": std}
        out = pd.DataFrame({c: [k] * len(batch) for c, k in zip(self.columns, key)})
        out["seq"] = batch["seq_no"].to_numpy()
        for name in EXFIL_FEATURES:
            column, _, stat = name.rsplit("_", 2)
            out[name] = stats[stat][column].to_numpy()[len(past):]
        used = pd.Series(range(len(past), len(values)))
        out["history_records_used"] = used.clip(upper=HISTORY).to_numpy()
        self.history.clear()
        self.history.put([tuple(r) for r in values.tail(HISTORY).itertuples(index=False)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-max(timerValues.getCurrentWatermarkInMs() * 1000 + 1000, int(batch["at_us"].max())) // 1000))
        yield plain_text(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.history.clear()
        yield pd.DataFrame(columns=[*self.columns, "seq", *EXFIL_FEATURES, "history_records_used"])

    def close(self):
        pass


def exfil_context_stream(df: DataFrame, by: Sequence[str], seq: str, ts: str = "ts", derive: bool = True, forget_seconds: float = 3_600.0) -> DataFrame:
    """The ten previous-20 features per record of a DNS stream. Needs the RocksDB state store.

    The history of a stream whose last record the event time has left ``forget_seconds`` behind is removed; older
    records are dropped.
    """
    by = list(by)
    if forget_seconds <= 0:
        raise ValueError("state needs an end: forget_seconds must be positive")
    base = dns_base_features(df, lenient=False) if derive else df
    prepared = base.select(
        *by, F.col(seq).cast("long").alias("seq_no"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(ts).cast("timestamp").alias("event_time"),
        *[F.col(c).cast("double").alias(c) for c in BASE],
    ).withWatermark("event_time", f"{forget_seconds} seconds")
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, seq long, {', '.join(f'{n} double' for n in EXFIL_FEATURES)}, history_records_used long"
    return prepared.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=ExfilProcessor(by), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )

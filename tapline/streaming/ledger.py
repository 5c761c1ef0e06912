"""Live counters: what streaming operators count on the way, gathered over micro-batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str, conditions: Mapping[str, Column]) -> DataFrame:
    """The frame, with a count of the rows of each condition taken as they pass; no pass of its own."""
    return df.observe(name, *[F.count_if(c).alias(k) for k, c in conditions.items()])


class Ledger(StreamingQueryListener):
    """Adds up observed counts by query and batch; a batch that runs again replaces its counts.

    Holds one row of numbers for each batch, the last ``batches`` of them in full and the sum of the older ones.
    """

    def __init__(self, batches: int = 1_000):
        self.batches, self.recent, self.older = batches, {}, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            self.add(str(progress.id), progress.batchId, name, row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def add(self, query: str, batch: int, name: str, counts: dict[str, int]) -> None:
        self.recent.setdefault((query, name), {})[batch] = {k: v or 0 for k, v in counts.items()}
        held = self.recent[query, name]
        while len(held) > self.batches:
            for k, v in held.pop(min(held)).items():
                sums = self.older.setdefault((query, name), {})
                sums[k] = sums.get(k, 0) + v

    def totals(self) -> dict[str, dict[str, int]]:
        """Counts by observation and name over all queries and batches."""
        out: dict[str, dict[str, int]] = {}
        parts = [(name, c) for (_, name), held in self.recent.items() for c in held.values()]
        for name, counts in parts + [(name, c) for (_, name), c in self.older.items()]:
            sums = out.setdefault(name, {})
            for k, v in counts.items():
                sums[k] = sums.get(k, 0) + v
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(observation, counter, records) of ``totals``."""
        rows = [(name, k, v) for name, counts in sorted(self.totals().items()) for k, v in sorted(counts.items())]
        return spark.createDataFrame(rows, "observation string, counter string, records long")

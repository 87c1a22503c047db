"""How far a run has come: counts of its phases, taken while the rows go by."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "phase string, rows long, bytes long"


def phase(rows: DataFrame, name: str, bytes_of: Column | None = None) -> DataFrame:
    """STM-08: `rows`, observed under a name: how many there are and how many bytes they have. Nothing is read twice for it."""
    size = F.coalesce(F.sum(bytes_of if bytes_of is not None else F.lit(0)), F.lit(0)).cast("long")
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), size.alias("bytes"))


class Progress(StreamingQueryListener):
    """Adds up the phases of streams as their batches end. Register it with `with Progress(spark) as p:`; a row a phase is kept."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark, self.lock = spark, threading.Lock()
        self.sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        self.batches: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            if p.batchId <= self.batches.get(str(p.runId), -1):
                return
            self.batches[str(p.runId)] = p.batchId
            for name, row in p.observedMetrics.items():
                self.sums[name][0] += row["rows"]
                self.sums[name][1] += row["bytes"]

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the last event of an ended stream has come."""
        if not self.ended[str(query.runId)].wait(seconds):
            raise TimeoutError("the stream's last event hasn't come")

    def rows(self) -> DataFrame:
        """(phase, rows, bytes) so far."""
        with self.lock:
            return self.spark.createDataFrame([(k, *v) for k, v in sorted(self.sums.items())], SCHEMA)

"""Throttling of events that come late and out of order, in the order of their own time."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _moments(block: bytes) -> Iterator[tuple[int, int]]:
    """(moment, events) of a block."""
    flat = array("q")
    flat.frombytes(bytes(block))
    return zip(flat[::2], flat[1::2])


class Throttle(StatefulProcessor):
    """For each key: the moment of the last accepted event, how many events wait for each moment, and the first of these, for which
    there is a timer. An event is decided once the watermark has passed it, so whatever came before it has come: a timer decides all that
    the watermark has passed, and sets the next one. What a batch brings for a key is one block of state, by its first moment, for each
    access to state is a message; blocks that a timer needn't decide stay as they are."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getMapState("waiting", "at long", "block binary")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = Counter(at for at in (r["at"] for r in rows) if at // 1000 >= passed)  # others are later than the stream waits
        if new:
            first = min(new)
            self._keep(new)
            self._wait_for(first)
        return iter([])

    def _keep(self, new: Counter) -> None:
        """Stores a block, with one that has the same first moment."""
        first = (min(new),)
        if self.waiting.containsKey(first):
            for at, n in _moments(self.waiting.getValue(first)[0]):
                new[at] += n
        self.waiting.updateValue(first, (array("q", [x for pair in sorted(new.items()) for x in pair]).tobytes(),))

    def _wait_for(self, at: int) -> None:
        """Sets a timer, unless there is one as early."""
        if not self.next.exists() or at < self.next.get()[0]:
            self.next.update((at,))
            self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.next.exists() or self.next.get()[0] >= end:
            return  # an earlier timer has decided it all
        due, left, firsts = Counter(), Counter(), []
        for (first,), block in list(self.waiting.iterator()):
            if first >= end:
                firsts.append(first)
                continue
            self.waiting.removeKey((first,))
            for at, n in _moments(block[0]):
                (due if at < end else left)[at] += n
        if left:
            firsts.append(min(left))
            self._keep(left)
        self.next.clear()
        if firsts:
            self._wait_for(min(firsts))
        last = self.last.get()[0] if self.last.exists() else None
        for at, n in sorted(due.items()):
            for _ in range(n):
                ok = last is None or at - last >= self.micros
                last = at if ok else last
                yield Row(key=key[0], at=at, accepted=ok)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def throttled(events: DataFrame, key: str, ts: str, seconds: int, late: str) -> DataFrame:
    """STM-05: (key, ts, accepted) of a stream of events: accepted if `seconds` have gone since the last accepted one of its key, in
    the order of `ts`, whatever order events come in. An event may be `late` behind the latest one; later ones are dropped.
    Decisions come once the watermark has passed. State a key: its last accepted moment, and the events of the last `late`.
    Of events of one moment the first is accepted at most. Null keys and times are left out. Needs the state store STORE.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    out = rows.groupBy("key").transformWithState(Throttle(seconds * 1_000_000), f"key {kind}, at long, accepted boolean", "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), "accepted")


def use_store(spark) -> None:
    """Sets the state store that timers and maps need, for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import snapshots
from scriptorium.streaming import progress, refresh, throttle

DAY = dt.datetime(2026, 1, 1)
SCHEMA = "pageid long, ts string, type string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    t = refresh.BucketTable(spark, str(tmp_path), SCHEMA, "pageid", "ts", 8)
    assert t.read().count() == 0 and t.manifest() is None
    assert t.merge(batch(spark, [(i, "a", "new") for i in range(40)]), "s", 0) == 8
    before = t.manifest()["at"]
    assert t.merge(batch(spark, [(7, "b", "edit"), (7, "c", "last"), (8, "0", "too old")]), "s", 1) <= 2
    after = t.manifest()["at"]
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2
    want = sorted([(i, "a", "new") for i in range(40) if i != 7] + [(7, "c", "last")], key=str)
    assert shown(t.read()) == want
    assert shown(t.read(0)) == sorted([(i, "a", "new") for i in range(40)], key=str)
    # again the same batch; then a stream that counts from 0 again; then null keys, and a batch of nothing
    assert t.merge(batch(spark, [(7, "z", "again")]), "s", 1) == 0 and shown(t.read()) == want
    assert t.merge(batch(spark, [(7, "z", "other stream")]), "s2", 0) == 1
    assert t.merge(batch(spark, [(None, "a", "x"), (None, "b", "y")]), "s2", 1) == 1
    assert t.merge(batch(spark, []), "s2", 2) == 0
    want = sorted([*((i, "a", "new") for i in range(40) if i != 7), (7, "z", "other stream"), (None, "b", "y")], key=str)
    assert shown(t.read()) == want
    assert t.vacuum(1) > 0 and shown(refresh.BucketTable(spark, str(tmp_path), SCHEMA, "pageid", "ts").read()) == want
    assert len(t.versions()) == 1


def test_refresh_stream_restarts(spark, tmp_path):
    t = refresh.BucketTable(spark, str(tmp_path / "t"), SCHEMA, "pageid", "ts", 4)
    for rows in ([(1, "a", "new"), (1, "b", "edit"), (2, "a", "new")], [(1, "c", "edit"), (2, "0", "old")]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        refresh.refresh(stream, t).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert shown(t.read()) == [(1, "c", "edit"), (2, "a", "new")]
    assert list(t.manifest()["batches"].values()) == [1]


@pytest.mark.parametrize("runs", [1, 3])
def test_shuffled_stream_equals_sorted_batch(spark, tmp_path, runs):
    rng = random.Random(9)
    rows = [(rng.randint(1, 4), DAY + dt.timedelta(seconds=rng.randint(0, 5000))) for _ in range(150)]
    rows += rows[:5]
    throttle.use_store(spark)
    df = spark.createDataFrame(rows, "user long, ts timestamp")
    parts = [rows[k::6] for k in range(6)]
    out = str(tmp_path / "out")
    for r in range(runs):
        for p in parts[r * 6 // runs : (r + 1) * 6 // runs]:
            spark.createDataFrame(p, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if r == runs - 1:
            spark.createDataFrame([(0, DAY + dt.timedelta(days=2)), (None, None)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = throttle.throttled(stream, "user", "ts", 600, "2 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = shown(spark.read.schema("user long, ts timestamp, accepted boolean").parquet(out).where("user > 0"))
    assert got == shown(snapshots.throttled(df, "user", "ts", 600))


def test_progress_of_phases(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with progress.Progress(spark) as seen:
        read = progress.phase(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "read", F.lit(8))
        q = progress.phase(read.where("id % 3 = 0"), "kept").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.wait(q)
        assert shown(seen.rows()) == [("kept", 10, 0), ("read", 30, 240)]


class _State(dict):
    """Stands for both kinds of state, and counts whole readings."""

    read = 0
    exists = lambda self: "v" in self
    get = lambda self: self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    def iterator(self):
        self.read += 1
        return iter(list(self.items()))


class _Moment:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_one_timer_decides_all_that_the_watermark_has_passed():
    class Handle:
        timers = []
        states = {}
        getValueState = getMapState = lambda self, name, *_: self.states.setdefault(name, _State())
        registerTimer = timers.append

    h = Handle()
    t = throttle.Throttle(5_000_000)
    t.init(h)
    times = [1_000_000 * k for k in (*range(50), 7, 200, 100)]
    assert list(t.handleInputRows((1,), iter([{"at": a} for a in times]), _Moment(0))) == []
    got = []
    for mark in (60_000, 300_000):
        for ms in sorted(x for x in h.timers if x <= mark):
            h.timers.remove(ms)
            got += [(r.at // 1_000_000, r.accepted) for r in t.handleExpiredTimer((1,), _Moment(mark), _Moment(ms))]
    assert [x for x, ok in got if ok] == [*range(0, 50, 5), 100, 200] and len(got) == len(times)
    assert h.states["waiting"].read == 2 and not h.states["waiting"]


def test_a_batch_is_one_block_of_a_keys_state():
    class Counted(_State):
        written = 0

        def updateValue(self, k, v):
            self.written += 1
            self[k] = v

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []
            self.getValueState = self.getMapState = lambda name, *_: self.states.setdefault(name, Counted())
            self.registerTimer = self.timers.append

    h = Handle()
    t = throttle.Throttle(3_000_000)
    t.init(h)
    batches = [[*range(0, 100, 2), 0], [*range(0, 100, 3)], [*range(1, 100, 5), 500]]
    for b in batches:
        list(t.handleInputRows((1,), iter([{"at": 1_000_000 * a} for a in b]), _Moment(0)))
    assert h.states["waiting"].written == 3
    got = []
    for mark in (50_500, 70_500, 900_000):
        for ms in sorted(x for x in h.timers if x <= mark):
            h.timers.remove(ms)
            got += [(r.at // 1_000_000, r.accepted) for r in t.handleExpiredTimer((1,), _Moment(mark), _Moment(ms))]
    want, last = [], None
    for a in sorted(a for b in batches for a in b):
        want.append((a, last is None or a - last >= 3))
        last = a if want[-1][1] else last
    assert got == want and not h.states["waiting"]

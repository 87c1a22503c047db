import datetime as dt

from pyspark.sql import functions as F

from scriptorium.streaming import flows

DAY = dt.datetime(2026, 1, 1)


def test_breaker_and_debounce(spark):
    rows = [("r", i, s) for i, s in enumerate(["ok", "throttle", "throttle", "ok", "throttle", "throttle", "throttle", "ok"])]
    kept = flows.breaker(spark.createDataFrame(rows, "run string, i int, status string"), "i", throttles=3)
    assert kept.agg(F.max("i")).head()[0] == 6
    events = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(seconds=5)), (1, DAY + dt.timedelta(seconds=50))], "k long, ts timestamp")
    assert sorted(r.events for r in flows.debounced(events, "k", "ts", "10 seconds").collect()) == [1, 2]

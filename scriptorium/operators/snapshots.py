"""Differences between snapshots, patches, membership audits and refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """JOI-18: (key, change, value): added, modified or removed; the value is the new one."""
    o, n = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(key, change.alias("change"), F.col("_new").alias(value)).where("change IS NOT NULL")


def apply(base: DataFrame, delta: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """SNK-15: the snapshot after a patch."""
    kept = base.select(key, value).join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.where("change <> 'removed'").select(key, value))


def verified(files: DataFrame, delta: DataFrame) -> DataFrame:
    """SNK-15: (path, ok): whether the content of each patched file has the digest that was promised."""
    return delta.where("change <> 'removed'").join(files.select("path", F.sha2("content", 256).alias("_got")), "path", "left").select("path", F.coalesce(F.col("_got") == F.col("sha256"), F.lit(False)).alias("ok"))


def membership_diff(a: DataFrame, b: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """JOI-16, AGG-16: (groups, both, only_a, only_b) of two sets of rows."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full_outer")
    return j.groupBy(*groups).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def classify_missing(missing: DataFrame, pages: DataFrame) -> DataFrame:
    """JOI-17, JOI-21: `missing` (ns, title) plus where: same_ns, other_ns or absent."""
    own = pages.select(F.col("ns").alias("p_ns"), F.col("title").alias("p_title")).distinct()
    titles = own.select(F.col("p_title").alias("q_title")).distinct()
    j = missing.join(own, (F.col("ns") == F.col("p_ns")) & (F.col("title") == F.col("p_title")), "left").join(titles, F.col("title") == F.col("q_title"), "left")
    where = F.when(F.col("p_title").isNotNull(), "same_ns").when(F.col("q_title").isNotNull(), "other_ns").otherwise("absent")
    return j.withColumn("where", where).drop("p_ns", "p_title", "q_title")


def latest_change(changes: DataFrame, key: str, ts: str, tie: Column) -> DataFrame:
    """AGG-18: the last row of each key; pre-aggregated, so a busy key costs one row a task."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), tie)).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in rest))


def stale(latest: DataFrame, captured: DataFrame, key: str, ts: str) -> DataFrame:
    """JOI-19: keys never captured, or captured before their last change; equal times are fresh."""
    j = latest.select(key, ts).join(captured.select(key, "captured_at"), key, "left")
    return j.where(F.col("captured_at").isNull() | (F.col("captured_at") < F.col(ts)))


def dead_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """JOI-20: links (dir, fn) whose file isn't there in any case."""
    return links.join(files.select(F.col("dir").alias("f_dir"), F.lower("fn").alias("f_fn")).distinct(), (F.col("dir") == F.col("f_dir")) & (F.lower("fn") == F.col("f_fn")), "left_anti")


def dead_link_report(links: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-15: total, dead, percent and different dead targets, in one row."""
    f = files.select(F.col("dir").alias("f_dir"), F.lower("fn").alias("f_fn")).distinct()
    j = links.join(f, (F.col("dir") == F.col("f_dir")) & (F.lower("fn") == F.col("f_fn")), "left").withColumn("dead", F.col("f_fn").isNull())
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if("dead").alias("dead"), F.round(100.0 * F.count_if("dead") / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("percent"), F.count_distinct(F.when(F.col("dead"), F.struct("dir", "fn"))).alias("targets"))


def upsert(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SNK-14, SNK-19, STM-03: the last row of each key of both; rows win ties."""
    both = base.withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), "_o")).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*base.columns)


def orphans(on_disk: DataFrame, expected: DataFrame, failures: int) -> DataFrame:
    """SNK-17, SNK-21: files to delete; none if any page failed."""
    if failures:
        return on_disk.limit(0)
    return on_disk.join(expected.select(F.lower("stem").alias("e")).distinct(), F.lower("stem") == F.col("e"), "left_anti")


def throttled(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """STM-05: `events` plus accepted: at least `seconds` since the last accepted one of its key.

    Each acceptance restarts the clock, which no window function can say. So each row first learns the
    row that would be accepted after it; then acceptance passes along these pointers, and each round of
    the join doubles how far they reach. A key with a third of all rows is rows of a join, not a group.
    """
    order = Window.partitionBy(key).orderBy(ts, *[c for c in events.columns if c not in (key, ts)])
    rows = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_n", F.row_number().over(order))
    ahead = Window.partitionBy(key).orderBy("_t").rangeBetween(seconds * 1_000_000, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.min("_n").over(ahead))
    rows = cut(rows)
    reached = rows.where("_n = 1").select(key, "_n")
    hop = rows.where("_next IS NOT NULL").select(F.col(key).alias("_k"), F.col("_n").alias("_a"), F.col("_next").alias("_b"))
    while hop.limit(1).count():
        further = reached.join(hop, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_a"))).select(key, F.col("_b").alias("_n"))
        reached = cut(reached.unionByName(further))
        y = hop.toDF("_k2", "_a2", "_b2")
        hop = cut(hop.join(y, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_a2"))).select("_k", "_a", F.col("_b2").alias("_b")))
    out = rows.join(reached.withColumn("accepted", F.lit(True)), [key, "_n"], "left")
    return out.select(*events.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))

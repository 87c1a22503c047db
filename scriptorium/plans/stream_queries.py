"""Queries over listings that are read as a stream, and files that are written, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from ..operators import snapshots
from ..sources import files, listing
from ..sources.shared import new_path
from ..streaming import progress, refresh, throttle
from .queries import query, table


def _answers(rows, size: int):
    """(path, content, number) of a listing's answers from rows (namespace, pageid, title): `size` rows each, by pageid, each naming
    the next. A namespace's rows are numbered by a window; they are a listing of one chain."""
    numbered = rows.withColumn("number", F.floor((F.row_number().over(Window.partitionBy("namespace").orderBy("pageid")) - 1) / size))
    answers = numbered.groupBy("namespace", "number").agg(F.array_sort(F.collect_list(F.struct("pageid", "title"))).alias("rows"))
    last = F.col("number") == F.max("number").over(Window.partitionBy("namespace"))
    content = F.to_json(F.struct("rows", F.when(~last, (F.col("number") + 1).cast("string")).alias("continue")))
    return answers.select(F.concat_ws("/", "namespace", F.concat(F.col("number").cast("string"), F.lit(".json"))).alias("path"), content.alias("content"), "number")


#: Writes a stream's logs by FileSystem; where there is no native library, the default runs a program for each file of a local folder.
LOGS = ("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")


def _run(spark, root: str, out: str, namespaces: str) -> None:
    stream = spark.readStream.format("listing").option("namespaces", namespaces).option("answersPerBatch", 2).option("cursors", f"{out}-cursors/at.json").load(root)
    before = spark.conf.get(LOGS[0], None)
    if out.startswith(("/", "file:")):
        spark.conf.set(*LOGS)
    try:
        running = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").start(out)
    finally:
        spark.conf.unset(LOGS[0]) if before is None else spark.conf.set(LOGS[0], before)
    try:
        running.processAllAvailable()
    finally:
        running.stop()


@query("""SELECT 'n' || c_nationkey % 4 AS namespace, ((row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey) - 1) // 20)::VARCHAR AS answer, c_custkey AS pageid, c_name AS title FROM customer""")
def resumed_listing(spark, sf_dir):
    """SRC-17, STM-02: a listing of the customers, half of it there when a stream first reads it; started again from its checkpoint, the
    stream reads the other half, and nothing twice."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey") % 4).alias("namespace"), F.col("c_custkey").alias("pageid"), F.col("c_name").alias("title"))
    answers, root, out = _answers(rows, 20), new_path(spark, "answers"), new_path(spark, "listed")
    spark.dataSource.register(listing.ListingSource)
    for half in (0, 1):
        files.write_files(answers.where(F.col("number") % 6 >= 3 if half else F.col("number") % 6 < 3), root)
        _run(spark, root, out, "n0,n1,n2,n3")
    return spark.read.schema("namespace string, answer string, pageid long, title string").parquet(out)


@query("SELECT 'n' || item_id % 7 || '/' || item_id || '.txt' AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256, text AS content FROM benchmark WHERE text IS NOT NULL")
def committed_files(spark, sf_dir):
    """SNK-09, SNK-10, SNK-16: passages as files of their own, written all or none, with sizes and digests taken on the way, and read back."""
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("n"), F.col("item_id") % 7, F.lit("/"), F.col("item_id"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    root = new_path(spark, "files")
    manifest = files.write_files(rows, root)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    found = back.select(F.regexp_extract("path", r"(n\d/\d+\.txt)$", 1).alias("found"), F.decode("content", "utf-8").alias("content"))
    return manifest.join(found, F.col("path") == F.col("found")).select("path", "bytes", "sha256", "content")


def _in_files(rows, path: str, n: int, part) -> None:
    """`rows` as files of a folder, those of part 0 first: a stream takes files in the order in which they were changed."""
    for k in range(n):
        rows.where(part == k).write.mode("append").parquet(path)


def _ended(running):
    running.awaitTermination()
    return running


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def refreshed_table(spark, sf_dir):
    """STM-03, SNK-14: users' last events, kept fresh by a stream of batches out of order, in buckets of which each batch
    rewrites those it touches; a second stream brings the first batch again and changes nothing."""
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("order"), "ts", "event_type", "event_id")
    path, source = new_path(spark, "users"), new_path(spark, "changes")
    _in_files(events, source, 4, F.pmod(F.col("event_id") * 7, F.lit(4)))
    kept = refresh.BucketTable(spark, path, events.schema, "user_id", "order", 32)
    for name in ("one", "two"):
        changes = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        _ended(refresh.refresh(changes, kept).option("checkpointLocation", f"{path}-{name}").trigger(availableNow=True).start())
    return kept.read().select("user_id", "ts", "event_type", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, ts, n, ts AS last, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts >= t.last + INTERVAL 6 HOUR THEN e.ts ELSE t.last END, e.ts >= t.last + INTERVAL 6 HOUR FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id, ts, accepted FROM t""")
def throttled_late(spark, sf_dir):
    """STM-05: events in batches out of order, throttled to one in six hours of each user in the order of their own time; the stream
    gives what sorted events give. A last event of no user lets the watermark pass all others."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "ts", "event_id")
    ends = events.agg(F.max("ts").alias("last"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("span")).head()
    source = new_path(spark, "events")
    _in_files(events.drop("event_id"), source, 5, F.when(F.col("ts") == F.lit(ends["last"]), 4).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(4))))
    flush = events.limit(1).select(F.lit(-1).cast("long").alias("user_id"), (F.lit(ends["last"]) + F.make_dt_interval(secs=F.lit(2 * ends["span"] + 60))).alias("ts"))
    _in_files(flush, source, 1, F.lit(0))
    throttle.use_store(spark)
    stream = spark.readStream.schema(events.drop("event_id").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = new_path(spark, "throttled")
    found = throttle.throttled(stream, "user_id", "ts", 6 * 3600, f"{ends['span'] + 1} seconds")
    _ended(found.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out))
    return spark.read.schema(found.schema).parquet(out).where("user_id <> -1").select("user_id", F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), "accepted")


@query("""SELECT 'read' AS phase, count(*)::BIGINT AS rows, sum(strlen(props))::BIGINT AS bytes FROM events
UNION ALL SELECT 'kept', count(*), sum(strlen(props)) FROM events WHERE event_type IN ('error', 'signup')
UNION ALL SELECT 'written', count(DISTINCT (user_id, event_type)), 0 FROM events WHERE event_type IN ('error', 'signup')""")
def phase_progress(spark, sf_dir):
    """STM-08: the phases of a stream over the events, counted while they pass, a batch a file, and told by a listener."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    source, out = new_path(spark, "events"), new_path(spark, "kept")
    _in_files(events, source, 3, F.pmod(F.col("user_id"), F.lit(3)))
    with progress.Progress(spark) as seen:
        read = progress.phase(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), "read", F.octet_length("props"))
        kept = progress.phase(read.where(F.col("event_type").isin("error", "signup")), "kept", F.octet_length("props"))

        def write(batch, number):
            batch.write.mode("append").parquet(out)

        running = kept.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        seen.wait(_ended(running))
        streamed = seen.rows()
    count = Observation("written")
    distinct = spark.read.parquet(out).select("user_id", "event_type").distinct().observe(count, F.count(F.lit(1)).alias("rows"))
    distinct.write.parquet(f"{out}-distinct")
    return streamed.unionByName(spark.createDataFrame([("written", count.get["rows"], 0)], progress.SCHEMA))


@query("""WITH o AS (SELECT c_name AS path, c_mktsegment AS content FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_name AS path, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_mktsegment END AS content FROM customer WHERE c_custkey % 3 <> 0),
d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content <> n.content THEN 'modified' END AS change, n.content FROM o FULL JOIN n ON o.path = n.path)
SELECT path, change, CASE WHEN change <> 'removed' THEN strlen(content)::BIGINT END AS bytes, CASE WHEN change <> 'removed' THEN sha256(content) END AS sha256 FROM d WHERE change IS NOT NULL""")
def patch_folder(spark, sf_dir):
    """SNK-13, JOI-18: what changed between two snapshots of the customers, written as a patch of files with a manifest."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("content"))
    new = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 7 == 0, F.upper("c_name")).otherwise(F.col("c_mktsegment")).alias("content"))
    delta = snapshots.diff(old, new, value="content").select("path", "change")
    return files.write_patch(delta, new, new_path(spark, "patch"))

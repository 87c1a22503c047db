"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SWEPT = [0.0]
#: Paths of stored tables, one list for each open `passing`.
_PASSING: list[list[str]] = []
#: A word: a run of anything but the space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Makes this package importable by Python workers, bounds the bytes of an Arrow batch, and lets workers give
    large arrays back when they are done with them."""
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for name, value in (("MALLOC_MMAP_THRESHOLD_", 2 << 20), ("MALLOC_TRIM_THRESHOLD_", 8 << 20), ("MALLOC_ARENA_MAX", 2), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, str(value))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder: lineage ends there, and a lost executor loses
    nothing. Shuffle files that no DataFrame can ask for any more then go, `df`'s own too unless the caller keeps it."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    del df  # while a name holds it, its shuffle files stay
    sweep(spark)
    return out


def sweep(spark: SparkSession) -> None:
    """Lets go of shuffle files that no DataFrame can ask for any more, at most every five seconds: Spark drops them once the driver
    has collected its garbage, which by itself may take it half an hour."""
    if time.monotonic() - _SWEPT[0] > 5:
        gc.collect()
        _released(spark)
        for pause in (0.2, 0):  # the first collection only frees what holds the last step's shuffles
            spark.sparkContext._jvm.System.gc()
            time.sleep(pause)
        _SWEPT[0] = time.monotonic()


def _released(spark: SparkSession) -> None:
    """Tells the JVM what Python has let go of; py4j's own thread looks once a second and would come after the JVM's collection."""
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:
        try:
            task = waiting.pop()
        except IndexError:  # its thread was faster
            return
        if not isinstance(task, tuple):  # the sign to stop is for its thread
            waiting.append(task)
            return
        task[0].garbage_collect_object(task[1], False)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    spark, schema = df.sparkSession, df.schema
    del df
    sweep(spark)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are `stored` inside are deleted at the end. Take a path out of the list to keep it, put one in to delete it too."""
    paths: list[str] = []
    _PASSING.append(paths)
    try:
        yield paths
    finally:
        _PASSING.remove(paths)
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table of a row a language or source, to be broadcast if it has at most `most` rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text) -> F.col:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers, or of $TOKENIZERS_DIR."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return str(Path(folder, name))
    import public_tokenizers

    return public_tokenizers.path(name)

"""A table kept fresh from a change feed, in buckets of its key: a batch rewrites the buckets that it touches and no other."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import snapshots
from ..sources.shared import file_system


class BucketTable:
    """STM-03, SNK-14: rows under `path`/data, a folder for each write, and `path`/manifests/<version>.json: for each bucket the folder
    that holds it now, and for each stream the last batch that went in. A reader takes one manifest, so it never sees half
    a batch; writers are one at a time. A manifest has as many entries as the table has buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, ts: str, buckets: int = 64):
        self.spark, self.path, self.key, self.ts = spark, path, key, ts
        self.schema = spark.createDataFrame([], schema).schema
        head = self.manifest()
        self.buckets = head["buckets"] if head else buckets

    def versions(self) -> list[int]:
        files, base = file_system(f"{self.path}/manifests")
        if files.get_file_info(base).type.name != "Directory":
            return []
        from pyarrow.fs import FileSelector

        names = [f.base_name for f in files.get_file_info(FileSelector(base))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """That of a version, or the last one."""
        known = self.versions()
        if not known:
            return None
        files, base = file_system(f"{self.path}/manifests/{known[-1] if version is None else version}.json")
        with files.open_input_stream(base) as f:
            return json.loads(f.read())

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        head = self.manifest(version)
        return self._read(head["at"] if head else {})

    def merge(self, changes: DataFrame, stream: str, batch: int) -> int:
        """The last change of each key replaces the key's row unless that is later. Returns how many buckets were written: none if
        the batch of that stream is in already. Null keys are a key."""
        head = self.manifest() or {"version": -1, "buckets": self.buckets, "at": {}, "batches": {}}
        if head["batches"].get(stream, -1) >= batch:
            return 0
        latest = snapshots.latest_change(changes.select(*self.schema.fieldNames()), self.key, self.ts, F.lit(0)).persist()
        try:
            touched = [str(r["b"]) for r in latest.select(self._bucket().alias("b")).distinct().collect()]
            base = self._read({b: head["at"][b] for b in touched if b in head["at"]})
            folder = f"v{head['version'] + 1}-{uuid.uuid4().hex}"
            if touched:
                merged = snapshots.upsert(base, latest.select(*base.columns), [self.key], self.ts)
                merged.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        finally:
            latest.unpersist()
        self._publish(head | {"version": head["version"] + 1, "at": head["at"] | dict.fromkeys(touched, folder), "batches": head["batches"] | {stream: batch}})
        return len(touched)

    def _publish(self, head: dict) -> None:
        files, base = file_system(f"{self.path}/manifests")
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/.part") as f:
            f.write(json.dumps(head).encode())
        files.move(f"{base}/.part", f"{base}/{head['version']}.json")

    def vacuum(self, keep: int = 2) -> int:
        """Drops manifests but the last `keep`, and what buckets held that none of those names. Returns how many buckets' folders
        went."""
        from pyarrow.fs import FileSelector

        known = self.versions()
        if not known:
            return 0
        used = {f"{folder}/bucket={b}" for v in known[-keep:] for b, folder in self.manifest(v)["at"].items()}
        files, base = file_system(self.path)
        for v in known[:-keep]:
            files.delete_file(f"{base}/manifests/{v}.json")
        held = [f.path for f in files.get_file_info(FileSelector(f"{base}/data", recursive=True, allow_not_found=True)) if f.base_name.startswith("bucket=")]
        old = [p for p in held if "/".join(p.split("/")[-2:]) not in used]
        for p in old:
            files.delete_dir(p)
        return len(old)


def refresh(changes: DataFrame, table: BucketTable) -> DataStreamWriter:
    """STM-03 as a stream. A stream is known by the id in its checkpoint, so a batch that is run again changes nothing, and a
    new stream's batches, counted from 0, go in."""
    def merge(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        table.merge(batch, stream, number)

    return changes.writeStream.foreachBatch(merge)

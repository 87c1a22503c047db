"""Writers. Output folders are new ones; none overwrites what is being read."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system


def pages(parsed: DataFrame, path: str) -> None:
    """SNK-01: pages as Parquet, by the first byte of the id's digest; the committer makes it atomic."""
    shard = F.substring(F.sha1(F.col("pageid").cast("string")), 1, 2)
    parsed.withColumn("shard", shard).repartition("shard").write.partitionBy("shard").parquet(path)


def failures(rows: DataFrame, path: str) -> None:
    """SNK-02: what failed, with errors cut to 500 characters."""
    rows.where("status <> 'ok'").withColumn("error", F.substring("error", 1, 500)).write.mode("append").json(path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SNK-03, SNK-20: the state of a run is what it has written."""
    return todo.join(done.select(key), key, "left_anti")


def files(rows: DataFrame, root: str) -> None:
    """SNK-09, SNK-18: one file a row (path, content), written by the tasks to the file system that `root`
    names, each under a name of its own first, so tries of one task don't meet. Rows without a path or content
    are left out; of several with one path any stays."""
    def write(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = file_system(root)
        done, last = 0, None
        for df in part:
            for path, content in zip(df["path"], df["content"]):
                name = f"{base}/{path}"
                if (folder := name.rsplit("/", 1)[0]) != last:
                    target.create_dir(last := folder, recursive=True)
                own = f"{name}.{uuid.uuid4().hex}.part"
                with target.open_output_stream(own) as f:
                    f.write(content.encode())
                target.move(own, name)
                done += 1
        yield pd.DataFrame({"n": [done]})

    rows.select("path", "content").where("path IS NOT NULL AND content IS NOT NULL").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def redirect_stubs(edges: DataFrame) -> DataFrame:
    """SNK-10: (path, content) of pages that send their reader on. edges: path, target_url, title."""
    head = F.concat(F.lit('<!doctype html><meta charset="utf-8"><meta http-equiv="refresh" content="0; url='), F.col("target_url"), F.lit('"><title>'), F.col("title"), F.lit("</title>"))
    body = F.concat(F.lit('<p><a href="'), F.col("target_url"), F.lit('">'), F.col("title"), F.lit("</a></p>"))
    return edges.select("path", F.concat(head, body).alias("content"))


def glossary(rows: DataFrame, path: str) -> None:
    """SNK-11, SNK-12: as JSON lines and as CSV, in a new folder."""
    rows.write.json(f"{path}/json")
    rows.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in rows.dtypes)).write.option("header", True).csv(f"{path}/csv")


def patch(delta: DataFrame, contents: DataFrame, most_bytes: int = 1 << 30) -> bytes:
    """SNK-13: a zip of a manifest and the files that are new or changed. It is one file by nature, so
    its size is checked before anything is gathered."""
    new = contents.join(delta.where("change <> 'removed'").select("path"), "path", "left_semi")
    size = new.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).head()[0]
    if size > most_bytes:
        raise ValueError(f"a patch of {size} bytes; at most {most_bytes} fit one file")
    lists = {k: [] for k in ("added", "modified", "removed")}
    digests = {}
    for r in delta.orderBy("path").toLocalIterator():
        lists[r["change"]].append(r["path"])
        if r["sha256"]:
            digests[r["path"]] = r["sha256"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(lists | {"sha256_after_apply": digests}, ensure_ascii=False, sort_keys=True))
        for r in new.orderBy("path").toLocalIterator():
            z.writestr(f"files/{r['path']}", bytes(r["content"]))
    return out.getvalue()

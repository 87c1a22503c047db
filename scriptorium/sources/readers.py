"""Readers. Each returns a DataFrame, and what is read often should be written once with `sinks`."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from . import schemas
from .shared import file_system


def parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 to SRC-03: pages, one JSON file each, in folders. Names that start with _ are skipped, and so
    are files that don't parse and pages without text."""
    schema = StructType([*schemas.PAGE.fields]).add("_broken", "string")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").json(path)
    return rows.where("_broken IS NULL AND pageid IS NOT NULL AND coalesce(parse.text, '') <> ''").drop("_broken")


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-04, SRC-12, SRC-13, SRC-35: (pages, redirect edges) of a metadata document."""
    doc = spark.read.schema(schemas.METADATA).option("multiLine", True).json(path)
    return doc.select(F.inline("pages")), doc.select(F.explode("redirect_map").alias("src", "tgt"))


def json_lines(spark: SparkSession, path: str, schema: StructType = schemas.WIKITEXT) -> DataFrame:
    """SRC-05: one record a line; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: (en, value array<string>, is_list, pos) of a JSON object of strings or lists of them, in
    the object's order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "en", "raw"))
    raw = F.col("raw")
    value = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return rows.select("en", value.alias("value"), raw.startswith("[").alias("is_list"), F.col("pos").cast("long").alias("pos"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: (name), without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' AND NOT startswith(name, '#')")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-25: (path, sha256) of all files below a folder; unreadable ones are skipped, and so are names
    that start with _ or a dot, which Spark holds for hidden. Tasks list the folders of a local path and share
    its files, however small and many; other file systems are read by Spark, which lists them in the driver."""
    if "://" in path and not path.startswith("file:"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
        root = path.rstrip("/")
        return files.select(F.regexp_replace("path", rf"^.*?\Q{root.split('/')[-1]}\E/", "").alias("path"), F.sha2("content", 256).alias("sha256"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    top = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(True).alias("folder"))
    for deep in (False, True):
        top = top.mapInPandas(partial(_listed, path, deep), "path string, folder boolean").repartition(n, "path")
    return top.mapInPandas(partial(_digested, path), "path string, sha256 string")


def _in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, 10_000)):
        yield pd.DataFrame(some, columns=columns)


def _listed(root: str, deep: bool, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in the given folders of `root`, all files below them if `deep`; files stay as they are."""
    from pyarrow.fs import FileSelector, FileType

    files, base = file_system(root)
    base = base.rstrip("/")

    def below(folder: str) -> Iterator[tuple[str, bool]]:
        for x in files.get_file_info(FileSelector(f"{base}/{folder}")):
            name = x.base_name
            if name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and name not in ("_metadata", "_common_metadata")):
                continue
            at = f"{folder}/{name}" if folder else name
            if deep and x.type == FileType.Directory:
                yield from below(at)
            else:
                yield at, x.type == FileType.Directory

    for df in parts:
        yield from _in_batches((row for p, folder in zip(df["path"], df["folder"]) for row in (below(p) if folder else [(p, False)])), ["path", "folder"])


def _digested(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files, base = file_system(root)
    base = base.rstrip("/")

    def digests(names: Iterator[str]) -> Iterator[tuple[str, str]]:
        for name in names:
            digest = hashlib.sha256()
            try:
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
            except OSError:
                continue
            yield name, digest.hexdigest()

    for df in parts:
        yield from _in_batches(digests(iter(df["path"])), ["path", "sha256"])


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC-26: `pages` without its text, one row a link (href)."""
    return pages.select(*[c for c in pages.columns if c != html], F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


def headings(html) -> F.col:
    """SRC-30: the headings of a page, without tags."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", "")))


def css_urls(css) -> F.col:
    """SRC-31"""
    return F.array_distinct(F.regexp_extract_all(css, F.lit(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"), F.lit(1)))


def missing_pages(meta: DataFrame, parsed: DataFrame, wanted: tuple[int, ...] = (0, 4, 14, 102, 3500)) -> DataFrame:
    """SRC-28, FLT-05, FLT-22, STM-01: pages to fetch: no redirects, of wanted namespaces, not there yet."""
    return meta.where(~F.col("is_redirect") & F.col("ns").isin(list(wanted))).join(parsed.select("pageid"), "pageid", "left_anti")


def captured(parsed: DataFrame) -> DataFrame:
    """SRC-33"""
    return parsed.groupBy("pageid").agg(F.max(F.coalesce("captured_at", F.lit(""))).alias("captured_at"))


def probe(wanted: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """SRC-29: `wanted` (title) plus state: page, redirect or missing."""
    p = pages.select("title", F.lit(True).alias("_p")).distinct()
    r = redirects.select(F.col("src").alias("title"), F.lit(True).alias("_r")).distinct()
    return wanted.join(p, "title", "left").join(r, "title", "left").select("title", F.when(F.col("_p"), "page").when(F.col("_r"), "redirect").otherwise("missing").alias("state"))


def lookup_batches(titles: DataFrame, size: int = 50) -> DataFrame:
    """SRC-14, SRC-21: titles in batches of about `size` for point lookups, without numbering all rows."""
    n = max(1, -(-titles.count() // size))
    return titles.groupBy(F.pmod(F.xxhash64("title"), F.lit(n)).alias("batch")).agg(F.array_sort(F.collect_list("title")).alias("titles"))


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ContinuedSource(DataSource):
    """SRC-08, SRC-17, STM-02, SRC-19, SRC-20: answers of a listing API, page by page, each naming the next. The
    answers are files that a fetcher has left in a folder: {"rows": [...], "continue": "next name"}.
    Chains (options `start`, comma-separated) are read in parallel; as a stream, one answer at a time."""

    @classmethod
    def name(cls) -> str:
        return "continued"

    def schema(self) -> str:
        return "pageid long, ns int, title string, ts string, type string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ContinuedReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _ContinuedStream(self.options)


def _answer(folder: str, name: str) -> tuple[list[tuple], str | None]:
    files, base = file_system(folder)
    with files.open_input_stream(f"{base}/{name}.json") as f:
        doc = json.loads(f.read())
    fields = ("pageid", "ns", "title", "ts", "type")
    return [tuple(r.get(f) for f in fields) for r in doc.get("rows", [])], doc.get("continue")


class _ContinuedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.starts = options["path"], options.get("start", "first").split(",")

    def partitions(self) -> list[InputPartition]:
        return [_Part(s) for s in self.starts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        name, seen = partition.name, set()
        while name and name not in seen:
            seen.add(name)
            rows, name = _answer(self.folder, name)
            yield from rows


class _ContinuedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.start = options["path"], options.get("start", "first")

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        name = start["next"]
        files, base = file_system(self.folder)
        if not name or not files.get_file_info(f"{base}/{name}.json").is_file:
            return iter([]), start
        rows, following = _answer(self.folder, name)
        return iter(rows), {"next": following or ""}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        name = start["next"]
        while name and name != end["next"]:
            rows, name = _answer(self.folder, name)
            yield from rows

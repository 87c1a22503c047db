"""Fetching in parallel, with retries, as a DataFrame of answers. The function that fetches one key is the
caller's: a web client on a cluster that may use one, or a reader of files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Throttled(Exception):
    """Try again, after the seconds given."""

    def __init__(self, seconds: float = 0.0):
        self.seconds = seconds


class Refused(Exception):
    """Don't try again."""


def attempt(get: Callable[[str], str], key: str, tries: int = 4, longest: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None, str | None]:
    """SRC-09, SRC-10: (status, answer, error): pauses double from one second to `longest`, or are what the
    server asks for; a refusal ends at once."""
    error, status = None, "fail"
    for i in range(tries):
        try:
            return "ok", get(key), None
        except Refused as e:
            return "fail", None, str(e)[:500]
        except Throttled as e:
            status, error, pause = "throttle", "throttled", e.seconds or 2.0**i
        except Exception as e:  # noqa: BLE001 - whatever a client raises is a failed try
            status, error, pause = "fail", str(e)[:500], 2.0**i
        if i < tries - 1:
            sleep(min(longest, pause))
    return status, None, error


def fetch(keys: DataFrame, get: Callable[[str], str], workers: int = 20, rate: float | None = None, **options) -> DataFrame:
    """SRC-10, SRC-11, SRC-22: (key, status, answer, error), by `workers` tasks at a time, each at most at `rate`
    a second."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = []
            for key in df["key"]:
                began = time.monotonic()
                rows.append((key, *attempt(get, key, **options)))
                if rate:
                    time.sleep(max(0.0, 1 / rate - (time.monotonic() - began)))
            yield pd.DataFrame(rows, columns=["key", "status", "answer", "error"])

    return keys.select(F.col("key").cast("string")).repartition(workers, "key").mapInPandas(run, "key string, status string, answer string, error string")


def resolved_edges(edges: DataFrame, normalised: DataFrame, answers: DataFrame) -> DataFrame:
    """SRC-15, SRC-16: edges with answers (src, tgt) filled in, under the source's own title and the one that
    the server made of it; answers win."""
    own = answers.join(normalised.select(F.col("to").alias("src"), F.col("from").alias("_from")), "src", "left")
    new = own.select("src", "tgt").unionByName(own.where("_from IS NOT NULL").select(F.col("_from").alias("src"), "tgt")).where("tgt <> ''").dropDuplicates(["src"])
    return edges.join(new.select("src"), "src", "left_anti").unionByName(new)


def namespaces(rows: DataFrame) -> DataFrame:
    """SRC-18: content namespaces: even ids with a name, and the main one; not files."""
    return rows.where("(id = 0 OR (id > 0 AND id % 2 = 0 AND coalesce(name, '') <> '')) AND id <> 6")


def cached_members(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC-19, SRC-37: (category, members): null for what was never fetched, an empty array for no members."""
    return wanted.join(cache, "category", "left").select("category", F.transform("members", lambda m: F.trim(F.replace(m, F.lit("_"), F.lit(" ")))).alias("members"))


def listed_titles(html) -> F.col:
    """SRC-34: the titles in a generated table."""
    cells = F.regexp_extract_all(html, F.lit(r'(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))), lambda c: c != ""))

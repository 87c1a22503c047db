"""What tables on pages do: facets, filters, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, groups: dict[str, Column], arrays: dict[str, Column] | None = None, top: int = 20) -> DataFrame:
    """AGG-07: (facet, value, n, place): one scan for all facets, values by count, then name; at most
    `top` of each array's values."""
    pairs = [F.array(F.struct(F.lit(g).alias("facet"), c.cast("string").alias("value"))) for g, c in groups.items()]
    pairs += [_pairs(g, c) for g, c in (arrays or {}).items()]
    rows = df.select(F.explode(F.concat(*pairs)).alias("f")).where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    return out.where(~F.col("facet").isin(list(arrays or [])) | (F.col("place") <= top))


def _pairs(group: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(group).alias("facet"), v.cast("string").alias("value")))


def facet_filter(df: DataFrame, active: dict[str, list], columns: dict[str, Column]) -> DataFrame:
    """FLT-08: all groups must match, any value of a group does; a group without chosen values asks for
    nothing. Null fails an active group."""
    for group, values in active.items():
        if values:
            c = columns[group]
            is_array = dict(df.select(c.alias("c")).dtypes)["c"].startswith("array")
            df = df.where(F.arrays_overlap(c, F.array(*map(F.lit, values))) if is_array else c.isin(values))
    return df


def row_search(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """FLT-09: rows whose cells, joined by blanks, hold the needle in any case."""
    cells = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or df.columns]))
    return df.where(F.contains(cells, F.lit(needle.lower())))


def number(cell: Column) -> Column:
    """The number that a cell starts with, without thousands commas and percent signs; null if none."""
    return F.nullif(F.regexp_extract(F.replace(F.trim(cell), F.lit(","), F.lit("")), r"^([+-]?\d+(?:\.\d+)?)\s*%?$", 1), F.lit("")).cast("double")


def majority_numeric_sort(df: DataFrame, column: str, original: str, descending: bool = False, least: float = 0.7) -> DataFrame:
    """SRT-02: by number if at least 70% of the cells that aren't empty are numbers, with other cells
    last either way, else by text; ties keep the original order. The share is one aggregate."""
    cell = F.trim(F.col(column).cast("string"))
    filled = F.coalesce(cell, F.lit("")) != ""
    share = df.agg((F.count_if(filled & number(cell).isNotNull()) / F.nullif(F.count_if(filled), F.lit(0))).alias("s")).head()["s"] or 0.0
    key = number(cell) if share >= least else F.lower(cell)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), original)


def typed_sort(df: DataFrame, column: str, original: str, numeric: bool, descending: bool = False) -> DataFrame:
    """SRT-03, SRT-04: blanks of a numeric column count as infinity, so they lead when descending."""
    key = F.coalesce(number(F.col(column).cast("string")), F.lit(float("inf"))) if numeric else natural_key(F.col(column))
    return df.orderBy(key.desc() if descending else key.asc(), original)


def natural_key(text: Column, width: int = 12) -> Column:
    """Text with each run of digits padded, so that 2 comes before 10."""
    padded = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def page(df: DataFrame, order: list[Column], number_: int, size: int) -> DataFrame:
    """WIN-06: the rows of a page; a number beyond the last gives the last."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(1, number_), pages)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


def pager(current: int, pages: int, around: int = 2) -> list[int | None]:
    """WIN-07: the first, the last and those around the current one; None for a gap."""
    shown = sorted({1, pages, *range(max(1, current - around), min(pages, current + around) + 1)})
    out: list[int | None] = []
    for p in shown:
        if out and p - out[-1] > 1:
            out.append(None)
        out.append(p)
    return out


def pager_numbers(current: Column, pages: Column, around: int = 2) -> Column:
    """WIN-07 as a column: an array of page numbers, null for a gap."""
    near = F.filter(F.sequence(current - around, current + around), lambda p: (p >= 1) & (p <= pages))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.least(F.lit(1), pages)), near, F.array(pages))))
    gap = F.array(F.lit(None).cast("int"))
    return F.flatten(F.transform(shown, lambda p, i: F.when((i > 0) & (p - F.get(shown, i - 1) > 1), F.concat(gap, F.array(p))).otherwise(F.array(p))))


def counter(df: DataFrame, matches: Column, number_: int, size: int) -> DataFrame:
    """AGG-24, AGG-25: one row: total, matched, pages, lo, hi."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(matches).alias("matched"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("matched") / size))
    at = F.least(F.lit(number_), pages)
    return out.withColumn("pages", pages).withColumn("lo", F.least(F.col("matched"), (at - 1) * size + 1)).withColumn("hi", F.least(F.col("matched"), at * size))


def newest(df: DataFrame, user: str, path: str, ts: str, keep: int = 20) -> DataFrame:
    """SRT-10: each user's last visits of different paths, newest first."""
    last = df.groupBy(user, path).agg(F.max(ts).alias(ts))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), path))).where(F.col("place") <= keep)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """SRT-11, SRT-12: n rows by a hash of key and seed; the same for every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WIN-04, WIN-05: the first row of each key, without sorting whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def sort_safe(rows: DataFrame) -> DataFrame:
    """FLT-25: (table_id, safe) over rows (table_id, n_cells, n_header, max_rowspan)."""
    g = rows.groupBy("table_id").agg(F.max("max_rowspan").alias("span"), F.min("n_cells").alias("lo"), F.max("n_cells").alias("hi"), F.max(F.col("n_cells") == F.col("n_header")).alias("only_headers"))
    return g.select("table_id", ((F.col("span") < 2) & (F.col("lo") == F.col("hi")) & ~F.col("only_headers")).alias("safe"))

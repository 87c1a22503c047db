"""Document fingerprints: quartiles of counts of hashed byte triplets, and a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

BUCKETS = 256
# Fixed values of the hash: odd multipliers for a triplet's bytes, and the places of the second and third byte after the first.
FACTORS = (2654435761, 2246822519, 3266489917)
PLACES = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
#: What the places of a triplet add to its hash, for each of PLACES.
STEP = 668265263
#: Differences from here on count as nothing in common: what two unrelated digests show on average.
LIMIT = 320
_REACH = 4
_TIMES = [(np.arange(256, dtype=np.uint64) * f % 2**32).astype(np.uint32) for f in FACTORS]


def triplet_counts(data: bytes, stretch: int = 1 << 18) -> np.ndarray:
    """How many triplets fall in each bucket, of those that start in all but the last four bytes. A triplet is a byte with two of
    the next four. Long texts go in stretches."""
    counts = np.zeros(BUCKETS, np.int64)
    a = np.frombuffer(data, np.uint8)
    for at in range(0, len(a) - _REACH, stretch):
        part = a[at : at + stretch + _REACH]
        n = len(part) - _REACH
        first, second, third = (t[part] for t in _TIMES)
        for k, (i, j) in enumerate(PLACES):
            h = first[:n] + second[i : n + i] + third[j : n + j] + np.uint32(k * STEP % 2**32)
            counts += np.bincount(h >> 24, minlength=BUCKETS)
    return counts


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """For each bucket the number of quartiles of all buckets' counts (the 64th, 128th and 192nd least) that it exceeds."""
    quarter = BUCKETS // 4
    marks = np.sort(counts)[[quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    return np.searchsorted(marks, counts, "left").astype(np.uint8)


def length_code(n: int) -> int:
    """Eight steps for each doubling of a length; 0 for nothing."""
    e = n.bit_length()
    return 8 * e + ((n << 4 >> e) & 7) if n else 0


def shown(length: int, codes: np.ndarray) -> str:
    """A digest as hex digits: four of the length's code, and one for each two buckets."""
    return f"{length:04x}" + (codes[::2] * 4 + codes[1::2]).astype(np.uint8).tobytes().translate(_HEX).decode()


_HEX = bytes(b"0123456789abcdef"[i % 16] for i in range(256))


def read(digest: str) -> tuple[int, np.ndarray]:
    """The length's code and the buckets' codes of a digest."""
    pairs = np.array([int(c, 16) for c in digest[4:]], np.uint8)
    return int(digest[:4], 16), np.stack([pairs >> 2, pairs & 3], 1).ravel()


def likeness_of(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 less the share of LIMIT that two digests differ by, at least 0: the sum of the differences of their buckets' codes and of
    their lengths' codes."""
    apart = int(np.abs(a[1].astype(np.int64) - b[1]).sum()) + abs(a[0] - b[0])
    return 1 - min(apart, LIMIT) / LIMIT


class Digest:
    """The fingerprint of a text that may be cut: its beginning is counted once for what follows it in several versions."""

    def __init__(self, begin: bytes):
        self.begin = begin
        self.counts = triplet_counts(begin)

    def then(self, end: bytes) -> tuple[int, np.ndarray]:
        """The codes of the beginning and `end`, and four zero bytes behind them, so short texts have triplets too."""
        rest = self.begin[-_REACH:] + end + bytes(_REACH)
        counts = self.counts + triplet_counts(rest) if self.begin or end else self.counts
        return length_code(len(self.begin) + len(end)), quartile_codes(counts)


def fingerprint(text: Column) -> Column:
    """The digest of each text; a null text is an empty one. Equal texts have equal digests."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shown(*Digest((t or "").encode()).then(b"")) for t in texts], dtype=object)

    return of(text)


def likeness(a: Column, b: Column) -> Column:
    """How alike two digests are, 0 to 1, the same both ways; null if one is null."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 1.0 if p == q else likeness_of(read(p), read(q)) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def _ranges(ids: DataFrame, n: int) -> np.ndarray:
    """At most n - 1 ascending ids that cut all rows into even parts; an id of many rows comes several times."""
    found = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).head()[0] if n > 1 else []
    return np.array(found or [], np.int64)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document, compared by digests with its edited text and with the next document.

    The edited text: the last quarter (rounded down) of the code points replaced by the first as many, or all, of the next
    document. That is the one of the least greater id; of several rows of that id, the one whose text hashes least. After the
    last id comes the first. Columns: the id (a long), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Texts are shuffled once, into ranges of ids with even numbers of rows; an id of more rows than a range has its rows dealt over
    several. The first row of each range goes to the range before it too. Tasks go down the ids and keep one text in mind, so
    neither rows of one id nor long texts gather. Null text: empty. Null ids: one id, before all others. Repeated rows: each is
    compared by itself. Empty table: no rows. Other columns are dropped.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = _ranges(rows.select("id").where("id IS NOT NULL"), parts or 8 * partitions(spark))
    own, copies = np.unique(marks, return_counts=True)
    many = own[copies > 1]  # each gets a range of its own
    starts = np.unique(np.concatenate([own, many + (many < np.iinfo(np.int64).max)]))
    spread = {int(x): int(c) for x, c in zip(own, copies) if c > 1}

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, ids.fillna(0).to_numpy(np.int64), "right").astype(np.int64) + 1
        return pd.Series(np.where(ids.isna(), 0, at))

    @F.pandas_udf("long")
    def copies_of(ids: pd.Series) -> pd.Series:
        return ids.map(spread).fillna(1).astype("int64")

    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), range_of("id").alias("range"))
    # of each range, its least id and the row of it that stands for the id; ranges are bounded in number
    least = {r["range"]: r["id"] for r in rows.groupBy("range").agg(F.min("id").alias("id")).collect()}
    used = sorted(least)
    before = {at: used[i - 1] for i, at in enumerate(used)}
    if not used:
        return spark.createDataFrame([], _beside(id_col))
    wanted = spark.createDataFrame([(at, least[at], before[at]) for at in used], "at long, least long, before long")
    heads = rows.join(F.broadcast(wanted), (F.col("range") == F.col("at")) & F.col("id").eqNullSafe(F.col("least"))).select("before", "id", "h", "text")
    heads = heads.groupBy("before").agg(F.min(F.struct("h", "id", "text")).alias("m"))
    salts = F.when(F.col("id").isNull(), F.lit(partitions(spark))).otherwise(copies_of("id"))
    dealt = rows.select("range", F.pmod(F.xxhash64("h", F.spark_partition_id()), salts).alias("salt"), F.lit(0).alias("head"), "id", "h", "text")
    of_range = {int(np.searchsorted(starts, x, "right")) + 1: c for x, c in spread.items()} | {0: partitions(spark)}
    salted = spark.createDataFrame([(at, j) for at in used for j in range(of_range.get(at, 1))], "before long, salt long")
    more = heads.join(F.broadcast(salted), "before").select(F.col("before").alias("range"), "salt", F.lit(1).alias("head"), "m.id", "m.h", "m.text")
    ordered = dealt.unionByName(more).repartition(partitions(spark), "range", "salt").sortWithinPartitions("range", "salt", F.desc("head"), F.desc_nulls_last("id"), F.desc("h"))
    return ordered.mapInArrow(_compared(id_col), _beside(id_col))


def _beside(id_col: str) -> str:
    return f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(id_col: str):
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = last = head_before = None  # the range and salt, and the row before
        after = current = ("", None)  # the next document, and the row that stands for the current id: text and codes
        for b in batches:
            out = []
            columns = [b.column(k).to_pylist() for k in range(5)]
            for k, (at, salt, head, key, _) in enumerate(zip(*columns)):
                text = b.column(5)[k].as_py()
                if place != (at, salt):
                    place, after, last = (at, salt), None, None
                elif key != last or head_before:
                    after = current
                last, head_before = key, head
                if head:
                    current = (text, Digest(text.encode()).then(b""))
                    continue
                n, (next_text, next_codes) = len(text), after
                kept = text[: n - n // 4]
                digest = Digest(kept.encode())
                codes, end = digest.then(text[n - n // 4 :].encode()), next_text[: n // 4].encode()
                edited = digest.then(end)
                sha = hashlib.sha256(digest.begin)
                sha.update(end)
                out.append((key, n, sha.hexdigest(), shown(*codes), shown(*edited), likeness_of(codes, edited), likeness_of(codes, next_codes)))
                current = (text, codes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run

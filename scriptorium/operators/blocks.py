"""Postings in blocks of ranked places, and a search for the best entries that stops once no other can be better."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut
from .search import numbered, parse_query, posting_rows, rank

#: Places in a block, as a power of two.
BITS = 12
MOST_KEYS, MOST_IDS = 200, 5000


def own_score(kind: Column, pop: Column) -> Column:
    """What an entry scores for a query that neither its title nor its name matches: RNK-03, RNK-05."""
    boost = F.least(F.lit(20), F.round(F.log2(F.lit(1.0) + pop) * 3).cast("int"))
    return (boost + F.when(kind == "p", 5).when(kind == "d", -250).otherwise(0)).cast("int")


def placed(items: DataFrame) -> DataFrame:
    """Entries with `own` (their score when only their text matches) and `place`: dense, in the order in which such entries are
    shown. Places come from ranks inside spans of equal score and popularity and near ids, so no task sorts everything."""
    rows = items.withColumn("own", own_score(F.col("kind"), F.col("pop")))
    span = F.concat(F.lpad((1000 - F.col("own")).cast("string"), 5, "0"), F.lpad((F.lit(10**12) - F.col("pop")).cast("string"), 13, "0"), F.lpad(F.shiftright("entry", BITS).cast("string"), 12, "0"))
    columns = items.columns
    out = numbered(rows.withColumnRenamed("id", "entry").withColumn("span", span), "entry")
    return out.withColumnRenamed("id", "place").withColumnRenamed("entry", "id").select(*columns, "own", "place")


def block_rows(rows: DataFrame) -> DataFrame:
    """SRC-23, AGG-01: (kind, bucket, token, block, low, high, n, offsets) from postings (kind, bucket, token, id), ids being places. A
    row holds a token's places inside one block of 4,096, as ascending distances from the block's first place; so no row and no
    task's group grows with the corpus."""
    block = F.shiftright("id", BITS)
    each = rows.groupBy("kind", "bucket", "token", block.alias("block")).agg(F.array_sort(F.collect_set(F.col("id").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))).alias("offsets"))
    first = F.shiftleft("block", BITS)
    ends = [(first + F.element_at("offsets", k)).alias(name) for k, name in ((1, "low"), (-1, "high"))]
    return each.select("kind", "bucket", "token", "block", *ends, F.size("offsets").alias("n"), "offsets")


@dataclass
class BlockIndex:
    """Entries by place, postings in blocks, and how many places each token has."""

    items: DataFrame
    blocks: DataFrame
    tokens: DataFrame
    _size: int | None = None
    #: Blocks that the last search had to go through.
    blocks_read: int = 0

    @classmethod
    def build(cls, items: DataFrame) -> BlockIndex:
        """Of entries as `search.entries` makes them; kept in the shared checkpoint folder."""
        items = cut(placed(items))
        blocks = cut(block_rows(posting_rows(items.select(F.col("place").alias("id"), "text"))))
        return cls(items, blocks, cut(blocks.groupBy("kind", "bucket", "token").agg(F.sum("n").alias("n"))))

    def write(self, path: str) -> None:
        """Entries in order of place; blocks and counts by kind and bucket, in order of token."""
        self.items.drop("text").repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/entries")
        self.blocks.repartition("kind", "bucket", F.pmod(F.xxhash64("token"), F.lit(8))).sortWithinPartitions("token", "block").write.partitionBy("kind").parquet(f"{path}/blocks")
        self.tokens.repartition("kind", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("kind").parquet(f"{path}/tokens")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        blocks = spark.read.schema("bucket string, token string, block long, low long, high long, n int, offsets array<int>, kind string").parquet(f"{path}/blocks")
        tokens = spark.read.schema("bucket string, token string, n long, kind string").parquet(f"{path}/tokens")
        return cls(spark.read.parquet(f"{path}/entries"), blocks, tokens)

    @staticmethod
    def _of(rows: DataFrame, kind: str, bucket: str) -> DataFrame:
        return rows.where((F.col("kind") == kind) & (F.col("bucket") == bucket))

    def lists(self, text: str) -> list[tuple[str, dict[str, int]]]:
        """SET-04, SRT-09: for each token of a query its kind and the tokens that stand for it, with their numbers of places: itself
        and the words it starts, in order, until 200, or until 5,000 places are there before the next. Tokens without any are left
        out. The driver sees at most 201 rows a token."""
        q = parse_query(text)
        wanted = [("b", t) for t in q.cjk] + [("w", t) for t in q.latin]
        parts = []
        for i, (kind, t) in enumerate(wanted):
            own = self._of(self.tokens, kind, _bucket(kind, t))
            own = own.where(F.col("token") == t) if kind == "b" else own.where(F.col("token").startswith(t)).orderBy("token").limit(MOST_KEYS + 1)
            parts.append(own.select(F.lit(i).alias("i"), "token", "n"))
        if not parts:
            return []
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        rows: list[dict[str, int]] = [{} for _ in wanted]
        for r in sorted(found.collect(), key=lambda r: (r["i"], r["token"])):
            rows[r["i"]][r["token"]] = r["n"]
        for i, (kind, t) in enumerate(wanted):
            longer = [w for w in rows[i] if w != t][:MOST_KEYS]
            keys = {w: rows[i].get(w, 0) for w in [t, *longer] if w in rows[i]}
            rows[i] = keys if sum(keys.values()) < MOST_IDS else self._until_enough(kind, t, keys)
        return [(kind, keys) for (kind, _), keys in zip(wanted, rows) if keys]

    def _until_enough(self, kind: str, word: str, keys: dict[str, int]) -> dict[str, int]:
        """The first keys, until 5,000 different places are there before the next."""
        if keys.get(word, 0) >= MOST_IDS:
            return {word: keys[word]}
        spark = self.blocks.sparkSession
        ranks = {w: i for i, w in enumerate(sorted(keys, key=lambda w: (w != word, w)))}
        start = 0 if word in keys else 1
        order = spark.createDataFrame([(w, i + start) for w, i in ranks.items()], "key string, rank int")
        rows = self._of(self.blocks, kind, _bucket(kind, word)).join(F.broadcast(order), F.col("token") == F.col("key"))
        first = rows.select("rank", "block", F.explode("offsets").alias("o")).groupBy("block", "o").agg(F.min("rank").alias("rank"))
        new, before, kept = {r["rank"]: r["count"] for r in first.groupBy("rank").count().collect()}, 0, {}
        for w, i in ranks.items():
            if i + start == 0 or before < MOST_IDS:
                kept[w] = keys[w]
            before += new.get(i + start, 0)
        return kept

    def hits(self, lists: list[tuple[str, dict[str, int]]], first: int, end: int) -> DataFrame:
        """(place) of the entries in blocks first to end - 1 that have a token of each list. Blocks in which the list of the fewest
        places has none aren't unpacked."""
        mask, any_of = F.lit(0), F.lit(False)
        for i, (kind, keys) in enumerate(lists):
            of = (F.col("kind") == kind) & F.col("bucket").isin(*{_bucket(kind, k) for k in keys}) & F.col("token").isin(*keys)
            mask, any_of = mask + F.when(of, 1 << i).otherwise(0), any_of | of
        rows = self.blocks.where(any_of & (F.col("block") >= first) & (F.col("block") < end))
        kind, keys = min(lists, key=lambda x: sum(x[1].values()))
        if len(lists) > 1 and sum(keys.values()) <= 100_000:
            own = self.blocks.where((F.col("kind") == kind) & F.col("bucket").isin(*{_bucket(kind, k) for k in keys}) & F.col("token").isin(*keys) & (F.col("block") >= first) & (F.col("block") < end))
            rows = rows.join(F.broadcast(own.select(F.col("block").alias("b")).distinct()), F.col("block") == F.col("b"), "left_semi")
        places = rows.select("block", mask.alias("mask"), F.explode("offsets").alias("o")).select((F.shiftleft("block", BITS) + F.col("o")).alias("place"), "mask")
        return places.groupBy("place").agg(F.bit_or("mask").alias("mask")).where(F.col("mask") == (1 << len(lists)) - 1).select("place")

    @property
    def size(self) -> int:
        """The number of entries."""
        if self._size is None:
            self._size = self.items.agg(F.coalesce(F.max("place") + 1, F.lit(0))).head()[0]
        return self._size

    def top(self, text: str, limit: int = 50) -> DataFrame:
        """RNK-01, RNK-09, SRT-01: the first `limit` rows of `search.search`, without `total`, in the same order.

        What an entry scores beyond its own score comes from its title and name alone. So the entries whose title or name match
        are ranked by themselves (a scan of two columns), and of all others those of the least places are best: blocks are
        read from the first on, twice as many each time, until `limit` hits are there. A query of common words reads a few blocks,
        one of rare words the few blocks that have the rarest. The driver sees 2 * `limit` rows a step.
        """
        spark, lower, lists = self.items.sparkSession, text.lower().strip(), self.lists(text)
        q = parse_query(text)
        columns = rank(self.items.limit(0), text)
        if not q.cjk and not q.latin:
            return columns
        title, name = T.title_matches(F.lower("title"), lower), F.lower(F.coalesce("name", F.lit(""))).startswith(lower)
        blocks = (self.size + (1 << BITS) - 1) >> BITS

        def best(of: DataFrame, plain: bool) -> DataFrame:
            return rank(of, text).withColumn("plain", F.lit(plain)).orderBy(F.desc("score"), F.desc("pop"), "id").limit(limit)

        matched = self.items.where(title)
        named = self.items.where(~title & name)
        if lists and named.limit(1).count():  # these count if their text matches too
            matched = matched.unionByName(named.join(self.hits(lists, 0, blocks), "place", "left_semi"))
        share = math.prod(min(1.0, sum(keys.values()) / max(1, self.size)) for _, keys in lists)
        first, step, rows, plain = 0, max(1, min(blocks, math.ceil(2 * limit / max(share * (1 << BITS), 1e-9)))), [], 0
        while True:
            parts = [best(matched, False)] if not first else []
            if lists and first < blocks:
                inside = (F.col("place") >= first << BITS) & (F.col("place") < (first + step) << BITS)
                parts.append(best(self.items.where(inside & ~title & ~name).join(self.hits(lists, first, first + step), "place", "left_semi"), True))
            if not parts:
                break
            new = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).collect()
            rows, plain = rows + new, plain + sum(r["plain"] for r in new)
            first, step = min(blocks, first + step), 2 * step
            if not lists or first >= blocks or plain >= limit:
                break
        self.blocks_read = first
        rows.sort(key=lambda r: (-r["score"], -r["pop"], r["id"]))
        return spark.createDataFrame([r[:-1] for r in rows[:limit]], columns.schema)


def _bucket(kind: str, token: str) -> str:
    """STR-05, STR-06 for one token, as a literal, so that folders and files are pruned."""
    return hashlib.md5(token.encode()).hexdigest()[:2] if kind == "b" else token[0] if "a" <= token[0] <= "z" else "_"

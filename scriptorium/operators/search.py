"""An inverted index as a table, and ranked search over it."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut

STUB = 120
#: First match wins. Category names and the codes they get.
TYPE_RULES = [
    ("S", ["法术", "戏法"]), ("F", ["专长", "职业专长", "族裔专长", "通用专长", "技能专长"]), ("L", ["职业"]), ("A", ["族裔"]), ("B", ["背景"]),
    ("G", ["信仰", "信仰和哲学", "主流神祇", "其他神祇"]), ("N", ["状态"]), ("C", ["超小型", "小型", "中型", "大型", "巨型", "超大型", "生物子类"]),
    ("I", ["物品", "物品导航", "装备", "穿戴物品", "手持物品", "辅助物品", "基础武器", "基础护甲", "物品子页面", "穿戴物品子页面", "手持物品子页面", "特殊魔法武器子页面"]),
    ("P", ["地理"]), ("T", ["动作", "基础动作", "技能动作", "通用技能动作"]), ("R", ["特征"]),
]
DATA_TYPES = {"Spells": "S", "Feats": "F", "Creatures": "C", "Items": "I", "Traits": "R", "Conditions": "N", "Backgrounds": "B"}
TYPE_NAMES = {"F": "feat", "S": "spell", "C": "creature", "I": "item", "G": "deity", "B": "background", "L": "class", "A": "ancestry", "P": "location", "N": "condition", "T": "action", "R": "trait", "U": "stub", "O": "other"}
ALIAS_PREFIX = "重定向 → "
POINTER = r"^本页面是存放物品数据的子页面[，,]\s*如果您是通过搜索栏进入本页的[，,]\s*请点击主页面[：:]"


def kind(ns):
    """PRJ-07"""
    return F.when(ns == 3500, "d").when(ns == 14, "c").otherwise("p")


def first_match(values, rules, default):
    """PRJ-09: the code of the first rule of which a value is in the array."""
    out = F.lit(default)
    for code, names in reversed(rules):
        out = F.when(F.arrays_overlap(values, F.array(*map(F.lit, names))), code).otherwise(out)
    return out


def type_code(title, categories, is_stub):
    """PRJ-09, PRJ-10: by a data title's prefix, else stub, else the first rule that fits."""
    prefix = F.regexp_extract(title, "^(?:Data|数据):([A-Za-z]+)-", 1)
    own = F.lit(None).cast("string")
    for name, code in DATA_TYPES.items():
        own = F.when(prefix == name, code).otherwise(own)
    return F.coalesce(own, F.when(is_stub, "U").otherwise(first_match(categories, TYPE_RULES, "O")))


def resolved_type(code, k, href):
    """PRJ-19: the name of a type's code if it has one; else, of data pages, the type of the name that their file starts with; else other."""
    out = F.lit(None).cast("string")
    for known, name in TYPE_NAMES.items():
        out = F.when(code == known, name).otherwise(out)
    file = F.substring_index(F.coalesce(T.percent_decoded(href), href), "/", -1)
    own = F.lit(None).cast("string")
    for head, known in DATA_TYPES.items():
        own = F.when(F.substring_index(file, "-", 1) == head, TYPE_NAMES[known]).otherwise(own)
    return F.coalesce(out, F.when(k == "d", own), F.lit("other"))


def english_name(title, body, k):
    """PRJ-11: the Latin words behind the title that a page's text starts with."""
    rest = F.ltrim(F.substring(body, F.length(title) + 1, F.length(body)))
    name = F.regexp_replace(F.regexp_extract(rest, r"^[A-Za-z][A-Za-z0-9'’ \-]{0,58}[A-Za-z0-9'’]", 0), r"^[ -]+|[ -]+$", "")
    return F.when((k == "p") & F.startswith(body, title) & (F.length(name) >= 2), name)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` plus a dense id from 0 in order of `order`, of which `span` is a prefix: ranks inside each
    span, plus the rows of the spans before. Only the counts of spans meet in one task."""
    before = rows.groupBy("span").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("span").orderBy(*order))
    return rows.join(before, "span").withColumn("id", F.col("before") + rank - 1)


def entries(pages: DataFrame, popularity: DataFrame | None = None) -> DataFrame:
    """PRJ-12, JOI-09: index entries of pages (ns, pageid, title, body, categories array<string>): id, title, kind, type,
    excerpt, name, pop, and the text that is indexed.

    Ids are dense, in order of the page id's digest: ranks inside ranges of the digest, plus the rows of
    the ranges before, so no task sorts everything.
    """
    pages = pages.where(~T.skipped(F.col("title")) & ~((F.col("ns") == 0) & T.stripped(F.col("body")).rlike(POINTER)))
    pages = pages.withColumn("digest", F.sha1(F.col("pageid").cast("string"))).withColumn("span", F.substring("digest", 1, 2))
    out = numbered(pages, "digest", "title")
    stub = F.length("body") < STUB
    out = out.withColumn("kind", kind(F.col("ns")))
    text = F.when(stub, F.col("title")).otherwise(F.concat("title", F.lit(" \n "), F.substring("body", 1, 600)))
    out = out.select(
        "id", "title", "kind", type_code(F.col("title"), F.col("categories"), stub).alias("type"), T.page_href(F.col("ns"), F.col("title")).alias("href"),
        T.excerpt(F.col("body")).alias("excerpt"), english_name(F.col("title"), F.col("body"), F.col("kind")).alias("name"), text.alias("text"),
    )
    if popularity is None:
        return out.withColumn("pop", F.lit(0).cast("long"))
    return out.join(popularity.select(F.col("title"), F.col("inlinks").alias("pop")), "title", "left").withColumn("pop", F.coalesce("pop", F.lit(0)).cast("long"))


def with_aliases(items: DataFrame, targets: DataFrame) -> DataFrame:
    """JOI-10, RNK-10: an entry for each alias (alias, target) that is no title itself, with its target's
    link, type and popularity; ids follow those of pages, in order of the alias."""
    known = targets.join(items.select(F.col("title").alias("alias")), "alias", "left_anti")
    found = known.join(items, F.col("target") == F.col("title"))
    start = items.agg(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    rows = numbered(found.withColumn("span", F.substring("alias", 1, 2)), "alias").select((start + F.col("id")).alias("id"), F.col("alias").alias("title"), "kind", "type", "href", F.concat(F.lit(ALIAS_PREFIX), "target").alias("excerpt"), F.lit(None).cast("string").alias("name"), F.col("alias").alias("text"), "pop")
    return items.select(*rows.columns).unionByName(rows)


def postings(items: DataFrame) -> DataFrame:
    """AGG-01, AGG-02: (kind, bucket, token, ids) of entries (id, text), ids in order. Written with
    partitionBy("kind", "bucket") a query reads only the buckets of its tokens."""
    words = items.select("id", F.lit("w").alias("kind"), F.explode(F.array_distinct(T.latin_words(F.col("text")))).alias("token"))
    pairs = items.select("id", F.lit("b").alias("kind"), F.explode(F.array_distinct(T.cjk_bigrams(F.col("text")))).alias("token"))
    rows = words.unionByName(pairs).groupBy("kind", "token").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    bucket = F.when(F.col("kind") == "b", T.bigram_bucket(F.col("token"))).otherwise(T.word_bucket(F.col("token")))
    return rows.select("kind", bucket.alias("bucket"), "token", "ids")


def posting_rows(items: DataFrame) -> DataFrame:
    """(kind, bucket, token, id): the index without lists, for corpora in which a token's list would not fit one
    row. Search reads this form."""
    words = items.select("id", F.lit("w").alias("kind"), F.explode(F.array_distinct(T.latin_words(F.col("text")))).alias("token"))
    pairs = items.select("id", F.lit("b").alias("kind"), F.explode(F.array_distinct(T.cjk_bigrams(F.col("text")))).alias("token"))
    both = words.withColumn("bucket", T.word_bucket(F.col("token"))).unionByName(pairs.withColumn("bucket", T.bigram_bucket(F.col("token"))))
    return both.select("kind", "bucket", "token", "id")


@dataclass
class Query:
    cjk: list[str] = field(default_factory=list)
    latin: list[str] = field(default_factory=list)


def parse_query(text: str) -> Query:
    """STR-07 for one string."""
    runs = re.findall("[㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df]+", text)
    pairs = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
    return Query(pairs, [w.lower() for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9_'-]*", text) if len(w) >= 2])


def expanded(rows: DataFrame, word: str, most_keys: int = 200, most_ids: int = 5000) -> DataFrame:
    """SET-04, SRT-09: ids of a word and of the words it starts, in order, until `most_keys` of them, or
    until `most_ids` ids are there before the next."""
    own = rows.where((F.col("kind") == "w") & (F.col("bucket") == T.word_bucket(F.lit(word))) & F.col("token").startswith(word))
    longer = own.where(F.col("token") != word).select("token").distinct().orderBy("token").limit(most_keys)
    keys = longer.withColumn("rank", F.row_number().over(Window.orderBy("token")))
    keys = keys.unionByName(rows.sparkSession.createDataFrame([(word, 0)], "token string, rank int"))
    first = own.join(F.broadcast(keys), "token").groupBy("id").agg(F.min("rank").alias("rank"))
    sums = first.groupBy("rank").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a key that adds nothing new has no row here; it counts as a key but brings no ids
    return first.join(F.broadcast(sums.where((F.col("rank") == 0) | (F.col("before") < most_ids)).select("rank")), "rank").select("id")


def search(items: DataFrame, rows: DataFrame, text: str, limit: int | None = 50) -> DataFrame:
    """RNK-01, PRJ-18, PRJ-19: (id, title, href, kind, type, excerpt, score, pop, total) of the best entries.

    Tokens without postings are left out; an entry must hold all others. Titles that match the whole
    query are added. Title, English name, popularity and kind make the score; ties go by popularity, id.
    """
    q = parse_query(text)
    spark: SparkSession = items.sparkSession
    if not q.cjk and not q.latin:
        return rank(items.limit(0), text).withColumn("total", F.lit(0).cast("long"))
    lists = [rows.where((F.col("kind") == "b") & (F.col("bucket") == T.bigram_bucket(F.lit(t))) & (F.col("token") == t)).select("id").distinct() for t in q.cjk]
    lists += [expanded(rows, w) for w in q.latin]
    tagged = [x.withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    hits = tagged[0]
    for x in tagged[1:]:
        hits = hits.unionByName(x)
    needed = hits.select(F.count_distinct("list").alias("needed"))
    all_in = hits.groupBy("id").agg(F.count_distinct("list").alias("n")).join(F.broadcast(needed), F.col("n") == F.col("needed")).select("id")
    lower = text.lower().strip()
    titled = items.where(T.title_matches(F.lower("title"), lower)).select("id")
    found = items.join(all_in.unionByName(titled).distinct(), "id", "left_semi")
    total = found.select("id").agg(F.count(F.lit(1))).scalar()
    scored = rank(found, text).withColumn("total", total)
    scored = scored.orderBy(F.desc("score"), F.desc("pop"), "id")
    return scored if limit is None else scored.limit(limit)


def rank(found: DataFrame, text: str) -> DataFrame:
    """RNK-02 to RNK-06."""
    lower = text.lower().strip()
    title, name = F.lower("title"), F.lower(F.coalesce("name", F.lit("")))
    tier = F.when(title == lower, 1000).when(title.startswith(lower), 500).when(T.title_matches(title, lower), 200).otherwise(0)
    tier = tier + F.when(name == "", 0).when(name == lower, 900).when(name.startswith(lower), 450).otherwise(0)
    boost = F.least(F.lit(20), F.round(F.log2(F.lit(1.0) + F.col("pop")) * 3).cast("int"))
    score = F.when(tier >= 200, tier - F.least(F.lit(50), F.length("title"))).otherwise(tier + boost)
    score = score + F.when(F.col("kind") == "p", 5).when(F.col("kind") == "d", -250).otherwise(0)
    return found.select("id", "title", "href", "kind", "type", "excerpt", score.cast("int").alias("score"), "pop")


def best_match(results: DataFrame) -> DataFrame:
    """RNK-08: the top row if it scores 900 or more."""
    return results.orderBy(F.desc("score"), F.desc("pop"), "id").limit(1).where("score >= 900")


def by_type(results: DataFrame) -> DataFrame:
    """AGG-08: results by type, in the order in which types are shown."""
    order = F.lit(len(TYPE_NAMES))
    for i, code in enumerate(TYPE_NAMES):
        order = F.when(F.col("type") == code, i).otherwise(order)
    return results.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("place", order).orderBy("place")


def manifest(items: DataFrame, index: DataFrame) -> DataFrame:
    """SNK-08: one row of counts."""
    a = items.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("pop") > 0).alias("linked"), F.max("pop").alias("most_linked"))
    b = index.agg(F.count_if(F.col("kind") == "b").alias("bigrams"), F.count_if(F.col("kind") == "w").alias("words"), F.count_distinct("kind", "bucket").alias("buckets"))
    return a.join(b)


class Engine:
    """UDF-05: an index that was built or read once, and queries over it."""

    def __init__(self, items: DataFrame, rows: DataFrame):
        self.items, self.rows = items, rows

    @classmethod
    def build(cls, pages: DataFrame, popularity: DataFrame | None = None) -> Engine:
        """The index of pages, built once: queries read it from the shared checkpoint folder."""
        items = cut(entries(pages, popularity))
        return cls(items, cut(posting_rows(items)))

    def write(self, path: str) -> None:
        """SNK-04 to SNK-07: titles in one table, postings by kind and bucket."""
        self.items.write.parquet(f"{path}/titles")
        self.rows.repartition("kind", "bucket", F.pmod(F.xxhash64("token"), F.lit(8))).sortWithinPartitions("token", "id").write.partitionBy("kind", "bucket").parquet(f"{path}/postings")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Engine:
        """SRC-23, SRC-24: a query's literal buckets prune the folders that are read."""
        rows = spark.read.schema("token string, id long, kind string, bucket string").parquet(f"{path}/postings")
        return cls(spark.read.parquet(f"{path}/titles"), rows)

    def search(self, text: str, limit: int | None = 50) -> DataFrame:
        """RNK-09: a larger limit shows more."""
        return search(self.items, self.rows, text, limit)

    parse_query = staticmethod(parse_query)

    @staticmethod
    def boost(pop: int) -> int:
        return min(20, math.floor(math.log2(1 + pop) * 3 + 0.5))

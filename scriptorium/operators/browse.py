"""Browse lists: buckets of categories, filtered sub-zones, class hubs, coverage, and category pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import first_seen

# ---- Fixed values: categories of buckets, and of item groups. ----
BUCKETS = {
    "feats": ["专长"], "spells": ["法术"], "items": ["物品", "物品导航", "基础武器", "基础护甲"], "creatures": ["超小型", "小型", "中型", "大型", "巨型", "超大型"],
    "ancestries": ["族裔"], "backgrounds": ["背景"], "archetypes": ["变体（特征）"], "deities": ["信仰"], "locations": ["地理"], "other": ["状态"],
}
ITEM_GROUPS = {
    "weapons": ["特殊魔法武器", "珍贵材料武器", "魔兽枪"], "armor": ["特殊魔法护甲", "珍贵材料护甲", "特殊魔法盾牌", "珍贵材料盾牌"], "runes": ["武器性能符文", "护甲性能符文", "配件符文"], "worn": ["穿戴物品", "护符", "魔法刺青", "植入体", "圣物种子"],
    "consumables": ["药水", "油", "炼金灵药", "炼金毒素", "炼金炸弹", "炼金食物", "炼金药物", "炼金弹药", "其他消耗品", "消耗品", "茶", "魔法弹药", "永久炼金物品", "瓶装气息", "瓶装怪物", "炼金工具", "圈套", "符箓", "法术触媒", "魔法圈套"],
    "implements": ["咒心", "法杖", "特殊魔杖", "魔杖", "魔典", "天命套牌", "尾声乐器"],
}
ROOTS = {"arcane": "奥术", "divine": "神术", "occult": "异能", "primal": "原能"}
SPELL_CLASSES = {"cantrips": "戏法", "focus": "聚能"}
BANDS = {"0-3": (-99, 3), "4-7": (4, 7), "8-12": (8, 12), "13-17": (13, 17), "18-25": (18, 99)}
KEYWORDS = {
    "feats": ["专长", "feat"], "spells": ["法术", "spell", "戏法", "聚能"], "items": ["物品", "装备", "武器", "护甲", "消耗品", "戴持物品", "符文", "法器", "item"], "creatures": ["怪物", "creature", "monster"], "ancestries": ["祖先", "ancestry"],
    "backgrounds": ["背景", "background"], "archetypes": ["变体", "archetype"], "classes": ["职业", "class"], "deities": ["神祇", "deity"], "locations": ["地点", "location", "城市", "国家", "区域"], "other": ["状态", "特征", "trait", "condition"],
}


def buckets(pages: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """SET-05, FLT-27, WIN-04, SRT-05: (bucket, title, pageid) of pages (ns, pageid, title, categories): main pages
    of any of a bucket's categories, once a title, the lowest page id first."""
    names = [(b, c, i) for b, cats in (rules or BUCKETS).items() for i, c in enumerate(cats)]
    rows = pages.where("ns = 0").select("pageid", "title", F.explode(F.array_distinct("categories")).alias("category"))
    lookup = pages.sparkSession.createDataFrame(names, "bucket string, category string, pos int")
    hits = rows.join(F.broadcast(lookup), "category").select("bucket", "title", "pageid", "pos")
    return first_seen(hits, ["bucket", "title"], [F.col("pos"), F.col("pageid")]).select("bucket", "title", "pageid")


def bucket_sizes(listed: DataFrame) -> DataFrame:
    """AGG-10: (bucket, n, letters)."""
    return listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(T.first_letter(F.col("title")))).alias("letters"))


def keyword_buckets(categories: Column, title: Column) -> Column:
    """STR-31: every bucket one of whose keywords stands in the categories or the title, in any case."""
    blob = F.lower(F.concat_ws(" ", categories, title))
    found = [F.when(blob.rlike("|".join(rf"\Q{k.lower()}\E" for k in keys)), name) for name, keys in KEYWORDS.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def enriched(listed: DataFrame, records: DataFrame) -> DataFrame:
    """JOI-07, PRJ-17: rows with the data record (pageid, name, fields) of their title; of several, the one
    of the highest page id."""
    own = records.groupBy("name").agg(F.max_by("fields", "pageid").alias("fields")).withColumnRenamed("name", "title")
    return listed.join(own, "title", "left")


def subzones(fields: Column, kind: Column) -> Column:
    """FLT-12: the sub-zones of a record: spells by root and class, creatures by level, items by group."""
    at = lambda k: F.coalesce(F.element_at(fields, k), F.lit(""))
    level = T.to_int(at("等级"))
    zones = [F.when((kind == "Spells") & F.array_contains(T.parts(at("根源")), zh), f"spells-{en}") for en, zh in ROOTS.items()]
    zones += [F.when((kind == "Spells") & (at("法术分类") == zh), f"spells-{en}") for en, zh in SPELL_CLASSES.items()]
    zones += [F.when((kind == "Creatures") & level.between(*b), f"creatures-level-{name}") for name, b in BANDS.items()]
    zones += [F.when((kind == "Items") & F.arrays_overlap(T.parts(at("物品分类")), F.array(*map(F.lit, names))), f"items-{name}") for name, names in ITEM_GROUPS.items()]
    return F.filter(F.array(*zones), lambda z: z.isNotNull())


def zone_members(records: DataFrame, listed: DataFrame) -> DataFrame:
    """JOI-08, WIN-05, REN-07: (zone, name, pageid) of records (pageid, kind, name, fields) that their zone's
    parent bucket lists, once a name."""
    rows = records.select("pageid", "name", F.explode(subzones(F.col("fields"), F.col("kind"))).alias("zone")).withColumn("bucket", F.substring_index("zone", "-", 1))
    inside = rows.join(listed.select("bucket", F.col("title").alias("name")).distinct(), ["bucket", "name"], "left_semi")
    return first_seen(inside.select("zone", "name", "pageid"), ["zone", "name"], [F.col("pageid")])


def coverage(zones: DataFrame, listed: DataFrame) -> DataFrame:
    """AGG-17: (bucket, total, covered): how many of a bucket's titles are in any of its zones."""
    own = zones.select(F.substring_index("zone", "-", 1).alias("bucket"), F.col("name").alias("title")).distinct().withColumn("in_zone", F.lit(1))
    j = listed.select("bucket", "title").distinct().join(own, ["bucket", "title"], "left")
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.count("in_zone").alias("covered"))


def class_hub(pages: DataFrame, known: list[str]) -> DataFrame:
    """FLT-13, PRJ-27: the listed classes' pages with 80 characters of text and five categories."""
    text = F.substring(T.collapsed(T.without_tags(F.col("text"))), 1, 80)
    return pages.where(F.col("title").isin(known)).select("title", text.alias("excerpt"), F.slice("categories", 1, 5).alias("categories"))


def category_universe(pages: DataFrame, on_disk: DataFrame) -> DataFrame:
    """SET-06, SET-11: categories that pages name or that have a page (ns 14), of those on disk."""
    named = pages.select(F.explode("categories").alias("category"))
    own = pages.where("ns = 14").select(T.bare_title(F.col("title")).alias("category"))
    return named.unionByName(own).distinct().join(on_disk.select("category").distinct(), "category", "left_semi")


def member_listing(members: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """AGG-26, JOI-06, SRT-06: (category, letter, n, members) of members (category, sortkey, title): grouped by first
    character, each with its page's path from the title index, else one made of its title."""
    key = F.coalesce(F.nullif(F.col("sortkey"), F.lit("")), F.col("title"))
    rows = members.withColumn("letter", T.member_letter(key)).withColumn("k", F.lower(key))
    made = F.concat(F.lit("pages/"), T.safe_title(F.col("title")))
    if index is not None:
        rows = rows.join(index.select(F.col("key").alias("title"), F.concat("dir", F.lit("/"), "fn").alias("own")), "title", "left").withColumn("path", F.coalesce("own", made))
    else:
        rows = rows.withColumn("path", made)
    return rows.groupBy("category", "letter").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("k", "title", "path"))).alias("members"))


def letter_order(letter: Column) -> list[Column]:
    """SRT-06: A to Z, then other characters, then _."""
    return [F.when(letter.rlike("^[A-Z]$"), 0).when(letter == "_", 2).otherwise(1), letter]


def category_summary(pages: DataFrame, top: int = 50) -> DataFrame:
    """AGG-13, AGG-21, SRT-08: the most frequent categories, with how many namespaces name them."""
    rows = pages.select("ns", F.explode("categories").alias("category")).groupBy("category", "ns").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("category").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("namespaces")).orderBy(F.desc("n"), "category").limit(top)


def synthesised(universe: DataFrame, rendered: DataFrame, classes: DataFrame) -> DataFrame:
    """REN-03: categories that get a made-up page: not rendered, not pageless, a jump for those whose only
    member is the page of their name."""
    rows = universe.join(rendered.select("category"), "category", "left_anti").join(classes.select("category", "class"), "category", "left")
    return rows.where("coalesce(class, '') NOT IN ('PAGELESS', 'BLOB')").select("category", F.when(F.col("class") == "A_SELF", "jump").otherwise("list").alias("form"))


def letters(pages: DataFrame, redirects: DataFrame, rendered: DataFrame) -> DataFrame:
    """FLT-06, REN-05: (letter, title) of main pages that are no redirects and are rendered."""
    ok = pages.where(F.col("ns").isin(0, 102) & ~T.skipped(F.col("title"))).join(redirects.select(F.col("src").alias("title")), "title", "left_anti").join(rendered.select("title"), "title", "left_semi")
    return ok.select(T.first_letter(F.col("title")).alias("letter"), "title").orderBy("letter", F.lower("title"))

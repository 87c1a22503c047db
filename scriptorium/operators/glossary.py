"""A bilingual glossary: mined pairs, merging, cleaning and checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import text as T
from . import phrases
from .search import numbered

# ---- Fixed values: thresholds and word lists that decide which terms are good. ----
STRONG = ["A_title_field", "E_infobox_field"]
FRAGMENT_PREFIXES = ["和", "或", "与", "的", "在", "就", "并", "也", "还", "如同", "就是", "是", "为", "被", "将", "已", "要", "如果", "即使", "但", "而", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]
FRAGMENT_SUFFIXES = ["的", "地", "得", "了", "着", "过", "而", "与", "和", "或", "之", "上", "下", "中", "内", "外", "时", "后", "前", "为", "是", "有", "会"]
SENTENCE_MARKERS = r"[你我他她它们这那某]|^这个|^那个"
SENTENCE_OPENERS = ["using ", "when ", "while ", "during ", "after ", "before ", "how to ", "what ", "where "]
ARTIFACT = r"</?\w+>|<!--|-->|&\w+;"
ACTION = "启动|触发|效果|反应|要求|频率|豁免|持续|范围|目标"
FRAGMENT_STARTERS = ["该", "其", "此", "来自", "位于", "关于", "对于", "随后", "所有", "每个", "一个", "一只", "一种", "一位", "一名", "并且", "然后", "然而", "即", "也就是", "就是"]
JUNK = ["你", "我", "他", "她", "它", "他们", "她们", "它们", "我们", "你们", "这", "那", "这个", "那个", "这些", "那些", "是", "有", "会", "可", "得", "的"]
AFTER_FROM = {"从": ["容", "此", "而", "不", "来", "未", "小", "前", "后", "今", "旁", "速", "事", "业", "军"], "由": ["于", "此", "衷", "来"]}
AFTER_LIKE = ["果", "此", "今", "何", "同", "意", "是", "若", "期", "许", "一", "其", "芒", "常", "故", "愿"]
GENERIC_TAILS = ["能力", "动作", "效果", "地点", "生物", "术语", "法术", "技能", "状态", "物品", "符文", "武器", "护甲", "区域", "环境", "位置", "世界", "位面", "名字", "名称", "身份", "种类", "类型", "人物", "角色", "数据", "信息", "特征", "特性", "能力值", "点数", "可能性", "结果", "选择", "方式", "方法", "过程", "时间", "空间"]
BOOK_CODES = ["CRB", "APG", "GMC", "GNG", "LOCG", "LOWG", "LOIL", "LOTGB", "LOAG", "LOPSG", "LOME", "LOAP", "ROE", "SOT", "AOE", "FOP", "AV", "KM", "AON", "DC", "PC", "HP", "XP", "AC", "TV", "EC"]
CONTENT_STOP = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "by", "with", "from", "as", "is", "was", "be", "been"]
END_PARTICLES, START_FRAGMENTS = ["中", "等", "啊", "吧", "呀", "哟", "呢", "嘛"], ["之", "其", "一", "某", "此"]
NOTE_STARTS, NOTES = ["例如", "比如", "请"], ["译者注", "译注", "注：", "编按", "按："]
VERB_PREFIXES = {"把": ["握", "戏", "柄", "手", "守", "持"], "使": ["节", "者", "用", "馆", "命", "徒", "团", "役", "唤", "劲"], "让": ["步", "位", "与", "给"], "令": ["人", "牌", "箭"], "给": ["予", "养"]}
STRAY_PREFIXES = ["之", "其", "由"]
ENGLISH = r"[A-Za-z][A-Za-z0-9'’ \-]{1,78}[A-Za-z0-9]"
CHINESE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
NOISE_CODES = ["AON", "DC", "PC", "HP", "XP", "AC", "CRB", "APG", "GMC", "GNG", "LOCG", "LOWG", "LOIL", "LOTGB", "LOAG", "LOPSG", "LOME", "LOAP", "ROE", "SOT", "KM", "TV", "EC", "AoA", "FoP", "AV"]


def _any(c: Column, test: Callable[[Column, str], Column], values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(c, v)
    return out


def starts(c: Column, values: list[str]) -> Column:
    return _any(c, lambda x, v: x.startswith(v), values)


def ends(c: Column, values: list[str]) -> Column:
    return _any(c, lambda x, v: x.endswith(v), values)


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def content_tokens(en: Column) -> Column:
    """STR-26"""
    return F.filter(F.split(F.lower(F.trim(en)), "[ -]"), lambda t: t.rlike("^[a-z]+$") & ~t.isin(CONTENT_STOP))


def content_words(en: Column) -> Column:
    """STR-26, the second form: without brackets and the marks at the edges of words."""
    plain = F.split(F.lower(F.trim(F.regexp_replace(en, "[（(][^）)]*[）)]?", " "))), "[ -]")
    return F.filter(F.transform(plain, lambda t: F.regexp_replace(t, "^[^a-z]+|[^a-z]+$", "")), lambda t: t.rlike("^[a-z]+$") & ~t.isin(CONTENT_STOP))


# ---- extraction ----

def split_mixed(s: Column) -> Column:
    """STR-16: struct<zh, en> of a line with Chinese and Latin runs, or null. Marks belong to the run
    before them; runs of one script are joined by blanks."""
    line = T.stripped(F.regexp_replace(F.regexp_replace(s, r"\{\{[^}]*\}\}", ""), r"\{\{.*$", ""))
    mark = rf"[^{T.HAN}A-Za-z0-9 '\-]"
    zh = F.transform(F.regexp_extract_all(line, F.lit(rf"(^{mark}*)?([{T.HAN}](?:[{T.HAN}]|{mark})*)"), F.lit(0)), T.stripped)
    en = F.transform(F.regexp_extract_all(line, F.lit(rf"[A-Za-z0-9 '\-](?:[A-Za-z0-9 '\-]|{mark})*"), F.lit(0)), T.stripped)
    joined_zh = F.regexp_replace(F.array_join(F.filter(zh, lambda x: x != ""), " "), r"^[ ，,。.·]+|[ ，,。.·]+$", "")
    joined_en = F.regexp_replace(F.array_join(F.filter(en, lambda x: x != ""), " "), r"^[ ,.'\-]+|[ ,.'\-]+$", "")
    ok = line.rlike(f"[{T.HAN}]") & line.rlike("[A-Za-z]{3,}") & joined_en.rlike("[A-Za-z]{3,}") & (joined_zh != "")
    short = (F.length(joined_en) < 4) & (joined_en == F.upper(joined_en))
    return F.when(ok & ~short, F.struct(joined_zh.alias("zh"), joined_en.alias("en")))


def is_noise(en: Column, zh: Column) -> Column:
    """FLT-14, FLT-15: a code, a number or too little English; no Chinese, or a sentence."""
    code = en.rlike(rf"(?U)^(?:{'|'.join(NOISE_CODES)})\b|^DC\s*\d+$|^\d+$|^[A-Z]{{2,5}}\s*\d+$")
    return code | (F.length(en) < 3) | ~en.rlike("[A-Za-z]{3,}") | (zh == "") | ((F.length(zh) >= 10) & zh.rlike("[，。；：、！？]"))


def extract_pairs(pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """EXT-01 to EXT-07, STR-19: (pageid, pos, tag, en, zh) from wikitext, by title field, bold text, brackets both
    ways, infobox fields, and language templates; noise is left out. Bold tags are gone before their pattern
    is tried, as in the original rules, so C_html_bold stands only where a tag survives the cleaning. With a lexicon (`phrases.lexicon`)
    long renderings are cut to the phrase that they end in."""
    pages, clean = pages.withColumn("_clean", T.precleaned(F.col("wikitext"))), F.col("_clean")  # once a page, not once a pattern
    pair = lambda tag, zh, en: F.struct(F.lit(tag).alias("tag"), F.struct(zh.alias("zh"), en.alias("en")).alias("p"))

    def mixed(pattern: str, tag: str) -> Column:
        return F.transform(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(tag).alias("tag"), split_mixed(x).alias("p")))

    def both(pattern: str, zh: int, en: int, tag: str) -> Column:
        rows = F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(zh)).alias("zh"), F.regexp_extract_all(clean, F.lit(pattern), F.lit(en)).alias("en"))
        return F.transform(rows, lambda r: pair(tag, r["zh"], r["en"]))

    zh_field = F.regexp_extract_all(clean, F.lit(r"(?i)\|\s*(?:中文名|name|名称|中文)\s*=\s*([^\n|]+)"), F.lit(1))
    pages = pages.withColumn("_zh", T.stripped(T.link_targets(F.coalesce(F.try_element_at(zh_field, F.lit(1)), F.col("title")))))
    zh_pick = F.col("_zh")
    fields = F.regexp_extract_all(clean, F.lit(r"(?i)\|\s*(?:英文名|英文|eng|english[_ ]?name|orig(?:inal)?[_ ]?name|en[_ ]?name)\s*=\s*([^\n|]+)"), F.lit(1))
    infobox = F.transform(F.when(zh_pick.rlike(f"[{CHINESE}]"), fields).otherwise(F.array().cast("array<string>")), lambda x: pair("E_infobox_field", zh_pick, T.stripped(T.link_targets(x))))
    pairs = F.concat(
        mixed(r"(?i)\|\s*title\s*=\s*([^\n|]+)", "A_title_field"), mixed(r"'''([^'\n]{2,120})'''", "B_triple_bold"), mixed(r"(?i)<b>([^<\n]{2,120})</b>", "C_html_bold"),
        both(rf"([{CHINESE}]{{2,12}})\s*[（(]\s*({ENGLISH})\s*[)）]", 1, 2, "D_paren_ZHopenEN"), both(rf"({ENGLISH})\s*[（(]\s*([{CHINESE}]{{2,12}})\s*[)）]", 2, 1, "D_paren_ENopenZH"),
        infobox, both(rf"([{CHINESE}]{{2,15}})\s{{0,28}}(?i:\{{\{{\s*lang\s*\|\s*en\s*\|\s*([^}}|]+)\}}\}})", 1, 2, "F_lang_template"),
    )
    rows = pages.select("pageid", F.posexplode(F.filter(pairs, lambda x: x["p"].isNotNull())).alias("pos", "x"))
    out = rows.select("pageid", "pos", "x.tag", T.normal_english(F.col("x.p.en")).alias("en"), trimmed(T.normal_chinese(F.col("x.p.zh"))).alias("zh"))
    if words is not None:
        out = phrases.trimmed(out, "zh", words)
    return out.where(~is_noise(F.col("en"), F.col("zh")))


def term_stats(pairs: DataFrame) -> DataFrame:
    """AGG-05, AGG-06: (en, zh, count, sources, alternatives) of pairs (en, zh, tag, pos): each term's
    most frequent rendering, the earlier one on a tie, and the counts of the others."""
    counts = pairs.groupBy("en", "zh").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("pos"), F.array_sort(F.collect_set("tag")).alias("sources"))
    per = counts.groupBy("en").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "pos", "zh", "count", "sources"))).alias("r"))
    best = F.element_at("r", 1)
    others = F.map_from_entries(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda x: F.struct(x["zh"], x["count"])))
    return per.select("en", best["zh"].alias("zh"), best["count"].alias("count"), best["sources"].alias("sources"), others.alias("alternatives"))


def confident(stats: DataFrame) -> DataFrame:
    """FLT-16"""
    return stats.where((F.col("count") >= 2) | (F.size("sources") >= 2) | F.arrays_overlap("sources", F.array(*map(F.lit, STRONG))))


def supplement(stats: DataFrame, known: DataFrame) -> DataFrame:
    """SET-07, GLO-17: confident short terms that `known` (en) doesn't have, in order of the term."""
    have = known.select(F.lower("en").alias("low")).distinct()
    return confident(stats).where(F.length("zh") <= 8).withColumn("low", F.lower("en")).join(have, "low", "left_anti").drop("low").orderBy(F.lower("en"))


LEADING_NOISE = ["依照", "除非", "虽然", "但是", "而且", "因此", "所以", "如果", "即使", "这个", "那个", "这些", "那些", "一个", "一只", "一位", "一名", "北部", "南部", "东部", "西部", "然后", "并且", "它会", "他们", "她们", "我们", "你们", "此外", "另外", "首先", "其次", "最后"]
BAD_STARTS = [*LEADING_NOISE, "是指", "代表", "表示", "指的是", "形如", "形似", "意味", "来自", "生长", "位于", "专门", "可以", "应当", "是否", "是相对", "或说", "或以", "或脚", "不过", "发该", "通常", "必须", "使用", "将会", "当与", "当你", "当他", "当她", "当它", "当这", "过欺"]


def trimmed(zh: Column) -> Column:
    """STR-18: without the first opening word that fits, if two characters are left."""
    out = zh
    for p in reversed(LEADING_NOISE):
        out = F.when(zh.startswith(p) & (F.length(zh) > len(p) + 1), F.substring(zh, len(p) + 1, 1000)).otherwise(out)
    return out


def plausible(en: Column, zh: Column) -> Column:
    """FLT-14, FLT-15, FLT-17, FLT-21: whether a pair may go into a supplement."""
    good_zh = F.length(zh).between(1, 10) & ~starts(zh, BAD_STARTS) & ~zh.rlike("^[的了过着得地将被会就或]") & ~zh.rlike(r"[|\[\]{}《》]") & ~((F.length(zh) >= 10) & zh.rlike("[，。；：、！？]"))
    good_en = (F.length(en) >= 3) & en.rlike("[A-Za-z]{3,}") & ~en.rlike(r"^[A-Z]{2,5}\s*\d+$") & ~en.rlike(r"^\d+[、,.。（）a-zA-Z]?[\s、。（）,.]|^\d[eE][）)]|\[\[|\]\]|\|")
    return good_en & good_zh


# ---- merging ----

def english_candidate(en: Column) -> Column:
    """FLT-18"""
    return ~en.rlike(ARTIFACT) & ~starts(F.lower(en), SENTENCE_OPENERS) & (spaces(en) <= 10)


def chinese_candidate(zh: Column, en: Column) -> Column:
    """FLT-19"""
    fragment = starts(zh, FRAGMENT_PREFIXES) | ends(zh, FRAGMENT_SUFFIXES) | zh.rlike(SENTENCE_MARKERS)
    return F.length(zh).between(2, 8) & ~zh.rlike("[，。；：、！？]") & zh.rlike(f"[{T.HAN}]") & ~fragment & ~((spaces(en) >= 4) & (F.length(zh) <= 2))


def candidates(en: Column, zh: Column, count: Column, alternatives: Column) -> Column:
    """GLO-01: the best rendering and the alternatives with 3 counts and 40% of its count, most counted
    first; empty if the best is no candidate."""
    alts = F.filter(F.map_entries(alternatives), lambda e: chinese_candidate(e["key"], en) & (e["value"] >= 3) & (e["value"] >= count * 0.4))
    rows = F.concat(F.array(F.struct(F.lit(0).alias("k"), zh.alias("zh"))), F.transform(F.array_sort(F.transform(alts, lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("zh")))), lambda x: F.struct(F.lit(1).alias("k"), x["zh"].alias("zh"))))
    return F.when(chinese_candidate(zh, en), F.array_distinct(F.transform(rows, lambda r: r["zh"]))).otherwise(F.array().cast("array<string>"))


MERGED = "struct<en:string,value:array<string>,is_list:boolean,action:string>"


def merge(glossary: DataFrame, stats: DataFrame) -> DataFrame:
    """GLO-02, JOI-11, AGG-19: (en, value, is_list, action). glossary: en, value array<string>, is_list, pos; stats: en,
    zh, count, sources, alternatives, pos.

    Mined terms with the same letters in any case see what the ones before them did, so such a group, which is a few rows, is
    folded in order of pos: glossary first (its first term is the one that mined terms meet), then mined terms. A value that is made
    a list has the mined renderings first, then those it had, in order.
    """
    wiki = stats.withColumn("cands", F.when(english_candidate(F.col("en")), candidates(F.col("en"), F.col("zh"), F.col("count"), F.col("alternatives"))))
    strong = (F.col("count") >= 8) | ((F.col("count") >= 3) & F.arrays_overlap("sources", F.array(*map(F.lit, STRONG))))
    a = glossary.select(F.lower("en").alias("low"), F.struct(F.lit(0).alias("side"), F.col("pos").cast("long").alias("pos"), "en", "value", "is_list", F.lit(True).alias("strong")).alias("r"))
    b = wiki.select(F.lower("en").alias("low"), F.struct(F.lit(1).alias("side"), F.col("pos").cast("long").alias("pos"), "en", F.col("cands").alias("value"), F.lit(False).alias("is_list"), strong.alias("strong")).alias("r"))
    rows = a.unionByName(b).groupBy("low").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<{MERGED}>").alias("out"))

    def entry(en: Column, value: Column, is_list: Column, action: Column) -> Column:
        return F.struct(en.alias("en"), value.cast("array<string>").alias("value"), is_list.alias("is_list"), action.alias("action"))

    def step(acc: Column, r: Column) -> Column:
        at, out, value = acc["at"], acc["out"], r["value"]
        known = F.get(out, at)
        several = F.size(value) > 1
        skip = F.when(value.isNull(), "skipped_bad_en").when(F.size(value) == 0, "skipped_bad_zh")
        skip = F.when(r["side"] == 0, None).otherwise(skip.when((at >= 0) & F.arrays_overlap(known["value"], value), "same").when((at >= 0) & ~r["strong"], "skipped_low_quality"))
        added = F.when(r["side"] == 0, entry(r["en"], value, F.coalesce(r["is_list"], F.lit(False)), F.lit("kept")))
        added = added.when(skip.isNotNull(), entry(r["en"], F.lit(None), F.lit(False), skip)).otherwise(entry(r["en"], value, several, F.when(several, "added_list").otherwise("added_scalar")))
        put = F.when(several, F.concat(value, F.array_sort(F.array_except(known["value"], value)))).otherwise(value)
        changed = entry(known["en"], put, several, F.when(several, "made_list").otherwise("overwritten"))
        replaces = (r["side"] == 1) & skip.isNull() & (at >= 0)
        more = F.when(replaces, F.transform(out, lambda x, i: F.when(i == at, changed).otherwise(x))).otherwise(F.concat(out, F.array(added)))
        now = F.when((at < 0) & skip.isNull(), F.size(out)).otherwise(at)
        return F.struct(now.alias("at"), more.alias("out"))

    return rows.select(F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("m")).select("m.*")


def diff_terms(wiki: DataFrame, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOI-12: (new terms, conflicts) of (en, zh, count) against the user's (en, zh)."""
    u = user.select(F.lower(F.trim("en")).alias("low"), F.col("zh").alias("user_zh"))
    w = wiki.withColumn("low", F.lower(F.trim("en")))
    new = w.join(u, "low", "left_anti").drop("low").orderBy(F.desc("count"), F.lower("en"))
    return new, w.join(u, "low").where("zh <> user_zh").drop("low").orderBy(F.desc("count"), "en")


# ---- cleaning ----

def _keep(new: Column, old: Column, han: bool = True) -> Column:
    ok = (F.length(new) >= 2) & (new.rlike(f"[{T.HAN}]") if han else F.lit(True))
    return F.when(ok, new).otherwise(old)


def strip_action(zh: Column) -> Column:
    """GLO-03"""
    return _keep(T.stripped(F.regexp_replace(zh, rf"(?U)^(?:{ACTION})(?:[—–\-:：\s]+)", "")), zh, han=False)


def strip_quotes(zh: Column) -> Column:
    """GLO-04"""
    return _keep(T.stripped(F.regexp_replace(zh, r"^[》〉】」』\]]+|[《〈【「『\[]+$", "")), zh, han=False)


def strip_starter(zh: Column) -> Column:
    """GLO-05"""
    p = "|".join(sorted(FRAGMENT_STARTERS, key=len, reverse=True))
    return F.when(zh.rlike(f"^(?:{p})"), _keep(F.regexp_replace(F.regexp_replace(zh, f"^(?:{p})", ""), "^[，。；: 　]+|[，。；: 　]+$", ""), zh)).otherwise(zh)


def is_junk(zh: Column) -> Column:
    """GLO-06"""
    return T.stripped(zh).isin(JUNK) | ~zh.rlike(f"[{T.HAN}]")


def strip_action_word(zh: Column) -> Column:
    """GLO-07"""
    return F.regexp_replace(zh, rf"^(?:启动|触发|反应|效果|要求|频率)([{T.HAN}]{{2,}})$", "$1")


def strip_preposition(zh: Column) -> Column:
    """GLO-08"""
    out = zh
    for p, kept in AFTER_FROM.items():
        out = F.regexp_replace(out, rf"^{p}(?![{kept}])(?=[{T.HAN}]{{2,}})", "") if p == "从" else F.when(zh.startswith("从"), out).otherwise(F.regexp_replace(out, rf"^{p}(?![{kept}])(?=[{T.HAN}]{{2,}})", ""))
    return out


def strip_name_title(zh: Column) -> Column:
    """GLO-09"""
    return F.regexp_replace(zh, rf"^(?:女神|男神|大神|邪神|半神)(?=[{T.HAN}]{{2,}})", "")


def strip_named(zh: Column) -> Column:
    """GLO-10"""
    return F.regexp_replace(zh, rf"^(?:如(?![{"".join(AFTER_LIKE)}])|名为|叫做|名叫|称为|称作|又名|又称)(?=[{T.HAN}]{{2,}})", "")


def clean_key(en: Column) -> Column:
    """STR-30"""
    out = F.trim(F.regexp_replace(en, r"^(?:\d+[.、]?\s*)?(?:\[\[\s*)?(?:[–—\-]\s*)?", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\]\]\s*$", "")), r"\[\[|\]\]", ""))


def rename_keys(df: DataFrame) -> DataFrame:
    """GLO-11: (en, value, is_list, pos) under cleaned keys. Of several with one key the longest value
    stays; on a tie the one whose key was clean, then the earlier one."""
    new = clean_key(F.col("en"))
    key = F.when((new != "") & new.rlike("^[A-Za-z]"), new).otherwise(F.col("en"))
    size = F.aggregate("value", F.lit(0), lambda a, v: a + F.length(v))
    rest = [c for c in df.columns if c != "en"]
    rows = df.select(key.alias("key"), "en", *rest, size.alias("_size"))
    best = rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("_size", F.col("en") == F.col("key"), -F.col("pos"))).alias("_row"))
    return best.select(F.col("key").alias("en"), *(F.col("_row")[c].alias(c) for c in rest))


STEPS: dict[int, Callable[[Column], Column]] = {1: strip_action, 2: strip_quotes, 3: strip_starter, 5: strip_action_word, 6: strip_preposition, 7: strip_name_title, 8: strip_named}


def _each(step: Callable[[Column], Column]) -> Column:
    return F.transform("value", lambda v: F.when(F.col("is_list"), v).otherwise(step(v)))


def clean(df: DataFrame, batches: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8, 9)) -> DataFrame:
    """GLO-12, GLO-18: the chosen batches, in order, over (en, value, is_list, pos). Lists pass as they
    are, except that their keys are cleaned."""
    for b in batches:
        one = F.element_at("value", 1)
        if b == 4:
            df = df.where(F.col("is_list") | ~is_junk(one))
        elif b == 9:
            df = rename_keys(df)
        else:
            # inside the lambda the value is computed once, however often the step names it
            df = df.withColumn("value", _each(STEPS[b]))
    return df


# ---- checking ----

def checks(df: DataFrame) -> DataFrame:
    """GLO-13: (en, zh, check): every check that a scalar entry (en, zh) fails."""
    n, han, zh = F.size(content_tokens(F.col("en"))), T.han_count(F.col("zh")), F.col("zh")
    bad = r"</?\w+>|<!--|-->|&\w+;|\{\{|\}\}|\[\[|\]\]|\|\|"
    named = {
        "T2_short_zh": (n >= 3) & (han <= F.floor(n / 2)),
        "T3_generic_tail": (n >= 2) & zh.isin(GENERIC_TAILS),
        "F1_fragment": (F.length(zh) >= 2) & ((ends(zh, END_PARTICLES) & (han >= 3)) | (starts(zh, START_FRAGMENTS) & (T.han_count(F.substring(zh, 2, 1000)) >= 2))),
        "F2_note": starts(zh, NOTE_STARTS) | _any(zh, lambda x, v: F.contains(x, F.lit(v)), NOTES),
        "X1_book_code": F.regexp_replace("en", "[^A-Za-z]", "").isin(BOOK_CODES),
        "X2_artifact": F.col("en").rlike(bad) | zh.rlike(bad),
        "X3_english": zh.rlike("[A-Za-z]{3,}"),
    }
    found = F.filter(F.array(*(F.when(test, name) for name, test in named.items())), lambda x: x.isNotNull())
    return df.select("en", "zh", F.explode(found).alias("check")).unionByName(suffix_copies(df).select("en", "zh", F.lit("T1_suffix").alias("check")))


def suffix_copies(df: DataFrame) -> DataFrame:
    """JOI-14: entries of several words whose rendering a shorter ending of them has too."""
    words = F.split(F.lower(F.trim("en")), " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, -k, k), " "))
    long = df.where(F.size(words) > 1).select("en", "zh", F.explode(tails).alias("tail"))
    return long.join(df.select(F.lower(F.trim("en")).alias("tail"), F.col("zh")).distinct(), ["tail", "zh"], "left_semi").select("en", "zh").distinct()


def flagged(found: DataFrame) -> DataFrame:
    """AGG-20"""
    return found.groupBy("en").agg(F.array_sort(F.collect_set("check")).alias("checks"))


def validated(df: DataFrame, delete: list[str]) -> DataFrame:
    """GLO-14: entries without those that fail a check in `delete`."""
    return df.join(checks(df).where(F.col("check").isin(delete)).select("en").distinct(), "en", "left_anti")


def correspondence(df: DataFrame, roles: dict[str, list[str]] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """GLO-15: `df` (en, zh) plus `reason`: the first rule that fails, or null."""
    words = content_words(F.col("en"))
    n, han, zh, en = F.size("_w"), T.han_count(F.col("zh")), F.col("zh"), F.col("en")
    tails = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice("_w", -k, k), " ")))
    rows = df.withColumn("_w", words)
    known = df.select(F.lower("en").alias("tail"), "zh").distinct()
    cut = rows.where(~en.rlike("[(（]") & (han < n * 1.5)).select("en", "zh", F.explode(tails).alias("tail")).join(known, ["tail", "zh"], "left_semi").select("en", "zh", F.lit(True).alias("_cut")).distinct()
    rows = rows.join(cut, ["en", "zh"], "left")
    listing = F.size(F.split("en", ",")) >= 3
    stray = F.size(F.filter(F.regexp_extract_all("zh", F.lit("([A-Za-z]{2,})"), F.lit(1)), lambda x: ~x.isin(allowed or [""]))) > 0
    role = F.lit(False)
    for name, own in (roles or {}).items():
        role = role | ((zh == name) & ~F.lower(F.trim("en")).isin(own))
    verb = F.lit(False)
    for p, ok in VERB_PREFIXES.items():
        verb = verb | (zh.rlike(f"^{p}[^{ok}]"))
    reason = (
        F.when(F.coalesce(han, F.lit(0)) == 0, "R0_no_cjk").when(F.col("_cut"), "R1_truncated").when(~listing & (((n >= 4) & (han < 3)) | ((n >= 6) & (han < 4))), "R2_too_short")
        .when((n >= 2) & zh.isin(GENERIC_TAILS), "R3_generic_tail").when(starts(zh, STRAY_PREFIXES), "R4_fragment_prefix").when(stray, "R5_stray_english").when(role, "R6_role_truncation").when((n <= 1) & verb, "R7_verb_prefix")
    )
    return rows.withColumn("reason", reason).select(*df.columns, "reason")


def replaced(failed: DataFrame, wiki: DataFrame, **options) -> DataFrame:
    """GLO-16, JOI-15: (en, zh, decision, new_zh): a mined rendering (en, zh, count) with 2 counts, more
    Chinese characters, and no failing rule replaces a failed entry; others are deleted. An exact key
    goes before one in another case, then the most counted one."""
    w = wiki.select(F.col("en").alias("w_en"), F.lower("en").alias("low"), F.col("zh").alias("w_zh"), "count")
    tries = failed.select("en", "zh").withColumn("low", F.lower("en")).join(w, "low").where((F.col("count") >= 2) & (T.han_count(F.col("w_zh")) > T.han_count(F.col("zh"))))
    ok = correspondence(tries.select(F.col("en"), F.col("w_zh").alias("zh"), F.col("zh").alias("old"), "w_en", "count"), **options).where("reason IS NULL")
    best = ok.groupBy("en").agg(F.min_by("zh", F.struct(F.col("w_en") != F.col("en"), -F.col("count"), "zh")).alias("new_zh"))
    return failed.select("en", "zh").join(best, "en", "left").select("en", "zh", F.when(F.col("new_zh").isNull(), "delete").otherwise("replace").alias("decision"), "new_zh")


def dedup_delta(delta: DataFrame, main: DataFrame) -> DataFrame:
    """JOI-13: `delta` (en, zh) plus state: new, same or differs, against main (en, value)."""
    m = main.select(F.lower("en").alias("low"), "value").dropDuplicates(["low"])
    j = delta.withColumn("low", F.lower("en")).join(m, "low", "left")
    state = F.when(F.col("value").isNull(), "new").when(F.array_contains("value", F.col("zh")), "same").otherwise("differs")
    return j.select("en", "zh", state.alias("state"))


GLOSSARY = TY.StructType().add("en", "string").add("value", TY.ArrayType(TY.StringType())).add("is_list", "boolean").add("pos", "long")


def ranked_terms(stats: DataFrame) -> DataFrame:
    """SRT-07: by count, then term; ranks come from ranges of both, so no task sorts all terms."""
    span = F.struct((-F.col("count")).alias("k"), F.substring("en", 1, 3).alias("start"))
    return numbered(stats.withColumn("span", span), "en").withColumn("rank", (F.col("id") + 1).cast("int")).drop("span", "id")

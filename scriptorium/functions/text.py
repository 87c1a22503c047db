"""Column functions on titles, tokens and small texts. None of them runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal what published indexes hold.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
HAN = r"\x{4E00}-\x{9FFF}"
ENGLISH_STOP = ["a", "an", "and", "or", "of", "to", "the", "in", "on", "at", "is", "as", "by", "for", "be", "it", "with", "from", "this", "that"]
CHINESE_STOP = ["的", "了", "是", "在", "与", "和", "及", "或", "但", "因", "為", "为", "以", "及", "他", "她", "它", "我", "你", "们", "们", "之", "于", "而"]
KNOWN_PREFIXES = ["Category", "分类", "Data", "数据", "Project", "Property", "属性", "Help", "帮助"]
SKIPPED_PREFIXES = ["Template:", "模板:", "File:", "文件:", "Module:", "模块:", "MediaWiki:", "Form:", "表单:"]
NAMESPACE_DIRS = {0: "pages", 4: "project", 14: "category", 102: "pages", 3500: "data"}
LEVELS = [("0-1", 0, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-15", 11, 15), ("16-20", 16, 20)]
FORM_TAGS = ["big", "small", "sup", "sub", "u", "i", "b", "br", "font", "span", "div"]
EDGE_MARKS = " \t\"'`’‘“”「」《》『』()（）[]{}：:；;,，.。·•*～~—-_/\\"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def latin_words(text: Column) -> Column:
    """STR-04: words of 2 to 31 characters from a letter on, lower-cased, without stop words."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9'_-]{1,30})"), F.lit(1)), F.lower)
    return F.filter(words, lambda w: ~w.isin(ENGLISH_STOP))


def cjk_runs(text: Column) -> Column:
    """STR-02"""
    return F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), F.lit(1))


def _bigrams(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))))


def cjk_bigrams(text: Column) -> Column:
    """STR-03: pairs of neighbours in each run, or its only character; pairs of two stop characters go."""
    return F.filter(_bigrams(cjk_runs(text)), lambda b: ~b.rlike(f"^[{''.join(CHINESE_STOP)}]{{2}}$"))


def query_tokens(text: Column) -> Column:
    """STR-07: bigrams without a stop list, and words that may start with a digit, of 2 characters on."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9][A-Za-z0-9_'-]*)"), F.lit(1)), F.lower)
    return F.struct(_bigrams(cjk_runs(text)).alias("cjk"), F.filter(words, lambda w: F.length(w) >= 2).alias("latin"))


def bigram_bucket(token: Column) -> Column:
    """STR-05"""
    return F.substring(F.md5(token), 1, 2)


def word_bucket(token: Column) -> Column:
    """STR-06"""
    first = F.substring(token, 1, 1)
    return F.when(first.rlike("^[a-z]$"), first).otherwise("_")


def safe_title(title: Column) -> Column:
    """PRJ-01: a title as a file name."""
    return F.regexp_replace(F.replace(F.replace(F.replace(title, F.lit(":"), F.lit("_")), F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("_")), r'[*?"<>|]', "")


def directory(ns: Column) -> Column:
    """PRJ-02: the directory of a namespace; `pages` if it has none of its own."""
    out = F.lit("pages")
    for number, name in NAMESPACE_DIRS.items():
        out = F.when(ns == number, name).otherwise(out)
    return out


def bare_title(title: Column) -> Column:
    """PRJ-02: the title without a known prefix."""
    prefixed = F.substring_index(title, ":", 1).isin(KNOWN_PREFIXES) & F.contains(title, F.lit(":"))
    return F.when(prefixed, F.regexp_replace(title, "^[^:]*:", "")).otherwise(title)


def percent(text: Column) -> Column:
    """A path segment in percent code: letters, digits and _.-~/ stay."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), F.lit("%2F"), F.lit("/"))


def percent_decoded(text: Column) -> Column:
    """STR-32: a plus sign stays one; null for broken code."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def page_href(ns: Column, title: Column) -> Column:
    """PRJ-03"""
    return F.concat(directory(ns), F.lit("/"), percent(safe_title(bare_title(title))), F.lit(".html"))


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def excerpt(text: Column, most: int = 200) -> Column:
    """PRJ-04: cut at `most` characters, with an ellipsis only where it was cut."""
    t = stripped(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", ""), F.lit("…")))


def without_tags(html: Column, put: str = " ") -> Column:
    return F.regexp_replace(html, "<[^>]+>", put)


def meta_description(html: Column) -> Column:
    """PRJ-05: the first 160 characters of the text, fit for an attribute."""
    return F.replace(F.substring(collapsed(F.regexp_replace(without_tags(html), "&[A-Za-z]+;", " ")), 1, 160), F.lit('"'), F.lit("'"))


def html_text(html: Column) -> Column:
    """STR-08 for well-formed pages: text without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    out = without_tags(out)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapsed(out)


def cleaned_parse(html: Column) -> Column:
    """STR-09: without comments, edit links and template placeholders."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r'(?is)<span class="mw-editsection".*?</span>\s*</span>|<span class="mw-editsection"[^>]*>.*?</span>', "")
    return F.regexp_replace(out, r"(?s)\{\{\{[^{}]*\}\}\}|&#123;&#123;&#123;.*?&#125;&#125;&#125;", "")


def first_letter(title: Column) -> Column:
    """PRJ-15: A to Z, CJK, or _."""
    first = F.substring(title, 1, 1)
    return F.when(first.rlike("^[A-Za-z]$"), F.upper(first)).when(first.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]$"), "CJK").otherwise("_")


def member_letter(title: Column) -> Column:
    """PRJ-16: A to Z, the CJK character itself, or _."""
    first = F.substring(title, 1, 1)
    return F.when(first.rlike("^[A-Za-z]$"), F.upper(first)).when(first.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]$"), first).otherwise("_")


def level_bucket(level: Column) -> Column:
    """STR-25: null below 0."""
    out = F.when(level >= 21, "21+")
    for name, low, high in LEVELS:
        out = out.when(level.between(low, high), name)
    return out


def parts(text: Column, marks: str = ",，、/") -> Column:
    """STR-13, STR-24: the pieces between any of `marks`, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, f"[{marks}]"), F.trim), lambda x: x != "")


def to_int(text: Column) -> Column:
    """STR-14: null if it isn't a whole number."""
    return F.trim(text).try_cast("int")


def escaped_html(text: Column) -> Column:
    """STR-21"""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def normal_title(title: Column) -> Column:
    """STR-28"""
    return F.trim(F.replace(title, F.lit("_"), F.lit(" ")))


def short_key(name: Column) -> Column:
    """STR-29"""
    return F.substring(F.sha1(name), 1, 16)


def han_count(text: Column) -> Column:
    """STR-27"""
    return F.length(F.regexp_replace(text, f"[^{HAN}]", ""))


def precleaned(wikitext: Column) -> Column:
    """STR-15: no file links, the labels of external links, no comments and tags of mere form."""
    out = F.regexp_replace(wikitext, r"(?i)\[\[(?:File|文件|图像|Image):[^\]]*\]\]", "")
    out = F.regexp_replace(out, r"(?U)\[https?://\S+\s+([^\]]+)\]", "$1")
    return F.regexp_replace(out, rf"(?is)</?(?:{'|'.join(FORM_TAGS)})(?:\s[^>]*)?/?>|<!--.*?-->", " ")


def link_targets(text: Column) -> Column:
    """Links as the titles that they lead to."""
    return F.regexp_replace(text, r"\[\[([^|\]]+)(?:\|[^\]]*)?\]\]", "$1")


def normal_english(text: Column) -> Column:
    """STR-17"""
    return F.btrim(F.replace(collapsed(text), F.lit("’"), F.lit("'")), F.lit(EDGE_MARKS))


def normal_chinese(text: Column) -> Column:
    """STR-17"""
    return F.trim(F.btrim(F.btrim(collapsed(link_targets(text)), F.lit(EDGE_MARKS)), F.lit("'")))


def highlighted(text: Column, terms: list[str], lead: int = 36, back: int = 12) -> Column:
    """STR-20: cut shortly before the first hit if that lies beyond `lead`; each hit is marked."""
    low = F.lower(text)
    spots = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms]
    first = F.least(*spots, spots[0])
    cut = F.when(first - 1 > lead, F.concat(F.lit("…"), F.substring(text, first - back, F.length(text)))).otherwise(text)
    pattern = "(?i)" + "|".join(rf"\Q{t}\E" for t in terms)
    return F.regexp_replace(cut, pattern, "<mark>$0</mark>")


def content_address(digest: Column, extension: Column) -> Column:
    """PRJ-22"""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 64), F.lit("."), extension)


def semver(version: Column) -> Column:
    """PRJ-23: array of three numbers, which compare in order; null if it isn't a version."""
    ok = version.rlike(r"^v?\d+\.\d+\.\d+")
    return F.when(ok, F.transform(F.slice(F.split(F.regexp_extract(version, r"^v?(\d+\.\d+\.\d+)", 1), r"\."), 1, 3), lambda x: x.cast("int")))


def is_external(href: Column) -> Column:
    """FLT-24, REN-10: a web link to another host, without control characters."""
    return href.rlike("(?i)^https?://") & ~href.rlike(r"(?i)127\.0\.0\.1|localhost") & ~href.rlike(r"\p{Cntrl}")


def title_matches(title: Column, needle: str) -> Column:
    """FLT-11: at the left edge of a word for an ASCII needle, anywhere for others. title: lower case."""
    if needle.isascii():
        return title.rlike(rf"(^|[^a-z0-9])\Q{needle}\E")
    return F.contains(title, F.lit(needle))


def skipped(title: Column) -> Column:
    """FLT-01"""
    out = F.lit(False)
    for p in SKIPPED_PREFIXES:
        out = out | title.startswith(p)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """FUN-04: percent with two digits; null for nothing."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2)


def megabytes(size: Column) -> Column:
    """FUN-09"""
    return F.round(size / 1024 / 1024, 2)

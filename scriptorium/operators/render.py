"""Pages rendered whole: tags taken out in order, resolved by joins, and put back where they stood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, site

ANCHOR = r'(?i)<a\b[^>]*?\bhref="[^"]*"[^>]*>'
IMAGE = r'(?i)<img\b[^>]*?\bsrc="[^"]*"[^>]*>'
MEDIA = r"(?i)\.(?:png|jpg|jpeg|gif|webp|svg|bmp|ico)$"


def tags(pages: DataFrame, pattern: str, key: str, html: str = "html") -> DataFrame:
    """(key, pos, tag): the tags of each page that a pattern finds, numbered from 0."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("pos", "tag"))


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?i)\b{name}="([^"]*)"', 1)


def put_back(pages: DataFrame, pattern: str, new: DataFrame, key: str, html: str = "html") -> DataFrame:
    """`pages` with the tags that a pattern finds replaced by those of `new` (key, pos, tag, drops): a tag that `drops` goes together
    with the first closing tag behind it. What lies between tags stays as it is; only the tags of a page meet in a row, and its
    html moves once. Pages without tags stay whole."""
    own = new.select(F.col(key).alias("_key"), F.struct("pos", "tag", "drops").alias("t")).groupBy("_key").agg(F.array_sort(F.collect_list("t")).alias("_tags"))
    rows = pages.select(F.struct("*").alias("row"), F.col(key).alias("_of"), F.col(html).alias("_html")).join(own, F.col("_of").eqNullSafe(F.col("_key")), "left")
    texts = F.split("_html", pattern, -1)
    behind = F.zip_with(F.slice(texts, F.lit(2), F.size(texts)), "_tags", lambda x, t: F.when(t["drops"], F.regexp_replace(x, "(?is)^(.*?)</a>", "$1")).otherwise(F.concat(t["tag"], x)))
    whole = F.when(F.col("_tags").isNotNull(), F.concat(F.get(texts, F.lit(0)), F.array_join(behind, ""))).otherwise(F.col("_html"))
    return rows.select(*(whole.alias(c) if c == html else F.col("row")[c].alias(c) for c in pages.columns))


def with_attribute(tag: Column, name: str, value: Column) -> Column:
    """A tag whose attribute has another value, or which gets it."""
    had = tag.rlike(rf'(?i)\b{name}="')
    put = F.concat(F.lit(f'{name}="'), value, F.lit('"'))
    begin, end = F.regexp_extract(tag, rf'(?is)^(.*?)\b{name}="[^"]*"(.*)$', 1), F.regexp_extract(tag, rf'(?is)^(.*?)\b{name}="[^"]*"(.*)$', 2)
    return F.when(had, F.concat(begin, put, end)).otherwise(F.concat(F.regexp_replace(tag, r"\s*/?>$", ""), F.lit(" "), put, F.lit(">")))


def link_title(href: Column) -> Column:
    """The title that a wiki's own link names, with blanks for underscores; null for other links."""
    path = F.regexp_extract(href, r"^/wiki/([^#]*)", 1)
    asked = F.regexp_extract(href, r"^/index\.php\?title=([^&]+)", 1)
    name = F.when(href.startswith("/wiki/"), path).when(asked != "", asked)
    return F.nullif(F.replace(T.percent_decoded(name), F.lit("_"), F.lit(" ")), F.lit(""))


def resolved_links(found: DataFrame, redirects: DataFrame, index: DataFrame, home: str) -> DataFrame:
    """JOI-01, JOI-02: (key columns, pos, tag, drops) of anchors (…, pos, tag): a wiki's own links lead to the page's file, by the redirect's
    target, else by the title; those without a page lead where it would be, and are marked `new`. Links to media and edit links
    drop, and their label stays; links elsewhere open there. Each different title is resolved once."""
    rows = found.withColumn("href", attribute(F.col("tag"), "href")).withColumn("title", link_title(F.col("href")))
    titles = graph.resolve_links(rows.select("title").where("title IS NOT NULL").distinct(), redirects, index)
    to = F.coalesce(F.col("path"), F.concat(T.directory(namespace(F.col("title"))), F.lit("/"), T.safe_title(T.bare_title(F.col("title")))))
    urls = titles.select(F.col("title").alias("t_title"), F.concat(F.lit("../"), T.percent(to), F.lit(".html")).alias("t_url"), F.col("path").isNull().alias("t_new"))
    rows = rows.join(urls, F.col("title") == F.col("t_title"), "left")
    fragment = F.when(F.col("href").startswith("/wiki/"), F.regexp_extract("href", "(#.*)$", 1)).otherwise("")
    own = with_attribute(F.col("tag"), "href", F.concat("t_url", fragment))
    had = attribute(own, "class")
    dead = F.when(F.array_contains(F.split(had, " "), "new"), own).otherwise(with_attribute(own, "class", F.trim(F.concat(had, F.lit(" new")))))
    away = F.col("href").startswith("http") & ~F.contains("href", F.lit(home))
    tag = F.when(F.col("t_url").isNotNull(), F.when(F.col("t_new"), dead).otherwise(own))
    tag = tag.when(away, with_attribute(with_attribute(F.col("tag"), "rel", F.lit("noopener external")), "target", F.lit("_blank"))).otherwise(F.col("tag"))
    drops = F.coalesce(F.col("title").rlike(MEDIA), F.lit(False)) | (F.col("title").isNull() & site.is_edit_link(F.col("href")))
    return rows.select(*(c for c in found.columns if c not in ("pos", "tag")), "pos", tag.alias("tag"), drops.alias("drops"))


def namespace(title: Column) -> Column:
    """The namespace that a title's prefix names; 0 without one that is known."""
    out = F.lit(0)
    for number, names in ((14, ["Category", "分类"]), (3500, ["Data", "数据"]), (4, ["Project"]), (102, ["Property", "属性"])):
        out = F.when(F.substring_index(title, ":", 1).isin(names) & F.contains(title, F.lit(":")), number).otherwise(out)
    return out


def local_images(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOI-04: (…, pos, tag, drops) of images whose source the manifest (url, path) has; others stay."""
    m = manifest.select(F.col("url").alias("m_url"), F.col("path").alias("m_path")).dropDuplicates(["m_url"])
    rows = found.withColumn("src", attribute(F.col("tag"), "src")).join(m, F.col("src") == F.col("m_url"), "left")
    tag = F.when(F.col("m_path").isNotNull(), with_attribute(F.col("tag"), "src", F.concat(F.lit("../"), "m_path"))).otherwise(F.col("tag"))
    return rows.select(*(c for c in found.columns if c not in ("pos", "tag")), "pos", tag.alias("tag"), F.lit(False).alias("drops"))


def category_block(categories: Column, links: Column) -> Column:
    """The block at a page's foot: each category as a link, or as plain text where `links`, an array of URLs alongside, has null."""
    item = lambda c, u: F.when(u.isNull(), F.concat(F.lit('<li><span class="new">'), T.escaped_html(c), F.lit("</span></li>"))).otherwise(
        F.concat(F.lit('<li><a href="'), u, F.lit('">'), T.escaped_html(c), F.lit("</a></li>")))
    return F.when(F.size(categories) > 0, F.concat(F.lit('<div class="page-categories"><ul>'), F.array_join(F.zip_with(categories, links, item), ""), F.lit("</ul></div>"))).otherwise("")


def rendered(pages: DataFrame, redirects: DataFrame, index: DataFrame, manifest: DataFrame, home: str = "wiki.example.org") -> DataFrame:
    """REN-01: (pageid, path, content) of pages (pageid, ns, title, html, categories array<string>), pageid told apart: cleaned, links and
    images resolved, images lazy, categories at the foot, and all of it in the page's frame. index: key, dir, fn; redirects: src, tgt;
    manifest: url, path. A redirect notice to a page that is there sends its reader on.

    Titles and sources are resolved once each, by joins of tags, so neither a large page nor a link of every page makes a large
    row or group. Null html: an empty page.
    """
    rows = pages.select("pageid", "ns", "title", "categories", T.cleaned_parse(F.coalesce("html", F.lit(""))).alias("html"), T.meta_description(F.coalesce("html", F.lit(""))).alias("about"))
    rows = put_back(rows, ANCHOR, resolved_links(tags(rows, ANCHOR, "pageid"), redirects, index, home), "pageid")
    rows = put_back(rows, IMAGE, local_images(tags(rows, IMAGE, "pageid"), manifest), "pageid")
    each = rows.select("pageid", F.posexplode(F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))).alias("pos", "name"))
    each = each.select("pageid", "pos", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))
    variants = F.array(*(F.concat(F.lit(p), F.col("name")) for p in ("Category:", "分类:", "")))
    places = graph.lookup_variants(each.select("name").distinct(), index.select("key", F.concat(F.lit("../"), T.percent(F.concat("dir", F.lit("/"), "fn")), F.lit(".html")).alias("value")), variants)
    each = each.join(places.withColumnRenamed("name", "c_name"), F.col("name") == F.col("c_name"), "left")
    foot = each.groupBy(F.col("pageid").alias("c_page")).agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.col("value").alias("url")))).alias("cats"))
    rows = rows.join(foot, F.col("pageid").eqNullSafe(F.col("c_page")), "left")
    none = F.array().cast("array<struct<pos:int,name:string,url:string>>")
    cats = F.coalesce("cats", none)
    block = category_block(F.transform(cats, lambda c: c["name"]), F.transform(cats, lambda c: c["url"]))
    notice = F.regexp_extract("html", r'(?is)class="redirectMsg".*?(<a\b[^>]*>)', 1)
    goes = F.when((notice != "") & ~attribute(notice, "class").rlike(r"\bnew\b") & ~attribute(notice, "href").startswith("http"), attribute(notice, "href"))
    send = F.when(goes != "", F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), goes, F.lit('">'))).otherwise("")
    bare = T.bare_title(F.col("title"))
    body = F.concat(F.lit('<div class="mw-parser-output">'), site.lazy_images(F.col("html")), F.lit("</div>"))
    body = F.when(F.contains("html", F.lit('class="mw-parser-output"')), site.lazy_images(F.col("html"))).otherwise(body)
    content = F.concat(
        F.lit('<!doctype html><html lang="zh"><head><meta charset="utf-8">'), F.coalesce(send, F.lit("")), F.lit("<title>"), T.escaped_html(bare), F.lit('</title><meta name="description" content="'), F.col("about"),
        F.lit('"></head><body class="'), site.body_class(F.col("ns"), bare), F.lit('">'), site.breadcrumb(F.col("ns"), bare), F.lit("<main>"), body, block, F.lit("</main></body></html>"),
    )
    path = F.concat(T.directory(F.col("ns")), F.lit("/"), T.safe_title(bare), F.lit(".html"))
    return rows.select("pageid", path.alias("path"), content.alias("content"))

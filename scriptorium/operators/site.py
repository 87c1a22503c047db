"""Pages as columns: what a rendered page is made of, its links and images, and stubs for dead links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T

LABELS = {0: "条目", 4: "项目", 14: "分类", 102: "属性", 3500: "数据"}  # PRJ-26
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}
POINTER_HTML = r"本页面是存放物品数据的子页面[，,]\s*如果您是通过搜索栏进入本页的[，,]\s*请点击主页面[：:]\s*(?:<[^>]+>\s*)*([^<]+)"


def label(ns: Column) -> Column:
    """PRJ-26"""
    out = F.lit("条目")
    for number, name in LABELS.items():
        out = F.when(ns == number, name).otherwise(out)
    return out


def body_class(ns: Column, bare: Column) -> Column:
    """PRJ-06"""
    page = T.safe_title(bare)
    return F.concat_ws(" ", F.lit("mediawiki ltr sitedir-ltr mw-hide-empty-elt"), F.concat(F.lit("ns-"), ns.cast("string")), F.lit("ns-subject action-view skin--responsive"), F.concat(F.lit("page-"), page), F.concat(F.lit("rootpage-"), page))


def breadcrumb(ns: Column, bare: Column) -> Column:
    """PRJ-14"""
    return F.concat(F.lit('<nav class="breadcrumb"><a href="../index.html">首页</a> › <span>'), label(ns), F.lit('</span> › <span class="current">'), T.escaped_html(bare), F.lit("</span></nav>"))


def contents(sections: Column, size: Column, least: int = 1500) -> Column:
    """PRJ-25: the table of contents, as an array of (level, line, anchor): of long texts, levels to 3, lines
    that say something; null for fewer than three."""
    plain = F.transform(sections, lambda s: F.struct(s["level"].try_cast("int").alias("level"), F.trim(T.without_tags(s["line"], "")).alias("line"), s["anchor"].alias("anchor")))
    rows = F.filter(plain, lambda s: (s["level"] <= 3) & (F.coalesce(s["line"], F.lit("")) != "") & (F.coalesce(s["anchor"], F.lit("")) != ""))
    return F.when((size >= least) & (F.size(rows) >= 3), rows)


def pointer_parent(html: Column) -> Column:
    """FLT-02, FLT-03: the main page that a data subpage points to, else null."""
    return F.nullif(F.trim(F.regexp_extract(html, POINTER_HTML, 1)), F.lit(""))


def is_edit_link(href: Column) -> Column:
    """FLT-23"""
    return href.rlike(r"[?&](?:action=(?:edit|history)|veaction=edit)\b")


def image_extension(url: Column, mime: Column) -> Column:
    """PRJ-22: of the URL if it is one of an image, else of the type, else bin."""
    own = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,4})(?:[?#].*)?$", 1))
    out = F.lit("bin")
    for kind, ext in IMAGE_TYPES.items():
        out = F.when(mime == kind, ext).otherwise(out)
    return F.when(own.isin([*IMAGE_TYPES.values(), "jpeg"]), F.replace(own, F.lit("jpeg"), F.lit("jpg"))).otherwise(out)


def image_titles(pages: DataFrame) -> DataFrame:
    """SET-10"""
    return pages.select(F.explode("images").alias("title")).where("title <> ''").distinct().orderBy("title")


def images_todo(titles: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOI-04, JOI-24: images that the manifest (title, missing) doesn't have or once missed."""
    m = manifest.select("title", F.coalesce("missing", F.lit(False)).alias("_missing"), F.lit(True).alias("_there"))
    return titles.join(m, "title", "left").where("_there IS NULL OR _missing").select("title")


def lazy_images(html: Column) -> Column:
    """REN-02"""
    return F.regexp_replace(html, r"(?i)<img\b(?![^>]*\bloading=)", '<img loading="lazy"')


def rendered(pages: DataFrame) -> DataFrame:
    """REN-01: (path, content) of pages (ns, title, html): cleaned, lazy images, classes, breadcrumb,
    description. Links are resolved before, as joins; see `graph.resolve_links`."""
    bare = T.bare_title(F.col("title"))
    body = lazy_images(T.cleaned_parse(F.col("html")))
    page = F.concat(
        F.lit('<!doctype html><html lang="zh"><head><meta charset="utf-8"><title>'), T.escaped_html(bare), F.lit('</title><meta name="description" content="'), T.meta_description(F.col("html")),
        F.lit('"></head><body class="'), body_class(F.col("ns"), bare), F.lit('">'), breadcrumb(F.col("ns"), bare), F.lit("<main>"), body, F.lit("</main></body></html>"),
    )
    return pages.select(F.concat(T.directory(F.col("ns")), F.lit("/"), T.safe_title(bare), F.lit(".html")).alias("path"), page.alias("content"))


def browse_page(rows: DataFrame, columns: list[str]) -> DataFrame:
    """REN-04, REN-06: one table row of HTML for each row, in order of the title."""
    cells = F.concat_ws("", *[F.concat(F.lit("<td>"), T.escaped_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns])
    return rows.orderBy(F.lower("title")).select("title", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))


def dead_stubs(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """REN-08: (target, url, label) for dead targets: by a rule (target, url, label), by the image's name for
    `.png.html`, else a search for the page's name."""
    name = F.regexp_replace(F.substring_index("target", "/", -1), r"(?i)(\.png)?\.html$", "")
    j = targets.join(rules.select("target", F.col("url").alias("_u"), F.col("label").alias("_l")), "target", "left")
    where = F.when(F.col("target").endswith(".png.html"), F.concat(name, F.lit(" ["), F.substring_index("target", "/", 1), F.lit("]"))).otherwise(name)
    return j.select("target", F.coalesce("_u", F.concat(F.lit("../search.html?q="), T.percent(name))).alias("url"), F.coalesce("_l", where).alias("label"))


def nav_audit(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """JOI-25, JOI-26: `targets` (path) plus state: missing, redirect, list or article, from pages (path, size,
    is_redirect, n_links)."""
    j = targets.join(pages, "path", "left")
    state = F.when(F.col("size").isNull(), "missing").when(F.col("is_redirect"), "redirect").when(F.col("n_links") * 60 > F.col("size"), "list").otherwise("article")
    return j.select("path", state.alias("state"))


def dead_reasons(dead: DataFrame, pages: DataFrame) -> DataFrame:
    """JOI-22: `dead` (fn) plus the title whose file name it would be, the first by title."""
    own = pages.groupBy(T.safe_title(T.bare_title(F.col("title"))).alias("fn")).agg(F.min("title").alias("title"))
    return dead.join(own, "fn", "left")


def missing_query(url: Column) -> Column:
    """PRJ-20: what to search for when a page isn't there: the query's q or missing, else the page's name."""
    asked = F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("q")), F.parse_url(url, F.lit("QUERY"), F.lit("missing")))
    path = F.parse_url(url, F.lit("PATH"))
    name = F.nullif(F.regexp_extract(path, r"(?i)/(?:pages|category|data)/([^?#]+)\.html$", 1), F.lit(""))
    tail = F.when(path != "/404.html", F.nullif(F.regexp_extract(path, r"(?i)([^/]+)\.html$", 1), F.lit("")))
    return F.coalesce(T.percent_decoded(asked), T.percent_decoded(F.coalesce(name, tail)), F.lit(""))


def site_path(url: Column, root: str = "site") -> Column:
    """PRJ-21: the path below the site's root; without one, the last name, with a known folder before it."""
    path = T.percent_decoded(F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), url), "[?#].*$", ""))
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    last = F.regexp_extract(path, r"((?:(?:pages|data|category|project|classes|source|index)/)?[^/]+)$", 1)
    return F.when(path.rlike(rf".*/\Q{root}\E/"), F.regexp_replace(path, rf"^.*/\Q{root}\E/", "")).otherwise(F.coalesce(F.nullif(last, F.lit("")), F.lit("index.html")))


def release_url(base: str, tag: Column) -> Column:
    """PRJ-24"""
    return F.concat(F.lit(f"{base.rstrip('/')}/download/"), tag, F.lit("/"), F.lit("full-"), tag, F.lit(".zip"))


def tooltip(params: Column, mark: str = "|") -> Column:
    """STR-23"""
    return F.array_join(F.filter(F.split(params, rf"\Q{mark}\E"), lambda x: F.trim(x) != ""), " · ")


def data_cells(html: Column) -> Column:
    """STR-11: a data page's record with its wikitext rendered, as one JSON text."""
    return H.rendered_inline(F.to_json(H.data_record(html)))


def compact_json(df: DataFrame) -> DataFrame:
    """FUN-07: each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def random_pool(items: DataFrame) -> DataFrame:
    """FLT-26"""
    return items.where(F.col("href").startswith("pages/"))


def table_rows(cells: DataFrame) -> DataFrame:
    """FLT-28: rows (table_id, row, n_th, n_td) plus is_header: the first row without data cells."""
    first = cells.where("n_td = 0").groupBy("table_id").agg(F.min("row").alias("_h"))
    return cells.join(first, "table_id", "left").withColumn("is_header", F.coalesce(F.col("row") == F.col("_h"), F.lit(False))).where("n_td > 0 OR row = _h").drop("_h")


def latency(df: DataFrame, ms: str) -> DataFrame:
    """AGG-22: mean milliseconds, and the requests a second that keep the load light."""
    mean = F.avg(ms)
    return df.agg(F.round(mean, 1).alias("mean_ms"), F.round(1.0 / F.greatest(mean / 1000, F.lit(0.5)), 2).alias("rate"))

"""The site's pages, rendered, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import render
from .queries import query, table

_SAFE = r"""regexp_replace(replace(replace(replace({0}, ':', '_'), '/', '__'), '\', '_'), '[*?"<>|]', '', 'g')"""
_PERCENT = "replace(url_encode({0}), '%2F', '/')"
_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


def pages_as_wiki(spark, sf_dir):
    """(pageid, ns, title, html, categories) of the pages: links lead into a wiki, an image stands at each article's end, the URL is the
    title, and the language and the first link's name are categories."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("pageid"), "url", "html")
    html = F.replace(F.replace("html", F.lit('href="/'), F.lit('href="/wiki/')), F.lit("</article>"), F.concat(F.lit('<img src="/img/'), F.col("pageid") % 5, F.lit('.png"></article>')))
    first = F.regexp_extract("html", 'href="/([^"]*)"', 1)
    return p.select("pageid", F.lit(0).alias("ns"), F.col("url").alias("title"), html.alias("html"), F.array(F.regexp_extract("html", 'lang="([a-z]+)"', 1), first).alias("categories"))


@query(rf"""
WITH p AS (SELECT page_id AS pageid, url AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(html, 'href="/([^"]*)"', 1) AS first, html AS raw,
    replace(replace(html, 'href="/', 'href="/wiki/'), '</article>', '<img src="/img/' || page_id % 5 || '.png"></article>') AS html FROM pages),
n AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages) WHERE name <> '' GROUP BY name),
i AS (SELECT name AS key, {_PERCENT.format("'pages/' || " + _SAFE.format('name'))} AS url FROM n WHERE n > 1),
r AS (SELECT name AS src, lower(name) AS tgt FROM n WHERE regexp_matches(name, '^[A-Z]')),
c AS (SELECT pageid, regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), '\{{\{{\{{[^{{}}]*\}}\}}\}}', '', 'g') AS html FROM p),
s AS (SELECT pageid, string_split_regex(html, '<a\b[^>]*?\bhref="[^"]*"[^>]*>') AS texts, regexp_extract_all(html, '<a\b[^>]*?\bhref="[^"]*"[^>]*>') AS tags FROM c),
t AS (SELECT pageid, texts, tags, unnest(range(1, len(tags) + 1)) AS pos FROM s),
u AS (SELECT pageid, pos, tags[pos] AS tag, texts[pos + 1] AS behind, replace(regexp_extract(tags[pos], 'href="/wiki/([^"#]*)', 1), '_', ' ') AS title FROM t),
v AS (SELECT u.*, coalesce(a.url, b.url) AS url, {_PERCENT.format("'pages/' || " + _SAFE.format('u.title'))} AS other FROM u LEFT JOIN r ON r.src = u.title LEFT JOIN i a ON a.key = r.tgt LEFT JOIN i b ON b.key = u.title),
w AS (SELECT pageid, string_agg(CASE WHEN title = '' THEN tag WHEN url IS NOT NULL THEN regexp_replace(tag, 'href="[^"]*"', 'href="../' || url || '.html"')
        ELSE regexp_replace(regexp_replace(tag, 'href="[^"]*"', 'href="../' || other || '.html"'), '>$', ' class="new">') END || behind, '' ORDER BY pos) AS tail FROM v GROUP BY pageid),
b AS (SELECT pageid, texts[1] || coalesce(tail, '') AS body FROM s LEFT JOIN w USING (pageid)),
g AS (SELECT pageid, regexp_replace(body, '<img src="/img/([012])\.png">', '<img src="../assets/\1.png">', 'g') AS body FROM b),
m AS (SELECT p.pageid, p.title, p.raw, string_agg(CASE WHEN k.url IS NULL THEN '<li><span class="new">' || {_ESCAPED.format("replace(x.name, '_', ' ')")} || '</span></li>' ELSE '<li><a href="../' || k.url || '.html">' || {_ESCAPED.format("replace(x.name, '_', ' ')")} || '</a></li>' END, '' ORDER BY x.at) AS cats
  FROM p LEFT JOIN (SELECT pageid, 0 AS at, lang AS name FROM p UNION ALL SELECT pageid, 1, first FROM p) x ON x.pageid = p.pageid AND x.name <> '' LEFT JOIN i k ON k.key = replace(x.name, '_', ' ') GROUP BY ALL),
d AS (SELECT pageid, title, cats, {_SAFE.format('title')} AS safe, {_ESCAPED.format('title')} AS shown,
  replace(left(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(raw, 'href="/', 'href="/wiki/'), '</article>', '<img src="/img/' || pageid % 5 || '.png"></article>'), '<[^>]+>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '\s+', ' ', 'g')), 160), '"', '''') AS about FROM m)
SELECT pageid, 'pages/' || safe || '.html' AS path,
  '<!doctype html><html lang="zh"><head><meta charset="utf-8"><title>' || shown || '</title><meta name="description" content="' || about || '"></head><body class="mediawiki ltr sitedir-ltr mw-hide-empty-elt ns-0 ns-subject action-view skin--responsive page-'
  || safe || ' rootpage-' || safe || '"><nav class="breadcrumb"><a href="../index.html">首页</a> › <span>条目</span> › <span class="current">' || shown || '</span></nav><main><div class="mw-parser-output">'
  || regexp_replace(body, '<img src', '<img loading="lazy" src', 'g') || '</div>' || CASE WHEN cats IS NULL THEN '' ELSE '<div class="page-categories"><ul>' || cats || '</ul></div>' END || '</main></body></html>' AS content
FROM d JOIN g USING (pageid)""")
def rendered_site(spark, sf_dir):
    """REN-01, REN-02, JOI-01, JOI-02, JOI-04: all pages through the renderer. Names that two pages link to are pages; a name with a
    capital redirects to the one without."""
    pages = pages_as_wiki(spark, sf_dir)
    names = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    index = names.where("n > 1").select(F.col("name").alias("key"), F.lit("pages").alias("dir"), T.safe_title(F.col("name")).alias("fn"))
    redirects = names.where(F.col("name").rlike("^[A-Z]")).select(F.col("name").alias("src"), F.lower("name").alias("tgt"))
    number = (F.col("pageid") % 5).cast("string")
    manifest = pages.select(number.alias("k")).distinct().where("k < '3'").select(F.concat(F.lit("/img/"), "k", F.lit(".png")).alias("url"), F.concat(F.lit("assets/"), "k", F.lit(".png")).alias("path"))
    return render.rendered(pages, redirects, index, manifest)

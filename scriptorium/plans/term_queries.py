"""Queries over fetching, continued listings, written files, mined terms and records, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import glossary as G
from ..operators import site, snapshots
from ..sources import fetch, readers, sinks
from ..sources.shared import new_path
from .queries import query, table


def _answer(key: str) -> str:
    """A stand-in for a server: by the key's last digit it throttles, refuses, fails or answers."""
    last = key[-1]
    if last == "1":
        raise fetch.Throttled(0)
    if last == "2":
        raise fetch.Refused("no such page")
    if last == "3":
        raise OSError("x" * 600)
    return f"page {key}"


@query("""SELECT c_custkey::VARCHAR AS key, CASE c_custkey % 10 WHEN 1 THEN 'throttle' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' ELSE 'ok' END AS status,
CASE WHEN c_custkey % 10 IN (1, 2, 3) THEN NULL ELSE 'page ' || c_custkey END AS answer, CASE c_custkey % 10 WHEN 1 THEN 'throttled' WHEN 2 THEN 'no such page' WHEN 3 THEN repeat('x', 500) END AS error FROM customer""")
def fetched_pages(spark, sf_dir):
    """SRC-09, SRC-10, SRC-11, SRC-22, SRC-36"""
    return fetch.fetch(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), _answer, workers=8, sleep=lambda s: None)


@query("""SELECT 'C' || c_custkey AS src, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey WHEN c_custkey % 5 = 0 THEN 'made ' || c_custkey ELSE '' END AS tgt FROM customer
UNION ALL SELECT 'c_' || c_custkey, 'made ' || c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0""")
def resolved_redirects(spark, sf_dir):
    """SRC-15, SRC-16: answers fill the edges in, under the title that was asked for too."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    src = F.concat(F.lit("C"), k)
    edges = c.select(src.alias("src"), F.lit("").alias("tgt"))
    other = (k % 5 == 0) & (k % 3 != 0)
    answers = c.where((k % 3 == 0) | other).select(src.alias("src"), F.when(k % 3 == 0, F.concat(F.lit("new "), k)).otherwise(F.concat(F.lit("made "), k)).alias("tgt"))
    normalised = c.where(other).select(F.concat(F.lit("c_"), k).alias("from"), src.alias("to"))
    return fetch.resolved_edges(edges, normalised, answers)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 6")
def content_namespaces(spark, sf_dir):
    """SRC-18"""
    return fetch.namespaces(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("SELECT c_name AS category, CASE WHEN c_custkey % 3 = 0 THEN [replace(c_mktsegment, '_', ' '), 'a b'] WHEN c_custkey % 3 = 1 THEN [] END AS members FROM customer")
def cached_members(spark, sf_dir):
    """SRC-19, SRC-37: null for what was never fetched."""
    c = table(spark, sf_dir, "customer")
    members = F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment", F.lit(" a_b "))).otherwise(F.array().cast("array<string>"))
    return fetch.cached_members(c.select(F.col("c_name").alias("category")), c.where("c_custkey % 3 < 2").select(F.col("c_name").alias("category"), members.alias("members")))


@query("SELECT p_partkey, [p_name, p_type] AS titles FROM part")
def listed_titles(spark, sf_dir):
    """SRC-34"""
    rows = F.concat(*(x for c in ("p_name", "p_type", "p_name") for x in (F.lit('<tr class="r"><td><a href="x">'), F.col(c), F.lit("</a></td><td>2</td></tr>"))))
    return table(spark, sf_dir, "part").select("p_partkey", fetch.listed_titles(rows).alias("titles"))


@query("SELECT p_partkey, ['a/' || p_size || '.png', '../b.svg'] AS urls FROM part")
def style_urls(spark, sf_dir):
    """SRC-31"""
    a = F.concat(F.lit("a{background:url('a/"), "p_size", F.lit(".png')}"))
    return table(spark, sf_dir, "part").select("p_partkey", readers.css_urls(F.concat(a, F.lit('b{background:url( "../b.svg" )}'), a)).alias("urls"))


@query("SELECT n_nationkey AS pageid, n_regionkey::INT AS ns, n_name AS title, '2024' AS ts, 'edit' AS type FROM nation")
def continued_listing(spark, sf_dir):
    """SRC-08, SRC-17: a chain of answers for each region, each naming the next, read in parallel."""
    n = table(spark, sf_dir, "nation")
    row = F.struct(F.col("n_nationkey").alias("pageid"), F.col("n_regionkey").alias("ns"), F.col("n_name").alias("title"), F.lit("2024").alias("ts"), F.lit("edit").alias("type"))
    place = F.col("n_nationkey") / 5  # nations of a region are five apart
    name = lambda at: F.concat(F.lit("r"), "n_regionkey", F.lit("_"), at.cast("int"))
    following = F.when(F.col("n_nationkey") < 20, name(F.floor(place) + 1))
    answers = n.select(F.concat(name(F.floor(place)), F.lit(".json")).alias("path"), F.to_json(F.struct(F.array(row).alias("rows"), following.alias("continue"))).alias("content"))
    root = new_path(spark, "answers")
    sinks.files(answers, root)
    spark.dataSource.register(readers.ContinuedSource)
    return spark.read.format("continued").option("path", root).option("start", ",".join(f"r{i}_0" for i in range(5))).load()


@query("SELECT 'pages/' || page_id || '.html' AS name, html FROM pages WHERE html IS NOT NULL")
def written_files(spark, sf_dir):
    """SNK-09: one file a page in the shared folder, read back whole."""
    root = new_path(spark, "site")
    sinks.files(table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content")), root)
    read = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return read.select(F.substring_index(F.input_file_name(), "/", -2).alias("name"), F.col("value").alias("html"))


@query("SELECT c_name AS en, [c_mktsegment] AS value, c_custkey AS pos FROM customer")
def written_glossary(spark, sf_dir):
    """SNK-11, SNK-12: a new folder for each writing, so the one before stays."""
    path = new_path(spark, "terms")
    sinks.glossary(table(spark, sf_dir, "customer").select(F.col("c_name").alias("en"), F.array("c_mktsegment").alias("value"), F.col("c_custkey").alias("pos")), path)
    return spark.read.schema("en string, value array<string>, pos long").json(f"{path}/json")


@query("""SELECT c_custkey AS pageid, unnest(['A_title_field', 'B_triple_bold', 'D_paren_ZHopenEN', 'D_paren_ENopenZH', 'E_infobox_field', 'F_lang_template']) AS tag, c_mktsegment AS en,
unnest(['火球术', '治疗术', '飞行术', '隐形术', '闪电术', '睡眠术']) AS zh FROM customer""")
def mined_pairs(spark, sf_dir):
    """EXT-01 to EXT-07, FLT-14, FLT-15, STR-16, STR-17: each form of a pair once in every page; bold tags go first."""
    en = F.col("c_mktsegment")
    text = F.concat(
        F.lit("| title = 火球术 "), en, F.lit("\n'''治疗术 "), en, F.lit("'''\n<b>护盾术 "), en, F.lit("</b>\n。飞行术（"), en, F.lit("）。\n"), en, F.lit("（隐形术）。\n| 中文名 = 闪电术\n| 英文名 = "), en,
        F.lit("\n。睡眠术 {{lang|en|"), en, F.lit("}}\n"),
    )
    return G.extract_pairs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pageid"), F.lit("题").alias("title"), text.alias("wikitext"))).select("pageid", "tag", "en", "zh")


_STATS = """s AS (SELECT p_name AS en, p_type AS zh, count(*) AS c, min(p_partkey) AS first, list_sort(list(DISTINCT p_brand)) AS sources FROM part GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY en ORDER BY c DESC, first) AS place FROM s)"""


def _stats(spark, sf_dir):
    return G.term_stats(table(spark, sf_dir, "part").select(F.col("p_name").alias("en"), F.col("p_type").alias("zh"), F.col("p_brand").alias("tag"), F.col("p_partkey").alias("pos")))


@query(f"WITH {_STATS} SELECT en, zh, c::BIGINT AS count, sources FROM b WHERE place = 1 AND (c >= 2 OR len(sources) >= 2)")
def confident_terms(spark, sf_dir):
    """FLT-16, AGG-05, AGG-06"""
    return G.confident(_stats(spark, sf_dir)).select("en", "zh", "count", "sources")


@query(f"WITH {_STATS} SELECT en, zh FROM b WHERE place = 1 AND (c >= 2 OR len(sources) >= 2) AND len(zh) <= 8 AND en NOT LIKE 'r%'")
def supplement_terms(spark, sf_dir):
    """GLO-17, FLT-17, SET-07"""
    known = table(spark, sf_dir, "part").where("p_name LIKE 'r%'").select(F.upper("p_name").alias("en"))
    return G.supplement(_stats(spark, sf_dir), known).select("en", "zh")


@query(f"WITH {_STATS} SELECT en, c::BIGINT AS count, (row_number() OVER (ORDER BY c DESC, en))::INT AS rank FROM b WHERE place = 1")
def ranked_terms(spark, sf_dir):
    """SRT-07"""
    return G.ranked_terms(_stats(spark, sf_dir)).select("en", "count", "rank")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 5) AS good FROM part")
def plausible_pairs(spark, sf_dir):
    """FLT-14, FLT-15, FLT-21"""
    k = F.col("p_partkey") % 6
    en = F.when(k == 1, "B2").when(k == 2, "ABC 12").when(k == 5, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name"))
    zh = F.when(k == 3, "的火球术").when(k == 4, "火球术[一]").otherwise("火球术")
    return table(spark, sf_dir, "part").select("p_partkey", G.plausible(en, zh).alias("good"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '火球术' WHEN 1 THEN '如果火' ELSE '火球如果' END AS zh FROM part")
def trimmed_terms(spark, sf_dir):
    """STR-18"""
    k = F.col("p_partkey") % 3
    zh = F.when(k == 0, "如果火球术").when(k == 1, "如果火").otherwise("火球如果")
    return table(spark, sf_dir, "part").select("p_partkey", G.trimmed(zh).alias("zh"))


@query("SELECT p_partkey, p_name AS en FROM part")
def cleaned_keys(spark, sf_dir):
    """STR-30"""
    return table(spark, sf_dir, "part").select("p_partkey", G.clean_key(F.concat(F.lit("12. "), F.lit("[["), F.lit("– "), F.col("p_name"), F.lit("]] "))).alias("en"))


@query("SELECT p_name AS en, list_sort(list(DISTINCT p_type)) AS checks FROM part GROUP BY p_name")
def flagged_terms(spark, sf_dir):
    """AGG-20"""
    return G.flagged(table(spark, sf_dir, "part").select(F.col("p_name").alias("en"), F.col("p_type").alias("check")))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), '\{\{\{[^{}]*\}\}\}', '', 'g') AS html FROM pages""")
def cleaned_pages(spark, sf_dir):
    """STR-09: comments and placeholders go, edit links too."""
    edit = F.lit('<span class="mw-editsection">[<a href="e">edit</a>]</span>')
    return table(spark, sf_dir, "pages").select("page_id", T.cleaned_parse(F.concat(edit, "html", F.lit("<!-- x\n --> {{{1|}}}"))).alias("html")).withColumn("html", F.substring("html", F.lit(1), F.length("html") - 1))


@query("SELECT p_partkey, p_name AS name, p_type || '2' AS kind FROM part")
def data_records(spark, sf_dir):
    """STR-12: of a field that repeats, the last value."""
    cell = lambda k, v: F.concat(F.lit(f'<tr><th>{k}</th><td class="mw-jsonconfig-value">&quot;<b>'), v, F.lit("</b>&quot;</td></tr>"))
    record = H.data_record(F.concat(cell("name", F.col("p_name")), cell("kind", F.col("p_type")), cell("kind", F.concat("p_type", F.lit("2")))))
    return table(spark, sf_dir, "part").select("p_partkey", record["name"].alias("name"), record["kind"].alias("kind"))


@query("SELECT p_partkey, (p_name || ' and more ' || repeat('x', 300))[1:220] AS summary FROM part")
def tooltip_summaries(spark, sf_dir):
    """STR-22"""
    html = F.concat(F.lit("<p><i>"), "p_name", F.lit("</i></p><p> </p>\n<p class='a'>and  more</p><p>"), F.repeat(F.lit("x"), 300), F.lit("</p>"))
    return table(spark, sf_dir, "part").select("p_partkey", H.summary(html).alias("summary"))


@query("SELECT p_partkey, CASE WHEN p_size >= 10 THEN ['One', p_name, 'Three'] END AS lines FROM part")
def page_contents(spark, sf_dir):
    """PRJ-25: long texts only; deep levels and empty lines are left out."""
    one = lambda level, line, anchor: F.struct(F.lit(level).alias("level"), line.alias("line"), F.lit(anchor).alias("anchor"))
    sections = F.array(one("1", F.lit("<b>One</b>"), "a"), one("2", F.col("p_name"), "b"), one("4", F.lit("deep"), "c"), one("2", F.lit(" "), "d"), one("3", F.lit("Three"), "e"), one("x", F.lit("Four"), "f"))
    rows = site.contents(sections, F.col("p_size") * 150)
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(rows, lambda s: s["line"]).alias("lines"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' a' ELSE '' END AS asked FROM customer")
def missing_searches(spark, sf_dir):
    """PRJ-20"""
    k = F.col("c_custkey") % 3
    name = F.replace("c_name", F.lit("#"), F.lit("%23"))
    url = F.when(k == 0, F.concat(F.lit("http://h/site/pages/"), name, F.lit(".html"))).when(k == 1, F.concat(F.lit("http://h/404.html?missing="), name, F.lit("%20a"))).otherwise("http://h/404.html")
    return table(spark, sf_dir, "customer").select("c_custkey", site.missing_query(url).alias("asked"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pages/' || c_mktsegment || '.html' WHEN 1 THEN 'data/' || c_mktsegment || '.html' ELSE 'category/index.html' END AS path FROM customer")
def site_paths(spark, sf_dir):
    """PRJ-21"""
    k = F.col("c_custkey") % 3
    url = F.when(k == 0, F.concat(F.lit("http://h/x/site/pages/"), "c_mktsegment", F.lit(".html?a=1#b"))).when(k == 1, F.concat(F.lit("http://h/other/data/"), "c_mktsegment", F.lit(".html"))).otherwise("http://h/site/category/")
    return table(spark, sf_dir, "customer").select("c_custkey", site.site_path(url).alias("path"))

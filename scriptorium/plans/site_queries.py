"""Queries over page, browse, search and state operators, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, graph, search, site, snapshots, tables
from ..sources import sinks
from ..sources.shared import new_path
from ..streaming import flows
from .queries import ITEMS_SQL, documents_as_pages, query, table


def safe_sql(x: str) -> str:
    return f"""regexp_replace(replace(replace(replace({x}, ':', '_'), '/', '__'), '\\', '_'), '[*?"<>|]', '', 'g')"""


def escaped_sql(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')"""


NS_SQL = "[0, 4, 14, 102, 3500, 7][page_id % 6 + 1]"
LABEL_SQL = "['条目', '项目', '分类', '属性', '数据', '条目'][page_id % 6 + 1]"


def _numbered_pages(spark, sf_dir):
    ns = F.element_at(F.array(*map(F.lit, [0, 4, 14, 102, 3500, 7])), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("ns", ns)


@query(f"""SELECT page_id, {LABEL_SQL} AS label, 'mediawiki ltr sitedir-ltr mw-hide-empty-elt ns-' || {NS_SQL} || ' ns-subject action-view skin--responsive page-' || {safe_sql('url')} || ' rootpage-' || {safe_sql('url')} AS body_class,
'<nav class="breadcrumb"><a href="../index.html">首页</a> › <span>' || {LABEL_SQL} || '</span> › <span class="current">' || {escaped_sql('url')} || '</span></nav>' AS breadcrumb FROM pages""")
def page_frames(spark, sf_dir):
    """PRJ-06, PRJ-14, PRJ-26"""
    p = _numbered_pages(spark, sf_dir)
    ns, url = F.col("ns"), F.col("url")
    return p.select("page_id", site.label(ns).alias("label"), site.body_class(ns, url).alias("body_class"), site.breadcrumb(ns, url).alias("breadcrumb"))


@query(f"SELECT page_id, CASE {NS_SQL} WHEN 3500 THEN 'd' WHEN 14 THEN 'c' ELSE 'p' END AS kind FROM pages")
def page_kinds(spark, sf_dir):
    """PRJ-07"""
    return _numbered_pages(spark, sf_dir).select("page_id", search.kind(F.col("ns")).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'S' WHEN 'STANDARD' THEN 'C' ELSE CASE WHEN p_size < 10 THEN 'U' ELSE 'O' END END
  ELSE CASE WHEN p_size < 10 THEN 'U' WHEN p_partkey % 3 = 0 THEN 'L' ELSE 'O' END END AS type FROM part""")
def page_types(spark, sf_dir):
    """PRJ-10: a data title's prefix decides before the stub flag and the categories."""
    kind = F.when(F.col("p_type") == "ECONOMY", "Spells").when(F.col("p_type") == "STANDARD", "Creatures").otherwise("Unknown")
    title = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Data:"), kind, F.lit("-"), "p_name")).otherwise(F.col("p_name"))
    cats = F.when((F.col("p_partkey") % 4 != 0) & (F.col("p_partkey") % 3 == 0), F.array(F.lit("职业"))).otherwise(F.array(F.lit("无")))
    return table(spark, sf_dir, "part").select("p_partkey", search.type_code(title, cats, F.col("p_size") < 10).alias("type"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS name FROM customer")
def english_names(spark, sf_dir):
    """PRJ-11: only of pages whose text starts with their title."""
    title = F.concat(F.lit("第"), F.col("c_custkey").cast("string"))
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(title, F.lit(" "), "c_mktsegment", F.lit(" 是"))).otherwise(F.concat(F.lit("见"), title))
    return table(spark, sf_dir, "customer").select("c_custkey", search.english_name(title, body, F.lit("p")).alias("name"))


@query(f"WITH {ITEMS_SQL} SELECT id, title, indexed AS text FROM items")
def indexed_texts(spark, sf_dir):
    """PRJ-12, WIN-08: a stub's title alone, else the title and the start of its text."""
    return search.entries(documents_as_pages(spark, sf_dir)).select("id", "title", "text")


@query(f"""WITH {ITEMS_SQL} SELECT (SELECT count(*) FROM items)::BIGINT AS entries, 0::BIGINT AS linked, 0::BIGINT AS most_linked, 0::BIGINT AS bigrams,
count(*)::BIGINT AS words, count(DISTINCT CASE WHEN token[1] BETWEEN 'a' AND 'z' THEN token[1] ELSE '_' END)::BIGINT AS buckets FROM posts""")
def index_manifest(spark, sf_dir):
    """SNK-04 to SNK-08, SRC-23, SRC-24, UDF-05: an index written, read back and counted."""
    path = new_path(spark, "index")
    search.Engine.build(documents_as_pages(spark, sf_dir)).write(path)
    read = search.Engine.read(spark, path)
    return search.manifest(read.items, read.rows)


_TIER = """CASE WHEN title = 'red ring' THEN 1000 WHEN starts_with(title, 'red ring') THEN 500 WHEN regexp_matches(title, '(^|[^a-z0-9])red ring') THEN 200 ELSE 0 END
 + CASE WHEN name = 'red ring' THEN 900 WHEN starts_with(name, 'red ring') THEN 450 ELSE 0 END"""
_RANKED = f"""r AS (SELECT id, title, pop, kind, type, CASE WHEN tier >= 200 THEN tier - least(50, len(title)) ELSE tier + least(20, floor(log2(1 + pop) * 3 + 0.5)) END
 + CASE kind WHEN 'p' THEN 5 WHEN 'd' THEN -250 ELSE 0 END AS score FROM (SELECT *, {_TIER} AS tier FROM (SELECT p_partkey AS id,
 CASE WHEN p_partkey % 7 = 0 THEN 'the ' || p_name ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'red rings' ELSE '' END AS name,
 ['p', 'c', 'd'][p_partkey % 3 + 1] AS kind, ['F', 'S', 'C', 'O'][p_partkey % 4 + 1] AS type, p_size::BIGINT AS pop FROM part)))"""


def _ranked(spark, sf_dir):
    k = F.col("p_partkey")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    items = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 7 == 0, F.concat(F.lit("the "), "p_name")).otherwise(F.col("p_name")).alias("title"), at(["red ring", "red rings", ""]).alias("name"), F.lit("").alias("href"),
        F.lit("").alias("excerpt"), at("pcd").alias("kind"), at("FSCO").alias("type"), F.col("p_size").cast("long").alias("pop"),
    )
    return search.rank(items, "Red Ring ")


@query(f"WITH {_RANKED} SELECT id, score::INT AS score FROM r")
def scored_entries(spark, sf_dir):
    """RNK-02, RNK-03, RNK-04, PRJ-18: tiers of the title and the English name, popularity, and kind."""
    return _ranked(spark, sf_dir).select("id", "score")


@query(f"WITH {_RANKED} SELECT id, score::INT AS score FROM (SELECT * FROM r ORDER BY score DESC, pop DESC, id LIMIT 1) WHERE score >= 900")
def best_entry(spark, sf_dir):
    """RNK-08"""
    return search.best_match(_ranked(spark, sf_dir)).select("id", "score")


@query(f"WITH {_RANKED} SELECT type, count(*)::BIGINT AS n FROM r GROUP BY type")
def entries_by_type(spark, sf_dir):
    """AGG-08"""
    return search.by_type(_ranked(spark, sf_dir)).select("type", "n")


@query("""WITH n AS (SELECT max(c_custkey) + 1 AS start FROM customer)
SELECT c_custkey AS id, c_name AS title, c_mktsegment AS type, '' AS excerpt FROM customer
UNION ALL SELECT start + row_number() OVER (ORDER BY s_name) - 1, s_name, c_mktsegment, '重定向 → ' || c_name FROM supplier JOIN customer ON c_custkey = s_suppkey, n""")
def entries_with_aliases(spark, sf_dir):
    """JOI-10, RNK-10"""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    items = c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("title"), F.lit("p").alias("kind"), F.col("c_mktsegment").alias("type"), F.lit("").alias("href"), F.lit("").alias("excerpt"), none.alias("name"), F.lit("").alias("text"), F.lit(0).cast("long").alias("pop"))
    targets = table(spark, sf_dir, "supplier").join(c, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_name").alias("alias"), F.col("c_name").alias("target"))
    same = c.select(F.col("c_name").alias("alias"), F.col("c_name").alias("target"))  # titles themselves are no aliases
    return search.with_aliases(items, targets.unionByName(same)).select("id", "title", "type", "excerpt")


@query("""SELECT p_brand AS table_id, max(p_size % 2 + 1) < 2 AND min(p_size % 3) = max(p_size % 3) AND NOT bool_or(p_size % 3 = p_partkey % 5) AS safe FROM part GROUP BY p_brand""")
def tables_safe_to_sort(spark, sf_dir):
    """FLT-25"""
    size = F.col("p_size")
    return tables.sort_safe(table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), (size % 3).alias("n_cells"), (F.col("p_partkey") % 5).alias("n_header"), (size % 2 + 1).alias("max_rowspan")))


@query("""WITH c AS (SELECT p_brand AS table_id, p_partkey AS row, p_size AS n_th, p_size % 3 AS n_td FROM part), h AS (SELECT table_id, min(row) AS h FROM c WHERE n_td = 0 GROUP BY ALL)
SELECT table_id, row, n_th, n_td, coalesce(row = h, false) AS is_header FROM c LEFT JOIN h USING (table_id) WHERE n_td > 0 OR row = h""")
def table_headers(spark, sf_dir):
    """FLT-28"""
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row"), F.col("p_size").alias("n_th"), (F.col("p_size") % 3).alias("n_td"))
    return site.table_rows(cells)


@query("SELECT p_partkey, p_size FROM part ORDER BY CASE WHEN p_size % 5 = 0 THEN 999 ELSE p_size END DESC, p_partkey LIMIT 50 OFFSET 50")
def typed_page(spark, sf_dir):
    """SRT-03, SRT-04, WIN-06: the second page in descending order, blanks first."""
    cell = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("")
    rows = table(spark, sf_dir, "part").withColumn("cell", cell)
    order = [F.coalesce(tables.number(F.col("cell")), F.lit(float("inf"))).desc(), F.col("p_partkey").asc()]
    return tables.page(tables.typed_sort(rows, "cell", "p_partkey", numeric=True, descending=True), order, 2, 50).select("p_partkey", "p_size")


@query("SELECT c_custkey, regexp_matches(c_name, '#0+[0-9]*5$') AS edit FROM customer")
def edit_links(spark, sf_dir):
    """FLT-23"""
    href = F.concat(F.lit("index.php?title="), "c_name", F.when(F.col("c_name").endswith("5"), "&action=edit").otherwise("&action=editor"))
    return table(spark, sf_dir, "customer").select("c_custkey", site.is_edit_link(href).alias("edit"))


@query("SELECT c_custkey, c_nationkey IN (3, 7) AS skipped FROM customer")
def skipped_titles(spark, sf_dir):
    """FLT-01"""
    prefix = F.when(F.col("c_nationkey") == 3, "Template:").when(F.col("c_nationkey") == 7, "文件:").otherwise("Templates:")
    return table(spark, sf_dir, "customer").select("c_custkey", T.skipped(F.concat(prefix, "c_name")).alias("skipped"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS parent FROM customer")
def pointer_parents(spark, sf_dir):
    """FLT-02, FLT-03"""
    lead = F.when(F.col("c_custkey") % 2 == 0, "本页面是存放物品数据的子页面， 如果您是通过搜索栏进入本页的,请点击主页面：<b><a href=\"x\">").otherwise("本页面是")
    return table(spark, sf_dir, "customer").select("c_custkey", site.pointer_parent(F.concat(lead, "c_name", F.lit("</a></b>"))).alias("parent"))


@query("SELECT 'https://example.org/r/download/' || n_name || '/full-' || n_name || '.zip' AS url FROM nation")
def release_urls(spark, sf_dir):
    """PRJ-24"""
    return table(spark, sf_dir, "nation").select(site.release_url("https://example.org/r/", F.col("n_name")).alias("url"))


@query("SELECT p_partkey, p_name || ' · ' || p_type AS tip FROM part")
def tooltips(spark, sf_dir):
    """STR-23"""
    return table(spark, sf_dir, "part").select("p_partkey", site.tooltip(F.concat_ws("|", "p_name", F.lit(" "), "p_type", F.lit(""))).alias("tip"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def compact_rows(spark, sf_dir):
    """FUN-07"""
    return site.compact_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT c_custkey, 'pages/' || c_name AS href FROM customer WHERE c_custkey % 3 = 0")
def random_pages(spark, sf_dir):
    """FLT-26"""
    folder = F.when(F.col("c_custkey") % 3 == 0, "pages/").otherwise("data/")
    return site.random_pool(table(spark, sf_dir, "customer").select("c_custkey", F.concat(folder, "c_name").alias("href")))


@query("SELECT round(avg(value), 1) AS mean_ms, round(1.0 / greatest(avg(value) / 1000, 0.5), 2) AS rate FROM events")
def request_rate(spark, sf_dir):
    """AGG-22"""
    return site.latency(table(spark, sf_dir, "events"), "value")


@query("SELECT DISTINCT p_name AS title FROM part")
def image_titles(spark, sf_dir):
    """SET-10"""
    return site.image_titles(table(spark, sf_dir, "part").select(F.array("p_name", F.lit("")).alias("images")))


@query("""SELECT 'a/' || c_name || '.html' AS path, '<!doctype html><meta charset="utf-8"><meta http-equiv="refresh" content="0; url=../pages/' || c_custkey || '.html"><title>' || c_name || '</title><p><a href="../pages/' || c_custkey || '.html">' || c_name || '</a></p>' AS content FROM customer""")
def redirect_stub_pages(spark, sf_dir):
    """SNK-10"""
    c = table(spark, sf_dir, "customer")
    return sinks.redirect_stubs(c.select(F.concat(F.lit("a/"), "c_name", F.lit(".html")).alias("path"), F.concat(F.lit("../pages/"), "c_custkey", F.lit(".html")).alias("target_url"), F.col("c_name").alias("title")))


@query("SELECT p_partkey, '<tr><td>' || p_name || '</td><td>' || p_size || '</td></tr>' AS html FROM part")
def browse_rows(spark, sf_dir):
    """REN-04, REN-06"""
    p = table(spark, sf_dir, "part").withColumn("title", F.concat("p_name", F.lit("\t"), "p_partkey"))
    return site.browse_page(p, ["p_name", "p_size"]).select(F.substring_index("title", "\t", -1).cast("long").alias("p_partkey"), "html")


@query("""SELECT 'pages/' || n_name || '.html' AS target, CASE WHEN n_nationkey % 4 = 0 THEN 'https://example.org/' || n_name ELSE '../search.html?q=' || n_name END AS url, CASE WHEN n_nationkey % 4 = 0 THEN 'rule' ELSE n_name END AS label FROM nation""")
def dead_stub_pages(spark, sf_dir):
    """REN-08, SNK-18"""
    n = table(spark, sf_dir, "nation").withColumn("target", F.concat(F.lit("pages/"), "n_name", F.lit(".html")))
    rules = n.where("n_nationkey % 4 = 0").select("target", F.concat(F.lit("https://example.org/"), "n_name").alias("url"), F.lit("rule").alias("label"))
    return site.dead_stubs(n.select("target"), rules)


@query("""SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_nationkey = 3 THEN 'redirect' WHEN c_nationkey * 60 > c_custkey THEN 'list' ELSE 'article' END AS state FROM customer""")
def nav_states(spark, sf_dir):
    """JOI-25, JOI-26"""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("size"), (F.col("c_nationkey") == 3).alias("is_redirect"), F.col("c_nationkey").alias("n_links"))
    return site.nav_audit(c.select("path"), c.where("size % 5 <> 0"))


@query(f"SELECT {safe_sql('url')} AS fn, CASE WHEN page_id % 2 = 0 THEN url END AS title FROM pages WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY url)")
def dead_names(spark, sf_dir):
    """JOI-22"""
    p = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return site.dead_reasons(p.select(T.safe_title(F.col("url")).alias("fn")), p.where("page_id % 2 = 0").select(F.col("url").alias("title")))


@query("""SELECT c_mktsegment AS category, upper(c_mktsegment[1]) AS letter, count(*)::BIGINT AS n, string_agg(c_name || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'own/' || c_custkey ELSE 'pages/' || c_name END, ';' ORDER BY c_name) AS members
FROM customer GROUP BY ALL""")
def member_lists(spark, sf_dir):
    """AGG-26, JOI-06, PRJ-16: members without a page of their own get one made of their title."""
    c = table(spark, sf_dir, "customer")
    members = c.select(F.col("c_mktsegment").alias("category"), F.concat("c_mktsegment", "c_name").alias("sortkey"), F.col("c_name").alias("title"))
    index = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.lit("own").alias("dir"), F.col("c_custkey").cast("string").alias("fn"))
    out = browse.member_listing(members, index)
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(" ", m["title"], m["path"])), ";"))


_ZONES = """z AS (SELECT DISTINCT CASE WHEN p_size <= 3 THEN 'creatures-level-0-3' WHEN p_size <= 7 THEN 'creatures-level-4-7' WHEN p_size <= 12 THEN 'creatures-level-8-12' WHEN p_size <= 17 THEN 'creatures-level-13-17' ELSE 'creatures-level-18-25' END AS zone,
p_name AS name, p_partkey AS pageid FROM part WHERE p_partkey % 7 = 0 AND p_name LIKE 'r%')"""


def _zones(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    records = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("pageid"), F.lit("Creatures").alias("kind"), F.col("p_name").alias("name"), F.create_map(F.lit("等级"), F.col("p_size").cast("string")).alias("fields"))
    listed = p.where("p_name LIKE 'r%'").select(F.lit("creatures").alias("bucket"), F.col("p_name").alias("title"), F.col("p_partkey").alias("pageid"))
    return browse.zone_members(records, listed), listed


@query(f"WITH {_ZONES} SELECT zone, name, min(pageid) AS pageid FROM z GROUP BY ALL")
def zone_lists(spark, sf_dir):
    """JOI-08, WIN-05, REN-07"""
    return _zones(spark, sf_dir)[0]


@query(f"WITH {_ZONES} SELECT 'creatures' AS bucket, count(DISTINCT p_name)::BIGINT AS total, count(DISTINCT z.name)::BIGINT AS covered FROM part LEFT JOIN z ON z.name = p_name WHERE p_name LIKE 'r%'")
def zone_coverage(spark, sf_dir):
    """AGG-17"""
    return browse.coverage(*_zones(spark, sf_dir))


@query(r"SELECT page_id, 'class ' || page_id % 10 AS title, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))[1:80] AS excerpt, ['a', 'b', 'c', 'd', page_id::VARCHAR] AS categories FROM pages WHERE page_id % 10 IN (1, 3)")
def class_hub_rows(spark, sf_dir):
    """FLT-13, PRJ-27"""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("class "), k % 10).alias("title"), F.col("html").alias("text"), F.array(*map(F.lit, "abcd"), k.cast("string"), F.lit("f")).alias("categories"))
    return browse.class_hub(pages, ["class 1", "class 3", "class 12"]).withColumn("page_id", F.element_at("categories", 5).cast("long"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ['feats'] WHEN 'MACHINERY' THEN ['spells', 'creatures'] ELSE [] END AS buckets FROM customer")
def keyword_buckets(spark, sf_dir):
    """STR-31"""
    cats = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("通用专长"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("法术"), F.lit("Monsters"))).otherwise(F.array(F.lit("无")))
    return table(spark, sf_dir, "customer").select("c_custkey", browse.keyword_buckets(cats, F.lit("题")).alias("buckets"))


@query("""SELECT o_custkey, max_by(o_orderkey, o_totalprice * 100000000 + o_orderkey) AS o_orderkey FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1) GROUP BY o_custkey""")
def upserted_orders(spark, sf_dir):
    """SNK-14, SNK-19, STM-03: the last row of each key of the table and of its changes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") * 100000000 + F.col("o_orderkey")).alias("at"))
    return snapshots.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("SELECT c_name AS stem FROM customer WHERE c_custkey % 4 <> 0")
def orphaned_files(spark, sf_dir):
    """SNK-17, SNK-21"""
    c = table(spark, sf_dir, "customer")
    return snapshots.orphans(c.select(F.col("c_name").alias("stem")), c.where("c_custkey % 4 = 0").select(F.upper("c_name").alias("stem")), failures=0)


@query("SELECT c_custkey, md5(c_name) AS digest FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unfinished_pages(spark, sf_dir):
    """SNK-03, SNK-20: what a run that wrote the orders' customers still has to do."""
    path = new_path(spark, "done")
    table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().write.parquet(path)
    return sinks.remaining(table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("digest")), spark.read.parquet(path), "c_custkey")


@query("SELECT page_id AS pageid, html[1:500] AS error FROM pages WHERE page_id % 2 = 0")
def failure_log(spark, sf_dir):
    """SNK-02: errors are cut to 500 characters by the log's rule."""
    path = new_path(spark, "failures")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pageid"), F.col("html").alias("error"), F.when(F.col("page_id") % 2 == 0, "http 500").otherwise("ok").alias("status"))
    sinks.failures(rows, path)
    return spark.read.schema("pageid long, error string").json(path)


@query("SELECT page_id AS pageid, html, sha1(page_id::VARCHAR)[1:2] AS shard FROM pages")
def sharded_pages(spark, sf_dir):
    """SNK-01"""
    path = new_path(spark, "sharded")
    sinks.pages(table(spark, sf_dir, "pages").select(F.col("page_id").alias("pageid"), "html"), path)
    return spark.read.schema("pageid long, html string, shard string").parquet(path)


@query("SELECT src AS src, final FROM (SELECT 'P' || p_partkey AS src, CASE WHEN p_partkey % 6 = 0 THEN 'T' || p_size || ' (b)' WHEN p_partkey % 2 = 0 THEN 'T' || p_size END AS final FROM part) WHERE final IS NOT NULL")
def canonical_targets(spark, sf_dir):
    """GRF-03, JOI-09: the first candidate of a redirect's target that has a page."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("T"), "p_size")
    edges = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k).alias("src"), F.when(k % 6 == 0, F.concat(base, F.lit("_(b)"))).when(k % 2 == 0, F.concat(base, F.lit(" (a)"))).otherwise(F.concat(F.lit("no"), k)).alias("tgt"))
    rendered = table(spark, sf_dir, "part").select(F.explode(F.array(base, F.concat(base, F.lit(" (b)")))).alias("title")).distinct()
    return graph.canonical_target(graph.redirect_candidates(edges, ["x"]), edges, rendered)


@query("SELECT count(*) FILTER (WHERE c_custkey % 10 = 0)::BIGINT AS self_loops, count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_custkey % 3 = 0)::BIGINT AS stub_to_stub FROM customer")
def stub_pairs(spark, sf_dir):
    """GRF-07"""
    k = F.col("c_custkey")
    return graph.stub_chains(table(spark, sf_dir, "customer").select(k.cast("string").alias("src"), F.when(k % 10 == 0, k.cast("string")).when(k % 3 == 0, "0").otherwise("none").alias("tgt")))


@query("""WITH e AS (SELECT user_id AS run, event_id, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events),
r AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY run, g ORDER BY event_id) AS t FROM e),
s AS (SELECT *, max((t >= 2 OR f >= 40)::INT) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT run, event_id FROM s WHERE coalesce(b, 0) = 0""")
def stopped_runs(spark, sf_dir):
    """STM-04: a user's events as a run that two throttles in a row or 40 failures stop."""
    status = F.when(F.col("event_type") == "error", "throttle").when(F.col("event_type") == "click", "fail").otherwise("ok")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", status.alias("status"))
    return flows.breaker(rows, "event_id", throttles=2, failures=40).select("run", "event_id")


@query("""SELECT title, (count(*) FILTER (WHERE k % 4 <> 0))::BIGINT AS inlinks FROM (SELECT 'P' || l_partkey AS title, l_orderkey AS k FROM lineitem) GROUP BY title HAVING count(*) FILTER (WHERE k % 4 <> 0) > 0""")
def inlink_counts(spark, sf_dir):
    """FLT-04, GRF-05: links to pages that exist, in wanted namespaces."""
    k = F.col("l_orderkey")
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("title"), (k % 8 != 0).alias("exists"), F.when(k % 8 == 4, 6).otherwise(0).alias("ns"))
    return graph.inlinks(links)

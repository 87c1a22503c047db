"""Queries over what is written to the shared folder and read back, and over link, browse and page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, graph, site
from ..sources import readers, sinks
from ..sources.shared import new_path
from .queries import query, table


@query("SELECT page_id AS pageid, (page_id % 3)::INT AS ns, url AS title, html AS text, len(html)::INT AS n FROM pages WHERE coalesce(html, '') <> ''")
def source_parsed_pages(spark, sf_dir):
    """SRC-01, SRC-02, SRC-03"""
    p = table(spark, sf_dir, "pages")
    docs = p.select(F.col("page_id").alias("pageid"), (F.col("page_id") % 3).cast("int").alias("ns"), F.col("url").alias("title"), F.struct(F.col("html").alias("text")).alias("parse"))
    path = new_path(spark, "parsed")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    out = readers.parsed_pages(spark, path)
    return out.select("pageid", "ns", "title", F.col("parse.text").alias("text"), F.length("parse.text").alias("n"))


@query("SELECT n_nationkey::BIGINT AS pageid, n_regionkey::INT AS ns, n_name AS title, n_nationkey % 2 = 0 AS is_redirect FROM nation")
def source_metadata(spark, sf_dir):
    """SRC-04, SRC-12"""
    return readers.metadata(spark, _metadata(spark, sf_dir))[0]


@query("SELECT n_name AS src, 'to ' || n_name AS tgt FROM nation")
def source_redirects(spark, sf_dir):
    """SRC-13, SRC-35"""
    return readers.metadata(spark, _metadata(spark, sf_dir))[1]


def _metadata(spark, sf_dir):
    """The nations as one metadata document, which is one JSON object by its form."""
    n = table(spark, sf_dir, "nation")
    page = F.struct(F.col("n_nationkey").cast("long").alias("pageid"), F.col("n_regionkey").cast("int").alias("ns"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 2 == 0).alias("is_redirect"))
    edge = F.struct("n_name", F.concat(F.lit("to "), "n_name"))
    path = new_path(spark, "metadata")
    n.agg(F.collect_list(page).alias("pages"), F.map_from_entries(F.collect_list(edge)).alias("redirect_map")).coalesce(1).write.json(path)
    return path


@query("SELECT doc_id AS pageid, 0 AS ns, source AS title, NULL::BIGINT AS revid, text AS wikitext FROM documents")
def source_json_lines(spark, sf_dir):
    """SRC-05"""
    d = table(spark, sf_dir, "documents")
    path = new_path(spark, "lines")
    d.select(F.col("doc_id").alias("pageid"), F.lit(0).alias("ns"), F.col("source").alias("title"), F.col("text").alias("wikitext")).write.json(path)
    return readers.json_lines(spark, path)


@query("SELECT p_name AS en, [first(p_brand ORDER BY p_partkey), first(p_type ORDER BY p_partkey)] AS value, true AS is_list FROM part GROUP BY p_name")
def source_glossary(spark, sf_dir):
    """SRC-06"""
    p = table(spark, sf_dir, "part")
    own = p.groupBy("p_name").agg(F.min_by(F.struct("p_brand", "p_type"), "p_partkey").alias("v"))
    item = F.concat(F.to_json(F.array("p_name")), F.lit(":"), F.to_json(F.array("v.p_brand", "v.p_type")))
    lines = own.select(F.regexp_replace(item, r'^\[(.*?)\]:', "$1:").alias("item"))
    path = new_path(spark, "glossary")
    lines.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("item"), ","), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return readers.glossary(spark, path).drop("pos")


@query("SELECT trim(s_name) AS name FROM supplier")
def source_targets(spark, sf_dir):
    """SRC-07"""
    s = table(spark, sf_dir, "supplier")
    path = new_path(spark, "targets")
    s.select(F.explode(F.array(F.concat(F.lit("  "), "s_name"), F.lit(""), F.concat(F.lit("# "), "s_name"))).alias("value")).write.text(path)
    return readers.targets(spark, path)


@query("SELECT sha256(doc_id::VARCHAR || chr(10)) AS sha256 FROM documents WHERE doc_id IS NOT NULL")
def source_file_digests(spark, sf_dir):
    """SRC-25: a file a row, in folders of 4,096 at most; rows of one id have files of their own."""
    path, k = new_path(spark, "files"), F.monotonically_increasing_id()
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(k.alias("k"), F.concat(F.col("doc_id").cast("string"), F.lit("\n")).alias("content"))
    sinks.files(rows.select(F.concat_ws("/", F.floor(F.col("k") / 4096), F.concat("k", F.lit(".txt"))).alias("path"), "content"), path)
    return readers.file_digests(spark, path).where("path LIKE '%.txt'").select("sha256")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def source_links(spark, sf_dir):
    """SRC-26"""
    return readers.html_links(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(r"""SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))) AS headings FROM pages""")
def source_headings(spark, sf_dir):
    """SRC-30"""
    return table(spark, sf_dir, "pages").select("page_id", readers.headings(F.col("html")).alias("headings"))


@query("SELECT c_custkey AS pageid, c_nationkey::INT AS ns, c_custkey % 5 = 0 AS is_redirect FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey IN (0, 4, 14) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def source_missing_pages(spark, sf_dir):
    """SRC-28, FLT-05, FLT-22, STM-01"""
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pageid"), F.col("c_nationkey").cast("int").alias("ns"), (F.col("c_custkey") % 5 == 0).alias("is_redirect"))
    return readers.missing_pages(meta, table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("pageid")))


@query("SELECT o_custkey AS pageid, max(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END) AS captured_at FROM orders GROUP BY o_custkey")
def source_captured(spark, sf_dir):
    """SRC-33"""
    stamp = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority"))
    return readers.captured(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pageid"), stamp.alias("captured_at")))


@query("SELECT c_name AS title, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'page' WHEN c_nationkey = 3 THEN 'redirect' ELSE 'missing' END AS state FROM customer")
def source_probe(spark, sf_dir):
    """SRC-29"""
    c = table(spark, sf_dir, "customer")
    pages = c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("title"))
    return readers.probe(c.select(F.col("c_name").alias("title")), pages, c.where("c_nationkey = 3").select(F.col("c_name").alias("src")))


@query("SELECT c_name AS title FROM customer")
def source_lookup_batches(spark, sf_dir):
    """SRC-14, SRC-21"""
    return readers.lookup_batches(table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"))).select(F.explode("titles").alias("title"))


@query("""WITH r AS (SELECT 'P' || p_partkey AS src, 'P' || (p_partkey // 3) AS tgt FROM part WHERE p_partkey % 4 = 0),
i AS (SELECT 'P' || p_partkey AS key, 'parts/' || p_partkey AS path FROM part WHERE p_partkey % 3 <> 0),
l AS (SELECT DISTINCT l_partkey, 'P' || l_partkey AS title FROM lineitem)
SELECT l.title, coalesce(a.path, b.path) AS path FROM l LEFT JOIN r ON l.title = r.src LEFT JOIN i a ON r.tgt = a.key LEFT JOIN i b ON l.title = b.key""")
def resolved_links(spark, sf_dir):
    """JOI-01, JOI-02"""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda x: F.concat(F.lit("P"), x.cast("long").cast("string"))
    redirects = part.where(k % 4 == 0).select(name(k).alias("src"), name(F.floor(k / 3)).alias("tgt"))
    index = part.where(k % 3 != 0).select(name(k).alias("key"), F.lit("parts").alias("dir"), k.cast("string").alias("fn"))
    links = table(spark, sf_dir, "lineitem").select(name(F.col("l_partkey")).alias("title")).distinct()
    return graph.resolve_links(links, redirects, index)


@query("""WITH t AS (SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 2 = 1)
SELECT c_name AS name, coalesce(a.value, b.value) AS value FROM customer LEFT JOIN t a ON a.key = 'k' || c_nationkey LEFT JOIN t b ON b.key = 'k' || (c_nationkey + 1)""")
def looked_up_variants(spark, sf_dir):
    """JOI-03, JOI-05"""
    c = table(spark, sf_dir, "customer")
    wanted = c.select(F.concat("c_name", F.lit("/"), "c_nationkey").alias("name"))
    n = F.substring_index("name", "/", -1).cast("long")
    known = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_name").alias("value"))
    out = graph.lookup_variants(wanted, known, F.array(F.concat(F.lit("k"), n), F.concat(F.lit("k"), n + 1)))
    return out.select(F.substring_index("name", "/", 1).alias("name"), "value")


@query("SELECT c_name AS title FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 AND c_custkey % 2 = 0")
def images_to_fetch(spark, sf_dir):
    """JOI-04, JOI-24"""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").alias("k"))
    there = c.where("k % 3 <> 0").select("title", ((F.col("k") % 5 == 0) & (F.col("k") % 2 == 0)).alias("missing"))
    return site.images_todo(c.select("title"), there).select("title")


@query(r"""SELECT page_id, regexp_replace(html, '(?i)<img\b', '<img loading="lazy"', 'g') AS html FROM pages""")
def lazy_images(spark, sf_dir):
    """REN-02: no image of these pages says how it is loaded."""
    return table(spark, sf_dir, "pages").select("page_id", site.lazy_images(F.col("html")).alias("html"))


@query("""WITH u AS (SELECT DISTINCT p_brand AS category FROM part), r AS (SELECT DISTINCT p_brand AS category FROM part WHERE p_size = 1 AND p_partkey % 2 = 0),
k AS (SELECT p_brand AS category, CASE min(p_partkey) % 4 WHEN 0 THEN 'PAGELESS' WHEN 1 THEN 'A_SELF' WHEN 2 THEN 'BLOB' ELSE 'PLAIN' END AS class FROM part GROUP BY p_brand)
SELECT category, CASE WHEN class = 'A_SELF' THEN 'jump' ELSE 'list' END AS form FROM u JOIN k USING (category) WHERE category NOT IN (SELECT category FROM r) AND class NOT IN ('PAGELESS', 'BLOB')""")
def synthesised_categories(spark, sf_dir):
    """REN-03"""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category")
    m = F.min("p_partkey") % 4
    classes = p.groupBy("category").agg(F.when(m == 0, "PAGELESS").when(m == 1, "A_SELF").when(m == 2, "BLOB").otherwise("PLAIN").alias("class"))
    return browse.synthesised(p.select("category").distinct(), p.where("p_size = 1 AND p_partkey % 2 = 0").select("category").distinct(), classes)


@query("""WITH r AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '专长' WHEN 'MACHINERY' THEN '法术' WHEN 'FURNITURE' THEN '物品' ELSE '无' END AS cat, c_name AS title, c_custkey AS pageid FROM customer WHERE c_nationkey % 2 = 0)
SELECT CASE cat WHEN '专长' THEN 'feats' WHEN '法术' THEN 'spells' ELSE 'items' END AS bucket, title, min(pageid) AS pageid FROM r WHERE cat <> '无' GROUP BY ALL""")
def browse_buckets(spark, sf_dir):
    """SET-05, FLT-27, WIN-04, SRT-05"""
    segment = F.col("c_mktsegment")
    name = F.when(segment == "BUILDING", "专长").when(segment == "MACHINERY", "法术").when(segment == "FURNITURE", "物品").otherwise("无")
    c = table(spark, sf_dir, "customer")
    return browse.buckets(c.select((F.col("c_nationkey") % 2).cast("int").alias("ns"), F.col("c_custkey").alias("pageid"), F.col("c_name").alias("title"), F.array(name).alias("categories")))


@query("""WITH r AS (SELECT p_partkey AS id, p_size::INT AS lv FROM part)
SELECT id, [z FOR z IN ['creatures-level-0-3', 'creatures-level-4-7', 'creatures-level-8-12', 'creatures-level-13-17', 'creatures-level-18-25']
  IF z = CASE WHEN lv <= 3 THEN 'creatures-level-0-3' WHEN lv <= 7 THEN 'creatures-level-4-7' WHEN lv <= 12 THEN 'creatures-level-8-12' WHEN lv <= 17 THEN 'creatures-level-13-17' ELSE 'creatures-level-18-25' END] AS zones FROM r""")
def browse_zones(spark, sf_dir):
    """FLT-12"""
    fields = F.create_map(F.lit("等级"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), browse.subzones(fields, F.lit("Creatures")).alias("zones"))


@query("SELECT c_name AS title, c_mktsegment AS bucket, fields FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS fields FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def browse_enriched(spark, sf_dir):
    """JOI-07, PRJ-17"""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    records = o.select(F.col("o_orderkey").alias("pageid"), F.col("c_name").alias("name"), F.col("o_orderstatus").alias("fields"))
    return browse.enriched(c.select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("bucket")), records)


@query("SELECT CASE WHEN regexp_matches(upper(c_mktsegment[1:1]), '^[A-Z]$') THEN upper(c_mktsegment[1:1]) ELSE c_mktsegment[1:1] END AS letter, c_mktsegment || c_custkey AS title FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_nationkey % 2 = 0")
def letter_index(spark, sf_dir):
    """FLT-06, REN-05"""
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 2).cast("int").alias("ns"), F.concat("c_mktsegment", "c_custkey").alias("title"), F.col("c_custkey").alias("k"))
    return browse.letters(c.select("ns", "title"), c.where("k % 3 = 0").select(F.col("title").alias("src")), c.where("k % 2 = 0").select("title"))


@query("SELECT c_mktsegment AS category, count(*)::BIGINT AS n, count(DISTINCT c_nationkey)::BIGINT AS namespaces FROM customer GROUP BY ALL")
def category_totals(spark, sf_dir):
    """AGG-13, AGG-21, SRT-08"""
    return browse.category_summary(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("ns"), F.array("c_mktsegment").alias("categories")))


@query("SELECT DISTINCT c_mktsegment AS category FROM customer WHERE c_mktsegment <> 'BUILDING'")
def known_categories(spark, sf_dir):
    """SET-06, SET-11"""
    c = table(spark, sf_dir, "customer")
    pages = c.select(F.lit(0).alias("ns"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("categories"))
    return browse.category_universe(pages, c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("category")))

"""Queries over the tables of a folder, one for each operator that tables can show, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import glossary as G
from ..operators import graph, search, snapshots, tables
from ..sources import readers
from ..streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.ENGLISH_STOP)
    return f"list_filter(list_transform(regexp_extract_all({text}, '([A-Za-z][A-Za-z0-9''_-]{{1,30}})', 1), lambda x: lower(x)), lambda x: x NOT IN ({stop}))"


EXCERPT_SQL = r"CASE WHEN len(b) <= 200 THEN b ELSE regexp_replace(b[1:200], '\s+$', '') || '…' END"
TITLE_SQL = r"regexp_extract(text, '^([^\n.]{0,60})', 1)"


def documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the form of pages: the start of the first line is the title, the source a category."""
    docs = table(spark, sf_dir, "documents")
    title = F.regexp_extract("text", r"^([^\n.]{0,60})", 1)
    return docs.select(F.lit(0).alias("ns"), F.col("doc_id").alias("pageid"), title.alias("title"), F.col("text").alias("body"), F.array("source").alias("categories"))


ITEMS_SQL = rf"""
items AS (
  SELECT (row_number() OVER (ORDER BY sha1(doc_id::VARCHAR), title) - 1)::BIGINT AS id, title, b AS body,
         CASE WHEN len(text) < 120 THEN title ELSE title || ' ' || chr(10) || ' ' || text[1:600] END AS indexed, text AS raw
  FROM (SELECT doc_id, text, {TITLE_SQL} AS title, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS b FROM documents)),
posts AS (SELECT DISTINCT id, unnest({words_sql('indexed')}) AS token FROM items)
"""


# ---- tokens and the index ----

@query(f"SELECT token, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS token FROM documents) GROUP BY token")
def token_frequency(spark, sf_dir):
    """STR-04, AGG-01: documents and occurrences of each word."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.latin_words(F.col("text"))).alias("token"))
    per_doc = words.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@query(f"WITH {ITEMS_SQL} SELECT token, list(id ORDER BY id) AS ids, CASE WHEN token[1] BETWEEN 'a' AND 'z' THEN token[1] ELSE '_' END AS bucket FROM posts GROUP BY token")
def inverted_index(spark, sf_dir):
    """AGG-01, AGG-02, WIN-03: postings of the documents as entries."""
    items = search.entries(documents_as_pages(spark, sf_dir))
    return search.postings(items).where("kind = 'w'").select("token", "ids", "bucket")


@query(f"SELECT bucket, count(*)::BIGINT AS tokens FROM (SELECT DISTINCT token, CASE WHEN token[1] BETWEEN 'a' AND 'z' THEN token[1] ELSE '_' END AS bucket FROM (SELECT unnest({words_sql('text')}) AS token FROM documents)) GROUP BY bucket")
def word_bucket_hist(spark, sf_dir):
    """STR-06, AGG-02"""
    words = table(spark, sf_dir, "documents").select(F.explode(T.latin_words(F.col("text"))).alias("token")).distinct()
    return words.groupBy(T.word_bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("tokens"))


@query(f"SELECT md5(token)[1:2] AS bucket, count(*)::BIGINT AS tokens FROM (SELECT DISTINCT unnest({words_sql('text')}) AS token FROM documents) GROUP BY 1")
def md5_bucket_hist(spark, sf_dir):
    """STR-05"""
    words = table(spark, sf_dir, "documents").select(F.explode(T.latin_words(F.col("text"))).alias("token")).distinct()
    return words.groupBy(T.bigram_bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("tokens"))


def _search_sql(text: str, words: list[str], limit: int) -> str:
    lists = ", ".join(
        f"l{i} AS (SELECT DISTINCT id FROM posts WHERE token = '{w}' OR token IN (SELECT token FROM k{i} WHERE r <= 200 AND before < 5000))" for i, w in enumerate(words)
    )
    keys = ", ".join(
        f"""f{i} AS (SELECT id, min(r) AS r FROM (SELECT p.id, CASE WHEN p.token = '{w}' THEN 0 ELSE k.r END AS r FROM posts p JOIN (SELECT token, row_number() OVER (ORDER BY token) AS r FROM (SELECT DISTINCT token FROM posts WHERE starts_with(token, '{w}') AND token <> '{w}') UNION ALL SELECT '{w}', 0) k USING (token)) GROUP BY id),
        k{i} AS (SELECT token, r, (SELECT count(*) FROM f{i} WHERE f{i}.r < q.r) AS before FROM (SELECT token, row_number() OVER (ORDER BY token) AS r FROM (SELECT DISTINCT token FROM posts WHERE starts_with(token, '{w}') AND token <> '{w}')) q)"""
        for i, w in enumerate(words)
    )
    used = " UNION ALL ".join(f"SELECT id, {i} AS l FROM l{i}" for i in range(len(words)))
    low = text.lower()
    return rf"""
    WITH {ITEMS_SQL}, {keys}, {lists}, h AS ({used}),
    c AS (SELECT id FROM h GROUP BY id HAVING count(DISTINCT l) = (SELECT count(DISTINCT l) FROM h) UNION SELECT id FROM items WHERE regexp_matches(lower(title), '(^|[^a-z0-9]){low}')),
    s AS (SELECT id, title, body AS b, CASE WHEN lower(title) = '{low}' THEN 1000 WHEN starts_with(lower(title), '{low}') THEN 500 WHEN regexp_matches(lower(title), '(^|[^a-z0-9]){low}') THEN 200 ELSE 0 END
            + CASE WHEN name = '' THEN 0 WHEN name = '{low}' THEN 900 WHEN starts_with(name, '{low}') THEN 450 ELSE 0 END AS tier
          FROM (SELECT *, CASE WHEN starts_with(raw, title) THEN lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(raw[len(title) + 1:], '^ +', ''), '^[A-Za-z][A-Za-z0-9''’ \-]{{0,58}}[A-Za-z0-9''’]'), '^[ -]+', ''), '[ -]+$', '')) ELSE '' END AS name
                FROM items SEMI JOIN c USING (id)))
    SELECT id, title, {EXCERPT_SQL} AS excerpt, ((CASE WHEN tier >= 200 THEN tier - least(50, len(title)) ELSE tier END) + 5)::INT AS score, (count(*) OVER ())::BIGINT AS total
    FROM s ORDER BY score DESC, id LIMIT {limit}"""


def _search(spark, sf_dir, text: str, limit: int) -> DataFrame:
    engine = search.Engine.build(documents_as_pages(spark, sf_dir))
    return engine.search(text, limit).select("id", "title", "excerpt", "score", "total")


@query(_search_sql("the thing", ["the", "thing"], 50))
def search_ranked(spark, sf_dir):
    """RNK-01 to RNK-06, SET-01 to SET-04, SRT-01, SRT-09, AGG-09: the whole query path."""
    return _search(spark, sf_dir, "the thing", 50)


@query(_search_sql("erth", ["erth"], 1000000))
def search_prefix(spark, sf_dir):
    """SET-04, SRT-09: one word and all it starts."""
    return _search(spark, sf_dir, "erth", 1000000)


@query(_search_sql("zu", ["zu"], 20))
def search_title(spark, sf_dir):
    """SET-03, RNK-07, FLT-11: titles match at the left edge of words."""
    return _search(spark, sf_dir, "zu", 20)


@query(f"SELECT doc_id, {EXCERPT_SQL} AS excerpt FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS b FROM documents)")
def excerpts(spark, sf_dir):
    """PRJ-04"""
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT type, count(*)::BIGINT AS n, sum(len(text))::BIGINT AS chars FROM (SELECT text, CASE WHEN len(text) < 120 THEN 'U' WHEN source IN ('src1', 'src2') THEN 'S' WHEN source IN ('src2', 'src3') THEN 'F' ELSE 'O' END AS type FROM documents) GROUP BY type")
def type_distribution(spark, sf_dir):
    """PRJ-08, PRJ-09, AGG-03: stubs first, then the first rule that fits."""
    rules = [("S", ["src1", "src2"]), ("F", ["src2", "src3"])]
    code = F.when(F.length("text") < search.STUB, "U").otherwise(search.first_match(F.array("source"), rules, "O"))
    return table(spark, sf_dir, "documents").groupBy(code.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'P' WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'B' WHEN p_size <= 5 THEN 'S' ELSE 'O' END AS code FROM part")
def type_first_match(spark, sf_dir):
    """PRJ-09 as a ladder of conditions."""
    code = F.when(F.col("p_type").startswith("PROMO"), "P").when(F.col("p_brand").isin("Brand#11", "Brand#12"), "B").when(F.col("p_size") <= 5, "S").otherwise("O")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


@query(r"SELECT CASE WHEN regexp_matches(text[1], '^[A-Za-z]$') THEN upper(text[1]) WHEN regexp_matches(text[1], '^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]$') THEN 'CJK' ELSE '_' END AS letter, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def first_letter_hist(spark, sf_dir):
    """PRJ-15, AGG-10"""
    return table(spark, sf_dir, "documents").groupBy(T.first_letter(F.col("text")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, regexp_replace(replace(replace(replace(url, ':', '_'), '/', '__'), '\', '_'), '[*?"<>|]', '', 'g') AS safe, lower(url[1:4]) = 'http' AND NOT regexp_matches(url, '127\.0\.0\.1|localhost') AS external FROM pages""")
def safe_titles(spark, sf_dir):
    """PRJ-01, FLT-24, REN-10"""
    return table(spark, sf_dir, "pages").select("page_id", T.safe_title(F.col("url")).alias("safe"), T.is_external(F.col("url")).alias("external"))


# ---- pages and links ----

_TEXT_SQL = "html"
for _pattern, _put in ((r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " "), ("<[^>]+>", " ")):
    _TEXT_SQL = f"regexp_replace({_TEXT_SQL}, '{_pattern}', '{_put}', 'g')"
for _entity, _char in T.ENTITIES:
    _TEXT_SQL = f"replace({_TEXT_SQL}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
_TEXT_SQL = rf"trim(regexp_replace({_TEXT_SQL}, '[\s\x{{a0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, {_TEXT_SQL} AS text FROM pages")
def html_text(spark, sf_dir):
    """STR-08"""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query()
def html_parsed(spark, sf_dir):
    """STR-08 by a parser, for pages of any form."""
    return table(spark, sf_dir, "pages").select("page_id", H.parsed_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, replace(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '\s+', ' ', 'g'))[1:160], '"', '''') AS description FROM pages""")
def meta_descriptions(spark, sf_dir):
    """PRJ-05"""
    return table(spark, sf_dir, "pages").select("page_id", T.meta_description(F.col("html")).alias("description"))


@query("""SELECT page_id, href, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def href_extract(spark, sf_dir):
    """SRC-26"""
    return readers.html_links(table(spark, sf_dir, "pages").select("page_id", "html")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS title FROM pages), p AS (SELECT title, count(*)::BIGINT AS inlinks FROM l WHERE title <> '' GROUP BY title)
SELECT title, inlinks, least(20, floor(log2(1 + inlinks) * 3 + 0.5))::INT AS boost FROM p""")
def inlink_popularity(spark, sf_dir):
    """GRF-05, RNK-05, FUN-03"""
    links = readers.html_links(table(spark, sf_dir, "pages").select("html")).select(F.col("href").alias("title"), F.lit(True).alias("exists"), F.lit(0).alias("ns"))
    boost = F.least(F.lit(20), F.round(F.log2(F.lit(1.0) + F.col("inlinks")) * 3).cast("int"))
    return graph.inlinks(links).withColumn("boost", boost)


@query("""WITH l AS (SELECT regexp_extract(h, '^(.*/)', 1) AS dir, regexp_extract(h, '([^/]*)$', 1) AS fn FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)),
f AS (SELECT DISTINCT regexp_extract(url, '^(.*/)', 1) AS dir, lower(regexp_extract(url, '([^/]*)$', 1)) AS fn FROM pages),
j AS (SELECT l.*, f.fn IS NULL AS dead FROM l LEFT JOIN f ON l.dir = f.dir AND lower(l.fn) = f.fn)
SELECT count(*)::BIGINT AS total, count_if(dead)::BIGINT AS dead, round(100.0 * count_if(dead) / count(*), 2)::DOUBLE AS percent, count(DISTINCT CASE WHEN dead THEN dir || chr(0) || fn END)::BIGINT AS targets FROM j""")
def dead_links(spark, sf_dir):
    """JOI-20, AGG-15, FUN-04"""
    pages = table(spark, sf_dir, "pages")

    def place(c):
        return [F.regexp_extract(c, "^(.*/)", 1).alias("dir"), F.regexp_extract(c, "([^/]*)$", 1).alias("fn")]

    return snapshots.dead_link_report(readers.html_links(pages.select("html")).select(*place("href")), pages.select(*place("url")))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''), split_part(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' — ', 1)) AS title FROM pages""")
def page_titles(spark, sf_dir):
    """PRJ-13, PRJ-29, SRC-30"""
    h1 = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    named = F.substring_index(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), " — ", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(h1, F.lit("")), named).alias("title"))


@query()
def page_attributes(spark, sf_dir):
    """UDF-04: a table function in SQL."""
    spark.udtf.register("page_attributes", H.Attributes)
    table(spark, sf_dir, "pages").createOrReplaceTempView("attribute_pages")
    return spark.sql("SELECT tag, attribute, count(*) AS n FROM attribute_pages, LATERAL page_attributes(html) GROUP BY ALL")


@query("""WITH e AS (SELECT source AS category, lower(doc_id::VARCHAR) AS key, doc_id::VARCHAR AS title FROM documents)
SELECT category, len(list(title))::BIGINT AS n, list(title ORDER BY key, title) AS members FROM e GROUP BY category""")
def category_inversion(spark, sf_dir):
    """GRF-06, SRT-06"""
    c = F.array(F.struct(F.col("source").alias("category"), F.lit("").alias("sortkey")))
    pages = table(spark, sf_dir, "documents").select(F.lit(0).alias("ns"), F.col("doc_id").cast("string").alias("title"), c.alias("categories"))
    members = F.transform("members", lambda m: m["title"])
    return graph.invert_categories(pages).select("category", F.size("members").cast("long").alias("n"), members.alias("members"))


@query("""WITH m AS (SELECT source AS category, count(*)::BIGINT AS n FROM documents GROUP BY source)
SELECT category, n, CASE WHEN regexp_matches(category, '[,;，；]') THEN 'BLOB' WHEN suffix(category, '子页面') THEN 'B_SYNTH' WHEN category NOT IN ('src1', 'src2', 'src3') THEN 'PAGELESS' ELSE 'PLAIN' END AS class FROM m""")
def pseudo_categories(spark, sf_dir):
    """FLT-07"""
    members = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.lit(0).alias("ns"), F.col("doc_id").cast("string").alias("title"))
    pages = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "title string")
    return graph.pseudo_categories(members, pages)


@query("""WITH n AS (SELECT c_custkey * 2 AS ord, 0 AS ns, 'C/' AS dir, 'Customer:' || c_name AS title, c_name AS bare, c_mktsegment AS fn FROM customer
  UNION ALL SELECT s_suppkey * 2 + 1, 14, 'S/', 'Supplier:' || s_name, s_name, lower(s_name) FROM supplier),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dir, lower(fn) ORDER BY ord) > 1 THEN fn || '~' || sha1(title)[1:6] ELSE fn END AS file FROM n),
k AS (SELECT title AS key, 0 AS b, CASE ns WHEN 0 THEN 0 ELSE 1 END AS prio, ord, dir, file FROM f UNION ALL SELECT bare, 1, CASE ns WHEN 0 THEN 0 ELSE 1 END, ord, dir, file FROM f)
SELECT key, dir, file AS fn FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY b, prio, ord) = 1""")
def title_index(spark, sf_dir):
    """JOI-27, WIN-01, WIN-02"""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.select((F.col("c_custkey") * 2).alias("ord"), F.lit(0).alias("ns"), F.lit("C/").alias("dir"), F.concat(F.lit("Customer:"), "c_name").alias("title"), F.col("c_name").alias("bare"), F.col("c_mktsegment").alias("fn"))
    b = s.select((F.col("s_suppkey") * 2 + 1).alias("ord"), F.lit(14).alias("ns"), F.lit("S/").alias("dir"), F.concat(F.lit("Supplier:"), "s_name").alias("title"), F.col("s_name").alias("bare"), F.lower("s_name").alias("fn"))
    return graph.title_index(a.unionByName(b), {0: 0, 14: 1})


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(doc_id::VARCHAR)) - 1 AS id FROM documents) SELECT doc_id, id::BIGINT AS id FROM d""")
def dense_ids(spark, sf_dir):
    """WIN-03"""
    rows = documents_as_pages(spark, sf_dir).withColumn("title", F.col("pageid").cast("string"))
    return search.entries(rows).select(F.col("title").cast("long").alias("doc_id"), "id")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_orderkey ELSE o_orderkey + 1 + o_orderkey % 3 END AS tgt FROM orders),
w AS (SELECT src AS start, src AS cur, [src] AS seen, false AS cycle, false AS done FROM e
  UNION ALL SELECT w.start, CASE WHEN e.tgt IS NULL OR list_contains(w.seen, e.tgt) OR len(w.seen) >= 10 THEN w.cur ELSE e.tgt END,
    CASE WHEN e.tgt IS NULL OR list_contains(w.seen, e.tgt) OR len(w.seen) >= 10 THEN w.seen ELSE list_append(w.seen, e.tgt) END,
    coalesce(list_contains(w.seen, e.tgt), false), e.tgt IS NULL OR list_contains(w.seen, e.tgt) OR len(w.seen) >= 10
  FROM w LEFT JOIN e ON w.cur = e.src WHERE NOT w.done)
SELECT start, cur AS final, cycle, (len(seen) - 1)::INT AS hops FROM w WHERE done""")
def redirect_chase(spark, sf_dir):
    """GRF-01, GRF-02"""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tgt = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, k).otherwise(k + 1 + k % 3)
    out = graph.chase(orders.select(k.cast("string").alias("src"), tgt.cast("string").alias("tgt")))
    return out.select(F.col("start").cast("long"), F.col("final").cast("long"), "cycle", "hops")


# ---- tables ----

@query("""WITH f AS (SELECT 'brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'level', CASE WHEN p_size < 0 THEN NULL WHEN p_size <= 1 THEN '0-1' WHEN p_size <= 5 THEN '2-5' WHEN p_size <= 10 THEN '6-10' WHEN p_size <= 15 THEN '11-15' WHEN p_size <= 20 THEN '16-20' ELSE '21+' END FROM part
  UNION ALL SELECT 'word', unnest(string_split(p_type, ' ')) FROM part),
c AS (SELECT facet, value, count(*)::BIGINT AS n FROM f WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY facet ORDER BY n DESC, value))::INT AS place FROM c QUALIFY facet <> 'word' OR place <= 3""")
def facet_counts(spark, sf_dir):
    """AGG-07, STR-24, STR-25"""
    part = table(spark, sf_dir, "part")
    return tables.facet_counts(part, {"brand": F.col("p_brand"), "level": T.level_bucket(F.col("p_size"))}, {"word": F.split("p_type", " ")}, top=3)


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size BETWEEN 2 AND 10")
def facet_filter(spark, sf_dir):
    """FLT-08"""
    part = table(spark, sf_dir, "part")
    out = tables.facet_filter(part, {"brand": ["Brand#11", "Brand#23"], "level": ["2-5", "6-10"], "type": []}, {"brand": F.col("p_brand"), "level": T.level_bucket(F.col("p_size")), "type": F.col("p_type")})
    return out.select("p_partkey", "p_brand", "p_size")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '7 auto')")
def row_search(spark, sf_dir):
    """FLT-09, FLT-10"""
    return tables.row_search(table(spark, sf_dir, "customer"), "7 AUTO", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey OFFSET 50 LIMIT 25")
def sorted_page(spark, sf_dir):
    """SRT-02, WIN-06"""
    out = tables.majority_numeric_sort(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", descending=True)
    return out.offset(50).limit(25)


@query("SELECT count(*)::BIGINT AS total, count_if(p_size > 25)::BIGINT AS matched, greatest(1, ceil(count_if(p_size > 25) / 50.0))::BIGINT AS pages, least(count_if(p_size > 25), (least(3, greatest(1, ceil(count_if(p_size > 25) / 50.0))) - 1) * 50 + 1)::BIGINT AS lo, least(count_if(p_size > 25), least(3, greatest(1, ceil(count_if(p_size > 25) / 50.0))) * 50)::BIGINT AS hi FROM part")
def page_counter(spark, sf_dir):
    """AGG-24, AGG-25"""
    return tables.counter(table(spark, sf_dir, "part"), F.col("p_size") > 25, 3, 50)


@query("WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type))::INT AS place FROM l QUALIFY place <= 3")
def recent_visits(spark, sf_dir):
    """SRT-10"""
    return tables.newest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", keep=3)


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || 'seed'), p_partkey LIMIT 30")
def seeded_sample(spark, sf_dir):
    """SRT-11, SRT-12"""
    return tables.seeded_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "seed", 30)


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1")
def first_seen(spark, sf_dir):
    """WIN-04, WIN-05"""
    return tables.first_seen(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")])


@query("SELECT l_returnflag, count(*)::BIGINT AS n, max(l_quantity)::DOUBLE AS most, count_if(l_discount > 0)::BIGINT AS nonzero FROM lineitem GROUP BY 1")
def popularity_stats(spark, sf_dir):
    """AGG-04, AGG-11, AGG-12"""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"), F.count_if(F.col("l_discount") > 0).alias("nonzero"))


@query("""WITH t AS (SELECT event_type, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events)) SELECT event_type, k, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS different FROM t GROUP BY ALL""")
def schema_profile(spark, sf_dir):
    """AGG-14, FUN-06: how often each field occurs, and with how many values."""
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    tally = rows.groupBy("event_type", "k", "v").agg(F.count(F.lit(1)).alias("c"))
    return tally.groupBy("event_type", "k").agg(F.sum("c").alias("n"), F.count("v").alias("different"))


# ---- snapshots ----

def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("sha256"))
    new = o.where("path % 10 <> 3").withColumn("sha256", F.when(F.col("path") % 10 == 4, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")))
    return o.where("path % 10 <> 5"), new


_VERSIONS_SQL = """o AS (SELECT o_orderkey AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS sha256 FROM orders), a AS (SELECT * FROM o WHERE path % 10 <> 5),
b AS (SELECT path, CASE WHEN path % 10 = 4 THEN sha256(sha256 || 'x') ELSE sha256 END AS sha256 FROM o WHERE path % 10 <> 3),
d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change, b.sha256 FROM a FULL JOIN b USING (path) WHERE a.sha256 IS DISTINCT FROM b.sha256)"""


@query(f"WITH {_VERSIONS_SQL} SELECT path, change, sha256 FROM d")
def snapshot_diff(spark, sf_dir):
    """JOI-18, FUN-08, SRC-25"""
    return snapshots.diff(*_versions(spark, sf_dir))


@query(f"WITH {_VERSIONS_SQL} SELECT path, sha256 FROM b")
def snapshot_apply(spark, sf_dir):
    """SNK-15: a base and its patch give the new snapshot."""
    old, new = _versions(spark, sf_dir)
    return snapshots.apply(old, snapshots.diff(old, new))


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_change(spark, sf_dir):
    """AGG-18"""
    return snapshots.latest_change(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", F.col("event_id"))


@query("WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), c AS (SELECT user_id, max(ts) AS captured_at FROM events WHERE event_type IN (SELECT min(event_type) FROM events) GROUP BY 1) SELECT user_id, ts, captured_at FROM l LEFT JOIN c USING (user_id) WHERE captured_at IS NULL OR captured_at < ts")
def refresh_todo(spark, sf_dir):
    """JOI-19, FUN-01, SRC-20"""
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type").alias("event_type"))
    captured = events.join(F.broadcast(kind), "event_type").groupBy("user_id").agg(F.max("ts").alias("captured_at"))
    return snapshots.stale(events.groupBy("user_id").agg(F.max("ts").alias("ts")), captured, "user_id", "ts")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, n, ts FROM e WHERE n = 1 UNION ALL SELECT user_id, n, ts FROM (SELECT e.user_id, e.n, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS k FROM a JOIN e ON a.user_id = e.user_id AND e.ts >= a.ts + INTERVAL 6 HOUR) WHERE k = 1)
SELECT e.user_id, e.event_id, e.ts, a.n IS NOT NULL AS accepted FROM e LEFT JOIN a ON e.user_id = a.user_id AND e.n = a.n""")
def throttle_6h(spark, sf_dir):
    """STM-05, FUN-02"""
    return snapshots.throttled(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 6 * 3600)


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def bookmark_state(spark, sf_dir):
    """STM-09"""
    return flows.bookmarks(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*)::BIGINT AS events, max(ts) AS last FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    """STM-06"""
    return flows.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS count FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """STM-11"""
    return flows.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", "event_type")


@query("""WITH l AS (SELECT DISTINCT doc_id, toxic AS g FROM labels), d AS (SELECT DISTINCT doc_id, (doc_id % 2)::INT AS g FROM documents)
SELECT g, count_if(l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL)::BIGINT AS both, count_if(d.doc_id IS NULL)::BIGINT AS only_a, count_if(l.doc_id IS NULL)::BIGINT AS only_b FROM l FULL JOIN d USING (doc_id, g) GROUP BY g""")
def membership_diff(spark, sf_dir):
    """JOI-16, AGG-16"""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("g"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("g"))
    return snapshots.membership_diff(labels, docs, ["doc_id", "g"], ["g"])


@query("""SELECT n_name, 'only_customer' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT n_name, 'only_supplier' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 8000)""")
def set_differences(spark, sf_dir):
    """SET-08, SET-09, JOI-23"""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    s = s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    a = c.select(F.col("c_nationkey").alias("k")).subtract(s).withColumn("side", F.lit("only_customer"))
    b = s.subtract(c.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k"))).withColumn("side", F.lit("only_supplier"))
    return a.unionByName(b).join(n, F.col("k") == F.col("n_nationkey")).select("n_name", "side")


@query("""WITH m AS (SELECT c_nationkey AS ns, c_name AS title FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 99, s_name FROM supplier), p AS (SELECT c_nationkey + c_custkey % 2 AS ns, c_name AS title FROM customer)
SELECT w AS "where", count(*)::BIGINT AS n FROM (SELECT CASE WHEN (ns, title) IN (SELECT ns, title FROM p) THEN 'same_ns' WHEN title IN (SELECT title FROM p) THEN 'other_ns' ELSE 'absent' END AS w FROM m) GROUP BY 1""")
def classify_missing(spark, sf_dir):
    """JOI-17, JOI-21, SRC-29"""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    m = c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("ns"), F.col("c_name").alias("title")).unionByName(s.select(F.lit(99).alias("ns"), F.col("s_name").alias("title")))
    p = c.select((F.col("c_nationkey") + F.col("c_custkey") % 2).alias("ns"), F.col("c_name").alias("title"))
    return snapshots.classify_missing(m, p).groupBy("where").agg(F.count(F.lit(1)).alias("n"))


# ---- terms ----

@query(f"""WITH t AS (SELECT token AS en, lang AS zh, count(*)::BIGINT AS count FROM (SELECT lang, unnest({words_sql('text')}) AS token FROM documents) GROUP BY ALL)
SELECT en, first(zh ORDER BY count DESC, zh) AS zh, max(count)::BIGINT AS count, count(*)::BIGINT AS kinds FROM t GROUP BY en""")
def argmax_alternatives(spark, sf_dir):
    """AGG-05, AGG-06: each word's most frequent language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(T.latin_words(F.col("text"))).alias("en"))
    counts = words.groupBy("en", "lang").agg(F.count(F.lit(1)).alias("count"))
    best = counts.groupBy("en").agg(F.min_by("lang", F.struct(-F.col("count"), "lang")).alias("zh"), F.max("count").alias("count"), F.count(F.lit(1)).alias("kinds"))
    return best


@query(f"""WITH d AS (SELECT DISTINCT unnest({words_sql('text')}) AS en FROM documents), b AS (SELECT DISTINCT unnest({words_sql('text')}) AS en FROM benchmark)
SELECT en, CASE WHEN en IN (SELECT en FROM d) THEN 'known' ELSE 'new' END AS state FROM b""")
def dedup_left_anti(spark, sf_dir):
    """JOI-12, JOI-13, SET-07"""
    words = lambda t: table(spark, sf_dir, t).select(F.explode(T.latin_words(F.col("text"))).alias("en")).distinct()
    return words("benchmark").join(words("documents").withColumn("_k", F.lit(True)), "en", "left").select("en", F.when(F.col("_k"), "known").otherwise("new").alias("state"))


@query("""WITH g AS (SELECT DISTINCT p_name AS en, p_brand AS zh FROM part), t AS (SELECT en, zh, unnest(list_transform(range(1, len(string_split(lower(trim(en)), ' '))), lambda k: array_to_string(string_split(lower(trim(en)), ' ')[len(string_split(lower(trim(en)), ' ')) - k + 1:], ' '))) AS tail FROM g)
SELECT DISTINCT en, zh FROM t WHERE (tail, zh) IN (SELECT lower(trim(en)), zh FROM g)""")
def suffix_selfjoin(spark, sf_dir):
    """JOI-14"""
    return G.suffix_copies(table(spark, sf_dir, "part").select(F.col("p_name").alias("en"), F.col("p_brand").alias("zh")).distinct())


@query("SELECT page_id, regexp_replace(html, '(?i)the|and', '<mark>\\0</mark>', 'g') AS marked, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def highlighted(spark, sf_dir):
    """STR-20, STR-21"""
    return table(spark, sf_dir, "pages").select("page_id", T.highlighted(F.col("html"), ["the", "and"], lead=2**31 - 1).alias("marked"), T.escaped_html(F.col("html")).alias("escaped"))


@query("SELECT p_partkey, substr(sha1(p_name), 1, 2) || '/' || substr(sha1(p_name), 3) || '.png' AS path, substr(sha1(p_brand), 1, 16) AS key, list_filter(list_transform(string_split_regex(p_type, '[,，、/]'), lambda x: trim(x)), lambda x: x <> '') AS parts, try_cast(trim(p_name) AS INT) AS number, lower(trim(replace(p_name, '_', ' '))) AS normal, round(p_retailprice * 1000 / 1024 / 1024, 2)::DOUBLE AS mb FROM part")
def scalar_functions(spark, sf_dir):
    """PRJ-22, STR-13, STR-14, STR-28, STR-29, FUN-05, FUN-09"""
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.content_address(F.sha1("p_name"), F.lit("png")).alias("path"), T.short_key(F.col("p_brand")).alias("key"), T.parts(F.col("p_type")).alias("parts"),
        T.to_int(F.col("p_name")).alias("number"), F.lower(T.normal_title(F.col("p_name"))).alias("normal"), T.megabytes(F.col("p_retailprice") * 1000).alias("mb"),
    )


from . import block_queries, glossary_queries, phrase_queries, render_queries, round_trips, site_queries, stream_queries, term_queries  # noqa: E402, F401  register their queries here

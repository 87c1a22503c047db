"""Queries over a glossary made of the tables' words, with DuckDB SQL. Renderings are words spelt in other letters, one for one, so all
rules on Chinese text have something to say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import glossary as G
from ..operators import graph, search, tables
from .queries import SQL, query, table

LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "火水风土的暗剑盾和龙巨法术师士兵城了山川林石金，银铁"
TAGS = ["A_title_field", "B_triple_bold", "D_paren_ZHopenEN"]


def mined(spark, sf_dir):
    """(en, zh, tag, pos) from pages' titles: each word, some behind an opener, with the first letters of its own or the next word."""
    words = F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")
    rows = table(spark, sf_dir, "pages").select("page_id", words.alias("w")).select("page_id", "w", F.posexplode("w").alias("pos", "word"))
    nearby = F.when(F.length("word") % 3 == 0, F.col("word")).otherwise(F.coalesce(F.get("w", F.col("pos") + 1), F.col("word")))
    en = F.when(F.col("pos") == 9, F.concat(F.lit("when the "), "word")).otherwise(F.col("word"))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("page_id") % 3 + 1).cast("int"))
    return rows.where("word <> ''").select(en.alias("en"), F.translate(F.lower(F.substring(nearby, 1, 3)), LATIN, HAN).alias("zh"), tag.alias("tag"), "pos")


_TAGS = ", ".join(f"'{t}'" for t in TAGS)
_MINED = f"""
q AS (SELECT page_id, string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS w FROM pages),
k AS (SELECT page_id, w, unnest(range(0, len(w))) AS pos FROM q),
m AS (SELECT CASE WHEN pos = 9 THEN 'when the ' ELSE '' END || w[pos + 1] AS en, [{_TAGS}][page_id % 3 + 1] AS tag, pos,
  translate(lower(left(CASE WHEN len(w[pos + 1]) % 3 = 0 THEN w[pos + 1] ELSE coalesce(w[pos + 2], w[pos + 1]) END, 3)), '{LATIN}', '{HAN}') AS zh FROM k WHERE w[pos + 1] <> ''),
c AS (SELECT en, zh, count(*)::BIGINT AS count, min(pos) AS pos, list_sort(list(DISTINCT tag)) AS sources FROM m GROUP BY en, zh),
o AS (SELECT *, row_number() OVER (PARTITION BY en ORDER BY count DESC, pos, zh) AS r FROM c)"""


def _either(column: str, values: list[str], test: str) -> str:
    return "(" + " OR ".join(f"{test}({column}, '{v}')" for v in values) + ")"


_SPACES = "(len(en) - len(replace(en, ' ', '')))"


def _ok(zh: str, en: str) -> str:
    """FLT-19 in SQL."""
    return f"""(len({zh}) BETWEEN 2 AND 8 AND NOT regexp_matches({zh}, '[，。；：、！？]') AND regexp_matches({zh}, '[一-鿿]') AND NOT {_either(zh, G.FRAGMENT_PREFIXES, "starts_with")}
  AND NOT {_either(zh, G.FRAGMENT_SUFFIXES, "ends_with")} AND NOT regexp_matches({zh}, '{G.SENTENCE_MARKERS}') AND NOT (len({en}) - len(replace({en}, ' ', '')) >= 4 AND len({zh}) <= 2))"""


@query(f"""
WITH RECURSIVE {_MINED},
s AS (SELECT en, first(zh ORDER BY r) AS zh, first(count ORDER BY r) AS count, first(sources ORDER BY r) AS sources FROM o GROUP BY en),
j AS (SELECT o.en, list(o.zh ORDER BY o.count DESC, o.zh) AS alts FROM o JOIN s ON s.en = o.en WHERE o.r > 1 AND o.count >= 3 AND o.count >= s.count * 0.4 AND {_ok('o.zh', 'o.en')} GROUP BY o.en),
b AS (SELECT s.en, CASE WHEN {_either("lower(en)", G.SENTENCE_OPENERS, "starts_with")} OR {_SPACES} > 10 OR regexp_matches(en, '{G.ARTIFACT}') THEN NULL WHEN {_ok('zh', 'en')} THEN list_concat([zh], coalesce(alts, [])) ELSE [] END AS value,
  (count >= 8 OR (count >= 3 AND list_has_any(sources, ['A_title_field', 'E_infobox_field']))) AS strong FROM s LEFT JOIN j USING (en)),
g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark),
e AS (SELECT lower(word) AS low, 0 AS side, ascii(word)::BIGINT AS pos, word AS en, CASE WHEN len(word) % 2 = 1 THEN [translate(lower(left(word, 3)), '{LATIN}', '{HAN}'), translate(reverse(lower(word)), '{LATIN}', '{HAN}')]
    ELSE [translate(lower(left(word, 3)), '{LATIN}', '{HAN}')] END AS value, len(word) % 2 = 1 AS is_list, true AS strong FROM g
  UNION ALL SELECT lower(en), 1, ascii(en)::BIGINT, en, value, false, strong FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY side, pos, en) AS i, count(*) OVER (PARTITION BY low) AS last FROM e),
f(low, i, last, pick, outs) AS (SELECT low, 0::BIGINT, max(last), 0, [struct_pack(en := '', value := ['']::VARCHAR[], is_list := false, action := '')][2:1] FROM n GROUP BY low
  UNION ALL SELECT low, i, last, CASE WHEN pick = 0 AND skip IS NULL THEN len(outs)::INT + 1 ELSE pick END,
    CASE WHEN side = 1 AND skip IS NULL AND pick > 0 THEN list_transform(range(1, len(outs) + 1), lambda x: CASE WHEN x = pick THEN struct_pack(en := outs[x].en,
        value := CASE WHEN len(value) > 1 THEN list_concat(value, list_sort(list_filter(list_distinct(outs[x].value), lambda y: NOT list_contains(value, y)))) ELSE value END,
        is_list := len(value) > 1, action := CASE WHEN len(value) > 1 THEN 'made_list' ELSE 'overwritten' END) ELSE outs[x] END)
      ELSE list_append(outs, struct_pack(en := en, value := CASE WHEN skip IS NULL THEN value END, is_list := CASE WHEN skip IS NOT NULL THEN false WHEN side = 0 THEN is_list ELSE len(value) > 1 END,
        action := CASE WHEN side = 0 THEN 'kept' WHEN skip IS NOT NULL THEN skip WHEN len(value) > 1 THEN 'added_list' ELSE 'added_scalar' END)) END
  FROM (SELECT n.*, f.pick, f.outs, CASE WHEN side = 0 THEN NULL WHEN value IS NULL THEN 'skipped_bad_en' WHEN len(value) = 0 THEN 'skipped_bad_zh'
      WHEN f.pick > 0 AND list_has_any(f.outs[f.pick].value, value) THEN 'same' WHEN f.pick > 0 AND NOT strong THEN 'skipped_low_quality' END AS skip FROM f JOIN n ON n.low = f.low AND n.i = f.i + 1)),
z AS (SELECT unnest(outs) AS x FROM f WHERE i = last)
SELECT x.en AS en, x.value AS value, x.is_list AS is_list, x.action AS action FROM z""")
def merged_terms(spark, sf_dir):
    """GLO-01, GLO-02, JOI-11, FLT-18 to FLT-20: terms mined from titles, merged into a glossary of the passages' words."""
    stats = G.term_stats(mined(spark, sf_dir)).withColumn("pos", F.ascii("en").cast("long"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("en")).distinct()
    own, back = F.translate(F.lower(F.substring("en", 1, 3)), LATIN, HAN), F.translate(F.reverse(F.lower("en")), LATIN, HAN)
    odd = F.length("en") % 2 == 1
    base = words.select("en", F.when(odd, F.array(own, back)).otherwise(F.array(own)).alias("value"), odd.alias("is_list"), F.ascii("en").cast("long").alias("pos"))
    return G.merge(base, stats)


@query(f"""WITH {_MINED} SELECT en, zh, count, sources FROM o WHERE r = 1""")
def mined_terms(spark, sf_dir):
    """AGG-05, AGG-06: each mined term's most frequent rendering."""
    return G.term_stats(mined(spark, sf_dir)).select("en", "zh", "count", "sources")


@query(f"""WITH {_MINED}, v AS (SELECT DISTINCT zh FROM m)
SELECT zh, zh IN ({', '.join(f"'{j}'" for j in G.JUNK)}) OR NOT regexp_matches(zh, '[一-鿿㐀-䶿]') AS junk, len(regexp_extract_all(zh, '[一-鿿]'))::BIGINT AS han FROM v""")
def judged_terms(spark, sf_dir):
    """GLO-06, STR-27: mined renderings that clean-up would delete, and how many Chinese characters each has."""
    zh = mined(spark, sf_dir).select("zh").distinct()
    return zh.select("zh", G.is_junk(F.col("zh")).alias("junk"), T.han_count(F.col("zh")).cast("long").alias("han"))


#: Shapes of renderings and terms that the rules tell apart; {} is a word of the tables.
ZH_SHAPES = ["启动——{}", "》{}《", "她", "abc", "{}中等", "{}Ball球", "从{}上来", "从容{}", "女神{}", "名为{}", "如果{}", "触发{}", "所有的{}", "{}", "例如{}", "使{}", "使者{}", "能力", "法术", "其{}", "巨龙", "译注{}"]
EN_SHAPES = ["{}", "Old {}", "the {} of the North", "12. [[ {}", "{} Dragon", "GMC", "{}<b>", "{} (note)"]


def shaped(spark, sf_dir):
    """(pos, en, zh): the words of pages' titles, each word of each page in one of the shapes."""
    words = F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(words).alias("pos", "word")).where("word <> ''")
    han = F.translate(F.lower("word"), LATIN, HAN)
    pick = lambda shapes, k: F.element_at(F.array(*map(F.lit, shapes)), (k % len(shapes) + 1).cast("int"))
    n = F.col("page_id") * 3 + F.col("pos")
    rows = rows.select(n.cast("long").alias("n"), F.replace(pick(EN_SHAPES, F.floor(n / 5)), F.lit("{}"), F.col("word")).alias("en"), F.replace(pick(ZH_SHAPES, n), F.lit("{}"), han).alias("zh"))
    return rows.groupBy("en", "zh").agg(F.min("n").alias("pos")).select("pos", "en", "zh")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SHAPED = f"""
y AS (SELECT page_id, string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS w FROM pages),
x AS (SELECT page_id * 3 + pos AS n, w[pos + 1] AS word FROM (SELECT page_id, w, unnest(range(0, len(w))) AS pos FROM y) WHERE w[pos + 1] <> ''),
t AS (SELECT min(n)::BIGINT AS pos, en, zh FROM (SELECT n, replace({_list(EN_SHAPES)}[n // 5 % {len(EN_SHAPES)} + 1], '{{}}', word) AS en,
  replace({_list(ZH_SHAPES)}[n % {len(ZH_SHAPES)} + 1], '{{}}', translate(lower(word), '{LATIN}', '{HAN}')) AS zh FROM x) GROUP BY en, zh)"""


@query()
def glossary_clean(spark, sf_dir):
    """GLO-03 to GLO-12, GLO-18: words in all shapes, cleaned by all batches; a list passes untouched."""
    rows = shaped(spark, sf_dir).groupBy("en").agg(F.min_by("zh", "pos").alias("zh"), F.min("pos").alias("pos"))
    listed = F.col("pos") % 10 == 0
    return G.clean(rows.select("en", F.when(listed, F.array("zh", F.lit("》x"))).otherwise(F.array("zh")).alias("value"), listed.alias("is_list"), "pos")).select("en", "value", "is_list")


@query(
    f"WITH {_SHAPED}" + rf""", s AS (SELECT *, list_filter(string_split_regex(lower(trim(en)), '[ -]'), lambda x: regexp_matches(x, '^[a-z]+$') AND x NOT IN ({", ".join(f"'{w}'" for w in G.CONTENT_STOP)})) AS w, len(regexp_replace(zh, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS han FROM t),
    f AS (SELECT en, zh, 'T2_short_zh' AS "check" FROM s WHERE len(w) >= 3 AND han <= len(w) // 2 UNION ALL SELECT en, zh, 'T3_generic_tail' FROM s WHERE len(w) >= 2 AND zh IN ({", ".join(f"'{w}'" for w in G.GENERIC_TAILS)})
     UNION ALL SELECT en, zh, 'F1_fragment' FROM s WHERE len(zh) >= 2 AND ((regexp_matches(zh, '[{"".join(G.END_PARTICLES)}]$') AND han >= 3) OR (regexp_matches(zh, '^[{"".join(G.START_FRAGMENTS)}]') AND len(regexp_replace(zh[2:], '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')) >= 2))
     UNION ALL SELECT en, zh, 'F2_note' FROM s WHERE regexp_matches(zh, '^({"|".join(G.NOTE_STARTS)})|{"|".join(G.NOTES)}') UNION ALL SELECT en, zh, 'X1_book_code' FROM s WHERE regexp_replace(en, '[^A-Za-z]', '', 'g') IN ({", ".join(f"'{w}'" for w in G.BOOK_CODES)})
     UNION ALL SELECT en, zh, 'X2_artifact' FROM s WHERE regexp_matches(en || chr(10) || zh, '</?\w+>|<!--|-->|&\w+;|\{{\{{|\}}\}}|\[\[|\]\]|\|\|') UNION ALL SELECT en, zh, 'X3_english' FROM s WHERE regexp_matches(zh, '[A-Za-z]{{3,}}')
     UNION ALL SELECT DISTINCT a.en, a.zh, 'T1_suffix' FROM t a JOIN t b ON a.zh = b.zh AND suffix(lower(a.en), ' ' || lower(b.en)))
    SELECT * FROM f"""
)
def glossary_checks(spark, sf_dir):
    """GLO-13, STR-26, STR-27: words in all shapes, and every check that they fail."""
    return G.checks(shaped(spark, sf_dir).select("en", "zh"))




_VERBS = " OR ".join(f"regexp_matches(zh, '^{p}[^{''.join(ok)}]')" for p, ok in G.VERB_PREFIXES.items())


def _reasons(source: str, p: str) -> str:
    """GLO-15 in SQL: the relations that end in {p}v (en, zh, reason), of distinct rows (en, zh) of a relation."""
    return rf"""
{p}s AS (SELECT en, zh, list_filter(list_transform(string_split_regex(lower(trim(regexp_replace(en, '[（(][^）)]*[）)]?', ' ', 'g'))), '[ -]'), lambda x: regexp_replace(x, '^[^a-z]+|[^a-z]+$', '', 'g')),
    lambda x: regexp_matches(x, '^[a-z]+$') AND x NOT IN ({", ".join(f"'{w}'" for w in G.CONTENT_STOP)})) AS w, len(regexp_extract_all(zh, '[一-鿿]')) AS han FROM (SELECT DISTINCT en, zh FROM {source})),
{p}k AS (SELECT DISTINCT lower(en) AS tail, zh FROM {source}),
{p}u AS (SELECT en, zh, han, w, unnest(range(1, len(w))) AS n FROM {p}s WHERE len(w) >= 3 AND NOT regexp_matches(en, '[(（]') AND han < len(w) * 1.5),
{p}c AS (SELECT DISTINCT u.en, u.zh FROM {p}u u JOIN {p}k k ON k.zh = u.zh AND k.tail = array_to_string(w[len(w) - n + 1:], ' ')),
{p}v AS (SELECT s.en, s.zh, CASE WHEN han = 0 THEN 'R0_no_cjk' WHEN c.en IS NOT NULL THEN 'R1_truncated'
  WHEN len(string_split(s.en, ',')) < 3 AND ((len(w) >= 4 AND han < 3) OR (len(w) >= 6 AND han < 4)) THEN 'R2_too_short' WHEN len(w) >= 2 AND s.zh IN ({", ".join(f"'{w}'" for w in G.GENERIC_TAILS)}) THEN 'R3_generic_tail'
  WHEN {" OR ".join(f"starts_with(s.zh, '{x}')" for x in G.STRAY_PREFIXES)} THEN 'R4_fragment_prefix' WHEN regexp_matches(s.zh, '[A-Za-z]{{2,}}') THEN 'R5_stray_english'
  WHEN len(w) <= 1 AND ({_VERBS.replace('(zh', '(s.zh')}) THEN 'R7_verb_prefix' END AS reason FROM {p}s s LEFT JOIN {p}c c ON c.en = s.en AND c.zh = s.zh)"""


@query(f"WITH {_SHAPED}, {_reasons('t', '')} SELECT en, zh, reason FROM v")
def glossary_verify(spark, sf_dir):
    """GLO-15: words in all shapes, and the first rule that each fails."""
    return G.correspondence(shaped(spark, sf_dir).select("en", "zh"))


@query(f"""WITH {_MINED}, {_SHAPED}, {_reasons('t', 'e')},
d AS (SELECT v.en, v.zh, c.zh AS new, c.en AS other, c.count FROM ev v JOIN c ON lower(c.en) = lower(v.en) WHERE reason IS NOT NULL AND c.count >= 2 AND len(regexp_extract_all(c.zh, '[一-鿿]')) > len(regexp_extract_all(v.zh, '[一-鿿]'))),
h AS (SELECT en, new AS zh FROM d), {_reasons('h', 'z')},
i AS (SELECT d.en, first(d.new ORDER BY d.other <> d.en, d.count DESC, d.new) AS new FROM d JOIN zv ON zv.en = d.en AND zv.zh = d.new WHERE zv.reason IS NULL GROUP BY d.en)
SELECT v.en, v.zh, CASE WHEN new IS NULL THEN 'delete' ELSE 'replace' END AS decision, new AS new_zh FROM ev v LEFT JOIN i ON i.en = v.en WHERE reason IS NOT NULL""")
def replaced_terms(spark, sf_dir):
    """GLO-16, JOI-15: what becomes of each entry that fails a rule: a mined rendering, or nothing."""
    failed = G.correspondence(shaped(spark, sf_dir).select("en", "zh")).where("reason IS NOT NULL")
    wiki = mined(spark, sf_dir).groupBy("en", "zh").agg(F.count(F.lit(1)).alias("count"))
    return G.replaced(failed, wiki)


@query(f"""WITH {_SHAPED}, b AS (SELECT DISTINCT en FROM t WHERE regexp_matches(en || chr(10) || zh, '</?\\w+>|<!--|-->|&\\w+;|\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|\\|\\|') OR regexp_matches(zh, '[A-Za-z]{{3,}}'))
SELECT en, zh FROM t WHERE en NOT IN (SELECT en FROM b)""")
def validated_terms(spark, sf_dir):
    """GLO-14, UDF-06: entries without those that fail the checks that were chosen for deletion."""
    return G.validated(shaped(spark, sf_dir).select("en", "zh"), ["X2_artifact", "X3_english"]).select("en", "zh")


@query("""WITH o AS (SELECT o_orderkey, (o_custkey % 60 + 1)::INT AS pages, (o_orderkey % (o_custkey % 60 + 1) + 1)::INT AS now FROM orders),
s AS (SELECT *, list_sort(list_distinct(list_concat([1, pages], list_filter(range(now - 2, now + 3), lambda p: p >= 1 AND p <= pages)))) AS shown FROM o)
SELECT o_orderkey, array_to_string(list_transform(range(1, len(shown) + 1), lambda i: CASE WHEN i > 1 AND shown[i] - coalesce(shown[i - 1], 0) > 1 THEN '… ' ELSE '' END || shown[i]), ' ') AS pager FROM s""")
def pager_lists(spark, sf_dir):
    """WIN-07: the numbers of a pager, for a page and a number of pages made of each order's keys."""
    pages = (F.col("o_custkey") % 60 + 1).cast("int")
    now = (F.col("o_orderkey") % pages + 1).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tables.pager_numbers(now, pages).alias("p"))
    return rows.select("o_orderkey", F.array_join("p", " ", "…").alias("pager"))


@query("""WITH p AS (SELECT p_partkey, ['S', 'F', 'C', 'zz', ''][p_partkey % 5 + 1] AS code, CASE WHEN p_partkey % 2 = 0 THEN 'd' ELSE 'p' END AS k,
  'data/' || ['Spells', 'Items', 'Feats', 'Traits', 'x'][p_partkey % 7 % 5 + 1] || '-' || replace(p_name, ' ', '%20') || '.json.html' AS href FROM part)
SELECT p_partkey, CASE code WHEN 'S' THEN 'spell' WHEN 'F' THEN 'feat' WHEN 'C' THEN 'creature' ELSE CASE WHEN k = 'd' THEN CASE regexp_extract(href, '^data/([^-]*)-', 1)
  WHEN 'Spells' THEN 'spell' WHEN 'Items' THEN 'item' WHEN 'Feats' THEN 'feat' WHEN 'Traits' THEN 'trait' ELSE 'other' END ELSE 'other' END END AS type FROM p""")
def resolved_types(spark, sf_dir):
    """PRJ-19: the type of each part as an entry: by its code, else by its data file's name."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    href = F.concat(F.lit("data/"), pick(["Spells", "Items", "Feats", "Traits", "x"], k % 7 % 5), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit(".json.html"))
    kind = F.when(k % 2 == 0, "d").otherwise("p")
    return table(spark, sf_dir, "part").select("p_partkey", search.resolved_type(pick(["S", "F", "C", "zz", ""], k % 5), kind, href).alias("type"))


@query(f"""WITH m AS ({SQL['merged_terms']}) SELECT action, count(*)::BIGINT AS n FROM m GROUP BY action""")
def glossary_merge(spark, sf_dir):
    """GLO-02, AGG-19: how many terms the merge added, changed, kept and left out."""
    return merged_terms(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query()
def term_pairs(spark, sf_dir):
    """EXT-01 to EXT-07, STR-15 to STR-17: pairs out of wikitext that holds each title's words in one of the seven patterns."""
    words = F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("pageid"), F.explode(words).alias("en")).where("en rlike '^[A-Za-z]{4,}$'")
    zh = F.translate(F.lower("en"), LATIN, HAN)
    shapes = ["|title={en} {zh}", "\'\'\'{zh} {en}\'\'\'", "<b>{zh} {en}</b>", "{zh}（{en}）", "{en} ({zh})", "{{{{info\n|英文名={en}\n|中文名={zh}\n}}}}", "{zh} {{{{lang|en|{en}}}}}"]
    cells = F.array(*(F.replace(F.replace(F.lit(x.replace("{{{{", "<<").replace("}}}}", ">>")), F.lit("{en}"), F.col("en")), F.lit("{zh}"), zh) for x in shapes))
    line = F.replace(F.replace(F.element_at(cells, (F.pmod(F.xxhash64("en"), F.lit(len(shapes))) + 1).cast("int")), F.lit("<<"), F.lit("{{")), F.lit(">>"), F.lit("}}"))
    pages = rows.withColumn("line", line).groupBy("pageid").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("wikitext"))
    return G.extract_pairs(pages.select("pageid", F.lit("标题").alias("title"), "wikitext")).drop("pos")


@query()
def inline_wikitext(spark, sf_dir):
    """STR-10, STR-11: titles' words as links and templates, nested, rendered in line."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = F.concat(F.lit("[["), title, F.lit("|b]] {{tooltip|"), F.regexp_replace(title, " ", "|"), F.lit("|y {{c|"), F.substring(title, 1, 5), F.lit("}}}} [["), F.substring(title, 1, 9), F.lit("]]"))
    return table(spark, sf_dir, "pages").select("page_id", H.rendered_inline(F.when(F.col("page_id") % 7 > 0, text)).alias("html"))


# ---- Chinese runs, titles and versions made of the tables ----

#: Half of the letters: texts of both scripts.
MIXED, MIXED_HAN = LATIN[:13], HAN[:9] + "了的和在"
_MIXED = f"SELECT page_id AS i, translate(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '{MIXED}', '{MIXED_HAN}') AS s FROM pages"


def mixed(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), F.translate(F.lower(title), MIXED, MIXED_HAN).alias("s"))


@query(rf"""WITH t AS ({_MIXED}),
r AS (SELECT i, unnest(regexp_extract_all(s, '([{T.CJK}]+)', 1)) AS run FROM t),
b AS (SELECT i, unnest(CASE WHEN len(run) = 1 THEN [run] ELSE list_transform(range(1, len(run)), lambda k: run[k:k+1]) END) AS gram FROM r)
SELECT i, gram, md5(gram)[1:2] AS bucket, count(*)::BIGINT AS n FROM b WHERE NOT regexp_matches(gram, '^[{''.join(T.CHINESE_STOP)}]{{2}}$') GROUP BY ALL""")
def cjk_bigrams(spark, sf_dir):
    """STR-01 to STR-03, STR-05"""
    grams = mixed(spark, sf_dir).select("i", F.explode(T.cjk_bigrams(F.col("s"))).alias("gram"))
    return grams.groupBy("i", "gram").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", T.bigram_bucket(F.col("gram")))


@query(rf"""WITH t AS ({_MIXED})
SELECT i, list_transform(list_filter(regexp_extract_all(s, '([A-Za-z0-9][A-Za-z0-9_''-]*)', 1), lambda x: len(x) >= 2), lambda x: lower(x)) AS latin,
  flatten(list_transform(regexp_extract_all(s, '([{T.CJK}]+)', 1), lambda r: CASE WHEN len(r) = 1 THEN [r] ELSE list_transform(range(1, len(r)), lambda k: r[k:k+1]) END)) AS cjk FROM t""")
def parse_query(spark, sf_dir):
    """STR-07"""
    return mixed(spark, sf_dir).select("i", T.query_tokens(F.col("s")).alias("q")).select("i", "q.latin", "q.cjk")


@query(r"""WITH t AS (SELECT CASE page_id % 5 WHEN 1 THEN 3500 WHEN 2 THEN 14 WHEN 4 THEN 102 ELSE 0 END AS ns, CASE page_id % 5 WHEN 0 THEN 'Data:' || url WHEN 1 THEN 'Data:Spells-' || url || '.json' WHEN 2 THEN '分类:' || url ELSE url END AS title FROM pages),
b AS (SELECT *, CASE WHEN split_part(title, ':', 1) IN (""" + ", ".join(f"'{p}'" for p in T.KNOWN_PREFIXES) + r""") AND contains(title, ':') THEN regexp_replace(title, '^[^:]*:', '') ELSE title END AS bare FROM t)
SELECT title, bare, CASE ns WHEN 4 THEN 'project' WHEN 14 THEN 'category' WHEN 3500 THEN 'data' ELSE 'pages' END || '/' || url_encode(regexp_replace(replace(replace(bare, ':', '_'), '/', '__'), '[*?"<>|]', '', 'g')) || '.html' AS href FROM b""")
def page_hrefs(spark, sf_dir):
    """PRJ-02, PRJ-03, STR-32: hrefs of the pages' URLs, as titles of several namespaces."""
    k, url = F.col("page_id") % 5, F.col("url")
    ns = F.when(k == 1, 3500).when(k == 2, 14).when(k == 4, 102).otherwise(0)
    title = F.when(k == 0, F.concat(F.lit("Data:"), url)).when(k == 1, F.concat(F.lit("Data:Spells-"), url, F.lit(".json"))).when(k == 2, F.concat(F.lit("分类:"), url)).otherwise(url)
    return table(spark, sf_dir, "pages").select(title.alias("title"), T.bare_title(title).alias("bare"), T.page_href(ns, title).alias("href"))


@query("SELECT list(p_name || p_partkey ORDER BY p_partkey) AS steps, count(*)::INT AS n_steps, round(sum(p_retailprice), 2) AS size_mb FROM part WHERE p_partkey < 40")
def version_chain(spark, sf_dir):
    """GRF-04, AGG-23, PRJ-28: a chain of forty steps among the hops that all parts make."""
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    hops = table(spark, sf_dir, "part").select(name(k).alias("from_version"), name(k + 1).alias("to_version"), F.concat("p_name", k.cast("string")).alias("url"), F.col("p_retailprice").alias("size_mb"))
    return graph.version_chain(hops, "v0", "v40")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'v' || o_orderkey % 3 || '.' || o_orderkey % 13 || '.' || o_orderkey % 7 END AS a, o_custkey % 3 || '.' || o_custkey % 13 || '.' || o_custkey % 7 AS b FROM orders)
SELECT o_orderkey, a, b, CASE WHEN a = 'x' THEN NULL ELSE sign(list_sum(list_transform([1, 2, 3], lambda i: sign(split_part(ltrim(a, 'v'), '.', i)::INT - split_part(b, '.', i)::INT) * [100, 10, 1][i])))::INT END AS compared FROM t""")
def semver_compare(spark, sf_dir):
    """PRJ-23, FLT-29: versions made of all orders' and customers' keys."""
    three = lambda k: F.concat_ws(".", *((F.col(k) % n).cast("string") for n in (3, 13, 7)))
    a = F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.concat(F.lit("v"), three("o_orderkey")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), three("o_custkey").alias("b"))
    x, y = T.semver(F.col("a")), T.semver(F.col("b"))
    return rows.select("o_orderkey", "a", "b", F.when(x > y, 1).when(x < y, -1).when(x == y, 0).alias("compared"))

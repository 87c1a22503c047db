"""Queries over texts without blanks, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases
from .queries import query, table

_CLOSED = ", ".join(f"('{w}', '{t}')" for t, words in phrases.CLOSED.items() for w in words)
_TRAILING, _CONTENT = "".join(phrases.TRAILING), "".join(t for t in phrases.CONTENT if len(t) == 1)


@query(f"""
WITH RECURSIVE p AS (SELECT lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(title, ' ')) AS word FROM p) WHERE word <> '' GROUP BY word HAVING count(*) > 1),
k AS (SELECT word, min(tag) AS tag FROM (VALUES {_CLOSED}) v(word, tag) GROUP BY word),
l AS (SELECT coalesce(c.word, k.word) AS word, coalesce(k.tag, 'n') AS tag, coalesce(n, 1) AS n FROM c FULL JOIN k ON c.word = k.word),
x AS (SELECT word, tag, round(ln((SELECT sum(n) FROM l)::DOUBLE / n) * 1000)::BIGINT AS cost FROM l),
t AS (SELECT DISTINCT replace(title, ' ', '') AS text FROM p WHERE replace(title, ' ', '') <> ''),
a AS (SELECT text, unnest(range(0, len(text))) AS start FROM t),
s AS (SELECT text, start, unnest(range(1, least((SELECT max(len(word)) FROM x), len(text) - start) + 1)) AS long FROM a),
e AS (SELECT text, start + long AS stop, struct_pack(start := start, cost := coalesce(cost, 20000), tag := coalesce(tag, 'x')) AS edge
      FROM s LEFT JOIN x ON x.word = substr(text, start + 1, long) WHERE cost IS NOT NULL OR long = 1),
g AS (SELECT text, stop, list(edge) AS edges FROM e GROUP BY text, stop),
r(text, stop, best) AS (SELECT text, 0::BIGINT, [struct_pack(cost := 0::BIGINT, start := 0::BIGINT, tag := '')] FROM t
  UNION ALL SELECT r.text, g.stop, list_append(best, list_sort(list_transform(edges, lambda q: struct_pack(cost := best[q.start + 1].cost + q.cost, start := q.start, tag := q.tag)))[1])
  FROM r JOIN g ON g.text = r.text AND g.stop = r.stop + 1),
b(text, stop, best, words, tags) AS (SELECT text, stop, best, []::VARCHAR[], '' FROM r WHERE stop = len(text)
  UNION ALL SELECT text, best[stop + 1].start, best, list_prepend(substr(text, best[stop + 1].start + 1, stop - best[stop + 1].start), words), best[stop + 1].tag || tags FROM b WHERE stop > 0),
f AS (SELECT text, words, tags, len(regexp_extract(tags, '[{_TRAILING}]*$')) AS behind, len(regexp_extract(tags, '([{_CONTENT}]+)[{_TRAILING}]*$', 1)) AS own FROM b WHERE stop = 0),
h AS (SELECT *, array_to_string(words[len(words) - behind - own + 1:len(words) - behind], '') AS phrase FROM f)
SELECT text, array_to_string(words, ' ') AS words, tags, CASE WHEN len(text) > 4 AND own > 0 AND len(phrase) >= 2 THEN phrase ELSE text END AS phrase FROM h
""")
def trailing_phrases(spark, sf_dir):
    """STR-19: pages' titles without their blanks, segmented by the words that come up twice in titles, and the phrase that each ends in."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    titles = table(spark, sf_dir, "pages").select(title.alias("title"))
    counts = titles.select(F.explode(F.split("title", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = titles.select(F.replace("title", F.lit(" "), F.lit("")).alias("text"))
    found = phrases.segmented(texts, phrases.lexicon(counts))
    shown, tags = F.array_join(F.transform("words", lambda w: w["word"]), " "), F.array_join(F.transform("words", lambda w: w["tag"]), "")
    return found.select("text", shown.alias("words"), tags.alias("tags"), phrases.trailing_phrase(F.col("text"), F.col("words")).alias("phrase"))

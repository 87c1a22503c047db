"""Queries over postings in blocks, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, search
from ..sources.shared import new_path
from .queries import ITEMS_SQL, _search_sql, documents_as_pages, query

_POP = "(len(title) * 13 % 29)"
_OWN = f"least(20, round(log2(1.0 + {_POP}) * 3))::INT + 5"


def _index(spark, sf_dir) -> blocks.BlockIndex:
    """The documents' index, written to the shared folder and read back. Popularity stands in for links: a number made of the title."""
    pages = documents_as_pages(spark, sf_dir)
    popularity = pages.select("title", (F.length("title") * 13 % 29).alias("inlinks")).distinct()
    path = new_path(spark, "blocks")
    blocks.BlockIndex.build(search.entries(pages, popularity)).write(path)
    return blocks.BlockIndex.read(spark, path)


def _top_sql(text: str, words: list[str], limit: int) -> str:
    """The whole ranking in SQL, with popularity and without a total."""
    sql = _search_sql(text, words, limit)
    for old, new in (
        ("ELSE tier END) + 5)::INT AS score, (count(*) OVER ())::BIGINT AS total", f"ELSE tier + least(20, round(log2(1.0 + {_POP}) * 3))::INT END) + 5)::INT AS score, {_POP}::BIGINT AS pop"),
        ("ORDER BY score DESC, id LIMIT", "ORDER BY score DESC, pop DESC, id LIMIT"),
    ):
        assert old in sql
        sql = sql.replace(old, new)
    return sql


def _top(spark, sf_dir, text: str, limit: int):
    return _index(spark, sf_dir).top(text, limit).select("id", "title", "excerpt", "score", "pop")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT id, (row_number() OVER (ORDER BY {_OWN} DESC, {_POP} DESC, id) - 1)::BIGINT AS place FROM items),
p AS (SELECT token, place, place // 4096 AS block FROM posts JOIN r USING (id))
SELECT token, block, min(place) AS low, max(place) AS high, count(*)::INT AS n, list((place % 4096)::INT ORDER BY place) AS offsets FROM p GROUP BY token, block""")
def posting_blocks(spark, sf_dir):
    """SRC-23, AGG-01, SNK-04 to SNK-07: postings in blocks of ranked places, written and read back."""
    return _index(spark, sf_dir).blocks.where("kind = 'w'").select("token", "block", "low", "high", "n", "offsets")


@query(_top_sql("the thing", ["the", "thing"], 50))
def search_top(spark, sf_dir):
    """RNK-01, RNK-09, SRT-01: the best of a query of common words, without ranking all hits."""
    return _top(spark, sf_dir, "the thing", 50)


@query(_top_sql("zu", ["zu"], 200))
def search_top_titles(spark, sf_dir):
    """RNK-01, RNK-07, SET-04: matching titles before all others."""
    return _top(spark, sf_dir, "zu", 200)

import re

import pytest

from scriptorium.operators import render

PAGES = "pageid long, ns int, title string, html string, categories array<string>"


def of(spark, rows):
    index = spark.createDataFrame([("Fire ball", "pages", "Fire ball"), ("分类:法术", "category", "法术"), ("Data:X.json", "data", "X.json")], "key string, dir string, fn string")
    redirects = spark.createDataFrame([("Ball", "Fire ball"), ("Loop", ""), ("Gone", "Nowhere")], "src string, tgt string")
    manifest = spark.createDataFrame([("/img/a.png", "assets/a.webp")], "url string, path string")
    out = render.rendered(spark.createDataFrame(rows, PAGES), redirects, index, manifest)
    return {r.pageid: (r.path, r.content) for r in out.collect()}


@pytest.mark.parametrize("html,want", [
    ('x <a href="/wiki/Fire_ball#top">b</a> y', 'x <a href="../pages/Fire%20ball.html#top">b</a> y'),
    ('<a class="k" href="/wiki/Ball">b</a>', '<a class="k" href="../pages/Fire%20ball.html">b</a>'),
    ('<a href="/wiki/Gone">b</a>', '<a href="../pages/Gone.html" class="new">b</a>'),
    ('<a class="k" href="/index.php?title=Data:Y&amp;x=1">b</a>', '<a class="k new" href="../data/Y.html">b</a>'),
    ('<a class="new" href="/wiki/%E7%81%AB">b</a>', '<a class="new" href="../pages/%E7%81%AB.html">b</a>'),
    ('<a href="/wiki/File:a.png"><img src="/img/a.png"></a><a href="#s">t</a>', '<img loading="lazy" src="../assets/a.webp"><a href="#s">t</a>'),
    ('<a href="https://wiki.example.org/i?action=edit">edit</a> <a href="/wiki/Ball">b</a>', 'edit <a href="../pages/Fire%20ball.html">b</a>'),
    ('<a href="http://x.org/">x</a>', '<a href="http://x.org/" rel="noopener external" target="_blank">x</a>'),
    ('<a href="mailto:x">x</a><!-- <a href="/wiki/Ball"> -->', '<a href="mailto:x">x</a>'),
    ("no tags at all", "no tags at all"), ("", ""), (None, ""),
])
def test_links_and_images(spark, html, want):
    path, content = of(spark, [(1, 0, "A/B & <c>", html, None)])[1]
    assert path == "pages/A__B & c.html"
    assert re.search("<main>(.*)</main>", content, re.S)[1] == f'<div class="mw-parser-output">{want}</div>'
    assert "<title>A/B &amp; &lt;c&gt;</title>" in content


def test_categories_and_notices(spark):
    notice = '<div class="mw-parser-output"><div class="redirectMsg"><p>to <a href="/wiki/{}">x</a></p></div></div>'
    out = of(spark, [(1, 14, "分类:法术", notice.format("Ball"), ["法术", "没_有", "", None]), (2, 0, "G", notice.format("Gone"), []), (3, 3500, "Data:X.json", "y", ["X.json"])])
    assert '<meta http-equiv="refresh" content="0; url=../pages/Fire%20ball.html">' in out[1][1] and "refresh" not in out[2][1]
    assert out[1][0] == "category/法术.html"
    assert '<ul><li><a href="../category/%E6%B3%95%E6%9C%AF.html">法术</a></li><li><span class="new">没 有</span></li></ul>' in out[1][1]
    assert out[1][1].count("mw-parser-output") == 1 and "page-categories" not in out[2][1]
    assert out[3][0] == "data/X.json.html"


def test_a_page_of_many_links_keeps_their_order(spark):
    n = 20_000
    html = " ".join(f'<a href="/wiki/{"Ball" if i % 3 else "Dead"}#{i}">{i}</a>' for i in range(n))
    content = of(spark, [(1, 0, "Big", html, []), (2, 0, "Small", "s", [])])[1][1]
    assert re.findall(r'#(\d+)"[^>]*>(\d+)</a>', content) == [(str(i), str(i)) for i in range(n)]

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import browse, site
from scriptorium.operators import glossary as G
from scriptorium.sources import fetch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_browse(spark):
    pages = spark.createDataFrame([(0, 1, "火球", ["法术"]), (0, 2, "火球", ["法术"]), (0, 3, "剑", ["基础武器", "物品"]), (14, 4, "分类:法术", ["物品"]), (0, 5, "Orc", ["中型"])], "ns int, pageid long, title string, categories array<string>")
    listed = browse.buckets(pages)
    assert sorted(map(tuple, listed.collect())) == [("creatures", "Orc", 5), ("items", "剑", 3), ("spells", "火球", 1)]
    assert {r.bucket: r.letters for r in browse.bucket_sizes(listed).collect()} == {"creatures": ["O"], "items": ["CJK"], "spells": ["CJK"]}
    records = spark.createDataFrame([(9, "Spells", "火球", {"根源": "奥术、原能", "法术分类": "聚能"}), (8, "Creatures", "Orc", {"等级": "5"}), (7, "Items", "无", {"物品分类": "药水"})], "pageid long, kind string, name string, fields map<string,string>")
    zones = browse.zone_members(records, listed)
    assert sorted((r.zone, r.name) for r in zones.collect()) == [("creatures-level-4-7", "Orc"), ("spells-arcane", "火球"), ("spells-focus", "火球"), ("spells-primal", "火球")]
    assert {r.bucket: (r.total, r.covered) for r in browse.coverage(zones, listed).collect()} == {"creatures": (1, 1), "items": (1, 0), "spells": (1, 1)}
    assert browse.enriched(listed, records).where("title = 'Orc'").head().fields == {"等级": "5"}
    on_disk = spark.createDataFrame([("法术",), ("物品",)], "category string")
    assert sorted(r.category for r in browse.category_universe(pages, on_disk).collect()) == ["法术", "物品"]
    assert browse.category_summary(pages, 1).head().category == "法术"
    assert one(spark, browse.keyword_buckets(F.array(F.lit("法术")), F.lit("Feat list"))) == ["feats", "spells"]
    members = spark.createDataFrame([("c", "", "beta"), ("c", "alpha", "x"), ("c", None, "乙")], "category string, sortkey string, title string")
    assert {r.letter: [m.title for m in r.members] for r in browse.member_listing(members).collect()} == {"A": ["x"], "B": ["beta"], "乙": ["乙"]}


def test_page_parts(spark):
    sections = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(ln).alias("line"), F.lit(a).alias("anchor")) for lv, ln, a in [("2", "<i>A</i>", "a"), ("3", "B", "b"), ("4", "C", "c"), ("x", "D", "d"), ("2", "E", "e")]])
    assert [s["line"] for s in one(spark, site.contents(sections, F.lit(2000)))] == ["A", "B", "E"]
    assert one(spark, site.contents(sections, F.lit(100))) is None
    assert one(spark, site.lazy_images(F.lit('<img src="a"><img loading="eager">'))) == '<img loading="lazy" src="a"><img loading="eager">'
    assert one(spark, site.image_extension(F.lit("http://x/a.JPEG?b"), F.lit(""))) == "jpg" and one(spark, site.image_extension(F.lit("http://x/a"), F.lit("image/png"))) == "png"
    assert one(spark, site.missing_query(F.lit("http://h/pages/%E7%81%AB+.html"))) == "火+" and one(spark, site.missing_query(F.lit("http://h/x?q=abc"))) == "abc"
    assert one(spark, site.site_path(F.lit("http://h/a/site/pages/x.html?y"))) == "pages/x.html" and one(spark, site.site_path(F.lit("/q/r.html"))) == "r.html" and one(spark, site.site_path(F.lit("/q/data/r.html"))) == "data/r.html"
    assert one(spark, site.tooltip(F.lit("a||b"))) == "a · b" and one(spark, site.is_edit_link(F.lit("/w?action=edit")))
    page = site.rendered(spark.createDataFrame([(0, "火:球", '<p>x<img src="i"></p>')], "ns int, title string, html string")).head()
    assert page.path == "pages/火_球.html" and 'loading="lazy"' in page.content and "ns-0" in page.content
    stubs = site.dead_stubs(spark.createDataFrame([("pages/a.html",), ("pages/b.png.html",)], "target string"), spark.createDataFrame([("pages/a.html", "../x.html", "A")], "target string, url string, label string"))
    assert {r.target: (r.url, r.label) for r in stubs.collect()} == {"pages/a.html": ("../x.html", "A"), "pages/b.png.html": ("../search.html?q=b", "b [pages]")}
    todo = site.images_todo(spark.createDataFrame([("a",), ("b",), ("c",)], "title string"), spark.createDataFrame([("a", False), ("b", True)], "title string, missing boolean"))
    assert sorted(r.title for r in todo.collect()) == ["b", "c"]


def test_terms(spark):
    assert one(spark, G.trimmed(F.lit("如果火球"))) == "火球" and one(spark, G.trimmed(F.lit("如果火"))) == "如果火"
    pairs = [("Fireball", "火球术", True), ("AB 12", "火球", False), ("1. Foo bar", "火球", False), ("Foo bar", "的火球", False), ("Foo bar", "火|球", False)]
    assert [one(spark, G.plausible(F.lit(e), F.lit(z))) for e, z, _ in pairs] == [w for _, _, w in pairs]
    assert one(spark, T.escaped_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"


def test_fetch(spark):
    pauses, calls = [], []

    def get(key):
        calls.append(key)
        if key == "refused":
            raise fetch.Refused("403")
        if key == "busy" and calls.count("busy") < 3:
            raise fetch.Throttled(3)
        if key == "broken":
            raise OSError("x" * 600)
        return key.upper()

    assert fetch.attempt(get, "a", sleep=pauses.append) == ("ok", "A", None)
    assert fetch.attempt(get, "refused", sleep=pauses.append)[0] == "fail" and calls.count("refused") == 1
    assert fetch.attempt(get, "busy", sleep=pauses.append)[0] == "ok" and pauses == [3, 3]
    assert len(fetch.attempt(get, "broken", sleep=pauses.append)[2]) == 500 and pauses[2:] == [1, 2, 4]
    out = fetch.fetch(spark.createDataFrame([("a",), ("b",)], "key string"), lambda k: k * 2, workers=2)
    assert sorted((r.key, r.answer) for r in out.collect()) == [("a", "aa"), ("b", "bb")]
    edges = fetch.resolved_edges(spark.createDataFrame([("a_b", ""), ("k", "v")], "src string, tgt string"), spark.createDataFrame([("a_b", "a b")], "from string, to string"), spark.createDataFrame([("a b", "t")], "src string, tgt string"))
    assert sorted(map(tuple, edges.collect())) == [("a b", "t"), ("a_b", "t"), ("k", "v")]

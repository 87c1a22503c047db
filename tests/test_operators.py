"""Cases whose results are known by hand."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import html as H
from scriptorium.functions import text as T
from scriptorium.operators import glossary as G
from scriptorium.operators import graph, search, snapshots, tables
from scriptorium.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_scores(spark):
    rows = [(0, "火球术", "p", "Fireball", 0), (1, "Data:Spells-Fireball.json", "d", None, 0), (2, "other", "p", None, 68), (3, "more", "p", None, 0)]
    items = spark.createDataFrame(rows, "id long, title string, kind string, name string, pop long").withColumn("href", F.lit("")).withColumn("type", F.lit("O")).withColumn("excerpt", F.lit(""))
    score = lambda q: {r.id: r.score for r in search.rank(items, q).collect()}
    assert score("火球术")[0] == 1002
    assert [score("Fireball")[i] for i in range(4)] == [902, -75, 23, 5]


def test_popularity_boost():
    assert [search.Engine.boost(p) for p in (0, 1, 3, 17, 68, 523)] == [0, 3, 6, 13, 18, 20]


def test_buckets(spark):
    want = {"法师": "71", "治疗": "29", "巨龙": "2e", "挥砍": "7f", "火球": "42", "球术": "de"}
    assert {k: one(spark, T.bigram_bucket(F.lit(k))) for k in want} == want


def test_title_matcher(spark):
    rows = [("属性:ac", True), ("owb pact", False), ("sack", False), ("act of war", True)]
    assert [one(spark, T.title_matches(F.lit(t), "ac")) for t, _ in rows] == [x for _, x in rows]


def test_types(spark):
    rows = [("Data:Spells-X.json", [], "S"), ("短", ["法术"], "U"), ("长" * 2, ["状态", "法术"], "S"), ("长" * 3, ["无"], "O")]
    df = spark.createDataFrame([(t, c, len(t) == 1, w) for t, c, w in rows], "t string, c array<string>, s boolean, w string")
    assert all(r.got == r.w for r in df.select("w", search.type_code(F.col("t"), F.col("c"), F.col("s")).alias("got")).collect())


def test_english_name(spark):
    df = spark.createDataFrame([("火球术", "火球术 Fireball - 法术", "p", "Fireball"), ("火球术", "别的 Fireball", "p", None), ("甲", "甲 Armor", "d", None)], "t string, b string, k string, w string")
    assert all(r.w == r.got for r in df.select("w", search.english_name(F.col("t"), F.col("b"), F.col("k")).alias("got")).collect())


def test_index_round_trip_and_aliases(spark, tmp_path):
    pages = spark.createDataFrame([(0, i, t, b, ["c"]) for i, (t, b) in enumerate([("护甲", "护甲 Armor is worn " * 9), ("火球术", "火球术 Fireball burns " * 9), ("Template:x", "skip"), ("短", "short")])], "ns int, pageid long, title string, body string, categories array<string>")
    items = search.entries(pages)
    assert sorted(r.id for r in items.collect()) == [0, 1, 2]
    both = search.with_aliases(items, spark.createDataFrame([("AC", "护甲"), ("护甲", "火球术"), ("none", "gone")], "alias string, target string"))
    alias = both.where("title = 'AC'").head()
    assert alias.excerpt == "重定向 → 护甲" and alias.id == 3
    engine = search.Engine(both, search.posting_rows(both))
    engine.write(str(tmp_path / "index"))
    again = search.Engine.read(spark, str(tmp_path / "index"))
    assert [r.title for r in again.search("Fireball").collect()] == ["火球术"] == [r.title for r in engine.search("fire").collect()]
    plan = again.search("Fireball 火球")._jdf.queryExecution().toString()
    assert "(bucket" in plan.split("PartitionFilters: [", 1)[1] and "= f)" in plan and "= w)" in plan
    assert [r.title for r in again.search("AC").collect()] == ["AC"] and again.search("!").count() == 0
    assert search.manifest(items, search.postings(items)).head().entries == 3
    assert search.best_match(again.search("AC")).count() == 1 and search.by_type(again.search("AC")).head().n == 1


def test_chase(spark):
    edges = [("A", "B"), ("B", "C"), ("S", "S"), ("E", ""), ("x0", "x1"), ("p", "q"), ("q", "p")] + [(f"x{i}", f"x{i + 1}") for i in range(1, 12)]
    out = {r.start: (r.final, r.cycle) for r in graph.chase(spark.createDataFrame(edges, "src string, tgt string")).collect()}
    assert out["A"] == ("C", False) and out["S"] == ("S", True) and out["E"] == ("E", False) and out["x0"] == ("x9", False) and out["p"] == ("q", True)


def test_canonical_target_and_lookup(spark):
    edges = spark.createDataFrame([("old", "Sword_(item)"), ("far", "gone")], "src string, tgt string")
    rendered = spark.createDataFrame([("Sword（专长）",)], "title string")
    out = graph.canonical_target(graph.redirect_candidates(edges, ["专长", "法术"]), edges, rendered)
    assert [tuple(r) for r in out.collect()] == [("old", "Sword（专长）")]
    table = spark.createDataFrame([("File:a.png", "1"), ("a.png", "2")], "key string, value string")
    found = graph.lookup_variants(spark.createDataFrame([("a.png",), ("b.png",)], "name string"), table, F.array(F.col("name"), F.concat(F.lit("File:"), "name")))
    assert {r.name: r.value for r in found.collect()} == {"a.png": "2", "b.png": None}


def test_version_chain(spark):
    hops = spark.createDataFrame([("a", "b", "u1", 1.5), ("b", "c", "u2", None)], "from_version string, to_version string, url string, size_mb double")
    assert graph.version_chain(hops, "a", "c").head().steps == ["u1", "u2"]
    assert graph.version_chain(hops, "a", "z").count() == 0 and graph.version_chain(hops, "c", "c").count() == 0


def test_titles_links_and_stubs(spark):
    pages = spark.createDataFrame([(14, "Category:武器", "category", "武器", "武器", 1), (0, "武器", "pages", "武器", "武器", 2), (3500, "Data:T-Spirit", "data", "T-Spirit", "T-Spirit", 3), (3500, "Data:T-spirit", "data", "T-spirit", "T-spirit", 4)], "ns int, title string, dir string, bare string, fn string, ord int")
    index = graph.title_index(pages, {0: 0, 14: 1})
    at = {r.key: (r.dir, r.fn) for r in index.collect()}
    assert at["武器"] == ("pages", "武器") and at["Category:武器"][0] == "category" and at["T-spirit"][1].startswith("T-spirit~")
    links = graph.resolve_links(spark.createDataFrame([("兵器",), ("武器",), ("无",)], "title string"), spark.createDataFrame([("兵器", "武器"), ("无", "")], "src string, tgt string"), index)
    assert {r.title: r.path for r in links.collect()} == {"兵器": "pages/武器", "武器": "pages/武器", "无": None}
    stubs = graph.stub_chains(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "z")], "src string, tgt string")).head()
    assert (stubs.self_loops, stubs.stub_to_stub) == (1, 1)


def test_sorts(spark):
    df = spark.createDataFrame([(0, "10"), (1, "2"), (2, ""), (3, "1,000"), (4, "x")], "i int, v string")
    order = lambda d: [r.i for r in d.collect()]
    assert order(tables.majority_numeric_sort(df, "v", "i")) == [1, 0, 3, 2, 4]
    assert order(tables.majority_numeric_sort(df, "v", "i", descending=True)) == [3, 0, 1, 2, 4]
    assert order(tables.typed_sort(df, "v", "i", numeric=True, descending=True)) == [2, 4, 3, 0, 1]
    assert order(tables.typed_sort(spark.createDataFrame([(0, "a10"), (1, "a2")], "i int, v string"), "v", "i", numeric=False)) == [1, 0]
    assert tables.pager(5, 9) == [1, None, 3, 4, 5, 6, 7, None, 9] and tables.pager(1, 1) == [1]
    assert order(tables.page(df, [F.col("i").asc()], 9, 2)) == [4]


def test_levels(spark):
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in (-1, 0, 1, 2, 10, 20, 21, None)], "v int").select("v", T.level_bucket(F.col("v")).alias("b")).collect()}
    assert got == {-1: None, 0: "0-1", 1: "0-1", 2: "2-5", 10: "6-10", 20: "16-20", 21: "21+", None: None}


CLEANED = [
    ("启动——星辉变身", "星辉变身"), ("》书卷《", "书卷"), ("所有野兽", "野兽"), ("启动安全地带", "安全地带"), ("从山丘来", "山丘来"), ("从容不迫", "从容不迫"), ("由于风暴", "由于风暴"), ("女神萨恩莱", "萨恩莱"), ("名为阿尔法", "阿尔法"), ("如果这样", "如果这样"), ("如风剑客", "风剑客"), ("启动", "启动"),
]


def test_cleaning(spark):
    rows = spark.createDataFrame([(f"k{i}", [z], False, i) for i, (z, _) in enumerate(CLEANED)] + [("list", ["启动——甲", "乙"], True, 99), ("junk", ["她"], False, 100), ("latin", ["abc"], False, 101)], G.GLOSSARY)
    out = {r.en: r.value for r in G.clean(rows).collect()}
    assert {f"k{i}": [w] for i, (_, w) in enumerate(CLEANED)} | {"list": ["启动——甲", "乙"]} == out


def test_key_cleanup(spark):
    rows = spark.createDataFrame([("76. [[ Antler", ["鹿角小屋"], False, 0), ("Antler", ["鹿角"], False, 1), ("– Recall]]", ["回忆"], False, 2), ("Same", ["甲乙"], False, 3), ("1. Same", ["丙丁"], False, 4)], G.GLOSSARY)
    assert {r.en: r.value for r in G.rename_keys(rows).collect()} == {"Antler": ["鹿角小屋"], "Recall": ["回忆"], "Same": ["甲乙"]}


def test_merge(spark):
    base = spark.createDataFrame([("Fireball", ["火焰球"], False, 0), ("Dragon", ["龙"], False, 1), ("Wind", ["风"], False, 2)], G.GLOSSARY)
    stats = [("fireball", "火球术", 9, ["B_triple_bold"], {"火球": 4}, 0), ("Dragon", "巨龙", 2, ["D_paren"], {}, 1), ("WIND", "风", 8, ["D_paren"], {}, 2), ("Sword", "长剑", 1, ["D_paren"], {"剑": 1}, 3), ("sword", "长剑", 3, ["A_title_field"], {}, 4), ("when it falls", "落下", 5, ["D_paren"], {}, 5), ("Bad", "的", 5, ["D_paren"], {}, 6)]
    stats = spark.createDataFrame(stats, "en string, zh string, count long, sources array<string>, alternatives map<string,bigint>, pos long")
    out = {r.en: (r.value, r.is_list, r.action) for r in G.merge(base, stats).collect() if r.value}
    assert out["Fireball"] == (["火球术", "火球", "火焰球"], True, "made_list")
    assert out["Dragon"] == (["龙"], False, "kept") and out["Wind"] == (["风"], False, "kept") and out["Sword"] == (["长剑"], False, "added_scalar")


def test_extraction(spark):
    wikitext = [
        (1, "火球术", "|title=Aeon Stone 光阴石\n'''火球术 Fireball''' and <b>火球术 Fireball</b>"), (2, "法师", "这里有火球术（Fireball）和 Magic Missile（魔法飞弹）"),
        (3, "巨龙", "{{info\n|英文名=Dragon\n|中文名=巨龙\n}} 红龙 {{lang|en|Red Dragon}}"), (4, "空", "nothing here"),
    ]
    got = {(r.tag, r.en, r.zh) for r in G.extract_pairs(spark.createDataFrame(wikitext, "pageid long, title string, wikitext string")).collect()}
    assert {("A_title_field", "Aeon Stone", "光阴石"), ("B_triple_bold", "Fireball", "火球术"), ("D_paren_ZHopenEN", "Fireball", "这里有火球术"), ("D_paren_ENopenZH", "Magic Missile", "魔法飞弹"), ("E_infobox_field", "Dragon", "巨龙"), ("F_lang_template", "Red Dragon", "红龙")} == got
    assert not any(t == "C_html_bold" for t, _, _ in got)


def test_term_stats(spark):
    rows = [("Fire", "火", "A", 0), ("Fire", "焰", "B", 1), ("Fire", "焰", "B", 2), ("Ice", "冰", "A", 0), ("Ice", "雪", "A", 1)]
    out = {r.en: r for r in G.term_stats(spark.createDataFrame(rows, "en string, zh string, tag string, pos int")).collect()}
    assert out["Fire"].zh == "焰" and out["Fire"].alternatives == {"火": 1} and out["Ice"].zh == "冰"


def test_correspondence(spark):
    rows = [("a", None), ("Old Red Dragon", "巨龙"), ("Dragon", "巨龙"), ("one two three four", "短词"), ("two words", "法术"), ("x", "之上"), ("y", "火ab球"), ("fly", "使飞行"), ("user", "使者"), ("fine", "很好的")]
    out = {r.en: r.reason for r in G.correspondence(spark.createDataFrame(rows, "en string, zh string")).collect()}
    assert out == {"a": "R0_no_cjk", "Old Red Dragon": "R1_truncated", "Dragon": None, "one two three four": "R2_too_short", "two words": "R3_generic_tail", "x": "R4_fragment_prefix", "y": "R5_stray_english", "fly": "R7_verb_prefix", "user": None, "fine": None}
    failed = spark.createDataFrame([("Old Red Dragon", "巨龙"), ("gone", "无")], "en string, zh string")
    wiki = spark.createDataFrame([("old red dragon", "老红龙兽", 3), ("Old Red Dragon", "龙", 9)], "en string, zh string, count long")
    assert {r.en: (r.decision, r.new_zh) for r in G.replaced(failed, wiki).collect()} == {"Old Red Dragon": ("replace", "老红龙兽"), "gone": ("delete", None)}


def test_html():
    assert H.text_of('<p>a<b>b</p><script>"</p>"</script><style>x</style><!-- c --> d &amp; e<br>f') == "a b d & e f"
    assert H.text_of('<div class="licensebox"><p>no</p></div><p>yes</p>', frozenset({"licensebox"})) == "yes"
    assert H.inline("[[A|b]] {{t|x{{u|y}}}}") == '<a href="A">b</a> xy'


def test_data_record(spark):
    html = '<tr><th>等级</th><td class="mw-jsonconfig-value">"3"</td></tr><tr><th>等级</th><td class="mw-jsonconfig-value">4</td></tr>'
    assert one(spark, H.data_record(F.lit(html))) == {"等级": "4"}


def test_readers(spark, tmp_path):
    root = tmp_path / "parsed"
    (root / "ab").mkdir(parents=True)
    good = {"pageid": 1, "ns": 0, "title": "t", "captured_at": "2026-01-01T00:00:00Z", "parse": {"text": "<p>x</p>", "categories": [{"category": "c_d", "sortkey": ""}]}}
    (root / "ab/1.json").write_text(json.dumps(good))
    (root / "ab/2.json").write_text("{broken")
    (root / "ab/3.json").write_text(json.dumps(good | {"pageid": 3, "parse": {"text": ""}}))
    (root / "ab/_4.json").write_text(json.dumps(good | {"pageid": 4}))
    assert [r.pageid for r in readers.parsed_pages(spark, str(root)).collect()] == [1]
    (tmp_path / "g.json").write_text(json.dumps({"b": "乙", "a": ["甲", "丙"]}, ensure_ascii=False))
    assert [(r.en, r.value, r.is_list) for r in readers.glossary(spark, str(tmp_path / "g.json")).orderBy("pos").collect()] == [("b", ["乙"], False), ("a", ["甲", "丙"], True)]
    (tmp_path / "t.txt").write_text("# no\n\n a \n")
    assert [r.name for r in readers.targets(spark, str(tmp_path / "t.txt")).collect()] == ["a"]
    (tmp_path / "m.json").write_text(json.dumps({"pages": [{"pageid": 1, "ns": 0, "title": "t", "is_redirect": False}, {"pageid": 2, "ns": 0, "title": "u", "is_redirect": False}], "redirect_map": {"a": "", "b": "t"}}))
    meta, edges = readers.metadata(spark, str(tmp_path / "m.json"))
    assert [r.pageid for r in readers.missing_pages(meta, readers.parsed_pages(spark, str(root))).collect()] == [2] and edges.count() == 2
    assert readers.file_digests(spark, str(root)).count() == 3


def test_continued_source(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"rows": [{"pageid": 1, "ts": "1"}], "continue": "next"}))
    (tmp_path / "next.json").write_text(json.dumps({"rows": [{"pageid": 2, "ts": "2"}]}))
    spark.dataSource.register(readers.ContinuedSource)
    assert sorted(r.pageid for r in spark.read.format("continued").option("path", str(tmp_path)).load().collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    sinks.files(spark.createDataFrame([("a/b.html", "x"), ("c.html", "y")], "path string, content string"), str(tmp_path / "site"))
    assert (tmp_path / "site/a/b.html").read_text() == "x"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    delta = snapshots.diff(old, new)
    assert {r.path: r.change for r in delta.collect()} == {"b": "modified", "c": "removed", "d": "added"}
    assert sorted(map(tuple, snapshots.apply(old, delta).collect())) == sorted(map(tuple, new.collect()))
    blob = sinks.patch(delta, spark.createDataFrame([("b", bytearray(b"bb")), ("d", bytearray(b"dd")), ("a", bytearray(b"aa"))], "path string, content binary"))
    import io
    import zipfile

    names = zipfile.ZipFile(io.BytesIO(blob)).namelist()
    assert names == ["manifest.json", "files/b", "files/d"]
    kept = snapshots.upsert(old.withColumn("ts", F.lit(1)), new.withColumn("ts", F.lit(1)), ["path"], "ts")
    assert {r.path: r.sha256 for r in kept.collect()} == {"a": "1", "b": "9", "c": "3", "d": "4"}
    assert snapshots.orphans(old.withColumnRenamed("path", "stem"), new.withColumnRenamed("path", "stem"), 1).count() == 0


def test_file_digests_of_many_small_files(spark, tmp_path):
    import hashlib

    root = tmp_path / "files"
    want = {}
    for k in range(400):
        f = root / (f"{k % 3}/{k % 5}/{k}" if k % 7 else f"{k} ü%20.gz")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * k)
        want[str(f.relative_to(root))] = hashlib.sha256(b"x" * k).hexdigest()
    for name in ("_no", ".no", "0/_no", "_none/x"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("hidden")
    for at in (str(root), f"file://{root}/"):
        found = readers.file_digests(spark, at)
        assert {r.path: r.sha256 for r in found.collect()} == want
        assert found.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism)


def test_rows_of_one_id_have_files_of_their_own(spark, tmp_path):
    import hashlib

    from scriptorium.plans import round_trips

    spark.createDataFrame([(1,), (1,), (None,), (2,)], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.sha256 for r in round_trips.source_file_digests(spark, str(tmp_path)).collect())
    assert got == sorted(hashlib.sha256(f"{k}\n".encode()).hexdigest() for k in (1, 1, 2))

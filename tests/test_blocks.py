import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import blocks, search

QUERIES = ["the", "the river", "river", "ri", "stone bridge", "bridge of", "zz", "", "火球", "火球术 river", "Page 7", "page 7", "t", "river stone bridge", "the the", "rare"]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    words = ["the", "river", "rivers", "riverbed", "stone", "stones", "bridge", "of", "then", "there", "ring", "火球术", "法师的护甲"]
    rows = []
    for i in range(300):
        title = f"Page {i}" if i % 11 else rng.choice(["River", "The river", "Stone Bridge", "火球术", "Theory"]) + f" {i}"
        name = rng.choice(["", "Stone Bridge ", "River "]) if i % 5 == 0 else ""
        body = f"{title} {name}" + " ".join(rng.choices(words, [30, 8, 3, 1, 5, 2, 6, 30, 9, 9, 2, 2, 1], k=rng.randint(20, 60))) + (" rare" if i in (40, 250) else "")
        rows.append((rng.choice([0, 0, 0, 14, 3500]), i, title, body, []))
    return spark.createDataFrame(rows, "ns int, pageid long, title string, body string, categories array<string>")


@pytest.fixture(scope="module")
def popularity(pages):
    return pages.where("pageid % 3 = 0").select("title", (F.col("pageid") * 7 % 23).alias("inlinks"))


def test_top_equals_the_full_ranking(spark, pages, popularity, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(blocks, "BITS", 4)  # many blocks
    monkeypatch.setattr(blocks, "MOST_IDS", 150)
    items = search.entries(pages, popularity)
    built = blocks.BlockIndex.build(items)
    path = str(tmp_path_factory.mktemp("index") / "i")
    built.write(path)
    index = blocks.BlockIndex.read(spark, path)
    engine = search.Engine.build(pages, popularity)
    monkeypatch.setattr(search.expanded, "__defaults__", (200, 150))
    stopped = 0
    for text in QUERIES:
        for limit in (5, 1000):
            want = [tuple(r) for r in engine.search(text, limit).drop("total").collect()]
            assert [tuple(r) for r in index.top(text, limit).collect()] == want, (text, limit)
            stopped += 0 < index.blocks_read < -(-index.size // 16)
    assert stopped > 3


def test_blocks_hold_every_posting(spark, pages):
    index = blocks.BlockIndex.build(search.entries(pages))
    rows = index.blocks.select("kind", "token", F.explode("offsets").alias("o"), "block", "low", "high", "n").withColumn("id", F.col("block") * 4096 + F.col("o"))
    assert rows.where("id < low OR id > high").count() == 0
    want = search.posting_rows(index.items.select(F.col("place").alias("id"), "text")).select("kind", "token", "id")
    assert sorted(map(tuple, rows.select("kind", "token", "id").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r.place for r in index.items.collect()) == list(range(index.size))


def test_empty_index(spark, pages):
    index = blocks.BlockIndex.build(search.entries(pages.limit(0)))
    assert index.top("the river").count() == 0

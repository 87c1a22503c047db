import random

from pyspark.sql import functions as F

from scriptorium.operators import glossary, phrases


def words_of(spark, counts):
    return phrases.lexicon(spark.createDataFrame([*counts.items()], "word string, n long"))


def all_paths(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in all_paths(text[k:]):
            yield [text[:k], *rest]


def test_equals_all_paths(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("ab的") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    words = words_of(spark, counts)
    cost = {r.word: (r.cost, r.tag) for r in words.collect()}
    texts = {"".join(rng.choice("ab的z") for _ in range(rng.randint(1, 11))) for _ in range(40)}
    got = {r.text: [(w.word, w.tag) for w in r.words] for r in phrases.segmented(spark.createDataFrame([(t,) for t in texts], "text string"), words).collect()}
    assert set(got) == texts
    for text, path in got.items():
        paths = [p for p in all_paths(text) if all(w in cost or len(w) == 1 for w in p)]
        of = lambda p: sum(cost.get(w, (20_000,))[0] for w in p)
        assert of([w for w, _ in path]) == min(map(of, paths))
        assert all(tag == cost.get(w, (0, "x"))[1] for w, tag in path)


def test_trailing_phrases(spark):
    words = words_of(spark, {"环境": 9, "强风": 4, "结界": 5, "困": 2, "火球术": 7, "法师": 8})
    cases = {
        "环境中有强风": "强风", "你将被困在这个结界中": "结界", "强风": "强风", "的的的的的": "的的的的的", "法师火球术的": "法师火球术", "在这个环境里有": "在这个环境里有",
        "火球术和和和": "火球术和和和", "": "", None: None,
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)], "i int, zh string, phrase string")
    got = {r.zh_was: r.zh for r in phrases.trimmed(df.withColumn("zh_was", F.col("zh")), "zh", words).collect()}
    assert got == cases
    assert phrases.trimmed(df, "zh", words).columns == df.columns


def test_pairs_are_cut_by_a_lexicon(spark):
    words = words_of(spark, {"环境": 9, "强风": 4})
    pages = spark.createDataFrame([(1, "t", "环境中有强风 (Strong Wind) x")], "pageid long, title string, wikitext string")
    assert [r.zh for r in glossary.extract_pairs(pages).collect()] == ["环境中有强风"]
    assert [r.zh for r in glossary.extract_pairs(pages, words).collect()] == ["强风"]


def test_empty(spark):
    words = words_of(spark, {})
    assert words.count() > 50
    assert phrases.segmented(spark.createDataFrame([], "text string"), words).count() == 0

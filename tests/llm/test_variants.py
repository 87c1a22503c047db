import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import variants as V


def neighbours(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=500, deadline=None)
@given(st.text("abé", min_size=1, max_size=7), st.text("abé", min_size=1, max_size=7))
def test_one_edit(a, b):
    assert V.one_edit(a, b) == V.one_edit(b, a) == neighbours(a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=8), min_size=2, max_size=40, unique=True))
def test_first_grams_meet_and_postings_find(words):
    order = V.Order(Counter(g for w in words for g in set(V.grams(w))))
    same = [w for w in words if len(w) == 6]
    index = V.Postings(same)
    for i, w in enumerate(same):
        assert {same[k] for k in index.alike(i)} >= {x for x in same[i + 1 :] if neighbours(w, x)}
    for w in words:
        if len(w) == 5:
            assert {same[k] for k in index.longer(w)} >= {x for x in same if neighbours(w, x)}
    for a in words:
        for b in words:
            if neighbours(a, b) and len(a) >= len(b):
                g, place = order.shared(a, b)
                assert (g, place) in order.first(a)
                assert any((g, place - k) in order.first(b) for k in ((0,) if len(a) == len(b) else (0, 1)))


def plain(words):
    """{word: row} by all pairs."""
    near = {w: [x for x in words if neighbours(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def check(spark, words, most=20_000):
    df = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in V.variants(df, most).collect()}
    assert got == plain(words)


@pytest.mark.parametrize("most", [20_000, 3])
def test_equals_all_pairs(spark, most):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("aé") for _ in range(rng.randint(5, 9))): rng.choice([3, 3, 4, 7, 16, 40, 200]) for _ in range(250)}
    words |= {"x" * 40: 5, "x" * 41: 50, "y" + "x" * 39: 400, "lonely": 9, "×÷ÿéé": 3}
    check(spark, words, most)


def test_chains_of_forms(spark):
    chain = {("a" * i + "bbbbbbbbbbbb")[:12]: 3 * 2**i for i in range(10)}
    check(spark, chain)


def test_whole_table(spark, sf, duck):
    from scriptorium.llm.queries import OP12_SQL, op12_spelling_variants
    from tests.compare import same

    same(op12_spelling_variants(spark, sf), duck, OP12_SQL)


def test_words_of_odd_texts(spark):
    texts = ["The THE the café CAFÉS cafés", None, "", "ÀÉÎ×÷ straße Straße", "a1b2c3d4e5", "x" * 5000, "the cat's whiskers " * 1000, "日本語 whiskers"]
    docs = spark.createDataFrame([(i if i % 4 else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    want = defaultdict(int)
    import re

    for i, t in enumerate(texts):
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{i if i % 4 else ''}:{r}".encode())
            r = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r
            if len(r) >= 5:
                want[r] += 1
    for held in (300_000, 2):
        assert {r.word: r.n for r in V.word_counts(docs, V.one_letter_lost, held=held).collect()} == want


def test_empty_tables(spark):
    assert V.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert V.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_a_hot_cell_loses_nothing(spark):
    words = [f"{a}{b}{c}zzqzz" for a in "abcdefghij" for b in "abcdefghij" for c in "ab"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.word, r.other))) for r in V.near_pairs(df, 20).collect())
    assert got == sorted({tuple(sorted((a, b))) for a in words for b in words if neighbours(a, b)})
    assert V.near_pairs(df.select("word", F.col("n").cast("long").alias("n")), 20).count() == len(got)


def test_a_gram_repeated_at_the_next_place_counts_a_pair_once(spark):
    # "zz" is the rarest, at two places in a row, and a letter before them moves both by one
    words = {"azzzb": 3, "cazzzb": 9} | {f"{x}az{y}zb": 3 for x in ("c", "") for y in "defghk"}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = sorted(tuple(sorted((r.word, r.other))) for r in V.near_pairs(df).collect())
    assert got == sorted({tuple(sorted((a, b))) for a in words for b in words if neighbours(a, b)})

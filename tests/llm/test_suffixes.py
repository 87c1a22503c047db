import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            s = hashlib.md5(b[i : i + length]).digest()
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.md5(b[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, kept))
    return sorted(out)


def found(spark, texts, length, width, parts=3):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, run binary").repartition(parts)
    return sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, length=length, width=width).collect())


def test_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert found(spark, texts, 400, 100) == brute(texts, 400)


def test_passages_copies_and_odd_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(60) for _ in range(6)]
    texts = [None, "", "a", "a" * 500, "ab" * 300, "ab" * 200 + "c", "x" * 39, "x" * 40, "x" * 41]
    for _ in range(150):
        t = word(rng.randrange(5, 80))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            k = rng.randrange(20)
            t += p[k : k + rng.randrange(30, 60)] + word(rng.randrange(50))
        texts.append(t)
    base = word(300)
    for _ in range(40):
        i = rng.randrange(300)
        texts.append(base[:i] + word(1) + base[i + 1 :])
    texts += [base] * 5 + ["ab" * 300] * 2
    assert found(spark, texts, 40, 12) == brute(texts, 40)
    assert found(spark, texts, 40, 20, 1) == brute(texts, 40)
    assert found(spark, [], 40, 20, 1) == []


def test_anchors_are_the_first_least_place_of_each_start():
    import numpy as np

    rng = random.Random(2)
    for n in (11, 12, 13, 60, 300):
        for letters in ("a", "ab", "abcdefgh"):
            a = np.frombuffer("".join(rng.choice(letters) for _ in range(n)).encode(), np.uint8)
            places, first, last, h = suffixes.anchors(a, 4, 9)
            of = {x: p for p, i, j in zip(places.tolist(), first.tolist(), last.tolist()) for x in range(i, j + 1)}
            assert sorted(of) == list(range(max(0, n - 11))) and all(x <= p < x + 9 for x, p in of.items())
            strings = {}
            for x, p in of.items():
                assert strings.setdefault(a[x : x + 12].tobytes(), p - x) == p - x
            parts = suffixes.anchors(a, 4, 9, stretch=7)
            assert {x: p for p, i, j in zip(*(c.tolist() for c in parts[:3])) for x in range(i, j + 1)} == of


def test_two_lengths_a_hot_passage_and_clashing_names(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    hot, other = word(70), [word(34) for _ in range(5)]
    texts = [None, "", "xy" * 30]
    for i in range(180):
        t = word(rng.randrange(40))
        if i % 3 == 0:
            t += hot[rng.randrange(8) :]
        if i % 5 == 0:
            t += rng.choice(other)
        texts.append(t + word(rng.randrange(40)))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, text_key int, spans int, n_bytes int").repartition(3)
    out = suffixes.remove_repeats(docs, length=40, width=12, also=25, words=3).collect()
    assert out[0].text_key == 1 and out[0].spans == 2
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == brute(texts, 40)
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - 24):
            seen[b[i : i + 25]] = seen.get(b[i : i + 25], 0) + 1
    for r in out:
        b = data[r.doc_id]
        spans = suffixes.joined([(i, i + 25) for i in range(len(b) - 24) if seen[b[i : i + 25]] > 1])
        assert r.n_passages == sum(len(b[x:y].split()) >= 3 for x, y in spans)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=9))
def test_loser_tree_merges(runs):
    coded = [suffixes.front_code([(s, (i,)) for s in sorted(r)]) for i, r in enumerate(runs)]
    got = list(suffixes.merged(coded))
    assert [s for _, s, _ in got] == sorted(s for r in runs for s in r)
    for (_, a, _), (k, b, _) in zip(got, got[1:]):
        assert k == suffixes.common(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=3, max_size=8), st.text("ab", max_size=6), st.integers(0, 3), st.integers(1, 2)), min_size=2, max_size=14, unique_by=lambda x: x[:3]))
def test_both_ways_settle_alike(rows):
    group = sorted((s.encode(), l.encode(), k, c) for s, l, k, c in rows if max(k, 8 - len(s)) <= len(l))
    group = [(s, l, max(k, 8 - len(s)), c) for s, l, k, c in group]
    shared = [0] + [suffixes.common(group[i - 1][0], group[i][0]) for i in range(1, len(group))]
    a, b = suffixes.spans_of(group, shared, 8, small=100), suffixes.spans_of(group, shared, 8, small=0)
    grow = lambda spans: {d for lo, hi in spans for d in range(lo, hi + 1)}
    assert list(map(grow, a)) == list(map(grow, b))

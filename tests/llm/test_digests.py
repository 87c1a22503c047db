import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import digests as D


def plain_codes(data):
    """Counted byte by byte."""
    b, counts = data + bytes(4), [0] * 256
    for x in range(len(data)):
        for k, (i, j) in enumerate(((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))):
            h = b[x] * 2654435761 + b[x + i] * 2246822519 + b[x + j] * 3266489917 + k * 668265263
            counts[h % 2**32 >> 24] += 1
    up = sorted(counts)
    return [sum(c > up[m] for m in (63, 127, 191)) for c in counts]


def plain(text):
    data = text.encode()
    e = len(data).bit_length()
    return (8 * e + len(data) * 16 // 2**e % 8 if data else 0), plain_codes(data)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.text(max_size=30))
def test_digest_equals_a_count_by_bytes(begin, end):
    length, codes = D.Digest(begin.encode()).then(end.encode())
    assert (length, codes.tolist()) == plain(begin + end)
    shown = D.shown(length, codes)
    assert D.read(shown)[0] == length and D.read(shown)[1].tolist() == codes.tolist()


def test_stretches_change_nothing():
    data = np.random.default_rng(1).integers(0, 256, 5000, np.uint8).tobytes()
    assert D.triplet_counts(data, 100).tolist() == D.triplet_counts(data).tolist()
    assert D.triplet_counts(b"abcd").sum() == 0 and D.triplet_counts(b"abcde").sum() == 6


def brute(rows):
    """Documents in order of id, of one id by the hash of the text; the next one is the first of the next id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    first = {}
    for k, t, _ in rows:
        first.setdefault(k, t or "")
    ids = list(first)
    out = []
    for k, t, _ in rows:
        t, following = t or "", first[ids[(ids.index(k) + 1) % len(ids)]]
        n = len(t)
        edited = t[: n - n // 4] + following[: n // 4]
        p, q, r = plain(t), plain(edited), plain(following)
        near = [1 - min(320, sum(abs(x - y) for x, y in zip(p[1], o[1])) + abs(p[0] - o[0])) / 320 for o in (q, r)]
        shown = [D.shown(a, np.array(c, np.uint8)) for a, c in (p, q)]
        out.append((-1 if k is None else k, n, hashlib.sha256(edited.encode()).hexdigest(), *shown, *near))
    return sorted(out)


TEXTS = ["", None, "a", "ab\n", "the quick brown fox " * 20, "été à la plage " * 9, "日本語テキスト" * 30, "the quick brown fox " * 20, "z" * 700, "words and more words here"]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("ids", [lambda i: i, lambda i: -5 * i, lambda i: 7 if i % 3 else None, lambda i: 7, lambda i: i // 4 if i % 5 else 3, lambda i: 2**63 - 1 - i // 6])
def test_equals_brute_force(spark, parts, ids):
    rows = [(ids(i), TEXTS[i % len(TEXTS)] and f"{i % 13} {TEXTS[i % len(TEXTS)]}", "clash") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(3)
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    got = sorted(tuple(r) for r in D.beside_next(docs, parts=parts).fillna({"doc_id": -1}).collect())
    assert got == brute([tuple(r) for r in hashed])


def test_one_document_follows_itself(spark):
    r = D.beside_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).head()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_empty_table(spark):
    out = D.beside_next(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_columns(spark):
    docs = spark.createDataFrame([("the end of it all",), ("the end of it oll",), (None,), ("",)], "text string")
    f = docs.select(D.fingerprint(F.col("text")).alias("f")).collect()
    assert f[2].f == f[3].f != f[0].f
    pair = spark.createDataFrame([(f[0].f, f[1].f), (f[0].f, f[0].f), (f[0].f, None)], "a string, b string")
    near = [r.n for r in pair.select(D.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert 0.5 < near[0] < 1 and near[1] == 1 and near[2] is None


def test_edits_are_nearer_than_strangers(spark, sf):
    rows = D.beside_next(spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200")).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def test_equals_sql(spark, sf, duck):
    from scriptorium.llm.queries import OP11_SQL, op11_fingerprints
    from tests.compare import same

    same(op11_fingerprints(spark, sf), duck, OP11_SQL)

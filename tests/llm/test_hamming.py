import random

from scriptorium.llm import hamming, queries
from tests.compare import same


def test_equals_sql(spark, sf, duck):
    same(queries.op10_top_k_search(spark, sf), duck, queries.SQL["op10_top_k_search"])


def brute(rows, asked, k):
    out = []
    for q, c in sorted({(i, c) for i, c in asked if c is not None}):
        near = sorted({(bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in rows if d is not None and i is not None and i != q})
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(60)]
    rows = list(enumerate(codes)) + [(100 + i, codes[3]) for i in range(40)] + [(200 + i, codes[5] ^ (1 << i)) for i in range(20)] + [(300, None), (0, codes[0])]
    asked = [(i, c) for i, c in rows if i % 5 == 0] + [(300, None)]
    df = lambda x: spark.createDataFrame(x, "id long, code long")
    for k in (1, 7):
        assert sorted(map(tuple, hamming.search(df(rows), df(asked), k).collect())) == brute(rows, asked, k)
    few = rows[:3]
    assert sorted(map(tuple, hamming.search(df(few), df(few), 10).collect())) == brute(few, few, 10)
    assert hamming.search(df([]), df([]), 3).count() == 0


def test_signs(spark):
    rows = [([1.0, -1.0, 0.0, None, 2.0],), (None,), ([float("nan")] * 2,), ([0.0] * 64 + [1.0],), ([-1.0] + [0.0] * 63 + [2.0],)]
    got = [r.c for r in spark.createDataFrame(rows, "e array<float>").select(hamming.signs(hamming.F.col("e")).alias("c")).collect()]
    assert got[0] == 0b10001 and got[1] is None and got[3] == 1 and got[4] == 1


def test_every_width_gives_the_same_beyond_4096_codes(spark):
    rng = random.Random(11)
    rows = [(i, rng.getrandbits(64) - 2**63) for i in range(4600)]
    rows += [(5000 + i, rows[i][1] ^ (1 << i % 60) ^ (1 << 61)) for i in range(60)]
    asked = [rows[i] for i in range(0, 60, 20)]
    df = lambda x: spark.createDataFrame(x, "id long, code long")
    want = brute(rows, asked, 4)
    for width in (None, 8):
        assert sorted(map(tuple, hamming.search(df(rows), df(asked), 4, width).collect())) == want

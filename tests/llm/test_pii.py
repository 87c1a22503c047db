import hashlib
import re

from pyspark.sql import functions as F

from scriptorium.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    None, "", "é 😀 a.b@c.d", "a@b.cd%x@e.fg a@@b.c @x.y x@y x@y.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824, +12 +1()2",
    "4" * 25000, "1 " * 20000, "a" * 50000 + "@b.c", "+1" * 3000, "12345678901234567890", "0000 0000 0000", "x@y.z" * 3000, "1.1.1.1 " * 300, "+1 743 555 3824 4111111111111111",
]


def ok(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p[-9:] if len(p) < 4000 else "999") <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    out = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(name, m[0])]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(out))


def test_base_spans(spark, sf):
    rows = [(i, t, 0) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int").union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text", "0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.detect(docs).select("doc_id", pii.listed(pii.F.col("base")).alias("base"), pii.listed(pii.F.col("spans")).alias("spans")).collect():
        assert r.base == brute(texts[r.doc_id]), texts[r.doc_id][:80]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert hashlib.sha256(r.base.encode()).hexdigest()


def test_patterns_spread_from_seeds(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'text {i} has token = "{digest(i)}" in it') for i in range(30)]
    rows += [(100 + i, f"here password={digest(i)[:18]} too") for i in range(10)]
    rows += [(200 + i, f"clean words chapter{i}of{i}volumes and more") for i in range(10)] + [(300, None), (None, ""), (301, "no digits")]
    rows += [(400 + i, f"with password=abcdefghij{i}") for i in range(3)] + [(500, "le mot password=hunter2."), (501, "a password=sk_live-77/x+y="), (502, "the password=secret")]
    rows += [(600 + i, f"clé={digest(i + 50)[:20]}") for i in range(8)] + [(610, "la clé=azerty")]
    rows += [(700 + i, f"note: chapter{i} time 12:30") for i in range(5)]
    out = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(pii.F.col("spans")).alias("spans")).collect()}
    assert all("id:" in out[i].spans for i in [*range(30), *range(100, 110)])
    assert [out[i].spans for i in (400, 500, 501, 502, 610)] == ["id:14:25", "id:16:23", "id:11:26", "id:13:19", "id:7:13"]
    assert all(out[i].spans == "" for i in [*range(200, 210), 300, 301, None, *range(700, 705)])


def test_redact(spark):
    rows = [(1, "mail a.b@c.de or +1 (743) 555-3824 now", 1), (2, None, 2), (3, "", 3), (4, "plain", 4), (1, "mail a.b@c.de or +1 (743) 555-3824 now", 1)]
    out = sorted((r.doc_id, r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect() if r.text is not None)
    one = "mail [EMAIL] or [PHONE] now"
    assert out == [(1, one, len(one)), (1, one, len(one)), (3, "", 0), (4, "plain", 5)]


def test_empty_table(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_matches_take_seconds(spark):
    import time

    n = 100_000
    text = " ".join(f"a{i}@b.cc" for i in range(n))
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    began = time.time()
    spans = docs.select(pii.base_spans(docs["text"]).alias("s")).head().s
    assert len(spans) == n and all(text[s.start : s.end] == f"a{i}@b.cc" for i, s in enumerate(spans))
    out = docs.select(pii.replaced(docs["text"], pii.base_spans(docs["text"]), F.array(F.lit("[E]"))).alias("t")).head().t
    assert out == " ".join(["[E]"] * n)
    assert time.time() - began < 60


def test_replaced_equals_plain_code(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(60):
        text = "".join(rng.choice("abé日 ") for _ in range(rng.randint(0, 900)))
        spans = sorted({(a, rng.randint(0, 1), min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 5, 200]) if text else 0))})
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    names = F.array(F.lit("[A]"), F.lit("[B]"))
    got = {r.i: r.t for r in df.where(F.size("spans") > 0).select("i", pii.replaced(df["text"], df["spans"], names).alias("t")).collect()}
    for i, text, spans in rows:
        if spans:
            at, want = 0, ""
            for start, k, end in spans:
                if start >= at:
                    want += text[at:start] + ("[A]", "[B]")[k]
                at = max(at, end)
            assert got[i] == want + text[at:]

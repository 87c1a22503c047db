import numpy as np

from scriptorium.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    out = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_codewords_differ():
    for n in (1, 2, 4, 7, 30):
        m = langid.codewords(n)
        far = (m[:, None] != m[None]).sum(2) + np.eye(n) * 99
        assert far.min() >= (1 if n == 2 else m.shape[1] // 5)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "123 ... \n", 3), (4, "word " * 20000, 4), (None, "the word", 5), (4, "the word", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = langid.fit(["the words of it", "der die und das"] * 5, ["en", "de"] * 5)
    out = langid.identify(docs, model).collect()
    assert len(out) == 6 and [r.lang_pred for r in out if not r.text or r.doc_id == 3] == ["und"] * 3
    assert {r.lang_pred for r in out if r.text and r.doc_id != 3} == {"en"}
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    only = langid.fit(["a b c"], ["xx"])
    assert [r.lang_pred for r in langid.identify(docs.where("doc_id = 4"), only).collect()] == ["xx", "xx"]
    assert langid.train(docs.selectExpr("doc_id AS id", "text", "cast(null AS string) AS lang")) is None
    assert langid.identify(docs.limit(0), model).count() == 0


def test_decoding_by_hand():
    import math

    langs = ["de", "en", "es", "fr", "it", "nl", "pt"]
    rng = np.random.default_rng(3)
    words = {l: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for l in langs}
    text = lambda l: " ".join(rng.choice(words[l], 25))
    labels = [l for l in langs for _ in range(12)]
    model = langid.fit([text(l) for l in labels], labels)
    new = [text(l) for l in langs] + [" ".join([text("de"), text("en")])]
    x = langid.features(new)
    number, score, odd = model.decode(x)
    for i in range(len(new)):
        bits = [sum(float(a) * float(b) for a, b in zip(x[i], model.weights[:-1, k])) + float(model.weights[-1, k]) for k in range(model.codes.shape[1])]
        loss = [sum(math.log1p(math.exp(-b * c)) * t for b, c, t in zip(bits, code.tolist(), model.trust.tolist())) for code in model.codes]
        p = [math.exp(min(loss) - v) for v in loss]
        p = sorted((v / sum(p), k) for k, v in enumerate(p))
        assert number[i] == p[-1][1] and abs(score[i] - p[-1][0]) < 1e-3
        assert bool(odd[i]) == (p[-1][0] - p[-2][0] < model.margin)
    assert [model.langs[k] for k in number[:-1]] == langs


def test_the_sample_is_bounded(spark):
    rows = [(i, f"word{i % 7} number{i % 11} of language l{i % 30}", f"l{i % 30:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    taken = []
    fit, langid.fit = langid.fit, lambda texts, labels: taken.append(labels)
    try:
        langid.train(docs, per_lang=400, most_texts=120)
        langid.train(docs, per_lang=400, most_langs=5)
    finally:
        langid.fit = fit
    assert len(taken[0]) <= 120 and len(set(taken[0])) > 20
    assert set(taken[1]) == {"l00", "l01", "l02", "l03", "l04"}

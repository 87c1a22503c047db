import zlib

import numpy as np
import zstandard

from scriptorium.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    toxic, plain = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([t > p for t in toxic for p in plain]) > 0.75
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_toxic_words_save_bytes():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    plain = [" ".join(word() for _ in range(60)) for _ in range(200)]
    bad = [" ".join([*(word() for _ in range(30)), "wretchedly", word(), "vilestuff", *(word() for _ in range(30))]) for _ in range(40)]
    scorer = toxicity.train(plain + bad, [0] * 200 + [1] * 40)
    new = " ".join([*(word() for _ in range(40)), "vilestuff", "wretchedly"])
    assert scorer.score(new) > 0.5 > scorer.score(" ".join(word() for _ in range(60)))


def test_gains_are_lengths_of_whole_windows():
    plain = [f"the quiet river number{i} runs past the old mill and the quiet field" for i in range(60)]
    scorer = toxicity.train(plain + [f"the quiet river vilestuff{i % 3} runs past{i}" for i in range(30)], [0] * 60 + [1] * 30, window=4)
    assert b"vilestuff" in scorer.toxic and b"vilestuff" not in scorer.ordinary

    def length(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_dict_id=False).compress(window))

    windows = [b" the quiet river vilestuff1 ", b" runs past "]
    expected = [length(scorer.ordinary, w) - length(scorer.ordinary + scorer.toxic, w) for w in windows]
    assert list(scorer.gains("The quiet river, vilestuff1 runs past!")) == expected and expected[0] > 0


def test_odd_rows(spark):
    scorer = toxicity.train(["plain words here"] * 3 + ["bad words"], [0, 0, 0, 1])
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x " * 30000, 9), (2, "x", 9)], "doc_id long, text string, toxicity int")
    for s in (scorer, toxicity.train([], []), toxicity.train(["a"], [1])):
        out = toxicity.score(docs, s).collect()
        assert len(out) == 4 and all(0 <= r.toxicity <= 1 for r in out)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert 0 <= toxicity.score(docs, toxicity.learn(docs, labels)).head().toxicity <= 1
    assert toxicity.score(docs.limit(0), scorer).count() == 0


def test_learns_from_whole_texts(spark, monkeypatch):
    long = "plain words " * 3000 + "vilestuff"
    docs = spark.createDataFrame([(1, long), (2, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: dict(zip(texts, labels)))
    assert toxicity.learn(docs, labels) == {long: 1, "plain": 0}

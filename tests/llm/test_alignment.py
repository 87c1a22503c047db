import functools
import hashlib
from collections import Counter, defaultdict

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import alignment, common

A, B = common.tokenizer_path(), common.tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n", "a", " a  b\n\n c ", "x ", "x  ", "it's <|endoftext|> 's <s></s>", "x" * 3000, "日本語 text 日本", "tab\tand\x1csep", "a\n b\n", "▁ mark",
    "no break space here", "end.\nNext line\nthe end", "\r\nwindows\r\n", "é ß 12²³ ¼ 👍🏽 x", "<0x41> \x00\x01", "ﬁ ½ Å", "the cat the cat " * 500, "the cat the cat " * 500,
]


def _library(cache={}):
    if not cache:
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(y for y in range(256) if y not in shown)}
        cache.update(a=a, b=b, names={i: s for s, i in a.get_vocab().items()}, of=of)
    return cache


def plain(text):
    """Groups of a text's ids, by walking both tokenizers' whole output."""
    if not text:
        return []
    c = _library()
    ids_a, ids_b = c["a"].encode(f" {text}", add_special_tokens=False).ids, c["b"].encode(text)
    of_a = [bytes(c["of"][x] for x in c["names"][i]) for i in ids_a]
    of_b = [bytes([int(p[3:5], 16)]) if c["b"].is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [c["b"].id_to_piece(i)]]
    if not b"".join(of_a) == b"".join(of_b) == f" {text}".encode():
        return []
    out, i, j, a, b, n_a, n_b = [], 0, 0, [], [], 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if n_a <= n_b and i < len(ids_a):
            a, n_a, i = [*a, ids_a[i]], n_a + len(of_a[i]), i + 1
        else:
            b, n_b, j = [*b, ids_b[j]], n_b + len(of_b[j]), j + 1
        if n_a == n_b:
            out.append((a, b))
            a, b = [], []
    return out


def brute(texts):
    groups = [plain(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for g, x in zip(groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in x.items()), hashlib.sha256(shown.encode()).hexdigest() if g else "",
        )


@functools.cache
def _encoder():
    return alignment.Encoder(A, B)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st \n\t.,!1é\xa0\x85\x1c²漢\r▁ <|>"), max_size=30))
def test_chunks_give_what_whole_texts_give(text):
    encoder, want = _encoder(), plain(text)
    found = next(encoder.encode([text]))
    if not want:
        assert found is None
        return
    shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
    assert found[4] == hashlib.sha256(shown.encode()).hexdigest()
    assert (found[2], found[3], int(found[1].sum())) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))


def check(spark, rows, most_groups):
    docs = spark.createDataFrame([(k, t, "x", 5, 6) for k, t in rows], "doc_id long, text string, key string, block long, pair long").repartition(3)
    out = alignment.align(docs, A, B, most_groups=most_groups)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.columns == names
    got = sorted(tuple(r) for r in out.select(*names).fillna({"doc_id": -1}).collect())
    assert got == sorted((-1 if k is None else k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows])))


def test_equals_brute_force(spark):
    check(spark, [(i if i % 9 else None, t) for i, t in enumerate(ODD)], 200_000)


def test_small_blocks_give_the_same(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    check(spark, rows, 300)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, *x) for r, x in zip(docs.collect(), brute([r.text for r in docs.collect()])))
    from scriptorium.llm.queries import op13_alignment

    assert sorted(tuple(r) for r in op13_alignment(spark, sf).collect()) == want


def test_pair_counts_are_documents(spark):
    docs = spark.createDataFrame([(1, "the the"), (2, "the cat"), (3, None)], "doc_id long, text string")
    found = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(alignment.encoded(docs, A, B)).collect()}
    the = next(p for p in (Counter((x, y) for a, b in plain("the") for x in a for y in b)))
    assert found[the] == (2, True)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0

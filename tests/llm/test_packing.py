import functools
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import common, packing

PATH = common.tokenizer_path()
ODD = ["", None, " ", "\n", "a", " a  b\n\n c ", "it's <|endoftext|> 's", "x" * 3000, "日本語 text", "tab\tand\x1csep", "a\n b", " wide", "no space here ", "é ß 12²³ ¼"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st \n\t.,!1é\xa0\x85²漢"), max_size=40))
def test_ids_are_the_library_s(text):
    tokens = _tokens()
    assert tokens.encode(text) == struct.pack(f"<{len(i)}I", *i) if (i := _library().encode(text, add_special_tokens=False).ids) else not tokens.encode(text)


@functools.cache
def _tokens():
    return packing.Tokens(PATH, words=50)


@functools.cache
def _library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing_equals_a_scan(lengths):
    got = packing.best_fit_decreasing(lengths, 16)
    left = []
    for i, sequence, offset in got:
        fits = [c for c in left if c >= lengths[i]]
        capacity = min(fits, default=16)
        assert offset == 16 - capacity
        if fits:
            left.remove(capacity)
        left.append(capacity - lengths[i])
    assert sorted(i for i, _, _ in got) == list(range(len(lengths)))


def check(spark, docs, window):
    out = packing.pack(docs, PATH, window).collect()
    library = Tokenizer.from_file(PATH)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= window
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    want = sorted(struct.pack(f"<{len(i)}I", *i) for t in docs.collect() for i in [library.encode(t.text or "", add_special_tokens=False).ids + [0]])
    docs_out, key = {}, lambda r: (str(r.doc_id), r.start)
    for r in sorted(out, key=key):
        docs_out.setdefault(str(r.doc_id), []).append(r)
    if len(docs_out) == len(want):
        assert sorted(b"".join(bytes(r.ids) for r in rows) for rows in docs_out.values()) == want
    assert sum(r.length for r in out) == sum(len(w) // 4 for w in want)
    return out, by_sequence


def test_documents_come_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, sequences = check(spark, docs, 1024)
    assert sum(r.length for r in out) > 0.97 * 1024 * (len(sequences) - 1)


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (0, "", "x"), (0, "", "x")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, length string"), 8)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_blocks_bound_what_a_task_holds(spark):
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(50)], "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, PATH, 8, block_tokens=12).collect()
    assert len(out) == 50 and len({(r.sequence_id, r.offset) for r in out}) == 50

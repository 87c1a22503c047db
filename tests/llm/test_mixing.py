import pytest

from scriptorium.llm import mixing, queries
from tests.compare import same

SCHEMA = "doc_id long, text string, source string, size int"


def test_equals_sql(spark, sf, duck):
    same(queries.op8_mixing(spark, sf), duck, queries.SQL["op8_mixing"])


def by_hand(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        spent = sum(2 * sizes[s] for s in stopped)
        got = {s: (total - spent) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return got | {s: 2 * sizes[s] for s in stopped}
        stopped |= over


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), s, 9) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 40 + [None] * 30)]
    rows += [(None, "null id", "a", 1), (5, None, "b", 1), (5, "", "b", 1), (7, "same row", "b", 1), (7, "same row", "b", 1)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = by_hand(sizes)
    names = {v: k for k, v in want.items()}
    taken = {}
    for r in out:
        assert r.taken <= 2 * r.size
        source = min(names, key=lambda t: abs(t - r.target))
        assert r.target == pytest.approx(source)
        taken[source] = taken.get(source, 0) + r.taken
    for t, n in taken.items():
        assert n == round(t)


def test_mixture_repeats_and_cuts(spark):
    rows = [(i, f"d{i} " + "w\n" * (i % 5), s, 0) for i, s in enumerate(["a"] * 30 + ["b"] * 9 + [None] * 9)] + [(1, "twin", "a", 0), (1, "twin", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sum(r.taken for r in mixing.mix(docs, keep=("doc_id", "text")).collect())
    out = mixing.mixture(docs).collect()
    assert sum(len(r.text.split()) for r in out) == want
    texts = {t for _, t, _, _ in rows}
    assert all(any(t.startswith(r.text) for t in texts) for r in out)
    assert mixing.mixture(docs).columns == docs.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_only_empty_texts(spark):
    out = mixing.mix(spark.createDataFrame([(1, "", "a", 0), (2, None, None, 0)], SCHEMA)).collect()
    assert [r.taken for r in out] == [0, 0] and [r.target for r in out] == [0.0, 0.0]

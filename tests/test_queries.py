"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import pytest

from scriptorium.plans.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_redirect_chase_takes_every_order(spark, tmp_path):
    keys = [*range(1, 60), *range(2980, 3100), 90001, 90002, 90003, 90004]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    to = {k: None if k % 7 == 0 else k if k % 11 == 0 else k + 1 + k % 3 for k in keys}

    def chased(k):
        seen = [k]
        while True:
            t = to.get(seen[-1])
            if t is None or t in seen or len(seen) >= 10:
                return seen[-1], t in seen, len(seen) - 1
            seen.append(t)

    out = {r.start: (r.final, r.cycle, r.hops) for r in QUERIES["redirect_chase"](spark, str(tmp_path)).collect()}
    assert out == {k: chased(k) for k in keys}


def test_highlights_whole_pages(spark, tmp_path):
    html = "<p>x</p>" * 100 + "the end & more"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = QUERIES["highlighted"](spark, str(tmp_path)).head()
    assert r.marked == html.replace("the", "<mark>the</mark>")
    assert r.escaped == html.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

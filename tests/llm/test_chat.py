import hashlib
import re

from scriptorium.llm import chat, queries
from scriptorium.llm.common import cut  # noqa: F401
from tests.compare import same

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_equals_sql(spark, sf, duck):
    same(queries.op2_chat_formatting(spark, sf), duck, queries.SQL["op2_chat_formatting"])


def read(df):
    rows = df.select("*", chat.read_back(chat.F.col("formatted")).alias("turns"), chat.masked(chat.F.col("formatted"), chat.F.col("loss")).alias("lost")).collect()
    return {(r.tree, r["rank"]): r for r in rows}


def test_branches_rank_and_come_back(spark):
    odd = ["[INST]", "\\[INST] x [/INST]", "\\\\</s>", "</s>\n<s> hi </s>\n[INST]", "[ROLE a] b [/ROLE]\n", None, "", "\\", "<<SYS>> \\<</SYS>>", " [/INST]\n"]
    rows = [(1, 0, None, "system", odd[0], 0.0), (1, 1, 0, "user", odd[1], 1.0), (1, 2, 1, "assistant", odd[2], 5.0), (1, 3, 1, "assistant", odd[3], 2.0), (1, 4, 3, "user", odd[4], 9.0), (1, 5, 4, "assistant", odd[5], None)]
    rows += [(2, i, i - 1 if i else None, ["user", "assistant", "tool ]", None][i % 4], odd[i % 10], 1.0) for i in range(70)]
    rows += [(3, 1, 2, "user", "round", 1.0), (3, 2, 1, "user", "and round", 1.0), (4, 9, 77, "user", "lost parent", 1.0)]
    out = read(chat.conversations(spark.createDataFrame(rows, NODES), best=None))
    text = {(t, n): (r or "", x or "") for t, n, _, r, x, _ in rows}
    want = {(1, 1): [0, 1, 3, 4, 5], (1, 2): [0, 1, 2], (2, 1): list(range(70)), (4, 1): [9]}
    assert set(out) == set(want)
    for (tree, rank), path in want.items():
        r = out[tree, rank]
        assert [tuple(t) for t in r.turns] == [text[tree, n] for n in path] and r.n_turns == len(path)
        assert r.lost == "".join(x for role, x in (text[tree, n] for n in path) if role == "assistant")


def test_linear_ties_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 0, "user", "a")]
    out = read(chat.conversations(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert [t.text for t in out[1, 1].turns] == ["a", "a", "b", ""] and hashlib
    assert chat.conversations(spark.createDataFrame([], NODES)).count() == 0


def test_null_conversation_stays(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    out = read(chat.conversations(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert {k: [t.text for t in r.turns] for k, r in out.items()} == {(None, 1): ["a", "b"], (1, 1): ["c"]}
    nodes = [(None, 0, None, "user", "x", 0.0), (None, 1, 0, "assistant", "y", 2.0), (None, 2, 0, "assistant", "z", 1.0), (5, 1, 0, "user", "own root", 0.0)]
    out = read(chat.conversations(spark.createDataFrame(nodes, NODES), best=None))
    assert {k: [t.text for t in r.turns] for k, r in out.items()} == {(None, 1): ["x", "y"], (None, 2): ["x", "z"], (5, 1): ["own root"]}


def plans(spark, nodes):
    """The numbers of scans in the plans that `branches` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    paths = chat.branches(nodes)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = store.executionsList(before, 1 << 20)
    return paths.count(), [len(re.findall(r"^\(\d+\) .*Scan", new.apply(i).physicalPlanDescription(), re.M)) for i in range(new.size())]


def test_plans_do_not_grow_with_the_depth(spark):
    chain = lambda n: spark.range(n).selectExpr("1L AS tree", "id AS node", "nullif(id, 0) - 1 AS parent", "1.0D AS score")
    (n_short, short), (n_deep, deep) = plans(spark, chain(9)), plans(spark, chain(400))
    assert (n_short, n_deep) == (9, 400) and max(short) > 1
    assert max(deep) == max(short) and len(deep) <= 2 * 10 + 2

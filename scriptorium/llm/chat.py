"""Reply trees: paths from root to leaf, ranked by score, each formatted as one conversation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut, passing, stored

# Marks of the template, before and after a turn's text. Fixed values.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE {}]", "[/ROLE]")
CONTROL = r"</?s>|<</?SYS>>|\[/?INST\]|\[ROLE |\[/ROLE\]"
TURN = r"(?s)(\[INST\]|<s>|<<SYS>>|\[ROLE [^\]]*\]) (.*?) (?:\[/INST\]|</s>|<</SYS>>|\[/ROLE\])\n"


def escape(text: Column) -> Column:
    """A backslash before each control string; n backslashes that stood there become 2n. A real mark
    always follows a blank or a mark, so it never has one."""
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\({CONTROL})", "$1$2")


def opening(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE "), F.url_encode(role), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def role_of(mark: Column) -> Column:
    out = F.url_decode(F.regexp_extract(mark, r"\[ROLE ([^\]]*)\]", 1))
    for name, (own, _) in MARKS.items():
        out = F.when(mark == own, name).otherwise(out)
    return out


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node) for the `best` root-to-leaf paths of each tree (None: all).

    nodes: tree, node, parent, score. Self-joins double the reach of each node's jump towards the root,
    so a tree of depth n takes log2(n) of them; then each chosen leaf follows the jumps, longest first,
    and a path costs one row a node. A path scores the sum of its nodes (null counts 0); ties go to the
    lower leaf. A parent that isn't there makes its child a root; nodes that only lead round in a circle
    are on no path. Nodes of a null tree are one tree. Each step stores its own rows only, and what all steps so far have
    stored is read as one table, so a step's plan doesn't grow with the depth.
    """
    spark = nodes.sparkSession
    own = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = own.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    with passing(spark) as paths:
        hops, far = [], first.select("tree", "node", F.col("n").alias("jump"), "score")
        most = None
        while True:
            seen = Observation()
            rows = stored(far.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("jump").alias("more")), "hops")
            hops.append(paths[-1])
            most = math.ceil(math.log2(seen.get["rows"] + 1)) + 1 if most is None else most
            a, done = rows.where("jump IS NOT NULL"), spark.read.schema(rows.schema).parquet(*hops).where("jump IS NULL")
            if not seen.get["more"] or len(hops) > most:
                break
            b = a.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("jump").alias("next"), F.col("score").alias("more"))
            far = a.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("jump") == F.col("n")))
            far = far.select("tree", "node", F.col("next").alias("jump"), (F.col("score") + F.col("more")).alias("score"))
        everything = spark.read.schema(rows.schema).parquet(hops[0])
        parents = everything.where("jump IS NOT NULL").select(F.col("tree").alias("t"), F.col("jump").alias("n")).distinct()
        leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
        ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node")))
        if best is not None:
            ranked = ranked.where(F.col("rank") <= best)
        on = stored(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up")), "ranked")
        found, schema = [paths[-1]], on.schema
        for k in reversed(range(len(hops))):
            hop = spark.read.schema(rows.schema).parquet(hops[k]).where("jump IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
            on = spark.read.schema(schema).parquet(*found).join(hop, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
            stored(on.select("tree", "leaf", "rank", F.col("jump").alias("node"), (F.col("up") + (1 << k)).alias("up")), "found")
            found.append(paths[-1])
        return cut(spark.read.schema(schema).parquet(*found))


def conversations(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss): a row for each chosen path of nodes (tree, node,
    parent, role, text, score), with `loss` the spans of assistant texts in `formatted`.

    Each turn is its role's mark, the escaped text, the closing mark and a newline. Null text counts as
    empty, a null role as the empty role. A tree without nodes has no row. Rows that repeat (tree, node)
    must not occur; `linear` numbers rows so that they don't.
    """
    paths = branches(nodes, best)
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = turns.withColumn("piece", F.concat(opening(F.col("role")), F.lit(" "), F.col("body"), F.lit(" "), closing(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.length(opening(F.col("role"))) + 1)
    span = F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    rows = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "piece", span.alias("span")))).alias("rows"))
    formatted = F.array_join(F.transform("rows", lambda r: r["piece"]), "")
    loss = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return rows.select("tree", "leaf", "rank", F.size("rows").cast("long").alias("n_turns"), formatted.alias("formatted"), loss.alias("loss"))


def linear(turns: DataFrame) -> DataFrame:
    """Nodes for conversations without branches (conv_id, turn, role, text): each row answers the one
    before it by turn; ties go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    marks, bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.transform(F.arrays_zip(marks.alias("mark"), bodies.alias("body")), lambda r: F.struct(role_of(r["mark"]).alias("role"), unescape(r["body"]).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

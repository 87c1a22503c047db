"""Mixing of sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, partitions, small


def targets(sources: DataFrame, share: tuple[int, int], most: int, weights: tuple[int, ...]) -> DataFrame:
    """Each source's target in tokens, from one row a source (source, source_size).

    The excess of sources that reach `most` times their size is shared again by weight until none is
    above. That ends at min(most * size, level * weight) for the one level that spends the budget, so
    sources are ordered by the level at which they fill up and two running sums find it.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(one) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    fill = F.col("cap") / F.col("weight")
    by_fill = Window.orderBy(fill, F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * share[0] / share[1]
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    stop = ranked.withColumn("level", level).withColumn("fill", fill)
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", F.col("source").isNull(), "source", "level"))).over(every)
    final = F.coalesce(first["level"], F.max("fill").over(every))
    return stop.select("source", "source_size", F.least(F.col("cap").cast("double"), final * F.col("weight")).alias("target"))


def mix(docs: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", size: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How many tokens the mix takes of every row: `keep`, source, size, source_size, target, taken.

    Rows get a hash-random key (of `seed` and doc_id) and are sorted by ranges of it within their
    source. Running sums of sizes inside the ranges, plus the sums of the ranges before, give each
    row's place in its source; whole epochs are taken of all, and the last one is cut exactly where
    the source's budget ends. A range holds about a quarter of a shuffle partition's share of rows,
    so a source with a third of all rows is spread over many tasks.

    Null text or size: size 0, taken 0. Null source: a source of its own, last in order. Null or
    repeated doc_id: ties of the key, each row counted by itself. Empty table: no rows. Sizes are
    words unless `size` is given.
    """
    spark = docs.sparkSession
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = cut(docs.select(*keep, "source", (n_words(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), hashed.alias("key")))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    plan = targets(sources, share, most, weights).withColumnRenamed("source", "s")
    everything = F.sum("rows").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = sources.select(F.col("source").alias("r"), F.ceil(F.col("rows") * 4.0 * partitions(spark) / everything).alias("ranges"))
    plan = cut(plan.join(ranges, F.col("s").eqNullSafe(F.col("r"))).drop("r"))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32))
    dealt = rows.join(small(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("part", part)
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("key", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    last = budget - epochs * F.col("source_size")
    cut_here = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("before") - F.col("within")))
    return placed.select(*keep, "source", "size", "source_size", "target", (epochs * F.col("size") + cut_here).cast("long").alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: a document once for each whole time it is
    taken, and its first words where the budget cuts it. Rows of which nothing is taken go, among them
    those without words. n_chars, where there is one, follows the text.

    doc_id ties: repeated rows of an id share what the id is given, in the order of their texts.
    """
    rows = docs.select("doc_id", "source", F.col("text"), F.md5("text").alias("text_hash"), F.struct("*").alias("row"))
    same = ("doc_id", "source", "text_hash")
    taken = mix(rows, keep=("doc_id", "text_hash"), **options)
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("taken")))).where("taken > 0")
    taken = taken.select(*(F.col(c).alias(f"t_{c}") for c in same), F.col("nth").alias("t_nth"), "size", "taken")
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    match = F.col("nth") == F.col("t_nth")
    for c in same:
        match &= F.col(c).eqNullSafe(F.col(f"t_{c}"))
    rest = F.col("taken") % F.col("size")
    counts = F.concat(F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = numbered.join(taken, match).withColumn("words", F.explode(counts))
    first = F.expr(r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', words, '}+'), 0)")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first)
    changed = {"text": text, "n_chars": F.length(text)}
    return out.select(*(changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("row")[f.name].alias(f.name) for f in docs.schema))

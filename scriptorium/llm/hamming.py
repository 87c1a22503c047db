"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

BITS = 64


def signs(embedding: Column) -> Column:
    """64 sign bits of a vector: bit i is whether the sum of its elements i, i + 64, ... is positive.
    Null for no vector; null elements count as 0."""
    def bit(i: Column) -> Column:
        own = F.filter(embedding, lambda x, k: F.pmod(k, F.lit(BITS)) == i)
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    short = F.aggregate(F.transform(embedding, lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    long = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.when(embedding.isNotNull(), F.when(F.size(embedding) <= BITS, short).otherwise(long))


def segment(code: Column, k: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, (k * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, width: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, hamming, rank): for each query the k rows of other ids with the least
    Hamming distance, ties by id. vectors and queries: id, code (64 bits).

    Codes are cut into segments; a code within m * (r + 1) - 1 bits of the query has one of its m
    segments within r bits of the query's. Round r probes every segment value at exactly r bits, takes a
    code only where its nearest segment is found first, and closes the queries whose kth verified
    distance is covered. Equal codes are one entry with their k + 1 lowest ids, for they tie in distance,
    so a vector with a third of all rows costs what any other does. At radius `width` all is covered.
    Segments have `width` bits, by default 8 or 16, whichever has about as many values as there are codes or fewer. The
    result doesn't depend on it. Recall over codes is 1; how well signs stand for the vectors isn't this operator's.

    Null code: neither found nor asked. A repeated id counts once for each different code. Fewer than k
    other ids: all of them. Empty table: no rows.
    """
    own = vectors.where("code IS NOT NULL AND id IS NOT NULL").select("id", "code").distinct()
    ranked = own.withColumn("at", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("at") <= k + 1)
    entries = cut(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = entries.count()
    width = width or (8 if n.bit_length() <= 12 else 16)
    m = BITS // width
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.struct(s.alias("seg"), segment(F.col("code"), s, width).alias("value")))
    table = cut(entries.select(F.col("code").alias("c"), F.size("ids").alias("n"), F.explode(parts).alias("p")).select("c", "n", "p.seg", "p.value"))
    asked = cut(queries.where("code IS NOT NULL").select("code").distinct().repartition(partitions(vectors.sparkSession), "code"))
    need = min(k + 1, entries.select(F.sum(F.size("ids"))).head()[0] or 0)
    open_, found = asked, None
    for r in range(width + 1):
        masks = [sum(1 << b for b in c) for c in combinations(range(width), r)]
        probes = open_.select(F.col("code").alias("q"), F.explode(parts).alias("p")).select("q", "p.seg", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda x: F.col("p.value").bitwiseXOR(x.cast("long")))).alias("value"))
        hits = probes.join(table, ["seg", "value"])
        apart = F.col("q").bitwiseXOR(F.col("c"))
        gaps = [F.bit_count(segment(apart, F.lit(s), width)) for s in range(m)]
        nearest = F.least(*gaps)
        at = F.array_position(F.array(*gaps), nearest) - 1
        hits = hits.where((nearest == r) & (at == F.col("seg"))).select("q", "c", "n", F.bit_count(apart).alias("d"))
        hits = hits if found is None else found.unionByName(hits)
        # entries behind `need` ids that lie strictly nearer can't be among the results
        nearer = Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
        less = hits.withColumn("sum", F.sum("n").over(nearer))
        found = cut(less.where(F.coalesce(F.col("sum"), F.lit(0)) < need).drop("sum"))
        covered = found.where(F.col("d") <= m * (r + 1) - 1).groupBy("q").agg(F.sum("n").alias("s")).where(F.col("s") >= need)
        open_ = cut(open_.join(covered.select(F.col("q").alias("code")), "code", "left_anti"))
        if not open_.limit(1).count():
            break
    near = found.join(entries.select(F.col("code").alias("c"), "ids"), "c").select("q", "d", F.explode("ids").alias("neighbor_id"))
    by_id = Window.partitionBy("q").orderBy("d", "neighbor_id")
    near = near.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    out = queries.where("code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct().join(near, "q").where(F.col("query_id") != F.col("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("d", "neighbor_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbor_id", F.col("d").cast("int").alias("hamming"), "rank")

"""Connected components, and a bounded Bloom filter, as DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node of edges (u, v): the least node that links reach.

    Alternating large and small stars: each round hangs nodes on the least neighbour they know, until
    every node hangs on its component's least one. Rounds grow with the logarithm of a component's size,
    and a node of many neighbours stays a column of rows, never one row's array.
    """
    def hang(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "w")
        return e.join(least, F.col("u") == F.col("w"))

    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    while True:
        # done when no node hangs on two others, and none that others hang on hangs itself
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if not ends.groupBy("n").agg(F.sum("hangs").alias("h"), F.max("holds").alias("o")).where("h > 1 OR h > 0 AND o > 0").limit(1).count():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hang(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    return e.select("u", F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())


class Bloom:
    """Marks of 64-bit hashes in at most 2**log_bits bits. It only ever lets too much through."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, name: str, log_bits: int = 26) -> Bloom:
        """From a column of longs. Executors combine the words, so the driver gets 2**(log_bits - 6) of
        them at most, whatever the number of rows."""
        def spot(shift: int) -> Column:
            return F.call_function("shiftrightunsigned", F.col(name), F.lit(shift)).bitwiseAND(F.lit((1 << log_bits) - 1))

        spots = hashes.select(F.explode(F.array(spot(0), spot(64 - log_bits))).alias("s"))
        word = F.call_function("shiftrightunsigned", F.col("s"), F.lit(6)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
        rows = spots.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # columns: rows of Python would take 20 times the memory
        words = np.zeros(1 << (log_bits - 6), np.int64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        log_bits = len(self.words).bit_length() + 5
        mask, out = np.uint64((1 << log_bits) - 1), np.ones(len(hashes), bool)
        for shift in (0, 64 - log_bits):
            s = (hashes >> np.uint64(shift)) & mask
            out &= (self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
        return out

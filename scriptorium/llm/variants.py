"""Spelling variants: words one edit apart, by a positional index of q-grams with a count filter."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import merge
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, small, stored

#: Letters of a run, of five or more; capitals other than A-Z stay as they are.
_RUN = re.compile("[a-zÀ-ÿ]{5,}")
Q = 2
_ENDS = ("\x02", "\x03")


def word_counts(docs: DataFrame, change: Callable[[str, str], str] | None = None, shortest: int = 5, id_col: str = "doc_id", text_col: str = "text", held: int = 300_000) -> DataFrame:
    """(word, n): how often each run of letters of all texts comes up, A-Z in lower case, of at least `shortest` (five or more)
    code points after `change(id as text, run)`. A task adds up its own words, at most `held` at a time, before they are shuffled."""
    prepare(docs.sparkSession)
    if shortest < 5:
        raise ValueError("words have five letters or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in Counter(_RUN.findall((text.as_py() or "").encode().lower().decode())).items():
                    word = change(key or "", word) if change else word
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) > held:
                    yield out()
        if total:
            yield out()

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(1)
def _begun(key: str) -> int:
    return zlib.crc32(f"{key}:".encode())


def one_letter_lost(key: str, word: str) -> str:
    """`word` without one code point, if 97 divides the crc32 of `key:word`; that one's place is the crc32 modulo the length."""
    h = zlib.crc32(word.encode(), _begun(key))
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def grams(word: str) -> list[str]:
    """The q-grams of a word between two marks, in order: one more than its code points."""
    padded = _ENDS[0] + word + _ENDS[1]
    return [a + b for a, b in zip(padded, padded[1:])]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


class Order:
    """Grams from the rarest on. An edit touches at most two grams of either word (one of the shorter), so two words one edit apart
    share one of the first three grams of each in this order (of the first two of the shorter)."""

    def __init__(self, counts: dict[str, int]):
        self.rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def first(self, word: str) -> list[tuple[str, int]]:
        """The three first grams and their places."""
        all_, of = grams(word), self.rank.get
        ranked = sorted([(of(g, -1), i) for i, g in enumerate(all_)])
        return [(all_[i], i) for _, i in ranked[: Q + 1]]

    def shared(self, longer: str, other: str, first: Callable[[str], list[tuple[str, int]]] | None = None) -> tuple[str, int] | None:
        """The first of the longer word's first grams that the other has too, at the same place (or one before, if it's shorter).
        `first`: one that remembers."""
        mine, its = map(first or self.first, (longer, other))
        places = set(its) if len(longer) == len(other) else {(g, i + k) for g, i in its[:Q] for k in (0, 1)}
        return next((x for x in mine if x in places), None)


class Postings:
    """The words of one length, by gram and place: ascending numbers of words. A gram at a place is one number, that at the next
    place the next number."""

    def __init__(self, words: list[str]):
        self.words, self.at, self.sets = words, {}, {}
        self.places = len(words[0]) + 2 if words else 2
        self.keys = [self._keys(w) for w in words]
        for i, keys in enumerate(self.keys):
            for k in keys:
                if k in self.at:
                    self.at[k].append(i)
                else:
                    self.at[k] = [i]

    def _keys(self, word: str) -> list[int]:
        c, m = memoryview((_ENDS[0] + word + _ENDS[1]).encode("utf-32-le")).cast("I"), self.places
        return [(a << 21 | b) * m + i for i, (a, b) in enumerate(zip(c, c[1:]))]

    def _set(self, number: int) -> set[int]:
        found = self.sets.get(number)
        if found is None:
            found = self.sets[number] = set(self.keys[number])
        return found

    def alike(self, number: int) -> Iterator[int]:
        """Words behind `number` that share all but two of its grams at their places. One that does is in one of the three
        shortest postings; the others are only looked up."""
        later, silent = [], 0  # silent: postings that end here
        for k in self.keys[number]:
            p = self.at[k]
            if p[-1] > number:
                later.append(p)
            else:
                silent += 1
                if silent > Q:
                    return
        starts = [(len(p) - start, start, p) for p in later for start in (bisect_right(p, number),)]
        starts.sort(key=itemgetter(0))
        mine = self._set(number)
        for i in _merged([p[start:] for _, start, p in starts[: Q + 1 - silent]]):
            if len(mine & self._set(i)) >= len(mine) - Q:
                yield i

    def longer(self, word: str) -> Iterator[int]:
        """Words a code point longer that share all but one of a word's grams, at the same place or the next."""
        both, at, lists, silent = self._keys(word), self.at.get, [], 0
        for k in both:
            x, y = at(k), at(k + 1)
            if x or y:
                lists.append((x or (), y or ()))
            else:
                silent += 1
                if silent >= Q:
                    return
        lists.sort(key=lambda x: len(x[0]) + len(x[1]))
        for i in _merged([p for x in lists[: Q - silent] for p in x if p]):
            its = self._set(i)
            if sum([k in its or k + 1 in its for k in both]) >= len(both) - 1:
                yield i


def _merged(lists: list[list[int]]) -> Iterator[int]:
    """Ascending lists' numbers, merged by a heap, each once."""
    last = -1
    for i in lists[0] if len(lists) == 1 else merge(*lists):
        if i != last:
            yield i
        last = i


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each gram is: at most the square of the letters' number, and a few."""
    padded = F.concat(F.lit(_ENDS[0]), "word", F.lit(_ENDS[1]))
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(Q))))
    return {r.g: r["count"] for r in words.select(F.explode(each).alias("g")).groupBy("g").count().collect()}


def near_pairs(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, n, other, other_n): all pairs of distinct words (word, n) that are one edit apart, each once.

    Each word posts itself under its three rarest grams with their places and its length, and visits the words one longer under
    its two rarest, at the same place and the next; words that meet so make a positional index of their own in a task. A cell of
    more than `most` words is cut by a hash into parts that meet two by two. A pair is told by the first cell where it meets.
    """
    spark = words.sparkSession
    prepare(spark)
    order = Order(gram_counts(words))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, size = order.first(word), len(word)
                rows += [(f"{g}{i} {size}", word, n, 0) for g, i in first]
                # each cell once: a gram and its repeat at the next place visit one together
                rows += [(f"{g}{i} {size + 1}", word, n, 1) for g, i in {(g, i + k): 0 for g, i in first[:Q] for k in (0, 1)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["cell", "word", "n", "visits"])

    posted = words.select("word", "n").mapInArrow(post, "cell string, word string, n long, visits int")
    wide = stored(posted.groupBy("cell").count().where(F.col("count") > most).select(F.col("cell").alias("wide"), F.ceil(F.col("count") / most).cast("int").alias("cuts")), "wide")
    cuts = F.coalesce("cuts", F.lit(1))
    part = F.pmod(F.xxhash64("word"), cuts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.struct(F.least(part, j).alias("low"), F.greatest(part, j).alias("high")))
    rows = posted.join(small(wide), F.col("cell") == F.col("wide"), "left").select("cell", "word", "n", "visits", part.alias("part"), F.explode(meets).alias("meet"))
    ordered = rows.select("cell", "meet.low", "meet.high", "visits", "word", "n", "part")
    ordered = ordered.repartition(partitions(spark), "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "visits", "word")

    def found(rows: list[tuple[int, str, int, int]]) -> Iterator[tuple[str, int, str, int]]:
        """Pairs of one cell's words, in two parts or one."""
        if len(rows) < 2 or rows[0][0]:
            return
        home = [r for r in rows if not r[0]]
        cell, across = rows[0][4], rows[0][5]
        index, firsts = Postings([r[1] for r in home]), {}

        def first(word: str) -> list[tuple[str, int]]:
            if word not in firsts:
                firsts[word] = order.first(word)
            return firsts[word]

        for i, (_, word, n, part, *_) in enumerate(home):
            for k in index.alike(i):
                other = home[k]
                if (not across or part != other[3]) and one_edit(word, other[1]) and order.shared(word, other[1], first) == cell:
                    yield word, n, other[1], other[2]
        for _, word, n, part, *_ in rows[len(home) :]:
            for k in index.longer(word):
                other = home[k]
                if (not across or part != other[3]) and one_edit(other[1], word) and order.shared(other[1], word, first) == cell:
                    yield word, n, other[1], other[2]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, place = (None, None, None), [], [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64()) * 2)], names=["word", "n", "other", "other_n"])

        for b in _and_none(batches):
            columns = [c.to_pylist() for c in b.columns] if b is not None else [[None]] * 7
            for cell, low, high, visits, word, n, part in zip(*columns):
                if cell != key[0] or low != key[1] or high != key[2]:
                    out.extend(found(rows))
                    if len(out) > 20_000:
                        yield batch()
                        out.clear()
                    key, rows = (cell, low, high), []
                    place = cell and (cell[:Q], int(cell[Q:].split(" ")[0]))
                if cell is not None:
                    rows.append((visits, word, n, part, place, low != high))
        if out:
            yield batch()

    return ordered.mapInArrow(search, "word string, n long, other string, other_n long")


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """None behind the last, to end the last cell."""
    yield from batches
    yield None


def variants(words: DataFrame, most: int = 20_000) -> DataFrame:
    """Groups of spelling variants among distinct words (word, n).

    A word's form is its near word (one inserted, deleted or replaced code point) of the largest n, the least in code-point order of
    several, if that n is at least twice the word's. Its root is reached by following forms to the last. Columns: word, form, root;
    n, n_near (how many near words), form_n.

    A root is found by letting each word point to where its form points, again and again: rounds grow with the logarithm of the
    longest chain, and a chain doubles n at each step. Null words are left out. Empty table: no rows.
    """
    words = words.where("word IS NOT NULL")
    pairs = near_pairs(words, most)
    ways = F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n")) for a, b, c in (("word", "other", "other_n"), ("other", "word", "n"))])
    each = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    found = best.select(F.col("word").alias("w"), "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    taken = F.col("near_n") >= 2 * F.col("n")
    table = stored(words.join(found, F.col("word") == F.col("w"), "left").select(
        "word", F.when(taken, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near_n")).alias("form_n"),
    ), "forms")
    ends = stored(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("at"), F.col("root").alias("on"))
        ends = stored(ends.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        if not ends.where("moved").limit(1).count():
            break
        ends = ends.select("word", "root")
    roots = ends.select(F.col("word").alias("w"), "root")
    return table.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Repeated byte strings by a distributed merge sort of sparse suffixes that never re-compares known
prefixes."""

from __future__ import annotations

import hashlib
import pickle
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import partitions, prepare
from .jaccard import _BASE, _mix, _powers
from .links import Bloom


def anchors(a: np.ndarray, width: int, window: int, stretch: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, last, hashes): each start of a string of width + window - 1 bytes has one anchor,
    the first of the `window` places inside it whose `width` bytes hash least, by 40 bits. It depends on the string
    alone, so equal strings have theirs at the same distance. An anchor serves the starts first to last.
    Very long texts go in stretches of starts.
    """
    n = len(a) - width + 1
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if n - window + 1 > stretch:
        parts = []
        for x in range(0, n - window + 1, stretch):
            places, first, last, h = anchors(a[x : x + stretch + window + width - 2], width, window, stretch)
            parts.append((places + x, first + x, last + x, h))
        return tuple(np.concatenate(c) for c in zip(*parts))
    power, inverse = _powers(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)])])
    h = _mix((sums[width:] - sums[:-width]) * inverse[:n])
    low = np.uint64((1 << 24) - 1)
    key = h & ~low | np.arange(n, dtype=np.uint64)
    pad = -n % window
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, window)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - window + 1], left[window - 1 : n])  # of the places from each start
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], change])
    places = (least[first] & low).astype(np.int64)
    return places, first, np.concatenate([change, [len(least)]]) - 1, h[places]


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, known to be `start` at least."""
    n, at, step = min(len(a), len(b)), start, 16
    while at < n and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= n:
        return n
    step = min(step, n - at)
    while step > 1:
        half = step // 2
        if a[at : at + half] == b[at : at + half]:
            at += half
            step -= half
        else:
            step = half
    return at + (at < n and a[at] == b[at])


def front_code(run: list[tuple[bytes, tuple]]) -> bytes:
    """A sorted run, each suffix as the length of the prefix it shares with the one before, and the rest."""
    out, last = [], b""
    for s, more in run:
        k = common(last, s)
        out.append((k, s[k:], more))
        last = s
    return zlib.compress(pickle.dumps(out, 5), 1)


class Run:
    """A front-coded run, read in order. `shared`: the prefix in common with the last suffix that the
    merge gave out."""

    def __init__(self, coded: bytes):
        self.rows, self.at, self.suffix, self.shared, self.more = pickle.loads(zlib.decompress(coded)), 0, b"", 0, None
        self.step()

    def step(self) -> None:
        """On to the next suffix; the last one was just given out, so the coded length is known shared."""
        if self.at == len(self.rows):
            self.suffix = None
            return
        self.shared, rest, self.more = self.rows[self.at]
        self.suffix = self.suffix[: self.shared] + rest
        self.rows[self.at] = None
        self.at += 1


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the last one, suffix, more) of all runs in order: a tree of losers. Of two
    suffixes the one that shares more with the last winner is the lesser; only on a tie are bytes
    compared, from the known prefix on, and the loser remembers what it shares with its winner."""
    heads = [Run(r) for r in runs]
    k = len(heads)
    if not k:
        return

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x.suffix is None or y.suffix is None:
            return (b, a) if x.suffix is None else (a, b)
        if x.shared != y.shared:
            return (a, b) if x.shared > y.shared else (b, a)
        n = common(x.suffix, y.suffix, x.shared)
        if x.suffix[n:] <= y.suffix[n:] if n == min(len(x.suffix), len(y.suffix)) else x.suffix[n] < y.suffix[n]:
            y.shared = n
            return a, b
        x.shared = n
        return b, a

    losers = [-1] * (2 * k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner].suffix is not None:
        head = heads[winner]
        yield head.shared, head.suffix, head.more
        head.step()
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def spans_of(group: list[tuple[bytes, bytes, int, int]], shared: list[int], length: int, small: int = 12) -> list[list[tuple[int, int]]]:
    """For each (suffix, reversed left context, least d, copies) of a sorted group with the prefix lengths that
    neighbours share: the ranges (least, most) of d for which the string that starts d bytes to the left
    occurs elsewhere. It does if another one shares d bytes to the left and length - d to the right."""
    n = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for i, (s, left, least, copies) in enumerate(group):
        if copies > 1 and least <= len(left):
            out[i] = [(least, len(left))]
    if n <= small:
        for i in range(n):
            right = length
            for j in range(i + 1, n):
                right = min(right, shared[j])
                lo = max(length - right, group[i][2], group[j][2])
                hi = common(group[i][1], group[j][1]) if lo <= len(group[i][1]) else -1
                if lo <= hi:
                    out[i].append((lo, hi))
                    out[j].append((lo, hi))
        return out
    order = sorted(range(n), key=lambda i: group[i][1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lefts = np.array([0] + [common(group[order[k - 1]][1], group[order[k]][1]) for k in range(1, n)])
    rights, own = np.array([0, *shared[1:]]), np.array([len(g[1]) for g in group])
    starts, copies = np.array([g[2] for g in group]), np.array([g[3] for g in group])
    on = np.zeros(n, bool)
    since = np.zeros(n, np.int64)
    for d in range(int(own.max()) + 2):
        block = np.cumsum(rights < length - d)
        kind = np.cumsum(lefts < d)[place]
        can = (own >= d) & (starts <= d)
        key = np.where(can, block * (n + 1) + kind, -1)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        now = can & ((count[which] > 1) | (copies > 1))
        for i in np.flatnonzero(now & ~on):
            since[i] = d
        for i in np.flatnonzero(on & ~now):
            out[i].append((int(since[i]), d - 1))
        on = now
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as maximal ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, length: int = 400, width: int = 100, cuts_a_part: int = 20, also: int | None = None, sampled: int = 8) -> DataFrame:
    """(text_key, spans, short_spans): for each distinct text with any, the spans of bytes covered by a string
    of `length` bytes that also starts elsewhere, and those for strings of `also` bytes, a lesser number. text_key is
    the text's md5 as bytes. Spans may overlap.

    1. Anchors are places chosen by content, so that equal strings of `length` bytes have one at the same
       place. Anchors whose `width` bytes occur once in the input can't lie in a repeat and go.
       Anchors are those of the shortest strings: each longer string starts with one.
    2. Each task sorts the suffixes of its anchors (the `length` bytes from each, with the bytes back to
       the first start that it serves) and sends the sorted run, front-coded, in ranges. Equal suffixes with equal left
       contexts are one entry of the run, so a passage that a third of all documents hold is one row a
       task. Splitters are a bounded sample from one text in `sampled`, and hold fewer than `width` bytes, so strings that share
       `width` bytes meet in one range.
    3. A tree of losers merges a range's runs. Neighbours' shared prefixes then bound groups, in which
       every start that an anchor serves is settled: see `spans_of`.
    """
    spark = docs.sparkSession
    prepare(spark)
    lengths = [length] if also is None else [length, also]
    window = lengths[-1] - width + 1
    texts = docs.where("text IS NOT NULL").select("text")

    def found(batches: Iterator[pa.RecordBatch], met: set) -> Iterator[tuple]:
        """(key, bytes, places, first, last, hashes, seen before in this task)"""
        for b in batches:
            for t in b.column(0):
                data = t.as_py().encode()
                if len(data) >= lengths[-1]:
                    key = hashlib.md5(data).digest()
                    marks = anchors(np.frombuffer(data, np.uint8), width, window) if key not in met else ((), (), (), ())
                    yield key, data, *marks, key in met
                    met.add(key)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held, met, copied = [], 0, set(), {}

        def flush():
            h, c = np.unique(np.concatenate(some), return_counts=True)
            for k in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 200_000].view(np.int64)), pa.array(np.minimum(c[k : k + 200_000], 2))], names=["hash", "n"])

        for key, data, _, _, _, h, again in found(batches, met):
            if again:  # a copy: its suffixes repeat whatever they are
                h = anchors(np.frombuffer(data, np.uint8), width, window)[3] if key not in copied else ()
                copied[key] = True
            if len(h):
                some.append(h)
                held += len(h)
            if held > 2_000_000:
                yield from flush()
                some, held = [], 0
        if some:
            yield from flush()

    many = texts.mapInArrow(hashes, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    bloom = spark.sparkContext.broadcast(Bloom.of(many, "hash").words)

    def entries(batches: Iterator[pa.RecordBatch], flush_bytes: int = 48 << 20) -> Iterator[list]:
        """Sorted lists of (suffix, (reversed left context, least distance, copies, [(key, place)]))."""
        held, run, met, again = 0, {}, set(), {}
        marks = Bloom(bloom.value)
        for key, data, at, first, last, h, seen in found(batches, met):
            if seen:
                again[key] = len(data)
                continue
            if not len(h):
                continue
            for p, x, y, good in zip(at.tolist(), first.tolist(), last.tolist(), marks.has(h).tolist()):
                if good:
                    entry = (data[p : p + length], data[x:p][::-1], p - y)
                    if entry in run:
                        run[entry].append((key, p))
                        held += 60
                    else:
                        run[entry] = [(key, p)]
                        held += length + p - x + 260
            if held > flush_bytes:
                yield sorted((s, (left, least, len(own), own)) for (s, left, least), own in run.items()), {}
                held, run = 0, {}
        yield sorted((s, (left, least, len(own), own)) for (s, left, least), own in run.items()), again

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Bloom(bloom.value)
        for key, data, at, _, _, h, seen in found(batches, set()):
            some = [p for p, x, good in zip(at, h, marks.has(h) if len(h) else ()) if good and int(x) % 7 == 0]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([data[p : p + width // 2] for p in some], pa.binary()), pa.array([int(h_) for h_ in np.array([zlib.crc32(data[p : p + width]) for p in some])], pa.int64())], names=["cut", "draw"])

    parts = partitions(spark)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(sampled)) == 0)  # results don't depend on where ranges are cut
    drawn = some.mapInArrow(sample, "cut binary, draw long").orderBy("draw", "cut").limit(cuts_a_part * parts).collect()
    points = sorted({bytes(r["cut"]) for r in drawn})
    points = sorted({points[i * len(points) // parts] for i in range(1, parts)}) if points else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, again in entries(batches):
            ranges: dict[int, list] = {}
            for entry in run:
                ranges.setdefault(bisect_right(points, entry[0][: width // 2]), []).append(entry)
            for k, part in ranges.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([front_code(part)], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())], names=["range", "run", "text_key", "n"])
            if again:
                keys = list(again)
                yield pa.RecordBatch.from_arrays([pa.array([i % (len(points) + 1) for i in range(len(keys))], pa.int32()), pa.array([None] * len(keys), pa.binary()), pa.array(keys, pa.binary()), pa.array([again[k] for k in keys], pa.int64())], names=["range", "run", "text_key", "n"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, rows = [], []

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], names=["text_key", "first", "end", "kind"])
            rows.clear()
            return b

        for b in batches:
            for run, key, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if run is not None:
                    coded.append(run)
                else:
                    rows.extend((key, 0, n, kind) for kind, least in enumerate(lengths) if n >= least)
        group, shared = [], []

        def close() -> None:
            if len(group) == 1 and group[0][1][2] == 1:
                return
            for kind, n in enumerate(lengths):
                members = [(s, left, max(least, n - len(s)), copies) for s, (left, least, copies, _) in group]
                for (_, (*_, own)), spans in zip(group, spans_of(members, shared, n)):
                    for lo, hi in joined([(a, b + 1) for a, b in spans]):
                        rows.extend((key, p - hi + 1, p - lo + n, kind) for key, p in own)

        for k, s, more in merged(coded):
            if group and k < width:
                close()
                group, shared = [], []
                if len(rows) > 20_000:
                    yield batch()
            if group and s == group[-1][0] and more[:2] == group[-1][1][:2]:  # the same in another run
                left, least, copies, own = group[-1][1]
                group[-1] = (s, (left, least, copies + more[2], own + more[3]))
            else:
                group.append((s, more))
                shared.append(k)
        if group:
            close()
        if rows:
            yield batch()

    sent = texts.mapInArrow(runs, "range int, run binary, text_key binary, n long")
    settled = sent.repartition(len(points) + 1, "range").mapInArrow(settle, "text_key binary, first long, end long, kind long")
    span = F.struct("first", "end")
    kinds = [F.collect_set(F.when(F.col("kind") == k, span)).alias(name) for k, name in enumerate(("spans", "short_spans"))]
    return settled.groupBy("text_key").agg(*kinds)


def remove_repeats(docs: DataFrame, words: int | None = None, **options) -> DataFrame:
    """`docs` plus n_bytes, n_removed, n_spans and `kept`, the bytes of the whole text that are left when
    each byte covered by a repeated string goes. `removed` holds the maximal spans. n_passages: how many maximal runs of
    repeated strings of `also` bytes have at least `words` words; null without these two.

    Null text counts as empty; texts shorter than the string are whole. Very long texts are whole, too. Copies of a
    text repeat each other. An empty table gives no rows. Other columns pass unchanged, but those of the names above
    are replaced.
    """
    own = ["n_bytes", "n_removed", "n_spans", "n_passages", "removed", "kept"]
    docs = docs.drop(*own)
    names, at = docs.columns, docs.columns.index("text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5("text")).alias("text_key"))
    found = repeats(docs, **options).withColumnRenamed("text_key", "found_key")
    rows = keyed.join(found, F.col("text_key") == F.col("found_key"), "left").select("row", "spans", "short_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in own]
            columns = b.column(0).flatten()
            for text, spans, short in zip(columns[at].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (text or "").encode()
                gone = joined([(s["first"], s["end"]) for s in spans or ()])
                left = np.ones(len(data), bool)
                for x, y in gone:
                    left[x:y] = False
                kept = np.frombuffer(data, np.uint8)[left].tobytes() if gone else data
                passages = None if words is None else sum(len(data[x:y].split()) >= words for x, y in joined([(s["first"], s["end"]) for s in short or ()]))
                for c, v in zip(out, (len(data), len(data) - len(kept), len(gone), passages, [[x, y] for x, y in gone], kept)):
                    c.append(v)
            types = [*[pa.int64()] * 4, pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(out, types))], names=[*names, *own])

    schema = StructType([*docs.schema.fields])
    for name in own[:4]:
        schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("removed", ArrayType(ArrayType(LongType()))).add("kept", "binary"))

"""Exact similarity join of word n-gram sets by prefix filters under several token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, prepare, sweep
from .links import Bloom, components

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"n": np.cumprod(np.full(1 << 16, _BASE, np.uint64))}
#: A token is counted if these of its bits are 0: one in four.
COUNTED = np.uint64(3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["n"]) < n or "inv" not in _POWERS:
        size = max(n, len(_POWERS["n"]))
        _POWERS["n"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _POWERS["inv"] = np.cumprod(np.full(size, _INVERSE, np.uint64))
    return _POWERS["n"], _POWERS["inv"]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles, A-Z lower-cased. A text of
    fewer words is one shingle; one without words has none."""
    a = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], (a != 32) & ((a < 9) | (a > 13)), [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    power, inverse = _powers(len(a) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)])])
    words = _mix((sums[end] - sums[start]) * inverse[start])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(start, first).tolist()

    def of(w: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _BASE + w[i : len(w) - k + 1 + i])
        return out

    windows = of(words, n) if len(words) >= n else words[:0]
    out = []
    for x, y in zip(at, at[1:]):
        if y - x < n:
            out.append(of(words[x:y], y - x) if y > x else words[:0])
        else:
            t = np.sort(windows[x : y - n + 1])
            out.append(t[np.concatenate([[True], t[1:] != t[:-1]])])
    return out


def prefix(tokens: np.ndarray, share: int, shared: Bloom | None, heavy: np.ndarray | None = None) -> np.ndarray:
    """The first tokens of a set under the first order: two sets with `share`% of Jaccard similarity
    share one of them. First come counted tokens not known to be `shared`, then those not counted, then
    shared ones, then `heavy` ones (sorted), each by a hash."""
    return tokens[first_order(tokens, marks(tokens, shared), heavy)[: _length(len(tokens), share)]]


def marks(tokens: np.ndarray, shared: Bloom | None) -> np.ndarray | None:
    """0 for counted tokens that one set alone has, 1 for those not counted, 2 for shared ones."""
    if shared is None:
        return None
    out = np.ones(len(tokens), np.uint64)
    counted = np.flatnonzero(tokens & COUNTED == 0)
    out[counted] = 2 * shared.has(tokens[counted])
    return out


def first_order(tokens: np.ndarray, rank: np.ndarray | None, heavy: np.ndarray | None) -> np.ndarray:
    key = _mix(tokens + _BASE) >> np.uint64(2)
    if rank is not None:
        if heavy is not None and len(heavy):
            rank = rank.copy()
            rank[heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens] = 3
        key |= rank << np.uint64(62)
    return np.argsort(key)


def sketch(tokens: np.ndarray, share: int) -> list[int]:
    """25 longs that screen a pair of sets before the sets move.

    The first 17 bound how much two sets have in common: tokens are dealt to 256 places, whose counts
    stand in four bits each, from a base that follows the set's size, and the number behind them counts tokens
    beyond that. Then come the places of the prefix tokens of the second order in four
    words, and of the third order's in four more: a pair needs a place in common in both.
    """
    place = _mix(tokens ^ _BASE) & np.uint64(255)
    counts, base = np.bincount(place, minlength=256), int(_floor(len(tokens)))
    held = (np.clip(counts, base, base + 15) - base).astype(np.uint8)
    order, k = _second(tokens), _length(len(tokens), share)
    ends = np.zeros((2, 256), bool)
    ends[0, place[order[:k]]] = ends[1, place[order[len(tokens) - k :]]] = True
    ends = np.packbits(ends, axis=1, bitorder="little")
    return [*(held[:128] | held[128:] << 4).view("<i8").tolist(), int(np.maximum(counts - base - 15, 0).sum()), *ends.view("<i8").ravel().tolist()]


def _floor(size):
    """The least count that a sketch tells apart: for large sets, a little under the mean."""
    return np.clip(size // 256 - 7, 0, 240)


class Sketches:
    """Sketches of several sets, ready to compare."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, share: int):
        self.sizes, self.share, self.floor = sizes.astype(np.int64), share, _floor(sizes)
        held = np.ascontiguousarray(rows[:, :16]).view(np.uint8)
        self.counts = np.concatenate([held & 15, held >> 4], 1) + self.floor[:, None].astype(np.uint8)
        self.excess, self.ends = rows[:, 16].astype(np.int64), np.ascontiguousarray(rows[:, 17:]).view(np.uint64)

    def hopes(self, i, j) -> np.ndarray:
        """What the sets at i and j can share per 1,000,000 of their union; 0 where they can't be similar enough, by size,
        by what they can have in common, or by prefixes in the second and third order."""
        a, b, share = self.sizes[i], self.sizes[j], self.share
        most = np.minimum(self.counts[i], self.counts[j]).sum(-1, dtype=np.int64)
        x, y = self.excess[i], self.excess[j]
        most = np.minimum(most + np.where(self.floor[i] == self.floor[j], np.minimum(x, y), x + y), np.minimum(a, b))
        union = a + b - most
        both = self.ends[i] & self.ends[j]
        ok = (100 * most >= share * union) & both[..., :4].any(-1) & both[..., 4:].any(-1)
        return np.where(ok, 1_000_000 * most // np.maximum(union, 1), 0)


def _second(tokens: np.ndarray) -> np.ndarray:
    """The places of a set's tokens in the second order; the third order is its reverse."""
    return np.argsort(_mix(tokens + _BASE + _BASE))


def hopeful_in_small_groups(key: np.ndarray, sketches: Sketches, component: np.ndarray, far: np.ndarray) -> np.ndarray:
    """`hopeful` for many small groups at once, rows sorted by `key`: all pairs, as two columns. Where a group has
    two sides in `far`, only sets on different sides are paired."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    two = (np.minimum.reduceat(far, starts) != np.maximum.reduceat(far, starts))[group]
    out, sizes, share = [np.zeros((0, 2), np.int64)], sketches.sizes, sketches.share
    for d in range(1, len(key)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        i = i[(component[i] != component[i + d]) & (~two[i] | (far[i] != far[i + d]))]
        i = i[100 * np.minimum(sizes[i], sizes[i + d]) >= share * np.maximum(sizes[i], sizes[i + d])]
        i = i[sketches.hopes(i, i + d) > 0]
        out.append(np.stack([i, i + d], 1))
    return np.concatenate(out)


def forest(sketches: Sketches, component: np.ndarray, far: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of a group that, if all of them link, join all that can be joined: a spanning forest over its
    components with the greatest bounds, grown from one set at a time. No more pairs than sets. `far`: only
    sets on different sides are paired."""
    n = len(component)
    best, parent, out = np.zeros(n, np.int64), np.full(n, -1), []
    open_ = np.ones(n, bool)
    for _ in range(n):
        k = int(np.argmax(np.where(open_, best, -1)))
        if best[k] and parent[k] >= 0:
            out.append((int(parent[k]), k))
        open_[k] = False
        same = open_ & (component == component[k])
        best[same], parent[same] = 1 << 40, -1
        if not open_.any():
            break
        h = sketches.hopes(k, slice(None))
        if far is not None:
            h[far == far[k]] = 0
        better = open_ & (h > best)
        best[better], parent[better] = h[better], k
    return out


def hopeful(sketches: Sketches, component: np.ndarray, far: np.ndarray | None = None, most: int | None = None) -> np.ndarray | None:
    """All pairs of a group, sorted by size, in different components that the sketches don't rule out, as two columns;
    None if there are more than `most`. Sets of the largest component needn't be paired among themselves."""
    names, counts = np.unique(component, return_counts=True)
    rest = np.flatnonzero(component != names[np.argmax(counts)])
    place, sizes = np.full(len(component), -1), sketches.sizes
    place[rest] = np.arange(len(rest))
    out, held, step = [np.zeros((0, 2), np.int64)], 0, max(1, min(32, 8_000 // len(component)))
    for x in range(0, len(rest), step):
        rows = rest[x : x + step]
        lo = np.searchsorted(100 * sizes, sketches.share * sizes[rows[0]])
        hi = np.searchsorted(sketches.share * sizes, 100 * sizes[rows[-1]], "right")
        ok = (component[rows][:, None] != component[lo:hi]) & (place[lo:hi] < place[rows][:, None])
        if far is not None:
            ok &= far[rows][:, None] != far[lo:hi]
        if ok.any():
            i, j = np.nonzero(ok)
            i, j = rows[i], j + lo
            good = sketches.hopes(i, j) > 0
            out.append(np.stack([i[good], j[good]], 1))
            held += int(good.sum())
        if most is not None and held > most:
            return None
    return np.concatenate(out)


def _length(size: int, share: int) -> int:
    return size - -(-share * size // 100) + 1


class Frequent:
    """Tokens that come up `least` times or more in some stretch of a task's sets, and how often."""

    def __init__(self, least: int = 8, stretch: int = 2_000_000):
        self.least, self.stretch, self.waiting, self.held, self.sums = least, stretch, [], 0, {}

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held >= self.stretch:
            self.close()

    def close(self) -> None:
        if self.waiting:
            tokens, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            for t, c in zip(tokens[counts >= self.least].tolist(), counts[counts >= self.least].tolist()):
                self.sums[t] = self.sums.get(t, 0) + c
        self.waiting, self.held = [], 0

    def rows(self) -> Iterator[list[np.ndarray]]:
        self.close()
        items = list(self.sums.items())
        for k in range(0, len(items), 20_000):
            t, c = (np.array(x) for x in zip(*items[k : k + 20_000]))
            yield [np.zeros(len(t), np.int64), t.astype(np.uint64).view(np.int64), c.astype(np.int64), np.full(len(t), 2), np.zeros(len(t), np.int64), [None] * len(t)]


def node_of(tokens: np.ndarray) -> int:
    """The set's own hash: documents with equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, n: int, schema: str, rows_of, again: bool = False, tally=None, only=None) -> DataFrame:
    """Rows that `rows_of(id, tokens, node, new)` gives for each document, as columns; `new`: the task's
    first document of this node. Without `again`, only for those. `tally()` gives a task a pair of
    functions: one takes the sets of new nodes, one gives rows at the end. `only`: a broadcast Bloom filter;
    texts whose xxhash64 it doesn't hold are passed over. `id` is (doc_id, xxhash64 of the text)."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int | None] = set()

        def batch(columns: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) and not pa.types.is_list(t) else c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        columns, held, waiting, size = [[] for _ in names], 0, [], 0
        add, rest = tally() if tally else (None, None)

        def work() -> None:
            nonlocal held
            for (key, _), tokens in zip(waiting, shingle_sets([t for _, t in waiting], n)):
                node = node_of(tokens) if len(tokens) else None
                if add and len(tokens) and node not in met:
                    add(tokens)
                if again or (len(tokens) and node not in met):
                    rows = rows_of(key, tokens, node, node not in met)
                    met.add(node)
                    if rows is not None:
                        held += len(tokens)
                        for c, x in zip(columns, rows):
                            c.append(x)
            waiting.clear()

        for b in batches:
            if only is not None:
                b = b.filter(pa.array(Bloom(only.value).has(b.column(2).to_numpy().view(np.uint64))))
            for key, place, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                waiting.append(((key, place), (text.as_py() or "").encode()))
                size += len(waiting[-1][1])
                if size > 200_000 or len(waiting) > 2000:
                    work()
                    size = 0
                    if held > 200_000 or len(columns[0]) > 20_000:
                        yield batch(columns)
                        columns, held = [[] for _ in names], 0
        work()
        if columns[0]:
            yield batch(columns)
        if rest:
            yield from (batch([[x] if isinstance(x, np.ndarray) else x for x in c]) for c in rest())

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, schema)


def verified_in_blocks(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, share: int, most_tokens: int = 200_000) -> DataFrame:
    """The pairs (a, b) that link, of `sets` (node, tokens in the second order) with `sizes` (node, size).
    Nodes are dealt to blocks by the least node within two pairs of them, so the nodes of a family of like
    texts meet, and each set is sent once a pair of blocks instead of once a pair. A block holds at most
    about `most_tokens`."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    far = ends.join(near.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("label"))
    block = cut(far.join(sizes.select("node", "size"), "node"))
    large = block.groupBy("label").agg(F.ceil(F.sum("size") / most_tokens).alias("parts"))
    block = cut(block.join(large, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")))
    a, b = block.toDF("a", "block_a"), block.toDF("b", "block_b")
    both = pairs.join(a, "a").join(b, "b")
    both = cut(both.select(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("key"), "a", "b"))
    needed = both.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = needed.join(sets, "node").select(F.col("key").alias("to"), "node", "tokens")

    def verify(key, rows, members):
        import pandas as pd

        own = {n: np.asarray(t, np.int64) for n, t in zip(members["node"].tolist(), members["tokens"])}
        whole = {n: np.sort(t) for n, t in own.items()}
        ok = []
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
            x, y = own[a], own[b]
            i, j = _length(len(x), share), _length(len(y), share)
            good = np.isin(x[:i], y[:j]).any() and np.isin(x[len(x) - i :], y[len(y) - j :]).any()
            if good:
                x, y = whole[a], whole[b]
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good = 100 * common >= share * (len(x) + len(y) - common)
            ok.append(bool(good))
        return rows.loc[np.array(ok, bool), ["a", "b"]] if len(ok) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return both.groupBy("key").cogroup(sent.groupBy("to")).applyInPandas(verify, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first column, in stretches that never cut a group. Lists of longs
    become rows of a matrix."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in b.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or held and held[-1][0][-1] != cols[0][0]:
            whole = [*held, [c[:last] for c in cols]]
            yield [np.concatenate(c) for c in zip(*whole)]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def dealt(rows: DataFrame, piece: int) -> DataFrame:
    """(key, side, node, component) from rows (token, node, component): a group of more than `piece` rows
    is dealt to pieces by node, and each two pieces meet under a key of their own, so no task holds more than two
    pieces of a group."""
    large = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")).where("pieces > 1")
    rows = rows.join(large, "token", "left")
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    whole = rows.where("pieces IS NULL").select(F.col("token").alias("key"), F.lit(0).alias("side"), "node", "component")
    split = rows.where("pieces IS NOT NULL").withColumn("side", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    key = F.xxhash64("token", F.least("side", "with"), F.greatest("side", "with"))
    return whole.unionByName(split.select(key.alias("key"), "side", "node", "component"))


def met_in_groups(rows: DataFrame, known: DataFrame, share: int, a_row: int | None) -> DataFrame:
    """(a, b, more) from rows (key, side, node, component) and known (node, size, sketch): pairs of nodes
    in different components that meet under a key and that sketches don't rule out. All of a group if it has
    at most 32 rows, they are at most `a_row` times its rows, or that is None; else a spanning forest of the group, and a row with the key as
    `more`."""
    parts = partitions(rows.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        more: list[int] = []
        held = 0

        def batch() -> pa.RecordBatch:
            p = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            ends = [pa.array([*p[:, k].tolist(), *[None] * len(more)], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*ends, pa.array([*[None] * len(p), *more], pa.int64())], names=["a", "b", "more"])

        for key, side, node, component, size, sketches in whole_groups(batches):
            ends = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
            small = np.repeat(np.diff(ends) <= 32, np.diff(ends))
            if small.any():
                found = hopeful_in_small_groups(key[small], Sketches(sketches[small], size[small], share), component[small], side[small])
                out.append(np.sort(node[small][found], axis=1))
                held += len(found)
            for x, y in zip(ends, ends[1:]):
                if y - x <= 32 or (component[x:y] == component[x]).all():
                    continue
                order = np.argsort(size[x:y], kind="stable") + x
                far = side[order]
                own = Sketches(sketches[order], size[order], share), component[order], far if (far != far[0]).any() else None
                found = hopeful(*own, a_row * (y - x) if a_row else None)
                if found is None:
                    found = np.array(forest(*own)).reshape(-1, 2)
                    more.append(int(key[x]))
                out.append(np.sort(node[order][found], axis=1))
                held += len(found)
                if held > 50_000:
                    yield batch()
                    out, more, held = [], [], 0
            if held > 50_000 or len(more) > 10_000:
                yield batch()
                out, more, held = [], [], 0
        if out:
            yield batch()

    sent = rows.join(known.select("node", "size", "sketch"), "node").select("key", "side", "node", "component", "size", "sketch")
    sent = sent.repartition(parts, "key").sortWithinPartitions("key", "node")
    return sent.mapInArrow(pairs, "a long, b long, more long")


def met_in_turns(rows: DataFrame, known: DataFrame, share: int, a_row: int | None, most: int) -> DataFrame:
    """`met_in_groups`, stored, in turns over the keys that send about `most` rows with a sketch each: what one turn has sent
    goes before the next one."""
    turns = max(1, -(-rows.count() // max(1, most)))
    own = F.pmod(F.xxhash64("key", F.lit("turn")), F.lit(turns))
    return reduce(DataFrame.unionByName, [cut(met_in_groups(rows.where(own == k), known, share, a_row)) for k in range(turns)])


def similar(docs: DataFrame, n: int = 4, share: int = 85, log_bits: int = 26, most_heavy: int = 200_000, piece: int = 4096, a_row: int = 4, most_sent: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) for every document: the size of its set of n-word
    shingles, the least doc_id reachable by links of at least `share`% Jaccard similarity, and whether
    its set has a link to a different set.

    Equal sets are one node. A quarter of all tokens, chosen by their hash, are counted over the input,
    and a Bloom filter of 2**log_bits bits holds those of several nodes; the first order puts them last,
    so passages that documents share rarely lie in a prefix (false positives only move a token back). Behind
    them come the `most_heavy` tokens most frequent in single tasks, whatever their hash.
    Nodes that share a prefix token of the first order meet in that token's group, as candidates. A
    node's sketch of 25 longs intersects this with the second and third order's prefix filters and bounds what two sets
    share, before any set moves. Three rounds find the components:

    1. Each node is paired with one leader, the node of its groups with the fewest tokens of its own. The
       links found that way join most copies of a text, however many, with one pair each.
    2. Of every group that still holds several components, the pairs across them that the sketches
       allow. If these are more than `a_row` times the group's rows, a spanning forest of them, likeliest first.
    3. All pairs that are left in those groups: in different components, allowed by the sketches, not
       yet compared.

    Groups of the same nodes count once. The sketches of a group's rows are sent in turns of about `most_sent` a node, so that what
    they take on disk grows with the nodes, however many groups a node is in. So the pairs compared are linear in the rows but for near misses: sets that look similar enough and
    aren't. Whole sets decide. Groups beyond `piece` rows are split, see `dealt`. Tokens counted in one
    node only aren't sent: nobody meets there.

    Null or empty text, or no word: n_shingles 0, in a component of its own. Repeated rows: equal sets.
    Null doc_id: linked like any other, but names a component only if there is no other id in it. Very
    long texts are one set like others. Other columns, whatever their names, are left out. Hashes
    of tokens and sets have 64 bits. Empty table: no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")

    def frequent():
        f = Frequent()
        return f.add, f.rows

    def member(key, tokens, node, new):
        (key, place), screen = key, sketch(tokens, share) if new and len(tokens) else None
        return key if key is not None else 0, node if node is not None else 0, len(tokens), int(key is None), place, screen

    look = cut(_sets(docs, n, "doc_id long, node long, size long, kind long, place long, sketch array<bigint>", member, again=True, tally=frequent))
    members = look.where("kind < 2").select(F.when(F.col("kind") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("size") > 0, F.col("node")).alias("node"), "size")
    sketches = look.where("sketch IS NOT NULL").select("node", "size", "sketch", "place")
    top = look.where("kind = 2").groupBy("node").agg(F.sum("size").alias("c")).orderBy(F.desc("c"), "node").limit(most_heavy)
    heavy = spark.sparkContext.broadcast(np.sort(top.select("node").toArrow()["node"].to_numpy().view(np.uint64)))

    def counted(key, tokens, node, new):
        some = tokens[tokens & COUNTED == 0]
        return (some.view(np.int64),) if len(some) else None

    often = _sets(docs, n, "token long", counted).groupBy("token").count().where("count > 1")
    often = spark.sparkContext.broadcast(Bloom.of(often, "token", log_bits).words)
    sweep(spark)

    def tokens_of(key, tokens, node, new):
        rank = marks(tokens, Bloom(often.value))
        lone = rank == 0
        p = first_order(tokens, rank, heavy.value)[: _length(len(tokens), share)]
        p = tokens[p[~lone[p]]]
        own = 1000 * int(lone.sum()) // len(tokens)
        return (p.view(np.int64), np.full(len(p), node), np.full(len(p), own)) if len(p) else None

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by token, own tokens and node: drops repeats and each token's first node, which
        becomes the leader of its others."""
        token = node = leader = None
        for b in batches:
            t, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(t):
                continue
            fresh = np.concatenate([[t[0] != token], t[1:] != t[:-1]])
            again = ~fresh & np.concatenate([[v[0] == node], v[1:] == v[:-1]])
            starts = np.flatnonzero(fresh)
            which = np.cumsum(fresh) - 1
            head = np.full(len(t), leader if leader is not None else 0, np.int64)
            if len(starts):
                head = np.where(which < 0, head, v[starts[np.maximum(which, 0)]])
            rows = ~again & (head != v)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[rows]), pa.array(v[rows]), pa.array(head[rows])], names=["token", "node", "leader"])
            token, node, leader = t[-1], v[-1], head[-1]

    spread = _sets(docs, n, "token long, node long, own long", tokens_of).repartition(partitions(spark), "token").sortWithinPartitions("token", "own", "node")
    shared = cut(spread.mapInArrow(led, "token long, node long, leader long"))

    def verified(pairs: DataFrame, blocks: bool = False) -> DataFrame:
        """The pairs (a, b) that link. Sets come sorted in the second order; the third is its reverse. Only texts that
        stand for a node of a pair are read for them."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = spark.sparkContext.broadcast(Bloom.of(known.join(nodes, "node", "left_semi"), "place", log_bits).words)

        def whole(key, tokens, node, new):
            return node, tokens[_second(tokens)].view(np.int64)

        sets = _sets(docs, n, "node long, tokens array<bigint>", whole, only=asked).dropDuplicates(["node"])
        return verified_in_blocks(pairs, sets, known, share) if blocks else one_by_one(pairs, sets)

    def one_by_one(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
        length = {c: (F.size(c) - F.ceil(F.size(c) * share / F.lit(100)) + 1).cast("int") for c in ("ta", "tb")}
        second = F.arrays_overlap(*(F.slice(c, 1, length[c]) for c in ("ta", "tb")))
        third = F.arrays_overlap(*(F.slice(c, -length[c], length[c]) for c in ("ta", "tb")))
        both = F.size(F.array_intersect("ta", "tb"))
        met = pairs.join(a, "a").join(b, "b").where(second & third)
        return met.where(100 * both >= share * (F.size("ta") + F.size("tb") - both)).select("a", "b").distinct()

    def parts_of(links: DataFrame) -> DataFrame:
        return cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))).withColumnRenamed("u", "node")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that sketches don't rule out."""
        for b in batches:
            if n := b.num_rows:
                sizes = np.concatenate([b.column(k).to_numpy() for k in (2, 3)])
                rows = np.concatenate([b.column(k).flatten().to_numpy().reshape(n, -1) for k in (4, 5)])
                ok = pa.array(Sketches(rows, sizes, share).hopes(np.arange(n), np.arange(n, 2 * n)) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    votes = shared.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    chosen = votes.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    known = cut(sketches.join(shared.select("node").unionByName(shared.select(F.col("leader").alias("node"))).distinct(), "node", "left_semi").dropDuplicates(["node"]))
    a = known.select("node", "size", "sketch").toDF("a", "size_a", "sketch_a")
    b = known.select("node", "size", "sketch").toDF("b", "size_b", "sketch_b")
    stars = chosen.select(F.col("node").alias("a"), F.col("leader").alias("b")).join(a, "a").join(b, "b")
    stars = cut(stars.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(screen, "a long, b long"))
    links = cut(verified(stars))
    part = parts_of(links)
    # every group once more, with its leader as a row of its own
    rows = shared.select("token", "node").unionByName(shared.select("token", F.col("leader").alias("node")).distinct())

    def several(rows: DataFrame, part: DataFrame) -> DataFrame:
        """Rows with their component, of the groups that hold more than one. Groups of the same nodes are one group: copies of a
        text share many tokens."""
        rows = rows.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark_{k}") for k in (0, 1)]
        groups = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), *marks)
        mixed = groups.where("lo <> hi").groupBy("n", "mark_0", "mark_1").agg(F.min("token").alias("token")).select("token")
        return rows.join(mixed, "token", "left_semi")

    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes, keys = known.count(), dealt(cut(several(rows, part)), piece)
    for limit in (a_row, None):
        found = met_in_turns(keys, known, share, limit, most_sent * nodes)
        pairs = cut(found.where("more IS NULL").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            tested = tested.unionByName(pairs)
            new = cut(verified(pairs, blocks=True))
            if new.limit(1).count():
                links = links.unionByName(new)
                part = parts_of(links)
        more = found.where("more IS NOT NULL").select(F.col("more").alias("key")).distinct()
        if not more.limit(1).count():
            break
        keys = dealt(cut(several(rows, part)), piece).join(more, "key", "left_semi")
    linked = members.join(part, "node", "left")
    group = F.when(F.col("size") > 0, F.coalesce("component", "node"))
    linked = cut(linked.select("doc_id", F.col("size").alias("n_shingles"), group.alias("group"), F.col("component").isNotNull().alias("links")))
    least = linked.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least")).withColumnRenamed("group", "g")
    out = linked.join(least, F.col("group") == F.col("g"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "links")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without near copies: of each component, one row, the least by doc_id. Rows are
    told apart by doc_id and text, so unlike texts under one doc_id each have a component of their own.
    Documents without words and rows without id stay; of rows that repeat doc_id and text, one stays."""
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", node.alias("node"))
    found = similar(keyed.select(F.col("node").alias("doc_id"), "text"), **options)
    found = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "component_id").distinct()
    ids = keyed.where("node IS NOT NULL").select("node", "doc_id").distinct()
    least = ids.join(found, "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    first = cut(least.select("first.node"))
    again = cut(keyed.where("node IS NOT NULL").groupBy("node").count().where("count > 1").join(first, "node", "left_semi").select("node"))
    # texts move once, past tables of nodes alone: they are neither sorted nor, where a filter tells that they go, sent
    hopeful = docs.sparkSession.sparkContext.broadcast(Bloom.of(first, "node", 26).words)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(1)
            ok = np.zeros(b.num_rows, bool)
            there = nodes.is_valid().to_numpy(zero_copy_only=False)
            ok[there] = Bloom(hopeful.value).has(nodes.drop_null().to_numpy().view(np.uint64))
            yield b.filter(pa.array(ok))

    rows = keyed.select("row", "node")
    sent = rows.mapInArrow(chosen, rows.schema)
    once = sent.join(first.join(again, "node", "left_anti").hint("shuffle_hash"), "node", "left_semi")
    one = once.select("row")
    if again.limit(1).count():
        one = one.unionByName(sent.join(again.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]).select("row"))
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))

"""Two tokenizers' ids of the same texts, linked through groups of tokens that cover the same bytes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, stored

_MARK = "▁"
#: Before a space or newline behind anything but white space both tokenizers end a token, whatever stands around.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_WIDE = re.compile(r"  | \n|\n\n|\n |[^\S \n]")


class Rows:
    """Short arrays of 64-bit numbers, one behind the other."""

    def __init__(self):
        self.flat, self.at, self.long, self.n, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), np.int64)])

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(flat))
        self.at, self.long = self._room(self.at, self.n + len(lengths)), self._room(self.long, self.n + len(lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.long[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(flat), self.n + len(lengths)

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The arrays of the given rows, in that order, as one."""
        lengths = self.long[rows]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.at[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbered(dict):
    """Numbers from 0, given out as keys are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Groups of a text's ids under tokenizers A (byte-level, a JSON file) and B (pieces with byte fallback, a model file).

    Both encode a space and the text. A group is the tokens between two bytes at which tokens of both end. Texts are cut into
    chunks at places where tokens of both always end, and the groups of chunks are remembered, as numbers of distinct groups.
    Any text with a chunk that doesn't give its own bytes goes through both tokenizers whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.bytes_a = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece goes on behind the end of a word or line")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.long_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.long_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known = _Numbered()  # chunks
        self.asked = 0  # chunks that have been encoded
        self.numbers = Rows()  # their groups' numbers
        self.sizes = Rows()  # their tokens of A and of B; -1 where the ids give other bytes
        self.group_of: dict[tuple, int] = {}
        self.named: list[bytes] = []  # groups, written out
        self.pairs = Rows()  # their distinct pairs of ids, A's above B's 32 bits

    def chunks(self, text: str) -> list[str]:
        """Chunks of a space and the text. One that is a space and a word comes without its space."""
        if not _WIDE.search(text) and text[0] not in " \n" and text[-1] not in " \n":
            return text.replace("\n", " \n").split(" ")
        return [c[1:] if c[0] == " " and c[1:2].strip() else c for c in _CUT.split(f" {text}")]

    def cuts(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Of a text that starts with a space: ids of A and of B, the bytes at which tokens of both end, and how many tokens of
        each end up to there. None if the ids don't give the text's bytes."""
        ids_a, ids_b, data = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]), text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != data or b"".join(map(self.bytes_b.__getitem__, ids_b)) != data:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.long_a[ids_a]), np.cumsum(self.long_b[ids_b])
        cut = ends_a[np.isin(ends_a, ends_b, assume_unique=True, kind="sort")]
        return ids_a, ids_b, cut, np.searchsorted(ends_a, cut, "right"), np.searchsorted(ends_b, cut, "right")

    def numbered(self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The numbers of groups that end at the given tokens."""
        from_a, from_b = np.concatenate([[0], at_a[:-1]]), np.concatenate([[0], at_b[:-1]])
        single = (at_a - from_a == 1) & (at_b - from_b == 1)
        out, before = np.zeros(len(at_a), np.int64), len(self.named)
        pairs, place = np.unique(ids_a[from_a[single]] << 32 | ids_b[from_b[single]], return_inverse=True)
        out[single] = np.array([self.number((p >> 32,), (p & 0xFFFFFFFF,)) for p in pairs.tolist()], np.int64)[place]
        a, b = ids_a.tolist(), ids_b.tolist()
        several = np.flatnonzero(~single)
        edges = zip(*(x[several].tolist() for x in (from_a, at_a, from_b, at_b)))
        out[several] = [self.number(tuple(a[i:k]), tuple(b[j:m])) for i, k, j, m in edges]
        if new := list(islice(reversed(self.group_of), len(self.named) - before))[::-1]:
            found = [distinct_pairs(*group)[0] for group in new]
            self.pairs.extend(np.concatenate(found), np.array([len(x) for x in found]))
        return out

    def number(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        """A group's number."""
        found = self.group_of.get((a, b))
        if found is None:
            found = self.group_of[a, b] = len(self.named)
            self.named.append((",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode())
        return found

    def learn(self) -> None:
        """Encodes the chunks that have been asked for since, many as one text; white space at the end of one would run on."""
        chunks = list(islice(reversed(self.known), len(self.known) - self.asked))[::-1]
        self.asked = len(self.known)
        first = 0
        for k in range(len(chunks) + 1):
            odd = k < len(chunks) and (_MARK in chunks[k] or not chunks[k][-1].strip())
            if odd or k == len(chunks) or k - first == 500:
                if k > first:
                    self._learn(chunks[first:k])
                first = k
            if odd:
                self._odd()
                first = k + 1

    def _odd(self) -> None:
        self.numbers.extend(np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.sizes.extend(np.full(2, -1), np.full(1, 2))

    def _learn(self, chunks: list[str]) -> None:
        texts = [f" {c}" if c[0].strip() else c for c in chunks]
        found = self.cuts(" x" + "".join(texts))
        ends = np.cumsum([2, *(len(t.encode()) for t in texts)])
        if found is None or not np.isin(ends, found[2]).all():
            if len(chunks) == 1:
                self._odd()
            else:  # look for the chunk in halves
                self._learn(chunks[: len(chunks) // 2])
                self._learn(chunks[len(chunks) // 2 :])
            return
        ids_a, ids_b, cut, at_a, at_b = found
        place = np.searchsorted(cut, ends)
        self.numbers.extend(self.numbered(ids_a, ids_b, at_a, at_b)[place[0] + 1 :], np.diff(place))
        self.sizes.extend(np.stack([np.diff(at_a[place]), np.diff(at_b[place])], 1).ravel(), np.full(len(chunks), 2))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, str] | None]:
        """For each text its distinct groups' numbers, how often each comes up, its tokens of A and B, and the digest of its groups.
        None for an empty text, and for one whose tokens don't give its bytes."""
        known = self.known
        parts = [np.array(list(map(known.__getitem__, self.chunks(t))), np.int64) if t else None for t in texts]
        self.learn()
        for text, at in zip(texts, parts):
            if at is None:
                yield None
                continue
            n_a, n_b = self.sizes.take(at).reshape(-1, 2).T
            if (n_a < 0).any():
                found = self.cuts(f" {text}")
                if found is None:
                    yield None
                    continue
                n_a, n_b = len(found[0]), len(found[1])
                numbers = self.numbered(found[0], found[1], found[3], found[4])
            else:
                n_a, n_b = int(n_a.sum()), int(n_b.sum())
                numbers = self.numbers.take(at)
            shown = b";".join(map(self.named.__getitem__, numbers.tolist()))
            yield (*np.unique(numbers, return_counts=True), n_a, n_b, hashlib.sha256(shown).hexdigest())


def distinct_pairs(ids_a, ids_b) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two lists of ids, A's above B's 32 bits, and how often each occurs."""
    if len(ids_a) == len(ids_b) == 1:
        return np.array([ids_a[0] << 32 | ids_b[0]], np.int64), np.ones(1, np.int64)
    (a, of_a), (b, of_b) = np.unique(np.array(ids_a, np.int64), return_counts=True), np.unique(np.array(ids_b, np.int64), return_counts=True)
    return (a[:, None] << 32 | b).ravel(), (of_a[:, None] * of_b).ravel()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_groups: int = 200_000) -> DataFrame:
    """Blocks of documents with a dictionary of their distinct groups each, stored in the shared folder.

    Rows of three kinds. 0, a document: its block, its own number, id, tokens, and its groups by their numbers in the
    block's dictionary (`groups`, ascending, as differences, and `occurs`: unsigned 32-bit numbers). 1, a distinct group of a
    block: its number, its key (64 bits of a hash of its ids) and ids. 2, a pair of ids that are linked: in how many of a task's
    documents, in parts. A block ends at `most_groups` groups, so its dictionary fits in memory.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [
        ("kind", pa.int32()), ("block", pa.int64()), ("row", pa.int64()), ("id", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("groups_sha256", pa.string()), ("groups", pa.binary()), ("occurs", pa.binary()), ("number", pa.int64()), ("key", pa.int64()),
        ("ids_a", pa.binary()), ("ids_b", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64()),
    ]
    sql = {"int32": "int", "int64": "long", "string": "string", "binary": "binary"}
    schema = ", ".join(f"{n} {id_type if t is None else sql[str(t)]}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path_a, path_b)) or _ENCODERS.setdefault((path_a, path_b), Encoder(path_a, path_b))
        base, rows, blocks, kind_of_id = TaskContext.get().partitionId() << 40, 0, 0, None
        seen = np.zeros(0, bool)
        held, pairs, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = 0

        def out(kind: int, n: int, **columns) -> pa.RecordBatch:
            arrays = [pa.array(columns[f], t or kind_of_id) if f in columns else pa.nulls(n, t or kind_of_id) for f, t in fields[1:]]
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *arrays], names=[f for f, _ in fields])

        def merged() -> None:
            nonlocal pairs, counts, waiting
            every, place = np.unique(np.concatenate([pairs, *held]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(waiting, np.int64)]), len(every)).astype(np.int64)
            pairs, waiting = every, 0
            held.clear()

        def linked() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, counts
            for k in range(0, len(pairs), 100_000):
                yield out(2, len(pairs[k : k + 100_000]), pair=pairs[k : k + 100_000], docs=counts[k : k + 100_000])
            pairs, counts = pairs[:0], counts[:0]

        def dictionary() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(seen).tolist()
            for k in range(0, len(used), 20_000):
                part = [encoder.named[i] for i in used[k : k + 20_000]]
                keys = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in part]
                sides = [[np.array(x.split(b",")).astype("<u4").tobytes() for x in s.split(b"|")] for s in part]
                yield out(1, len(part), block=[base + blocks] * len(part), number=used[k : k + 20_000], key=keys, ids_a=[s[0] for s in sides], ids_b=[s[1] for s in sides])

        for b in batches:
            kind_of_id = b.column(0).type
            texts, total, first = [], 0, 0
            for k in range(b.num_rows + 1):
                if k == b.num_rows or total > 1 << 20:
                    ids, ready = b.column(0)[first:k], []
                    for found in encoder.encode(texts):
                        if found is None:
                            ready.append((0, 0, 0, "", b"", b""))
                            continue
                        groups, occurs, n_a, n_b, digest = found
                        if len(seen) < len(encoder.named):
                            seen = np.concatenate([seen, np.zeros(2 * len(encoder.named) - len(seen), bool)])
                        seen[groups] = True
                        every = np.unique(encoder.pairs.take(groups))
                        held.append(every)
                        waiting += len(every)
                        ready.append((n_a, n_b, int(occurs.sum()), digest, np.diff(groups, prepend=0).astype("<u4").tobytes(), occurs.astype("<u4").tobytes()))
                    if ready:
                        n = len(ready)
                        columns = dict(zip(("n_a", "n_b", "n_groups", "groups_sha256", "groups", "occurs"), zip(*ready)))
                        yield out(0, n, block=[base + blocks] * n, row=range(base + rows, base + rows + n), id=ids, **columns)
                        rows += n
                    if waiting > 1 << 21:
                        merged()
                        if len(pairs) > 1 << 20:
                            yield from linked()
                    if np.count_nonzero(seen) >= most_groups or len(encoder.known) > 3 * most_groups:
                        yield from dictionary()
                        blocks, seen = blocks + 1, seen[:0]
                        if len(encoder.known) > 3 * most_groups:
                            encoder.clear()
                    texts, total, first = [], 0, k
                if k < b.num_rows:
                    texts.append(b.column(1)[k].as_py() or "")
                    total += len(texts[-1])
        if rows:
            yield from dictionary()
            merged()
            yield from linked()

    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "encoded")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, pair, docs, best) of each pair of ids that are linked: how many documents link them, and whether no other pair of
    the same A id has more. The most of an A id is broadcast: a row an entry of A's vocabulary."""
    counts = blocks.where("kind = 2").groupBy("pair").agg(F.sum("docs").alias("docs"))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("most_a")).agg(F.max("docs").alias("most"))
    out = counts.select(a.alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "pair", "docs")
    return out.join(F.broadcast(most), F.col("a") == F.col("most_a")).select("a", "b", "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def group_links(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, n_links, n_best, count_sum) of each distinct group, whose links are expanded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n = [], 0
            for key, x, y in zip(*(c.to_pylist() for c in b.columns)):
                of, times = distinct_pairs(np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist())
                rows.append((np.full(len(of), key), of, times))
                n += len(of)
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["key", "pair", "times"])
                    rows, n = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["key", "pair", "times"])

    distinct = blocks.where("kind = 1").groupBy("key").agg(F.first("ids_a").alias("ids_a"), F.first("ids_b").alias("ids_b"))
    links = distinct.mapInArrow(run, "key long, pair long, times long").join(pairs.select("pair", "docs", "best"), "pair")
    return links.groupBy("key").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
    )


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_groups: int = 200_000) -> DataFrame:
    """Each document's tokens, groups and links under both tokenizers, with counts over all documents.

    Columns: the id, n_a, n_b, n_groups, n_links (pairs of an A and a B token of one group), n_best (links whose pair of ids no other
    pair of that A id outnumbers), count_sum (over links, the number of documents that link their ids), groups_sha256.

    Documents are encoded once, in blocks with a dictionary of distinct groups. Links are expanded once for each distinct group
    and counted in documents; a group's sums then go back to the dictionaries of all blocks by its key, and each block's
    documents meet its dictionary. So a group or text in a third of all documents comes up once a block in every shuffle.

    Null or empty text, and one whose tokens don't give its bytes: no tokens, zeros, an empty digest. Very long texts are encoded
    whole. Null and repeated ids and rows: each row by itself; each counts as a document. Empty table: no rows. Other columns
    are dropped.
    """
    blocks = encoded(docs, path_a, path_b, id_col, text_col, most_groups)
    links = group_links(blocks, pair_counts(blocks))
    found = blocks.where("kind = 1").select("block", "number", "key").join(links, "key")
    sums = ["n_links", "n_best", "count_sum"]
    rows = blocks.where("kind = 0").select("block", F.lit(1).alias("kind"), "row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "occurs", *[F.lit(None).cast("long").alias(c) for c in ("number", *sums)])
    of_groups = found.select("block", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:10]], "number", *sums)
    met = rows.unionByName(of_groups).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "row")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = met.mapInArrow(_summed, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of documents' groups; a block's dictionary comes before its documents."""
    block, sums = None, np.zeros((3, 0), np.int64)
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        blocks, kinds = c["block"].to_numpy(), c["kind"].to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
        for first, end in zip(edges, edges[1:]):
            if blocks[first] != block:
                block, sums = blocks[first], np.zeros((3, 0), np.int64)
            part = {n: x.slice(first, end - first) for n, x in c.items()}
            if kinds[first] == 0:
                numbers = part["number"].to_numpy()
                if (need := int(numbers.max()) + 1) > sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros((3, 2 * need - sums.shape[1]), np.int64)], 1)
                for k, n in enumerate(("n_links", "n_best", "count_sum")):
                    sums[k, numbers] = part[n].to_numpy()
                continue
            totals = []
            for groups, occurs in zip(part["groups"], part["occurs"]):
                at = np.cumsum(np.frombuffer(groups.as_py(), "<u4"), dtype=np.int64)
                totals.append(sums[:, at] @ np.frombuffer(occurs.as_py(), "<u4").astype(np.int64))
            columns = [pa.array(x, pa.int64()) for x in np.array(totals, np.int64).T]
            yield pa.RecordBatch.from_arrays(
                [part["id"], part["n_a"], part["n_b"], part["n_groups"], *columns, part["groups_sha256"]],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

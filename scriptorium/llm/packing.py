"""Best-fit-decreasing packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import prepare

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# Characters beyond those for which single spaces and newlines are sure to end a token.
_RARE = re.compile("[^\n\x20-\x7e\xa1-\xff]")


class _Numbered(dict):
    """Numbers from 0, given out as words are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with the ids of words remembered.

    A text is cut at single spaces and newlines, where the vocabulary's own splitting rule always
    cuts; any text outside that simple shape goes through the library whole. Words that aren't known yet are
    encoded many at a time, as one text.
    """

    def __init__(self, path: str, words: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.words, self.known, self.ids = words, _Numbered(), []
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        # an entry has a character a byte
        self.long = np.array([len(s) for s, _ in sorted(self.whole.get_vocab().items(), key=lambda x: x[1])], np.int64)
        self.newline = len(self.packed(self.library("\n")))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def library(self, text: str) -> list[int]:
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self) -> None:
        """The ids of the words that have been asked for since. A word stands without its leading space, or with a leading
        newline that stands alone. None for one with characters that may go on from one word to the next."""
        new = list(islice(reversed(self.known), len(self.known) - len(self.ids)))[::-1]
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            if _RARE.search("".join(part)):
                self.ids += [None if _RARE.search(w) else self.packed(self.library(w if w[:1] == "\n" else f" {w}")) for w in part]
                continue
            chunks = [w if w[:1] == "\n" else f" {w}" for w in part]
            ids = np.array(self.library("".join(chunks)), "<u4")
            ends, stops = np.cumsum(self.long[ids]), np.cumsum([len(c.encode()) for c in chunks])
            at = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[at] == stops).all():
                data, edges = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                self.ids += [data[i:j] for i, j in zip(edges, edges[1:])]
            else:
                self.ids += [self.packed(self.library(c)) for c in chunks]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, in order. Give a bounded number of characters at a time."""
        if len(self.known) >= self.words:
            self.known, self.ids = _Numbered(), []
        asked, special = self.known.__getitem__, self.special
        parts: list[list[int] | None] = []
        for text in texts:
            simple = text and "  " not in text and " \n" not in text and "\n\n" not in text and text[-1] not in " \n" and text[0] not in " \n"
            if not simple or any(s in text for s in special):
                parts.append(None)
            else:
                parts.append(list(map(asked, f"\n{text}".replace("\n", " \n").split(" ")[1:])))
        self.learn()
        of = self.ids.__getitem__
        for text, p in zip(texts, parts):
            try:
                yield b"".join(map(of, p))[self.newline :]
            except TypeError:  # not cut, or with a word that has no ids of its own
                yield self.packed(self.whole.encode(text, add_special_tokens=False).ids) if text else b""

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities, with a stack at each leaf."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        k = capacity + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window of the least capacity that is at least `need`."""
        count, k = self.count, need + self.size
        while not count[k]:
            while k & 1:  # a right child: climb
                k >>= 1
            if not k:
                return None
            k += 1  # the sibling on the right
            if k & (k - 1) == 0:  # past the last leaf of this level
                return None
        while k < self.size:
            k = 2 * k + (not count[2 * k])
        capacity = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """(item, sequence, offset), longest items first; sequences count from 0."""
    windows, used, out = OpenWindows(window), 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = windows.tightest(lengths[i])
        if found is None:
            found, used = (window, used), used + 1
        capacity, sequence = found
        out.append((i, sequence, window - capacity))
        if capacity > lengths[i]:
            windows.put(capacity - lengths[i], sequence)
    return out


_TOKENS: dict[tuple[str, int], Tokens] = {}


def encoded(tokens: Tokens, b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple]:
    """(id, token ids) of a batch's rows, of about `most` characters at a time."""
    keys, texts, total = [], [], 0
    for key, text in zip(b.column(0).to_pylist(), b.column(1)):
        keys.append(key)
        texts.append(text.as_py() or "")
        total += len(texts[-1])
        if total > most:
            yield from zip(keys, tokens.encode_all(texts))
            keys, texts, total = [], [], 0
    yield from zip(keys, tokens.encode_all(texts))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, block_tokens: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text", words: int = 1_000_000) -> DataFrame:
    """Pieces of all documents in windows of at most `window` tokens, packed best fit decreasing.

    A document's ids and then `end_id` are cut into full windows, each a sequence of its own, and a
    rest. The rests of an input partition are packed together, at most `block_tokens` of them at a
    time, so nothing is shuffled and a task holds a bounded number of tokens. A recomputed partition
    gives the same rows: sequence ids hold the partition's number above 40 bits of a counter.
    `ids` holds the piece's ids, little-endian unsigned 32 bits each. A worker remembers `words` words, some 200 bytes each.

    Null or empty text: the end id alone. Repeated rows and ids: each row is packed by itself. A null
    id stays null. Empty table: no rows. Other columns are dropped.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {PIECES}"
    end = Tokens.packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get((tokenizer, words)) or _TOKENS.setdefault((tokenizer, words), Tokens(tokenizer, words))
        base, sequences = TaskContext.get().partitionId() << 40, 0
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        ready: list[tuple] = []
        rests: list[tuple] = []
        held = waiting = 0
        id_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            rows, most = [], 0
            for i, sequence, offset in best_fit_decreasing([len(r[2]) // 4 for r in rests], window):
                key, start, ids, total = rests[i]
                rows.append((key, start, len(ids) // 4, ids, total, base + sequences + sequence, offset))
                most = max(most, sequence + 1)
                if len(rows) == 2000:
                    yield batch(rows)
                    rows = []
            sequences += most
            if rows:
                yield batch(rows)
            rests.clear()

        for b in batches:
            id_type = b.column(0).type
            for key, ids in encoded(tokens, b):
                ids += end
                total, step = len(ids) // 4, 4 * window
                for k in range(0, len(ids), step):
                    piece = ids[k : k + step]
                    if len(piece) == step:
                        ready.append((key, k // 4, window, piece, total, base + sequences, 0))
                        sequences += 1
                        held += 1
                    else:
                        rests.append((key, k // 4, piece, total))
                        waiting += len(piece) // 4
                if held >= 2000:
                    yield batch(ready)
                    ready, held = [], 0
                if waiting >= block_tokens:
                    yield from packed()
                    waiting = 0
        if ready:
            yield batch(ready)
        if rests:
            yield from packed()

    return docs.select(id_col, text_col).mapInArrow(run, schema)

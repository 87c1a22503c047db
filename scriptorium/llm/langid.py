"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[i for i in range(128) if not chr(i).isalpha()]] = 32
BITS = 12


def features(texts: list[str]) -> np.ndarray:
    """A row a text: square roots of the shares of its hashed 1- to 3-grams of bytes, of length 1.

    Letters are lower-cased and other ASCII becomes a space, so symbols and digits don't matter.
    """
    out = np.zeros((len(texts), 3 << BITS), np.float32)
    for i, text in enumerate(texts):
        a = _TABLE[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
        a = a[np.flatnonzero((a[1:] != 32) | (a[:-1] != 32))]
        if len(a) < 3:
            continue
        pairs = a[:-1] | a[1:] << 8
        grams = (a, pairs, pairs[:-1] | a[2:] << 16)
        for n, g in enumerate(grams):
            counts = np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
            out[i, n << BITS : (n + 1) << BITS] = np.sqrt(counts / max(1, len(g)))
    return out / np.sqrt(3)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1. Up to five languages get every way to split them; more get random
    columns, from the draw whose closest two codewords differ most."""
    if n <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(columns, dtype=np.float32).reshape(-1, n).T
    rng, width = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))

    def draw():
        m = rng.choice([-1, 1], (n, width)).astype(np.float32)
        return m, (width - (m @ m.T - np.eye(n) * 2 * width).max()) / 2

    return max((draw() for _ in range(50)), key=lambda x: x[1])[0]


class Model:
    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, trust: np.ndarray, margin: float):
        self.langs, self.codes, self.weights, self.trust, self.margin = langs, codes, weights, trust, margin

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous): the codeword of least loss, where each bit's logistic
        loss is weighted by how far its classifier can be trusted."""
        bits = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([(np.logaddexp(0, -bits * c) * self.trust).sum(1) for c in self.codes], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), top[:, -1], top[:, -1] - second < self.margin


def fit(texts: list[str], labels: list[str], margin: float = 0.2, steps: int = 150) -> Model | None:
    """One logistic classifier a bit, by gradient descent with momentum; None without labels."""
    langs = sorted(set(labels))
    if not langs:
        return None
    codes = codewords(len(langs))
    x = features(texts)
    y = codes[[langs.index(l) for l in labels]]
    w = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    v = np.zeros_like(w)
    share = np.bincount([langs.index(l) for l in labels], minlength=len(langs))
    each = (1.0 / share[[langs.index(l) for l in labels]] / len(langs)).astype(np.float32)[:, None]
    for _ in range(steps):
        g = -each * y / (1 + np.exp(np.clip(y * (x @ w[:-1] + w[-1]), -30, 30)))
        v = 0.9 * v - 8.0 * np.concatenate([x.T @ g, g.sum(0, keepdims=True)])
        w += v
    right = ((x @ w[:-1] + w[-1]) * y > 0).mean(0) if codes.shape[1] else np.zeros(0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return Model(langs, codes, w, trust * codes.shape[1] / max(trust.sum(), 1e-9), margin)


def train(rows: DataFrame, per_lang: int = 400, most_langs: int = 4000, most_chars: int = 4000, most_texts: int = 8000) -> Model | None:
    """A model from rows of (id, text, lang): of each language about `per_lang` rows with the least hashes of id, fewer where
    `most_texts` in all would not do for that, and of each row a stretch of `most_chars` characters from a hashed place. The
    sample is bounded by these parameters: 8,000 texts are 400 MB of features in the driver. Of more than `most_langs`
    languages those with most rows are learned; the others have no codeword, and their texts get the most alike of these."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(most_langs, most_texts // 2)).collect()
    if not sizes:
        return None
    per_lang = min(per_lang, most_texts // (2 * len(sizes)))
    rate = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 2.0 * per_lang / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    start = (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20) * F.greatest(F.lit(0), F.length("text") - most_chars)).cast("int")
    chosen = rows.withColumn("draw", draw).where(F.col("draw") < F.element_at(rate, F.col("lang")))
    chosen = chosen.select("lang", "draw", F.expr("text").substr(start + 1, F.lit(most_chars)).alias("text"))
    sample = chosen.orderBy("draw", "lang", "text").limit(2 * per_lang * len(sizes)).collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` plus lang_pred, score and ambiguous (two codewords nearly as close), from whole texts.

    Null text, text without a letter, or no model: `und`, 0, true. Other columns pass unchanged.
    """
    prepare(docs.sparkSession)
    schema = docs.drop("lang_pred", "score", "ambiguous")
    names, at = schema.columns, schema.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score, odd = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            for k in range(0, len(known), 256):
                some = known[k : k + 256]
                for i, l, s, o in zip(some, *model.decode(features([texts[i] for i in some]))):
                    lang[i], score[i], odd[i] = model.langs[l], float(s), bool(o)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"])

    out = StructType([*schema.schema.fields]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return schema.mapInArrow(run, out)

"""Toxicity by how much better a window compresses with a dictionary of toxic text than with one of
ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare

_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes beyond ASCII."""
    return text.lower().encode().translate(_PLAIN).split()


class Scorer:
    """Two zstandard dictionaries and the weights of the calibrated score."""

    def __init__(self, ordinary: bytes, toxic: bytes, window: int, level: int):
        self.ordinary, self.toxic, self.window, self.level, self.weights = ordinary, toxic, window, level, None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pair"}

    def compressors(self):
        if not hasattr(self, "pair"):
            import zstandard

            pair = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                pair.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.pair = pair
        return self.pair

    def gains(self, text: str) -> np.ndarray:
        """For each window of the whole text, the bytes that the toxic dictionary saves. It stands behind the
        ordinary one, so words that both know cost the same and don't drown the difference."""
        ordinary, toxic = (c.compress for c in self.compressors())
        w, n = words(text), self.window
        out = []
        for i in range(0, len(w), n):
            b = b" %b " % b" ".join(w[i : i + n])
            out.append(len(ordinary(b)) - len(toxic(b)))
        return np.array(out or [0])

    def features(self, text: str) -> np.ndarray:
        g = np.sort(self.gains(text))[::-1]
        over = [float((g >= k).sum()) for k in (1, 2, 3, 4, 5, 6)]
        return np.array([1.0, min(g[0], 16), min(g[:2].sum(), 30), *np.log1p(over), np.log1p(len(g)), over[1] / len(g), over[3] / len(g), g.mean()])

    def calibrate(self, texts: list[str], labels: list[int], steps: int = 30) -> None:
        """Logistic regression on the windows' gains, by Newton's method; it sets the threshold."""
        x, y = np.array([self.features(t) for t in texts]), np.array(labels, float)
        mean, deviation = x.mean(0), x.std(0) + 1e-9
        mean[0], deviation[0] = 0, 1
        z, w = (x - mean) / deviation, np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(w)), z.T @ (y - p) - w)
        self.weights = (mean, deviation, w)

    def score(self, text: str) -> float:
        mean, deviation, w = self.weights
        return float(1 / (1 + np.exp(-np.clip(((self.features(text) - mean) / deviation) @ w, -30, 30))))


def dictionary(samples: list[bytes], size: int, **options) -> bytes:
    """A dictionary of at most `size` bytes that zstandard trains on `samples`; their end where they are too few."""
    import zstandard

    try:
        content = zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        content = b""
    return content or b" ".join(samples)[-size:]


def train(texts: list[str], labels: list[int], window: int = 6, level: int = 3, size: int = 64 << 10, toxic_size: int = 8 << 10, distinct: float = 5.0) -> Scorer | float:
    """Two trained dictionaries and the calibration, from labelled texts; a constant score if one label is missing.

    Toxic texts are mostly ordinary words, which would fill a dictionary trained on them as they are. So
    the toxic dictionary is trained on what stands out in each of them: words of four bytes or more whose
    share of toxic texts is `distinct` deviations above that of ordinary ones. The ordinary dictionary is
    trained on ordinary texts without these words, for such texts quote some. The same texts calibrate
    the score. Copies count once.
    """
    seen = dict(zip(texts, labels))
    texts, labels = list(seen), list(seen.values())
    if not texts or sum(labels) in (0, len(labels)):
        return float(labels[0]) if texts else 0.0
    toxic, ordinary = Counter(), Counter()
    for t, y in seen.items():
        (toxic if y else ordinary).update(set(words(t)))
    n, m = sum(labels), len(labels) - sum(labels)
    least = min(distinct, 0.2 * np.sqrt(n + m))

    def stands_out(w: bytes) -> bool:
        a, b = toxic[w], ordinary[w]
        p = (a + b) / (n + m)
        return a / n - b / m >= least * np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)

    telling = {w for w in toxic if toxic[w] > 1 and len(w) >= 4 and stands_out(w)}
    plain = [b" ".join(w for w in words(t) if w not in telling) for t, y in seen.items() if not y]
    bad = [b" %b " % b" ".join(k) for t, y in seen.items() if y and (k := [w for w in words(t) if w in telling])]
    scorer = Scorer(dictionary(plain, size), dictionary(bad, toxic_size, k=32, d=6), window, level)
    scorer.calibrate(texts, labels)
    return scorer


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 1200, most_ordinary: int = 3000) -> Scorer | float:
    """A scorer from a bounded sample of labelled rows: at most `most_toxic` and `most_ordinary` ids
    with the least hashes, each with its whole text, as `score` takes it."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic").distinct()
    ids = None
    for label, most in ((1, most_toxic), (0, most_ordinary)):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.union(some)
    chosen = docs.sparkSession.createDataFrame(ids.collect() or [], "id long, toxic int")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where("text IS NOT NULL")
    rows = rows.select("id", "text", "toxic").orderBy(F.xxhash64("id"), "id", "text").limit(most_toxic + most_ordinary)
    sample = rows.collect()
    return train([r["text"] for r in sample], [r["toxic"] for r in sample])


def score(docs: DataFrame, scorer: Scorer | float) -> DataFrame:
    """`docs` plus double `toxicity` from 0 to 1, from whole texts. Null text counts as empty; every
    row is scored by itself; an empty table gives no rows. Other columns pass unchanged."""
    prepare(docs.sparkSession)
    docs = docs.drop("toxicity")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [scorer if isinstance(scorer, float) else scorer.score(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*names, "toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxicity", "double"))

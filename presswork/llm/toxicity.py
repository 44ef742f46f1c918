"""Toxicity by compression distance between two zstandard dictionaries.

1. One dictionary is trained on windows of ordinary text, one on windows of toxic
   text. Toxic documents are mostly ordinary prose, so of their windows those train
   that toxic documents hold far more often than ordinary ones do.
2. A window is a word with padding. Its distance is its compressed length under the
   ordinary dictionary minus that under the toxic one.
3. How the largest distances and the number of windows beyond thresholds tell the
   classes apart is calibrated by a logistic regression on documents that trained
   neither dictionary.

A text's words are measured once each, and each worker remembers what it measured
within a bound. Training uses at most ``toxic_rows`` and ``ordinary_rows`` labelled
documents (both documented bounds); scoring reads whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.labelled import labelled_texts

#: ASCII that is neither letter, digit nor apostrophe parts words; A-Z becomes lower case.
_PARTED = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() or b == 39 else 32 for b in range(256))
#: The compressor leaves the last bytes of its input unmatched: these take their place.
_BEFORE, _AFTER = b" ", b" " + b"\x01" * 12
ORDINARY_BYTES, TOXIC_BYTES = 2_048, 8_192
LARGEST = 3
BEGINNINGS = (4, 5, 6)
#: A telling window stands in this share of the toxic documents at least; the calibration picks the best of these.
LEAST_SHARES = (0.01, 0.02, 0.03, 0.05)
CACHE_WORDS = 200_000


def words(text: str | None) -> list[bytes]:
    text = text or ""
    return (text if text.isascii() else text.lower()).encode("utf-8", "replace").translate(_PARTED).split()


def windows_of(word: bytes) -> set[bytes]:
    """The windows that may train the toxic dictionary: the word and its beginnings."""
    return {_BEFORE + word + b" ", *(_BEFORE + word[:n] for n in BEGINNINGS if len(word) > n)}


def train_dictionary(size: int, windows: dict[bytes, int], k: int) -> bytes:
    """The trained dictionary of windows with their counts.

    Windows that fit as a whole are the dictionary, the most frequent ones last, where
    they are cheapest to refer to; so are the last of them where training fails.
    """
    order = sorted(windows, key=lambda w: (windows[w], w))
    if sum(map(len, order)) > size:
        try:
            samples = [w for w in order for _ in range(windows[w])]
            return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
        except (zstandard.ZstdError, ValueError):
            pass
    return b"".join(order)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary or b"\x01" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=8, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


class Distances:
    """Distances of words, remembered per worker process."""

    _made: dict[tuple[bytes, bytes], Distances] = {}

    @classmethod
    def of(cls, ordinary: bytes, toxic: bytes) -> Distances:
        if (ordinary, toxic) not in cls._made:
            cls._made.clear()
            cls._made[ordinary, toxic] = cls(ordinary, toxic)
        return cls._made[ordinary, toxic]

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def _lengths(self, engine: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in windows], "<u8")
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u8")
        packed = engine.multi_compress_to_buffer(
            zstandard.BufferWithSegments(b"".join(windows), segments.tobytes()), threads=1)
        return np.array([len(s) for s in packed])

    def of_texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The distances of each text's different words."""
        if len(self.known) > CACHE_WORDS:
            for old in list(islice(self.known, CACHE_WORDS // 2)):
                del self.known[old]
        different = [set(text) for text in texts]
        new = list({w for text in different for w in text if w not in self.known})
        for low in range(0, len(new), 1 << 14):
            windows = [_BEFORE + w + _AFTER for w in new[low:low + (1 << 14)]]
            gains = self._lengths(self.ordinary, windows) - self._lengths(self.toxic, windows)
            self.known.update(zip(new[low:low + (1 << 14)], gains.tolist()))
        return [np.array([self.known[w] for w in text], np.int64) for text in different]


FEATURES = 2 * LARGEST + 4


def features(distances: np.ndarray) -> list[float]:
    """What the calibration sees of one text; a text without words is all zeros."""
    if not len(distances):
        return [0.0] * FEATURES
    top = np.sort(distances)[::-1][:LARGEST]
    top = np.concatenate([top, np.zeros(LARGEST - len(top), np.int64)]).clip(-2, 10)
    return [
        *top.astype(float), *(top >= 4).astype(float), float(np.log1p((distances >= 3).sum())),
        float(np.log1p((distances >= 4).sum())), float((distances >= 4).mean()), float(np.log1p(len(distances)))]


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    middle: list[float]
    spread: list[float]
    weights: list[float]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        distances = Distances.of(self.ordinary, self.toxic).of_texts([words(t) for t in texts])
        return self.of_features(np.array([features(d) for d in distances]).reshape(-1, FEATURES))

    def of_features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ np.array(self.weights[1:]), -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights by Newton steps; the ridge keeps separable classes finite."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _telling(train: list[list[list[bytes]]], contrast: float) -> dict[bytes, int]:
    """Windows that toxic texts hold far more often than ordinary ones, and how many different words precede them.

    Copies of one text repeat its words behind the same words, so they don't add up.
    """
    holding = [Counter(x for t in part for x in set().union(*map(windows_of, set(t)))) for part in train]
    n, m = (max(len(part), 1) for part in train)
    behind = {x: set() for x, c in holding[0].items() if c > 1 and c / n > contrast * (holding[1][x] + 0.5) / m}
    for text in train[0]:
        for before, word in zip([b"", *text], text):
            for x in windows_of(word):
                if x in behind:
                    behind[x].add(before)
    return {x: min(len(words), holding[0][x]) for x, words in behind.items()}


def fit_toxicity(toxic: list[str], ordinary: list[str], share: float | None = None, contrast: float = 8.0) -> ToxicModel:
    """A model from sample texts; every other text of a class trains, the rest calibrates.

    ``share`` is the part of toxic documents in the corpus that the samples come from.
    With texts of one class only, or none, the score is a constant.
    """
    train = [[words(t) for t in part[::2]] for part in (toxic, ordinary)]
    rest = [[words(t) for t in part[1::2] or part] for part in (toxic, ordinary)]
    in_ordinary = Counter(w for t in train[1] for w in set(t))
    n = max(len(train[0]), 1)
    common = sorted(in_ordinary, key=lambda w: (-in_ordinary[w], w))[:60_000]
    plain = train_dictionary(ORDINARY_BYTES, {_BEFORE + w + b" ": min(in_ordinary[w], 8) for w in common}, 24)
    in_toxic = _telling(train, contrast)
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    if len(np.unique(y)) < 2:
        level = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return ToxicModel(plain, b"", [0.0] * FEATURES, [1.0] * FEATURES, [level] + [0.0] * FEATURES)
    share = min(max(y.mean() if share is None else share, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    best = None
    for least in sorted({max(2, round(s * n)) for s in LEAST_SHARES}):
        telling = {w: min(c, 50) for w, c in in_toxic.items() if c >= least}
        marked = train_dictionary(TOXIC_BYTES, telling, 16)
        x = np.array([features(d) for d in Distances(plain, marked).of_texts(rest[0] + rest[1])])
        middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        weights = logistic((x - middle) / spread, y, weight)
        model = ToxicModel(plain, marked, middle.tolist(), spread.tolist(), weights.tolist())
        p = model.of_features(x).clip(1e-9, 1 - 1e-9)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def fit_on(
    docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", key: str = "doc_id", text: str = "text",
    toxic_rows: int = 2_000, ordinary_rows: int = 4_000,
) -> ToxicModel:
    counts = {r[0]: r[1] for r in labels.where(use).groupBy(label).count().collect() if r[0] in (0, 1)}
    sample = {}
    for value, rows in ((1, toxic_rows), (0, ordinary_rows)):
        own = labelled_texts(docs, labels.where(F.col(label) == value), label, use, rows, key, text)
        sample[value] = [r["text"] for r in sorted(own.collect(), key=lambda r: (r[key], r["text"]))]
    return fit_toxicity(sample[1], sample[0], counts.get(1, 0) / max(sum(counts.values()), 1))


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1); null and empty texts have a score like any other.

    An existing column named score is replaced; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [model.scores(list(texts[low:low + 256])) for low in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn("score", run(F.col(text)))

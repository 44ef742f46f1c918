"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

A ratio is compressed bytes by bytes. Repetitive text compresses far better than prose of
its length, noise hardly at all, and short texts worse than long ones, so each length
has a band of its own. A text is rejected if

* its base counts fail: too few words, or most of them in repeated 3-word windows;
* the ratio of the whole text is outside the band of its length; or
* chunks outside the band of theirs hold more than ``SHARE`` of its bytes, which finds
  repetitive or random stretches that the rest of a long text makes up for.

Every text is judged by itself: one pass, no shuffle, words a slice at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from presswork.llm.common import whole_text

#: (bytes below, least ratio, greatest ratio); shorter texts carry more of the frame and of the first occurrences.
BANDS = [
    (128, 0.45, 1.30), (256, 0.42, 1.10), (512, 0.38, 0.95), (1 << 10, 0.33, 0.85), (1 << 11, 0.30, 0.78),
    (1 << 12, 0.27, 0.73), (1 << 14, 0.24, 0.70), (1 << 17, 0.20, 0.68), (1 << 62, 0.17, 0.66)]
LEVEL = 3
CHUNK = 1 << 12
#: A rest of fewer bytes goes with the chunk before it.
REST = 1 << 10
SHARE = 0.25
#: Bytes whose words are numbered at a time.
SLICE = 1 << 22
SYMBOLS = b"#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "
_SPACE = re.compile(rb"[\x09-\x0d\x20]")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["ratio", "least_chunk", "greatest_chunk", "outside_share"]


def word_numbers(data: bytes) -> np.ndarray:
    """One number per word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    parts, low = [], 0
    while low < len(data):
        m = _SPACE.search(data, low + SLICE)
        high = m.start() if m else len(data)
        words = data[low:high].split()
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        low = high
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def repeated_words(numbers: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` that are found twice or more."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    key = numbers
    for i in range(1, width):  # pair by pair, so that the keys stay below the square of the words
        key = np.unique(key[:n] if i == 1 else key, return_inverse=True)[1] * (numbers.max() + 1) + numbers[i:i + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(numbers), bool)
    again = counts[inverse] > 1
    for i in range(width):
        covered[i:i + n] |= again
    return int(covered.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """The values of ``COUNTS``."""
    numbers = word_numbers(data)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(numbers), len(text) - sum(map(text.count, SPACE)), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(numbers))


def side(size: int, ratio: float, bands: list[tuple[int, float, float]] = BANDS) -> int:
    """-1 below the band of this size, 1 above it, 0 within."""
    low, high = next((low, high) for below, low, high in bands if size < below)
    return (ratio > high) - (ratio < low)


def chunk_bounds(n: int, chunk: int = CHUNK, rest: int = REST) -> list[tuple[int, int]]:
    starts = list(range(0, n, chunk))
    if len(starts) > 1 and n - starts[-1] < rest:
        starts.pop()
    return list(zip(starts, [*starts[1:], n]))


class Ratios:
    def __init__(self):
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress

    def __call__(self, data: bytes) -> tuple[float, float, float, float, bool]:
        """The values of ``RATIOS``, and whether the text is within its limits; an empty text is not."""
        n = len(data)
        if not n:
            return 0.0, 0.0, 0.0, 0.0, False
        whole = len(self.compress(data)) / n
        sizes = [(high - low, len(self.compress(data[low:high])) / (high - low)) for low, high in chunk_bounds(n)]
        outside = sum(size for size, ratio in sizes if side(size, ratio)) / n
        ratios = [ratio for _, ratio in sizes]
        return whole, min(ratios), max(ratios), outside, not side(n, whole) and outside <= SHARE


def compression_bands(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``COUNTS``, base_failed, ``RATIOS``, kept) for every row of ``docs``.

    Words are runs without ASCII white space; word_chars counts their characters,
    n_dup_lines the lines with a word that equal an earlier line. base_failed: under
    50 words, or more than half of them in 3-word windows found twice or more. A null text is
    empty; an empty one fails. The key may have any type and be null; repeated rows
    stay; other columns are ignored. An empty table gives an empty one.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + \
        ", base_failed boolean, " + ", ".join(f"{c} double" for c in RATIOS) + ", kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios()
        for batch in batches:
            columns = [[] for _ in range(len(COUNTS) + len(RATIOS) + 2)]
            for value in batch.column(1):
                body = value.as_py()
                data = body.encode("utf-8", "replace")
                counts, (*found, within) = base_counts(body, data), ratios(data)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                for column, cell in zip(columns, (*counts, failed, *found, within and not failed)):
                    column.append(cell)
            types = [pa.int64()] * len(COUNTS) + [pa.bool_()] + [pa.float64()] * len(RATIOS) + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [key, *COUNTS, "base_failed", *RATIOS, "kept"])

    return docs.select(key, whole_text(text).alias("_text")).mapInArrow(run, schema)

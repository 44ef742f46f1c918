"""Packing of documents into token sequences: non-negative least squares over length combinations.

1. Each document becomes ids plus one end id, cut into full windows and a rest.
2. Lengths are rounded up to units; the histogram over units is all that the plan
   needs. Combinations of up to ``depth`` lengths that fill a window are its columns,
   repeat counts are the unknowns, solved by non-negative least squares and rounded down.
3. What the rounded counts leave is packed greedily, on counts again: the largest
   length first, then the largest that still fits, repeated until a count runs out.
4. A piece finds its sequence through its rank among the pieces of its length. Ranks
   come from salted groups and their running totals, so no length, however common,
   is ranked in one task.

The driver holds the histogram (one number per unit) and the patterns; pieces stay
in tables.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage

END = 1
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: Letters followed by ASCII marks other than the apostrophe: always two words to the tokenizer.
_WORD_AND_MARKS = re.compile(rb"(" + _LETTER + rb"+)([!-&(-/:-@\[-`{-~]*)\Z")
#: Byte-level tokenizers write the bytes that have no visible character as the characters from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_NOTHING = re.compile(rb"(?!)")
#: Characters tokenised before the caches are looked at again, and most words kept in them.
SLICE = 1 << 21
CACHE_WORDS = 250_000
#: Bytes of words, with four of ids for each, learned before the caches are emptied.
CACHE_BYTES = 1 << 27


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins characters across white space.

    Words are encoded once and looked up afterwards. ``lower`` says that the tokenizer
    lower-cases; texts with combining marks are left as they are, since composing
    comes first. Byte-level tokenizers only.
    """

    _made: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One per path and worker process, so that later tasks find the words."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, lower: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.learned = 0
        # tokens that are found in the text as it stands, before it is lower-cased
        added = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)")
        probe = "chevêche straße"
        self._encode_words(set(probe.encode().split()))
        if b"".join(map(self.words.get, probe.encode().split())) != np.array(
                self.tokenizer.encode(probe, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("not a byte-level tokenizer that parts words at white space")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.learned > CACHE_BYTES:
            self.chunks.clear()
            self.words.clear()
            self.learned = 0
        for cache in (self.chunks, self.words):
            if len(cache) > CACHE_WORDS:
                for old in list(islice(cache, CACHE_WORDS // 2)):
                    del cache[old]
        split, missing = [], set()
        for text in texts:
            data = text.encode("utf-8", "replace")
            if self.lower and b"\xcc" not in data and b"\xcd" not in data:
                low = data.translate(LOWER)
                if self.added.search(low):
                    chunks = [c if self.added.search(x) else x for c, x in zip(data.split(), low.split())]
                else:
                    chunks = low.split()
            else:
                chunks = data.split()
            missing.update(chunks)
            split.append(chunks)
        missing -= self.chunks.keys()
        if missing:
            self.learned += 5 * sum(map(len, missing))
            self._learn(missing)
        known = self.chunks.__getitem__
        return [b"".join(map(known, chunks)) for chunks in split]

    def _learn(self, missing: set[bytes]) -> None:
        plain, pairs, odd = [], [], []
        match = (_WORD_AND_MARKS if self.lower else _NOTHING).match
        for chunk in missing:
            m = match(chunk)
            if m is None:
                odd.append(chunk)
            elif m.end(1) == len(chunk):
                plain.append(chunk)
            else:
                pairs.append((chunk, *m.groups()))
        words, chunks = self.words, self.chunks
        self._encode_words({w for _, w, _ in pairs if w not in words} | {w for w in plain if w not in words})
        self._encode_marks({m for _, _, m in pairs if m not in words}, words)
        self._encode_marks(odd, chunks)
        for word in plain:
            chunks[word] = words[word]
        for chunk, word, marks in pairs:
            chunks[chunk] = words[word] + words[marks]

    def _encode_words(self, new: set[bytes]) -> None:
        """Runs of letters are one word each: the model takes them without the steps that find words."""
        tokenize, words = self.tokenizer.model.tokenize, self.words
        pack = [struct.Struct(f"<{n}I").pack for n in range(64)]
        for word in new:
            plain = word.decode("latin-1") if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(_BYTES)
            ids = [token.id for token in tokenize(plain)]
            words[word] = pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def _encode_marks(self, new, into: dict[bytes, bytes]) -> None:
        new = list(new)
        for word, got in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            into[word] = np.array(got.ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048,
           keep_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]) of every piece: full windows, then the rest."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.of(tokenizer)
        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column(1).cast(pa.large_string()).buffers()[1], np.int64)) if batch.num_rows else []
            low, n = 0, batch.num_rows
            while low < n:
                high, size = low, 0
                while high < n and (high == low or size + lengths[high] <= SLICE):
                    size += lengths[high]
                    high += 1
                part = batch.slice(low, high - low)
                at, columns = [], [[] for _ in range(5)]
                for row, ids in enumerate(encoder.ids(part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start:4 * (start + window)]
                        at.append(row)
                        for column, value in zip(columns, (start, len(own) // 4, zlib.crc32(own), total, own)):
                            column.append(value)
                arrays = [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4])]
                arrays += [pa.array(columns[4], pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(arrays, [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)
                low = high
        encoder.chunks.clear()  # the words stay for the worker's next task

    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


# ---- the plan -------------------------------------------------------------------------
def combinations_filling(units: int, depth: int) -> np.ndarray:
    """Rows of ``depth`` unit lengths, descending, 0 as padding, that add up to ``units``."""
    rows = [()]
    for level in range(depth):
        rows = [(*r, n) for r in rows for n in range(min(r[-1] if r else units, units - sum(r)), -1, -1)
                if n or level]
        rows = [r for r in rows if sum(r) + (depth - level - 1) * r[-1] >= units]
    return np.array([r for r in rows if sum(r) == units])


def solve(columns: np.ndarray, counts: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations with the least squared error of their histogram."""
    n = len(counts)
    amounts = np.zeros((len(columns), n))
    for level in range(columns.shape[1]):
        np.add.at(amounts, (np.arange(len(columns)), columns[:, level]), 1.0)
    amounts[:, 0] = 0
    x, used = np.zeros(len(columns)), []
    tolerance = 1e-9 * max(1.0, counts.max(initial=0))
    for _ in range(rounds or 3 * n):
        rest = counts - x @ amounts
        gain = amounts @ rest
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= max(tolerance, 0.5):
            break
        used.append(best)
        while True:
            s = np.linalg.lstsq(amounts[used].T, counts, rcond=None)[0]
            if s.min() > 0:
                break
            now, bad = x[used], s <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - s[bad], 1e-300))
            x[used] = now + step * (s - now)
            drop = [u for u in used if x[u] <= tolerance]
            x[drop] = 0
            used = [u for u in used if u not in drop]
            if not used:
                break
        if not used:
            break
        x[:] = 0
        x[used] = s
    return x


def patterns(counts: np.ndarray, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """({unit length: pieces}, repeats) of all sequences; ``counts[u]`` pieces have unit length u."""
    units = len(counts) - 1
    left = counts.astype(np.int64).copy()
    planned = []
    columns = combinations_filling(units, depth)
    repeats = np.floor(solve(columns, counts.astype(float)) + 1e-6).astype(np.int64)
    for row in np.argsort(-repeats, kind="stable"):
        need = {int(u): int((columns[row] == u).sum()) for u in columns[row] if u}
        times = min([int(repeats[row]), *(int(left[u]) // m for u, m in need.items())])
        if times > 0:
            planned.append((need, times))
            for u, m in need.items():
                left[u] -= m * times
    while left.any():
        need: dict[int, int] = {}
        room = units
        spare = left.copy()
        while room:
            fits = np.flatnonzero(spare[1:room + 1])
            if not len(fits):
                break
            u = int(fits[-1]) + 1
            take = min(room // u, int(spare[u]))
            need[u] = need.get(u, 0) + take
            spare[u] -= take
            room -= take * u
        times = min(int(left[u]) // m for u, m in need.items())
        planned.append((need, times))
        for u, m in need.items():
            left[u] -= m * times
    return planned


def pack(rows: DataFrame, key: str = "doc_id", window: int = 2048, unit: int = 8, depth: int = 3,
         salt_rows: int = 4_096) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset (long, gapless from 0 in the sequence).

    No sequence is longer than ``window``. Rows that are equal in all columns are
    interchangeable. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    units = -(-window // unit)
    total = rows.count()
    salts = max(1, total // salt_rows)
    own = [F.col(key), F.col("start"), F.col("length"), F.col("ids_crc32")]
    filed = rows.withColumn("_unit", F.ceil(F.col("length") / F.lit(unit)).cast("int")).withColumn(
        "_salt", F.pmod(F.xxhash64(*own), F.lit(salts)))
    groups = stage(filed.groupBy("_unit", "_salt").count(), "packing-counts")
    counts = np.zeros(units + 1, np.int64)
    for row in groups.groupBy("_unit").agg(F.sum("count").alias("n")).collect():
        counts[row["_unit"]] = row["n"]
    places, base, at = [], 0, np.zeros(units + 1, np.int64)
    for need, times in patterns(counts, depth):
        for u, m in need.items():
            places.append((u, int(at[u]), int(at[u]) + m * times, base, times))
            at[u] += m * times
        base += times
    before = Window.partitionBy("_unit").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        "_unit", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("_before"))
    ranked = filed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_unit", "_salt").orderBy(*own)) - F.lit(1).cast("long"))
    # at most a few thousand rows: the patterns are bounded by the number of units
    table = F.broadcast(spark.createDataFrame(
        places, "_place_unit int, _low long, _high long, _base long, _times long"))
    rank = F.col("_rank") + F.col("_before")
    placed = ranked.join(starts, ["_unit", "_salt"]).withColumn("_rank", rank).join(
        table, (F.col("_unit") == F.col("_place_unit")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    placed = placed.withColumn("sequence_id", F.col("_base") + (F.col("_rank") - F.col("_low")) % F.col("_times"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *own).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long"))).select(
        *rows.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048,
                   keep_ids: bool = False) -> DataFrame:
    """All of ``docs`` packed: key, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Rows with the same
    key are documents of their own; other columns are ignored. An empty table gives
    an empty one.
    """
    return pack(stage(pieces(docs, tokenizer, key, text, window, keep_ids), "packing-pieces"), key, window)

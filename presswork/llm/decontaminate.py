"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces. An item of n
characters may differ from a passage by ``k = floor(rate * n)`` edits. Cut into k + 1
pieces, at least one piece stands in the passage unchanged and at most k places
from where it should be. All pieces are searched at once in each document; around
each hit Myers' bit-parallel distance decides. Items and texts are compared with a
space at each end, so that a passage that starts or ends inside a word costs an edit,
and an item with k = 0 has to stand between word bounds.

Items go to the workers in blocks of about ``block_chars`` characters, each an
automaton of bounded size, however large the benchmark is; documents never move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII characters that are neither letters nor digits become spaces.
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = dict.fromkeys(map(ord, " «»¿¡–—‘’“”…"), " ")


def normal(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_MARKS) if any(chr(c) in text for c in _MARKS) else text
    return b" ".join(text.encode("utf-8", "replace").translate(_SPACED).split()).decode()


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 nearly equal pieces with their places."""
    bounds = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.n, self.where = len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.where[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end): the least distance to any substring of ``text`` and the first end that has it."""
        full, high, where = (1 << self.n) - 1, 1 << (self.n - 1), self.where
        plus, minus, score = full, 0, self.n
        least, end = self.n, 0
        for j, c in enumerate(text, 1):
            eq = where.get(c, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq) | minus
            up = minus | ~(d | plus) & full
            down = plus & d
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            if score < least:
                least, end = score, j
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(x | up) & full
            minus = up & x
        return least, end


class Matcher:
    """Finds the items of one block in normal texts; both are compared with a space at each end."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        pieces = defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            k, text = int(rate * len(text)), f" {text} "
            self.items.append((item_id, text, k, Pattern(text)))
            for at, piece in cut(text, k):
                pieces[piece].append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end of the passage) for each item with a passage in reach."""
        text = f" {text} "
        found = []
        around = defaultdict(list)
        for end, (size, owners) in self.automaton.iter(text) if self.any else ():
            for owner, at in owners:
                n, k = len(self.items[owner][1]), self.items[owner][2]
                start = end + 1 - size - at
                # fewer characters than any passage within k edits has
                if start + n + k > 0 and min(len(text), start + n + k) - max(0, start - k) >= n - k:
                    around[owner].append((max(0, start - k), min(len(text), start + n + k)))
        for owner, spans in around.items():
            item_id, item, k, pattern = self.items[owner]
            exact = text.find(item)
            if exact >= 0:
                found.append((item_id, 0, exact + len(item) - 2))
                continue
            if not k:
                continue
            best = None
            spans.sort()
            low, high = spans[0]
            for a, b in [*spans[1:], (len(text) + 1, 0)]:
                if a <= high:
                    high = max(high, b)
                    continue
                distance, end = pattern.best(text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, low + end - 1 - (text[low + end - 1] == " ")
                low, high = a, b
            if best:
                found.append((item_id, *best))
        return found


def contaminations(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", rate: float = 0.06, block_chars: int = 2 << 20,
) -> DataFrame:
    """(key, item, distance, end): each document and item with a passage of it, the least distance, and where it ends.

    ``end`` counts characters of the normal text; the first of equal distances wins.
    Items of any length are searched. Items and texts without letters or digits match
    nothing, null texts are empty. Every row is a document and an item of its own, so
    repeated rows repeat their results. Empty tables give an empty one. The key may
    have any type and be null, as may the long item id.
    """
    spark = docs.sparkSession
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` long, distance long, end long"
    chars = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == block)
        # a block holds about block_chars characters
        items = [(r[0], normal(r[1])) for r in own.select(F.col(item).cast("long"), item_text).collect() if r[1]]
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                at, found = [], []
                for row, column in enumerate(batch.column(1)):
                    hits = matcher.find(normal(column.as_py()))
                    at += [row] * len(hits)
                    found += hits
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*found))],
                        [key, item, "distance", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out

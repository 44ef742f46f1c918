"""Ranked lexical search over posting lists cut into geometric blocks.

1. One pass reads the texts and writes, per document, its number of terms and the counts
   of those terms that a query has. The statistics of the corpus are sums over that table.
2. Documents are searched where they lie, ``SHARD`` entries at a time. A shard has a posting
   list per term. A list is clustered by document similarity: evenly spaced members of the
   list are centres, and each document joins the centre that its sketch of weighted terms
   is closest to. A cluster is cut into blocks of at most ``BLOCK`` documents, and a block
   keeps a summary: the greatest impact of every term over its documents.
3. The best ``top`` found so far give a query its limit. Lists are visited from the
   strongest term on, until what the remaining terms can add up to is below the limit.
   In a list, the blocks are visited by falling bound, the product of query and summary.
   The bound is exact, since no document of the block can score more, so a block is
   skipped only if its bound is below the limit. Scores are exact integers.
4. Each task gives at most ``top`` rows per query; they are merged by rank, first in salted
   parts, so that no query gathers all tasks' rows at once.

Lists are clustered and summarised when a query first visits them and kept for the shard's
other queries. Memory holds one shard and one block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import whole_text
from presswork.session import stage

#: ASCII letters in lower case, digits, bytes of other characters as they are, all else a space.
_TERMS = bytes((b | 32 if chr(b).isalpha() else b if chr(b).isdigit() else 32) if b < 128 else b for b in range(256))
#: Entries (document, term) searched at once, and documents of a block.
SHARD = 1 << 19
BLOCK = 32
#: Numbers of a document's sketch, and most centres of one assignment.
SKETCH = 24
CENTRES = 256
#: Characters of queries searched in one pass.
QUERY_CHARS = 1 << 22
#: Rows of one query that a merge takes at a time, roughly.
MERGE = 1 << 16
LAST = (1 << 63) - 1


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# ---- the corpus in terms of the queries ------------------------------------------------------
def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                own, n = np.unique(np.array([i for i in map(known, words) if i is not None], np.int32), return_counts=True)
                terms.append(own)
                counts.append(n)
            offsets = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[1], pa.int64()))], ["key", "n", "terms", "counts"])

    return run


def _document_counts(size: int):
    """Documents that hold each term, one row per term and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found[own], pa.int64())], ["term", "df"])

    return run


# ---- one shard ----------------------------------------------------------------------------------
class Shard:
    """Posting lists of some documents; row i is terms[at[i]:at[i + 1]] with its impacts."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray, impacts: np.ndarray, at: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        self.keys, self.terms, self.impacts, self.at, self.block = keys, terms, impacts, at, block
        self.size = len(weights)
        self.owners = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(at))
        order = np.argsort(terms, kind="stable")
        self.order = order
        self.starts = np.searchsorted(terms[order], np.arange(self.size + 1))
        self.greatest = np.zeros(self.size, np.int64)
        np.maximum.at(self.greatest, terms, impacts)
        signs = np.random.default_rng(11).standard_normal((self.size, SKETCH)).astype(np.float32)
        drawn = signs[terms] * (weights[terms] * impacts).astype(np.float32)[:, None]
        sums = np.add.reduceat(np.vstack([drawn, np.zeros((1, SKETCH), np.float32)]), np.minimum(at[:-1], len(terms)), axis=0)
        sums[np.diff(at) == 0] = 0
        self.sketches = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple] = {}

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries one after the other, and how many each row has."""
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        return np.repeat(self.at[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def clustered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list's documents in order of their blocks, and where the blocks start."""
        if len(rows) <= self.block:
            return rows, np.array([0])
        own = self.sketches[rows]
        n = min(-(-len(rows) // self.block), CENTRES)
        centres = own[np.linspace(0, len(rows) - 1, n).astype(np.int64)]
        nearest = (own @ centres.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        first = np.searchsorted(nearest, nearest)
        return rows[order], np.flatnonzero((np.arange(len(rows)) - first) % self.block == 0)

    def blocked(self, term: int) -> tuple:
        """(documents, block starts, summary starts by term, summary blocks, summary maxima) of a posting list."""
        if term not in self.lists:
            rows = self.owners[self.order[self.starts[term]:self.starts[term + 1]]]
            rows, starts = self.clustered(rows)
            blocks = np.zeros(len(rows), np.int64)
            blocks[starts[1:]] = 1
            places, sizes = self.entries(rows)
            cells = self.terms[places].astype(np.int64) * len(starts) + np.repeat(np.cumsum(blocks), sizes)
            impacts = self.impacts[places].astype(np.int32)  # below 10**6
            if self.size * len(starts) <= 4 * len(cells):
                most = np.zeros(self.size * len(starts), np.int32)
                np.maximum.at(most, cells, impacts)
                cells = np.flatnonzero(most)
                most = most[cells]
            else:
                order = np.argsort(cells)
                cells = cells[order]
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                most = np.maximum.reduceat(impacts[order], first)
                cells = cells[first]
            terms, at = np.divmod(cells, len(starts))
            self.lists[term] = rows, starts, np.searchsorted(terms, np.arange(self.size + 1)).astype(np.int32), at.astype(np.int32), most
        return self.lists[term]

    def search(self, query: np.ndarray, weights: np.ndarray, top: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best (scores, keys), falling score, then key, of ``best`` and this shard's documents."""
        held = query[(self.starts[query + 1] > self.starts[query]) & (weights[query] > 0)]
        power = weights[held] * self.greatest[held]
        held = held[np.argsort(-power, kind="stable")]
        left = np.cumsum(np.sort(power))[::-1]
        own = np.zeros(self.size, np.int64)
        own[held] = weights[held]
        seen = np.zeros(len(self.keys), bool)
        scores, keys = best
        for term, possible in zip(held, left):
            # from here on no unseen document can score more than ``possible``
            if len(scores) == top and possible < scores[-1]:
                break
            rows, starts, at, blocks, most = self.blocked(int(term))
            bounds = np.zeros(len(starts), np.int64)
            for other in held:
                part = slice(at[other], at[other + 1])
                bounds[blocks[part]] += own[other] * most[part]
            ends = np.append(starts[1:], len(rows))
            order = np.argsort(-bounds, kind="stable")
            low, step = 0, 1
            while low < len(order):
                if len(scores) == top:
                    order = order[:np.searchsorted(-bounds[order], -scores[-1], "right")]
                    if low >= len(order):
                        break
                chosen = order[low:low + step]
                low, step = low + step, min(2 * step, 64)
                found = np.concatenate([rows[starts[b]:ends[b]] for b in chosen])
                found = found[~seen[found]]
                if not len(found):
                    continue
                seen[found] = True
                places, sizes = self.entries(found)
                exact = np.add.reduceat(own[self.terms[places]] * self.impacts[places], np.cumsum(sizes) - sizes)
                good = exact >= (scores[-1] if len(scores) == top else 1)
                found, exact = found[good], exact[good]
                scores, keys = np.append(scores, exact), np.append(keys, self.keys[found])
                kept = np.lexsort((keys, -scores))[:top]
                scores, keys = scores[kept], keys[kept]
        return scores, keys


def _searched(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n: int, total: int, top: int, shard: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: (np.empty(0, np.int64), np.empty(0, np.int64)) for q, _ in queries}

        def settle(held):
            keys, sizes, terms, counts = (np.concatenate(x, axis=-1) for x in zip(*held))
            if not len(terms):
                return
            at = np.append(0, np.cumsum(sizes[1]))
            m = np.repeat(50 + (50 * sizes[0] * n) // total, sizes[1])
            own = Shard(keys, terms, (1_000_000_000 * counts) // (1000 * counts + 20 * m), at, weights, block)
            for q, query in queries:
                best[q] = own.search(query, weights, top, best[q])

        def parts(batch):
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            # a null key comes last
            keys = batch.column(0).fill_null(LAST).to_numpy().astype(np.int64)
            sizes = np.vstack([batch.column(1).to_numpy(), np.diff(offsets)])
            low = 0
            while low < len(keys):  # at least one document, and no more entries than a shard has
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + shard, "right")) - 1)
                yield (keys[low:high], sizes[:, low:high], lists.values.to_numpy()[offsets[low]:offsets[high]],
                       batch.column(3).values.to_numpy()[offsets[low]:offsets[high]])
                low = high

        held, entries = [], 0
        for batch in batches:
            for part in parts(batch):
                if held and entries + len(part[2]) > shard:
                    settle(held)
                    held, entries = [], 0
                held.append(part)
                entries += len(part[2])
        if held:
            settle(held)
        for q, (scores, keys) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * len(scores), pa.int64()), pa.array(keys, pa.int64(), mask=keys == LAST), pa.array(scores, pa.int64())],
                    ["query", "key", "score"])

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", shard: int = SHARD, block: int = BLOCK, query_chars: int = QUERY_CHARS) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents with the highest score above 0 of every query row.

    Terms are runs of ASCII letters (in lower case), digits and characters beyond ASCII.
    With N documents that have a term, L terms in all, n terms in a document, df documents
    with a term, a term that stands tf times in a document adds
    floor(1000 ln((2N + 2) / (2 df + 1))) * (10**9 tf // (1000 tf + 20 m)), m = 50 + 50 n N // L.
    Equal scores go by ascending key, null keys last. Null texts have no terms, and a
    query without terms no rows. Every row is a document and a query of its own, so
    repeated rows repeat; keys are long and may be null. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    asked = stage(queries.select(F.col(item).alias("item"), whole_text(item_text).alias("text")).withColumn(
        "query", F.monotonically_increasing_id()), "search-queries")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // query_chars) or 1
    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    found = None
    for at in range(blocks):
        # a block of queries holds about ``query_chars`` characters
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == at).select("query", "text").collect()
        own = [(q, sorted(set(terms_of(t)))) for q, t in own]
        numbers = {t: i for i, t in enumerate(sorted({t for _, ts in own for t in ts}))}
        counted = stage(rows.mapInArrow(_counted(numbers), "key long, n long, terms array<int>, counts array<long>"), "search-terms")
        n, total = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        weights = np.zeros(len(numbers), np.int64)
        for term, df in counted.select("terms").mapInArrow(_document_counts(len(numbers)), "term int, df long").groupBy("term").agg(
                F.sum("df")).collect():
            weights[term] = weight(n, df)
        own = [(q, np.array([numbers[t] for t in ts], np.int64)) for q, ts in own if ts]
        part = counted.where(F.size("terms") > 0).mapInArrow(
            _searched(own, weights, n, total or 1, top, shard, block), "query long, key long, score long")
        found = part if found is None else found.union(part)
    found = stage(found, "search-found")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    parts = max(1, found.count() // MERGE)
    salted = found.withColumn("part", F.pmod(F.xxhash64("key", "score"), F.lit(parts)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item), "rank", F.col("key").alias(key), "score")

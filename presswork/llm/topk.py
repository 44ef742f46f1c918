"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are packed into blocks of rows. A candidate block is turned into postings,
one list of (row, weight) per dimension. Each query row then walks its non-zero
terms and scatters query weight times posting weight into a dense array with one
score per candidate row; a partition selection keeps the k best, and the lists of
all blocks are merged per query.

Candidate blocks are dealt into groups, and the packed queries are copied to every
group, as often as their copies take no more room than the candidates or as the cores
need. A task holds the queries of one group, the best rows of each so far and one
candidate block; where the queries are more than ``QUERY_LOAD``, they are dealt into
tiles as well. The merge ranks at most k rows per query and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "ids binary, sizes binary, weights binary"
#: Components that a block may hold beyond its first row.
BLOCK_ENTRIES = 1 << 19
#: Components of the queries, and 8 for each of their k best rows, that a task is to hold at most.
QUERY_LOAD = 1 << 23


def quantised(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null or not finite."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(F.coalesce(~odd, F.lit(False)), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, weights) of each partition as blocks of at most ``block_rows`` rows and ``BLOCK_ENTRIES`` components."""
    most = BLOCK_ENTRIES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, weights, held, entries = [], [], [], 0, 0

        def block():
            return pa.RecordBatch.from_pydict({
                "ids": [np.concatenate(ids).tobytes()], "sizes": [np.concatenate(sizes).tobytes()],
                "weights": [np.concatenate(weights).tobytes()]})

        for batch in batches:
            at, ends = 0, np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            while at < batch.num_rows:
                fitting = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most - entries, "right")) - at
                part = batch.slice(at, min(block_rows - held, max(fitting, 0 if held else 1)))
                at, held = at + part.num_rows, held + part.num_rows
                lists = part.column(1)
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                sizes.append(np.diff(lists.offsets.to_numpy()).astype(np.int32))
                weights.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                entries += len(weights[-1])
                if held == block_rows or at < batch.num_rows:
                    yield block()
                    ids, sizes, weights, held, entries = [], [], [], 0, 0
        if held:
            yield block()

    return rows.mapInArrow(pack, _BLOCK)


def _unpacked(ids: bytes, sizes: bytes, weights: bytes):
    sizes = np.frombuffer(sizes, np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(ids, np.int64), starts, np.frombuffer(weights, np.int64)


def _joined(blocks):
    """Unpacked blocks as one."""
    ids, starts, weights = zip(*blocks)
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for s in starts]))])
    return np.concatenate(ids), starts, np.concatenate(weights)


def postings(starts: np.ndarray, weights: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per dimension the places of rows with a weight there and the weights; a list of most rows is a slice, with its zeros."""
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(weights)) - starts[rows]
    used = weights != 0
    rows, terms, weights = places[rows[used]], terms[used], weights[used]
    order = np.argsort(terms, kind="stable")
    rows, weights = rows[order], weights[order]
    cuts = np.searchsorted(terms[order], np.arange(int(sizes.max(initial=0)) + 1))
    lists = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        if 2 * (high - low) < len(sizes):
            lists.append((rows[low:high], weights[low:high].copy()))
        else:
            dense = np.zeros(len(sizes), np.int64)
            dense[rows[low:high]] = weights[low:high]
            lists.append((slice(None), dense))
    return lists


def best_of_block(query_ids, query_starts, query_weights, ids, starts, weights, k: int):
    """(query_id, id, score) of the k best rows of one block for each query; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    places = np.empty_like(order)
    places[order] = np.arange(len(order))
    lists = postings(starts, weights, places)
    ids = ids[order]
    scores, part = np.zeros(len(ids), np.int64), np.empty(len(ids), np.int64)
    found = []
    for q, query in enumerate(query_ids):
        scores[:] = 0
        row = query_weights[query_starts[q]:query_starts[q + 1]]
        for term in np.flatnonzero(row[:len(lists)]):
            at, weight = lists[term]
            scores[at] += np.multiply(weight, row[term], out=part[:len(weight)])
        low, high = np.searchsorted(ids, query), np.searchsorted(ids, query, "right")
        by_id, mine = (scores, ids) if low == high else (np.delete(x, slice(low, high)) for x in (scores, ids))
        take = min(k, len(mine))
        if take == 0:
            continue
        least = np.partition(by_id, len(by_id) - take)[len(by_id) - take]
        above = np.flatnonzero(by_id > least)
        level = np.flatnonzero(by_id == least)[:take - len(above)]
        best = np.concatenate([above, level])
        found.append((np.full(len(best), query), mine[best], by_id[best]))
    return found


def best_of_lists(found, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of lists (query_id, id, score) for each query; ties to smaller ids."""
    query_ids, ids, scores = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((ids, ~scores, query_ids))
    query_ids, at = query_ids[order], np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.append(True, query_ids[1:] != query_ids[:-1]), at, 0))
    keep = at - first < k
    return query_ids[keep], ids[order[keep]], scores[order[keep]]


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, query_rows: int = 512, block_rows: int = 8192,
) -> DataFrame:
    """The k best ``candidates`` of each of the ``queries``: query_id, rank (int, from 1), id, score (long).

    Both inputs are rows ``id long, weights array<long>``. A row with a null id or
    null weights takes no part, a null weight counts as 0. Missing trailing
    components count as 0, and sums wrap like Spark's long. A candidate with the query's own id is
    left out. Of queries that share an id the one with the smallest weights asks;
    repeated candidates each count. Ties go to the smaller id. An empty side gives no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.select("id", F.transform("weights", lambda w: F.coalesce(w, F.lit(0).cast("long"))).alias("weights")).where(
            F.col("id").isNotNull() & F.col("weights").isNotNull())

    asked = clean(queries).groupBy("id").agg(F.min("weights").alias("weights"))
    spark = candidates.sparkSession
    asking, load = clean(queries).select(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("weights") + F.lit(8 * k)), F.lit(0))).first()
    many, slots = candidates.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-load // QUERY_LOAD))
    # the copies of the queries stay within the room of the candidates, unless the cores need more groups
    useful = max(3 * spark.sparkContext.defaultParallelism, many // max(1, asking))
    groups = max(1, min(-(-many // block_rows), 4 * slots, useful))
    deal = F.xxhash64(F.monotonically_increasing_id())

    def cells(group: Column, tile: Column) -> Column:
        return (group * F.lit(tiles) + tile).cast("int").alias("cell")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    blocks = _packed(clean(candidates), block_rows).withColumn("group", F.pmod(deal, F.lit(groups)))
    blocks = blocks.withColumn("tile", each(tiles)) if tiles > 1 else blocks.withColumn("tile", F.lit(0))
    questions = _packed(asked, query_rows).withColumn("tile", F.pmod(deal, F.lit(tiles))).withColumn("group", each(groups))
    dealt = (
        questions.select(cells(F.col("group"), F.col("tile")), F.lit(False).alias("answers"), "ids", "sizes", "weights")
        .unionByName(blocks.select(cells(F.col("group"), F.col("tile")), F.lit(True).alias("answers"), "ids", "sizes", "weights"))
        .repartitionById(groups * tiles, "cell").sortWithinPartitions("cell", "answers")
        .select("answers", "ids", "sizes", "weights"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = [], []
        for batch in batches:
            for at, answers in enumerate(batch.column(0).to_pylist()):
                block = _unpacked(*(batch.column(c)[at].as_buffer() for c in (1, 2, 3)))
                if not answers:
                    asked.append(block)
                elif asked:
                    asked = [_joined(asked)] if len(asked) > 1 else asked
                    found = best_of_block(*asked[0], *block, k)
                    best = [best_of_lists(best + found, k)] if found else best
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(part) for part in best[0]], ["query_id", "id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        dealt.mapInArrow(score, "query_id long, id long, score long")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score"))

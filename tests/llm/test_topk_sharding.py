import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import sharding, topk
from presswork.llm.topk import best_of_block, quantised, top_k


def brute_top(rows, k):
    queries = {}
    for i, w in rows:
        if i is not None and w is not None and i % 100 == 0:
            queries[i] = min(queries.get(i, w), w, key=lambda v: [x or 0 for x in v])
    want = set()
    for q, w in queries.items():
        scored = sorted(
            (-sum((a or 0) * (b or 0) for a, b in zip(w, v)), i) for i, v in rows if i is not None and v is not None and i != q)
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return want


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0, 0, -2, -1, 1, 2]) for _ in range(rnd.choice([0, 5, 8]))]) for i in range(0, 1200, 3)]
    rows += [(7, [1, 1]), (7, [1, 1]), (None, [1]), (3000, None), (500, [None, 2, 0])]
    df = spark.createDataFrame(rows, "id long, weights array<long>")
    for block_rows in (16, 4096):
        got = top_k(df.where("id % 100 = 0"), df, 4, query_rows=2, block_rows=block_rows).collect()
        assert {tuple(r) for r in got} == brute_top(rows, 4)
        assert len(got) == len({(r[0], r[1]) for r in got})


@pytest.mark.parametrize("load,entries", [(100, 1 << 19), (200, 20), (1 << 23, 1)])
def test_queries_and_blocks_are_dealt_in_bounds(spark, monkeypatch, load, entries):
    monkeypatch.setattr(topk, "QUERY_LOAD", load)
    monkeypatch.setattr(topk, "BLOCK_ENTRIES", entries)
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(-3, 3) for _ in range(rnd.choice([0, 1, 9]))]) for i in range(0, 700, 7)] + [(14, [1]), (700, [])]
    df = spark.createDataFrame(rows, "id long, weights array<long>").repartition(3)
    out = top_k(df.where("id % 100 = 0"), df, 3, query_rows=2, block_rows=8)
    assert {tuple(r) for r in out.collect()} == brute_top(rows, 3)


def test_queries_meet_blocks_without_a_row_for_each_pair(spark):
    rows = [(i, [i % 5, -i]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, weights array<long>").coalesce(1)
    out = top_k(df.where("id % 100 = 0"), df, 2, block_rows=10)
    assert {tuple(r) for r in out.collect()} == brute_top(rows, 2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_largest_and_least_scores_keep_their_order():
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    lists = [(np.array([1, 1]), np.array([5, 6]), np.array([low, high])), (np.array([1, 2]), np.array([4, 9]), np.array([high, low]))]
    assert [x.tolist() for x in topk.best_of_lists(lists, 2)] == [[1, 1, 2], [4, 6, 9], [high, high, low]]


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "id long, weights array<long>")
    one = spark.createDataFrame([(0, [1])], "id long, weights array<long>")
    assert top_k(none, none).count() == top_k(one, none).count() == top_k(none, one).count() == top_k(one, one).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.0005],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(quantised("v")).collect()] == [[512, -1], None, None, None, None, []]


def test_block_keeps_ties_by_id():
    ids, starts = np.array([9, 3, 5, 1]), np.array([0, 1, 2, 3, 4])
    found = best_of_block(np.array([3]), np.array([0, 1]), np.array([2]), ids, starts, np.array([1, 1, 1, 1]), 2)
    assert sorted(found[0][1].tolist()) == [1, 5]


@pytest.mark.parametrize("shards,nodes,slack", [(5, 3, 0.0), (7, 20, 0.0), (4, 8, 0.25), (1, 1, 0.0)])
def test_shards_follow_the_ring(spark, shards, nodes, slack):
    rows = [(i, f"x{i}", i % 3) for i in range(400)] + [(None, "n", 0), (None, "m", 1), (5, "again", 2), (5, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    cells = {r[0]: r[1] for r in df.select("doc_id", sharding.ring_cell(F.col("doc_id"))).distinct().collect()}
    out = sharding.assign_shards(df, shards=shards, virtual_nodes=nodes, slack=slack).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    bounds = sharding.load_bounds(len(rows), shards, slack)
    sizes = [len(slots[s]) for s in range(shards)]
    assert all(n <= b for n, b in zip(sizes, bounds)) and (slack or sizes == bounds)
    # a row away from its own place only where that place's shard is full
    places = sharding.ring(shards, nodes)
    for r in out:
        arc = next((a for a, (cell, _) in enumerate(places) if cell >= cells[r["doc_id"]]), 0)
        own = places[arc][1]
        assert r["shard"] == own or sizes[own] == bounds[own]


def test_more_shards_move_few_rows(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r[0]: r[1] for r in sharding.assign_shards(df, shards=n, slack=0.3).select("doc_id", "shard").collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


def test_no_rows_no_shards(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0

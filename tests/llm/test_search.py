import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from presswork.llm import geometric


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    counts = [Counter(terms(t)) for _, t in docs]
    n, total = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (key, _), c in zip(docs, counts):
            m = 50 + 50 * c.total() * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            scores += [(-score, key is None, key)] * (score > 0)
        out += [(item, i, key, -s) for i, (s, _, key) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def tables(n=400):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    topics = [rnd.choices(words, k=8) for _ in range(12)]
    docs = [(i, " ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(1, 30)) + rnd.choices(words, k=rnd.randint(0, 4)))) for i in range(n)]
    docs += [(1000 + i, "w1 w2 rare common, W1") for i in range(120)] + [(5, "w1 w2"), (None, "w1 w2 rare common w1"), (None, "Ünder_ünder don't"), (7, None), (8, ""), (9, "?!")]
    docs += [(2000, "w3 " * 50_000 + "w4"), docs[3]]
    items = [(i, " ".join(rnd.choices(rnd.choice(topics), k=6))) for i in range(12)]
    items += [(50, "w1 W1 w2, rare"), (50, "w1 W1 w2, rare"), (None, "Ünder x"), (51, None), (52, "-"), (53, "nowhere"), (54, "w3 w4 " * 2000)]
    return docs, items


@pytest.mark.parametrize("shard, block, query_chars, merge", [(1 << 20, 32, 1 << 22, 1 << 16), (60, 3, 300, 5)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block, query_chars, merge):
    monkeypatch.setattr(geometric, "MERGE", merge)
    docs, items = tables()
    left = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, item_id int").repartition(3)
    right = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    got = geometric.ranked_search(left, right, 20, shard=shard, block=block, query_chars=query_chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame(t, f"{k} long, text string") for t, k in zip(tables(20), ("doc_id", "item_id")))
    assert geometric.ranked_search(docs.limit(0), items).count() == geometric.ranked_search(docs, items.limit(0)).count() == 0


def shard_of(n=3000):
    docs, _ = tables(n)
    counts = [Counter(int(t[1:]) for t in terms(text) if re.fullmatch(r"w\d+", t)) for _, text in docs[:n]]
    at = np.cumsum([0, *map(len, counts)])
    flat = [(t, 1000 * c // (c + 1)) for own in counts for t, c in sorted(own.items())]
    flat = np.array(flat, np.int64)
    weights = np.random.default_rng(3).integers(1, 9000, 60)
    return geometric.Shard(np.arange(n), flat[:, 0], flat[:, 1], at, weights, 16), weights


def test_blocks_part_each_list_and_their_summaries_bound_it():
    shard, _ = shard_of()
    for term in range(60):
        rows, starts, at, blocks, most = shard.blocked(term)
        assert sorted(rows) == sorted(np.flatnonzero([term in shard.terms[a:b] for a, b in zip(shard.at, shard.at[1:])]))
        assert np.diff(np.append(starts, len(rows))).max(initial=1) <= 16
        summary = np.zeros((len(starts), 60), np.int64)
        for other in range(60):
            summary[blocks[at[other]:at[other + 1]], other] = most[at[other]:at[other + 1]]
        for b, own in enumerate(np.split(rows, starts[1:])):
            places, _ = shard.entries(own)
            want = np.zeros(60, np.int64)
            np.maximum.at(want, shard.terms[places], shard.impacts[places])
            assert (summary[b] == want).all()


def test_blocks_of_similar_documents_let_most_be_skipped(monkeypatch):
    shard, weights = shard_of()
    looked = []
    entries = shard.entries
    query = np.array([1, 5, 9, 30])
    for term in range(60):
        shard.blocked(term)
    monkeypatch.setattr(shard, "entries", lambda rows: looked.append(len(rows)) or entries(rows))
    scores, keys = shard.search(query, weights, 10, (np.empty(0, np.int64), np.empty(0, np.int64)))
    own = np.zeros(60, np.int64)
    own[query] = weights[query]
    full = np.add.reduceat(own[shard.terms] * shard.impacts, shard.at[:-1])
    want = np.lexsort((np.arange(len(full)), -full))[:10]
    assert keys.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert sum(looked) < 0.5 * (full > 0).sum()

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from presswork.llm import divergence


def brute(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for own, source, terms in found:
            if own == lang:
                docs.update(set(terms))
                counts[source].update(terms)
        kept = {t for t, n in docs.items() if n >= least_docs}
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        for source, c in counts.items():
            p = shares(c)
            pairs = [(-sum(abs(p[t] - r[t]) for t in kept), other.encode(), other) for other, d in counts.items() if other != source for r in [shares(d)]]
            terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if c[t] and p[t] > q[t])[:top]
            for part, values in (("pair", sorted(pairs)), ("term", terms)):
                out += [(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(values, 1)]
    return sorted(out)


def documents():
    rnd = random.Random(12)
    words = ["Tree", "tree", "ÄRA", "ära", "w'x", "𝒳", "don", "a1b", "z z"] + [f"k{chr(97 + i)}{chr(97 + i // 3)}" for i in range(26)]
    rows = []
    for i in range(150):
        source = rnd.choice(["s1", "s1", "s1", "s2", "S3", "é", None, "", "only"])
        rows.append((rnd.choice(["en", "de", None]), source, " ".join(rnd.choices(words[rnd.randint(0, 5):], k=rnd.randint(0, 40)))))
    rows += rows[:10]
    rows += [("rare", "a", "nothing twice"), ("rare", "b", "else"), ("rare", "c", None), ("en", "mute", "12 34"), ("single", "x", "a a")]
    rows += [("", "long", "tree " * 200_000)]
    return rows


@pytest.mark.parametrize("block, tile, entries", [(1 << 14, 64, 1 << 18), (3, 2, 10), (1, 1, 0)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, tile, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(3)
    got = divergence.source_divergence(docs, least_docs=8, top=5, block=block, tile=tile)
    want = brute(rows, 8, 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[0] == "rare" and r[4] == 0 for r in want) and {r[2] for r in want} == {"pair", "term"}
    assert dict(got.dtypes) == dict(lang="string", source="string", part="string", item="string", value="bigint", rank="int")


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0


def test_runs_and_differences():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        lengths = rnd.integers(1, 4, 30)
        ends = np.cumsum(lengths)
        a, b = (np.where(rnd.random(30) < 0.4, rnd.integers(1, 3, 30), 0) for _ in range(2))
        a[rnd.integers(30)], b[rnd.integers(30)] = 1, 2
        one, other = (divergence.runs(np.flatnonzero(x), x[x > 0], ends) for x in (a, b))
        for x, (e, v) in ((a, one), (b, other)):
            assert (np.repeat(v, np.diff(e, prepend=0)) == np.repeat(x, lengths)).all() and (np.diff(v) != 0).all()
        assert divergence.difference(one, other) == (np.abs(a - b) * lengths).sum()


def test_shares_are_exact():
    for n, total, vocabulary in [(0, 0, 1), (7, 10, 3), (10**15, 2 * 10**15, 10**9), (3, 10**15, 5)]:
        assert divergence.share(np.array([n]), total, vocabulary)[0] == 1 + 10**9 * (n + 5) // (total + 5 * vocabulary)

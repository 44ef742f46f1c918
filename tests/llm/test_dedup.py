import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from presswork.llm import simhash, suffixes
from presswork.operators.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_print(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\t\n\x0b\x1f Z.", max_size=40))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_print(text)


def test_fingerprint_of_nothing_and_of_much():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(random.Random(2).choices(WORDS, k=70_000))
    assert simhash.fingerprint(long) & (2**64 - 1) == brute_print(long)


def groups_of(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            root = find(i)
            ids[root] = min(ids.get(root, key), key)
    return sorted(((key, f"{prints[i]:016x}", ids.get(find(i))) for i, (key, _) in enumerate(rows)), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(25)]
    rows = []
    for i in range(160):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            if words:
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((rnd.randint(0, 300), " ".join(words)))
    rows += [(None, None), (4, ""), (900, "one"), (None, "one"), (7, base[0]), (7, base[0])]
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, key string, fp int")
    want = groups_of(rows)
    for bucket_rows in (1 << 15, 2):
        assert sorted((tuple(r) for r in simhash.near_duplicates(df, bucket_rows=bucket_rows).collect()), key=repr) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_every_plan_finds_every_pair():
    rnd = np.random.default_rng(5)
    both = rnd.random((64, 64))
    both = (both + both.T) * 100
    np.fill_diagonal(both, 500)
    for n in (1000, 10**6, 10**9, 10**12):
        for tau in (1, 2, 3):
            parts = simhash.plan(n, both, tau)
            m = len(parts)
            for _ in range(200):
                flipped = set(rnd.choice(64, tau, replace=False).tolist())
                assert any(len(flipped & set(bits)) <= t for bits, t in parts), (n, tau, m)


def test_thresholds_are_the_cheapest():
    costs = [[0, 5, 9, 30], [0, 4, 5, 6], [0, 7, 8, 9]]
    best = min((a[i] + b[j] + c[k], [i - 1, j - 1, k - 1]) for a, b, c in [costs] for i in range(4) for j in range(4) for k in range(4)
               if i + j + k - 3 == 0)
    assert simhash.allocate(costs, 0)[0] == best[0]


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 900 + i) for i in range(40)] + [(5, 5), (3, None)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{900 + i: 900 for i in range(40)}, 1000: 900}


def test_pipeline_links_rows_by_their_own_texts(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join("x" if i and j == 500 * i else w for j, w in enumerate(words))) for i in range(4)]
    rows += [(4, " ".join("x" if j % 5 == 0 else w for j, w in enumerate(words)))]
    rows += [(1, "one text"), (1, "another text under that id"), (None, "one text"), (7, None), (8, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = {i for i in range(4) if bin(simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[0][1])).count("1") <= 2}
    assert len(near) > 1
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    want = [(0, 0)] + [(i, i) for i in range(1, 4) if i not in near] + [(4, 4), (1, 5), (1, 6), (7, 8)]
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((d, rows[i][1] or "") for d, i in want)
    assert got[0].__fields__ == docs.columns
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


# ---- repeated substrings ------------------------------------------------------------
def brute_repeats(rows):
    first = {}
    data = [(suffixes.NO_KEY if k is None else k, (t or "").encode()) for k, t in rows]
    for key, text in data:
        for s in range(len(text) - 49):
            first[text[s:s + 50]] = min(key, first.get(text[s:s + 50], key))
    out = []
    for (key, text), (shown, _) in zip(data, rows):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 49):
            if first[text[s:s + 50]] < key:
                gone[s:s + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((shown, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows():
    rnd = random.Random(8)
    passages = ["".join(rnd.choices("abé ", k=rnd.choice([40, 49, 50, 51, 80, 200]))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 70))) if rnd.random() < 0.5 else rnd.choice(passages) for _ in range(rnd.randint(0, 6))]
        rows.append((rnd.randint(0, 50), "".join(parts)))
    rows += [(None, None), (None, passages[5]), (70, ""), (71, "a" * 300), (72, "a" * 120), (3, "x" * 49), (2, "x" * 49), (71, "a" * 300)]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    df = spark.createDataFrame([(k, t, "keep", "b") for k, t in rows], "doc_id long, text string, kept string, payload string").repartition(3)
    want = brute_repeats(rows)
    for options in ({}, {"hot_ties": 1, "bucket_bytes": 2000, "place_bytes": 1500}):
        got = suffixes.remove_repeats(df, **options)
        assert got.columns == ["doc_id", "payload", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == want
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    text = suffixes.remove_repeats(df, keep="text").where("doc_id = 70").first()
    assert text["kept"] == "" and suffixes.remove_repeats(df, keep=None).columns[-1] == "kept_sha256"


def test_long_texts_are_cut_without_a_seam(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 20_000).astype(np.uint8)
    data[9000:12000] = data[:3000]
    data[15_000:15_500] = 97
    whole = suffixes.sample_texts(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    for a, b in zip(whole, suffixes.sample_texts(data, np.array([0, len(data)]))):
        assert np.array_equal(a, b)


def test_runs_equal_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(24):
        period = ["-", "ab", "xyz"][i % 3]
        ends = ["".join(rnd.choices("pqrs", k=rnd.choice([0, 5, 30, 60]))) for _ in range(2)]
        rows.append((rnd.randint(0, 15), ends[0] + period * rnd.randint(20, 300) + ends[1] + period * rnd.randint(1, 90)))
    want = brute_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"hot_ties": 1, "bucket_bytes": 2000, "place_bytes": 1500}):
        got = suffixes.remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_a_run_needs_few_looks():
    texts = pa.RecordBatch.from_pydict({"id": [1, 2], "row": [5, 6], "body": [b"one " + b"-" * 100_000 + b" two", b"x" + b"-" * 300 + b"y"]})
    sent = pa.concat_tables(pa.Table.from_batches([b]) for b in suffixes._send_samples(1, 1)(iter([texts]))).combine_chunks().to_batches()
    ties = [x for batch in suffixes._sort_bucket(1, 1, 1 << 17)(iter(sent)) for x in batch.column(2).to_pylist() if x is not None]
    assert 0 < sum(len(suffixes._unpacked(x)[0]) for x in ties) < 1000

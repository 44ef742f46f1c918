"""The funnel and the deduplication operators against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from presswork.config import CrawlLimits
from presswork.operators import dedup, ingest


def body(text):
    return f"<html><head><title>t</title></head><body><article><p>{text}</p></article></body></html>"


def brute_force(pages, keywords, limits, seen_urls, seen_hashes):
    """One page after the other, as a sequential ingest would do it."""
    out, seen = {}, set(seen_hashes)
    for key, url, html, content in sorted(pages):
        digest = hashlib.sha256((content or "").encode()).hexdigest()
        if url in seen_urls:
            out[key] = "duplicate_url"
        elif not html or not html.strip().startswith("<"):
            out[key] = "failed_fetch"
        elif len(content) < limits.min_content_chars:
            out[key] = "too_short"
        elif len(content) > limits.max_content_chars:
            out[key] = "too_long"
        elif not any(k in f"t {content}".lower() for k in keywords):
            out[key] = "filtered_keyword"
        elif digest in seen:
            out[key] = "duplicate_content"
        else:
            seen.add(digest)
            out[key] = "saved"
    return out


def make_pages(n=90):
    rng, pages = random.Random(1), []
    for key in range(n):
        kind = key % 9
        word = rng.choice(["robot", "garden"])
        # A third of the pages share one text.
        text = "robot " * 110 if kind in (0, 3, 6) else f"{word} {key % 25} " * 70
        text = {1: "robot short", 2: "robot " * 2000}.get(kind, text).strip()
        html = {4: None, 5: " not html"}.get(kind, body(text)) if key % 2 else body(text)
        pages.append((key, f"https://h/{key}", html, text))
    return pages


def test_funnel_equals_brute_force(spark):
    pages, limits = make_pages(), CrawlLimits()
    seen_urls = {"https://h/10", "https://h/21"}
    seen_hashes = {hashlib.sha256(("garden 7 " * 70).strip().encode()).hexdigest(),
                   hashlib.sha256(("robot 7 " * 70).strip().encode()).hexdigest()}
    want = brute_force(pages, ["robot"], limits, seen_urls, seen_hashes)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    for parts in (1, 7):
        run = ingest.run_funnel(
            df.repartition(parts), ["robot"], limits,
            history_urls=spark.createDataFrame([(u,) for u in seen_urls], "url string"),
            history_hashes=spark.createDataFrame([(h,) for h in seen_hashes], "content_hash string"))
        got = {r["page_id"]: r["outcome"] for r in run.outcomes.collect()}
        assert got == want
        assert {r["page_id"] for r in run.articles.collect()} == {k for k, o in want.items() if o == "saved"}
    counts = {r["outcome"]: r["pages"] for r in ingest.funnel_counts(run.outcomes).collect()}
    assert counts.pop("attempted") == len(pages) == sum(counts.values())


def test_keyword_hits_are_substrings(spark):
    df = spark.createDataFrame([("An AIRSHIP nlp",), ("none",)], "t string")
    got = [r[0] for r in df.select(ingest.keyword_hits(F.col("t"), ["air", "NLP", "x"])).collect()]
    assert got == [["air", "nlp"], []]


def test_first_wins_last_wins_and_caps(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), rng.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, pos int").repartition(5)
    first, last = {}, {}
    for g, k, pos in rows:
        first.setdefault(k, (k, g, pos))
        last[k] = (k, g, pos)
    assert {(r["k"], r["g"], r["pos"]) for r in dedup.first_wins(df, ["k"], ["pos"]).collect()} == set(first.values())
    assert {(r["k"], r["g"], r["pos"]) for r in dedup.last_wins(df, ["k"], ["pos"]).collect()} == set(last.values())
    capped = dedup.cap_per_group(df, ["g"], ["pos"], 40, salts=7)
    want = [r for g in "ab" for r in [x for x in rows if x[0] == g][:40]]
    assert {r["pos"] for r in capped.collect()} == {r[2] for r in want}
    total = dedup.cap_total(capped, ["g"], ["pos"], 55)
    assert {r["pos"] for r in total.collect()} == {r[2] for r in want[:55]}


def test_history_keys_skip_missing(spark):
    df = spark.createDataFrame([("u", None), (None, "h"), ("u", "h")], "url string, content_hash string")
    urls, hashes = ingest.history_keys(df)
    assert [r[0] for r in urls.collect()] == ["u"] and [r[0] for r in hashes.collect()] == ["h"]


def test_repeated_urls_follow_the_rows_in_order(spark):
    import random

    rnd = random.Random(4)
    for rows in [
        [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u2", "h2"), (4, "u1", "h9"), (5, None, "h1"), (6, None, "h7")],
        [(i, f"u{rnd.randint(0, 9)}", f"h{rnd.randint(0, 12)}") for i in range(60)],
    ]:
        urls, hashes, want = set(), set(), set()
        for key, url, digest in rows:
            if url not in urls and digest not in hashes:
                want.add(key)
                urls |= {url} - {None}
                hashes.add(digest)
        df = spark.createDataFrame(rows, "page_id long, url string, content_hash string").repartition(3)
        for in_order, rounds in ((1 << 18, 2), (0, 9), (8, 0), (3, 1)):
            got = ingest.first_of_both(df, "page_id", "url", "content_hash", in_order, rounds)
            assert {r[0] for r in got.collect()} == want
        assert ingest.first_of_both(df.limit(0), "page_id", "url", "content_hash").count() == 0


@pytest.mark.parametrize("in_order", [1 << 18, 6000])
def test_chains_take_few_jobs(spark, monkeypatch, in_order):
    staged = []
    monkeypatch.setattr(ingest, "stage", lambda df, name, inner=ingest.stage: staged.append(name) or inner(df, name))
    n = 5000  # each row shares its URL with the row before it and its text with the row after it
    rows = [(c * n + i, f"u{c}-{(i + 1) // 2}", f"h{c}-{i // 2}") for c in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, content_hash string").repartition(4)
    got = {r[0] for r in ingest.first_of_both(df, "page_id", "url", "content_hash", in_order, rounds=1).collect()}
    assert got == {c * n + i for c in range(2) for i in range(0, n, 2)}
    assert len(staged) < 8


def test_second_page_of_a_saved_url_is_a_duplicate_url(spark):
    body = "<html><article><p>" + "robot words " * 60 + "{}</p></article></html>"
    pages = spark.createDataFrame(
        [(1, "http://a/1", body.format("one")), (2, "http://a/1", body.format("two")), (3, "http://a/1", "no page"),
         (4, "http://a/4", body.format("two")), (5, "http://a/9", body.format("x"))], "page_id long, url string, html string")
    known = spark.createDataFrame([("http://a/9",), ("http://a/9",)], "url string")
    run = ingest.run_funnel(pages, ["robot"], history_urls=known)
    assert {r["page_id"]: r["outcome"] for r in run.outcomes.collect()} == {
        1: "saved", 2: "duplicate_url", 3: "duplicate_url", 4: "saved", 5: "duplicate_url"}
    assert sorted(r["page_id"] for r in run.articles.collect()) == [1, 4]


def test_history_may_hold_digests(spark):
    page = "<html><article><p>" + "robot words " * 60 + "{}</p></article></html>"
    pages = spark.createDataFrame([(i, f"http://a/{i}", page.format(i)) for i in range(4)], "page_id long, url string, html string")
    ids = spark.createDataFrame([(hashlib.sha256(f"http://a/{i}".encode()).hexdigest(),) for i in (1, 1, 3, 9)], "id string")
    run = ingest.run_funnel(pages, ["robot"], history_urls=ids)
    assert {r["page_id"]: r["outcome"] for r in run.outcomes.collect()} == {0: "saved", 1: "duplicate_url", 2: "saved", 3: "duplicate_url"}


@pytest.mark.parametrize("bucket_rows", [1 << 16, 20, 1, 0])
def test_ranks_are_exact_at_any_bucket_size(spark, bucket_rows):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i // 3 if i < 90 else i) for i in range(500)] + [("only", 7)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(4)
    digest = F.md5(F.col("k").cast("string"))
    got = dedup.rank_cutoffs(df, digest, "k", ["g"], {"one": F.lit(1), "half": F.floor((F.col("_size") + 1) / 2), "last": F.col("_size")}, bucket_rows)
    for g in ("a", "b", None, "only"):
        ordered = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for own, k in rows if own == g)
        r = next(r for r in got.collect() if r["g"] == g)
        assert [tuple(r[c]) for c in ("one", "half", "last")] == [ordered[0], ordered[(len(ordered) + 1) // 2 - 1], ordered[-1]]


def test_total_cap_over_many_groups(spark):
    rows = [(f"g{i // 3:03d}" if i > 5 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, pos int").repartition(7)
    for n in (0, 1, 7, 150, 500):
        got = dedup.cap_total(df, ["g"], ["pos"], n)
        assert sorted(r["pos"] for r in got.collect()) == list(range(min(n, 200))) and got.columns == ["g", "pos"]

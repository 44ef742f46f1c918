"""Discovery against a breadth-first walk in plain Python."""

import random

from presswork.config import CrawlLimits
from presswork.operators import discover

BASE = "https://h.example"


def site(n=40, seed=3):
    rng, pages = random.Random(seed), {}
    for i in range(n):
        targets = [f"/q/{rng.randrange(n + 3)}" for _ in range(8)]  # some are not stored
        anchors = "".join(f'<a href="{t}">next</a>' for t in targets)
        pages[f"{BASE}/q/{i}"] = ([BASE + t for t in targets], f'{anchors}<a href="/news/story{i % 11}#x">s</a><a href="/about">a</a>')
    return pages


def walk(pages, seed, max_depth, fanout):
    visited, frontier, depth_of = {seed}, [seed], {seed: 0}
    for depth in range(1, max_depth + 1):
        found = set()
        for url in frontier:
            fresh = [t for t in pages.get(url, ([], ""))[0] if t not in visited]
            found |= set(fresh[:fanout])
        visited |= found
        depth_of.update({u: depth for u in found})
        frontier = sorted(found)
    return {u: d for u, d in depth_of.items() if u in pages}


def test_crawl_equals_walk(spark):
    pages = site()
    df = spark.createDataFrame([(u, h) for u, (_, h) in pages.items()], "url string, html string")
    seeds = spark.createDataFrame([(0, f"{BASE}/q/0")], "site int, url string")
    got = {r["url"]: r["depth"] for r in discover.crawl_pages(df, seeds, 3, 2).collect()}
    assert got == walk(pages, f"{BASE}/q/0", 3, 2)
    locs = {r["loc"] for r in discover.crawl_urls(df, seeds, 3, 2).collect()}
    assert locs == {f"{BASE}/news/story{int(u.rsplit('/', 1)[1]) % 11}" for u in got}


def test_sitemaps(spark):
    index = "<sitemapindex>{}</sitemapindex>"
    loc = "<sitemap><loc>{}</loc></sitemap>"
    docs = [(f"s{i}", index.format(loc.format(f"s{i}") + loc.format(f" s{i + 1} "))) for i in range(7)]
    docs.append(("m", "<x:urlset><x:url><x:loc> https://a/news/1?a&amp;b </x:loc><x:loc>https://a/news/1?a&amp;b</x:loc>"
                      "<x:loc><![CDATA[https://a/news/2]]></x:loc><x:loc>https://a/tag/</x:loc></x:url></x:urlset>"))
    docs.append(("broken", "<urlset><loc>https://a/news/1?a&amp;b</loc><loc>https://a/feed/</loc><loc>https://a/news/3</loc>"))
    df = spark.createDataFrame(docs, "url string, xml string")
    seeds = spark.createDataFrame([(0, "s0")], "site int, url string")
    reached = {r["url"]: r["depth"] for r in discover.expand_sitemaps(df, seeds, 5).collect()}
    assert reached == {f"s{i}": i + 1 for i in range(5)}
    urls = [(r["url"], r["pos"], r["loc"]) for r in discover.sitemap_urls(df).orderBy("url", "pos").collect()]
    assert urls == [("broken", 0, "https://a/news/1?a&amp;b"), ("broken", 1, "https://a/news/3"),
                    ("m", 0, "https://a/news/1?a&b"), ("m", 1, "https://a/news/2")]


def test_feeds(spark):
    rss = "<rss><channel><link>home</link><item><link> https://a/1 </link></item><item><title>x</title></item><item><link><![CDATA[https://a/2]]></link></item></channel></rss>"
    atom = '<feed><link href="home"/><entry><link rel="self" href="s"/><link href="https://a/3"/></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom)], "url string, xml string")
    got = [(r["url"], r["loc"]) for r in discover.feed_urls(df).orderBy("url", "pos").collect()]
    assert got == [("a", "https://a/3"), ("r", "https://a/1"), ("r", "https://a/2")]
    assert discover.feed_urls(df, 1).count() == 2


def test_candidates_are_first_wins_over_sites(spark):
    rows = [(1, "https://a/news/1#x", 0), (0, "https://a/news/1", 5), (0, "https://a/news/2", 1),
            (0, "ftp://a/news/3", 2), (1, "https://a/news/4", 3), (1, "https://a/tag/", 4)]
    found = spark.createDataFrame(rows, "site_pos int, url string, pos int")
    history = spark.createDataFrame([("https://a/news/4",)], "url string")
    out = discover.candidate_urls(found, ["pos"], history)
    assert {(r["site_pos"], r["url"]) for r in out.collect()} == {(0, "https://a/news/1"), (0, "https://a/news/2")}
    one = discover.candidate_urls(found, ["pos"], None, CrawlLimits(max_urls=1))
    assert [r["url"] for r in one.collect()] == ["https://a/news/2"]


def test_sitemap_endings(spark):
    index = "<sitemapindex><sitemap><loc>http://a/x.xml</loc></sitemap></sitemapindex>"
    urls = "<urlset><url><loc>http://a/2024/01/story?a=1&amp;b=2</loc></url></urlset>"
    ends = ["", "\n<!-- made\nby -->\n", "<?done?> <!-- x --><!-- y -->"]
    df = spark.createDataFrame([(i, index + e, urls + e) for i, e in enumerate(ends)], "i int, index string, urls string")
    from pyspark.sql import functions as F

    for row in df.select(discover.is_sitemap_index(F.col("index")), discover.sitemap_locs(F.col("urls"))).collect():
        assert row[0] and row[1] == ["http://a/2024/01/story?a=1&b=2"]
    broken = df.select(discover.is_sitemap_index(F.concat("index", F.lit("<x>")))).collect()
    assert not any(r[0] for r in broken)


def test_a_level_shuffles_its_frontier_and_its_finds_alone(spark):
    from pyspark.sql import functions as F

    from presswork.operators import reach as R

    edges = spark.createDataFrame([(f"u{i}", 0, f"u{(i * 7 + 1) % 50}") for i in range(50)], "src string, pos int, url string")
    links = R.Bucketed(edges, ["src"], "test-edges")
    seen = R.Bucketed(spark.createDataFrame([(0, "u0", 0)], "site int, url string, depth int"), ["site", "url"], "test-seen", ["depth"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frontier = seen.read().where("depth = 0").select("site", F.col("url").alias("src"))
        found = frontier.join(links.read(), "src").select("site", "url").distinct()
        found = found.join(seen.read().select("site", "url"), ["site", "url"], "left_anti")
        plan = found._jdf.queryExecution().sparkPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan[1].splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2, plan[1]
    assert sum("src" in line for line in exchanges) == 1 and sum("site" in line for line in exchanges) == 1
    assert links.close().count() == 50 and seen.close().count() == 1


def test_reach_follows_cycles_and_long_chains_once(spark):
    from presswork.operators.reach import reach

    edges = [(f"c{i}", 0, f"c{i + 1}") for i in range(9)] + [("c9", 0, "c0"), ("c2", 1, "c0"), ("c0", 1, None), (None, 0, "c5"), ("x", 0, "y")]
    df = spark.createDataFrame(edges, "src string, pos int, url string")
    seeds = spark.createDataFrame([(0, "c0"), (0, "c0"), (1, "c4"), (2, "alone")], "site int, url string")
    got = sorted((r["site"], r["url"], r["depth"]) for r in reach(df, seeds).collect() if r["url"])
    assert got == sorted([(0, f"c{i}", i) for i in range(10)] + [(1, f"c{(4 + i) % 10}", i) for i in range(10)] + [(2, "alone", 0)])
    assert reach(df.limit(0), seeds).count() == 3 and reach(df, seeds.limit(0)).count() == 0

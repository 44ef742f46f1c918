"""Files, configuration and streams."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from presswork import schemas
from presswork.config import CrawlLimits, label_dimension
from presswork.functions.urls import netloc
from presswork.operators.inference import lexicon_stage
from presswork.operators.ingest import run_funnel
from presswork.operators.scoring import Lexicon
from presswork.plans import corpus
from presswork.sources import tables
from presswork.sources.config import read_keyword_table, read_sources
from presswork.streaming import ingest as stream_ingest
from presswork.streaming import score as stream_score

RECORD = "id string, content string"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "content": "x"}\n\n{"id": "2", "cont\n{"id": "3", "content": "y"}\n', encoding="utf8")
    got = tables.read_articles(spark, str(path), "DROPMALFORMED", RECORD)
    assert {r["id"] for r in got.collect()} == {"1", "3"}
    with pytest.raises(Exception):
        tables.read_articles(spark, str(path), "FAILFAST", RECORD).collect()
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("1", "ä")], RECORD)
    tables.append_articles(df, out)
    tables.append_articles(df, out)
    assert tables.read_articles(spark, out, schema=RECORD).count() == 2
    tables.write_articles(df.withColumn("label", F.lit("l")), out)
    assert [r["label"] for r in tables.read_articles(spark, out, schema=RECORD + ", label string").collect()] == ["l"]


def test_csv_holds_quotes_and_line_breaks(spark, tmp_path):
    rows = [("1", 'a "quoted", text\nwith \\ lines '), ("2", "back\\slash\\"), ("3", '"'), ("4", " lead")]
    df = spark.createDataFrame(rows, RECORD)
    tables.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c"), RECORD).collect()} == set(rows)


def test_required_columns(spark):
    df = spark.createDataFrame([("1", "x")], RECORD)
    assert tables.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="label"):
        tables.require_columns(df, ["label"])


def config_file(tmp_path, **more):
    doc = {"sites": [
        {"domain": "m", "type": "sitemap", "feed": "https://m/sitemap.xml", "js": False},
        {"domain": "c", "type": "category", "url": "https://c/news", "js": True}],
        "keywords": ["Robot", "garden"], "min_content_chars": 20, **more}
    path = tmp_path / "sources.json"
    path.write_text(json.dumps(doc, indent=1), encoding="utf8")
    return str(path)


def test_source_config(spark, tmp_path):
    cfg = read_sources(spark, config_file(tmp_path, max_urls=9))
    assert cfg.keywords == ["robot", "garden"]
    assert cfg.limits == CrawlLimits(min_content_chars=20, max_urls=9)
    assert [(r["site_pos"], r["domain"], r["js"]) for r in cfg.sites.collect()] == [(0, "m", False), (1, "c", True)]
    assert read_keyword_table(spark, config_file(tmp_path)).count() == 2
    assert label_dimension(spark).count() == 18


def test_collect_job(spark, tmp_path):
    """Sitemap and category discovery, then the funnel over the stored candidates."""
    cfg = read_sources(spark, config_file(tmp_path))
    html = "<html><article><p>" + "robot " * 100 + "{}</p></article></html>"
    pages = spark.createDataFrame(
        [(0, "https://c/news", '<a href="/news/one">1</a><a href="/news/two">2</a>'),
         (1, "https://c/news/one", html.format("one")), (2, "https://c/news/two", html.format("one")),
         (3, "https://m/news/three", html.format("three")), (4, "https://m/news/unlisted", html.format("four"))],
        "page_id long, url string, html string")
    docs = spark.createDataFrame(
        [("https://m/sitemap.xml", "<urlset><url><loc>https://m/news/three</loc></url></urlset>")], "url string, xml string")
    run = corpus.collect(cfg, pages, docs)
    got = {r["url"]: r["outcome"] for r in run.outcomes.collect()}
    assert got == {"https://c/news/one": "saved", "https://c/news/two": "duplicate_content", "https://m/news/three": "saved"}
    again = corpus.collect(cfg, pages, docs, run.articles)
    assert {r["url"]: r["outcome"] for r in again.outcomes.collect()} == {"https://c/news/two": "duplicate_content"}
    tables.write_urls(run.articles, str(tmp_path / "urls"))
    assert spark.read.text(str(tmp_path / "urls")).count() == 2


def test_result_documents(spark, tmp_path):
    m = "struct<micro_f1:double,macro_f1:double,hamming_loss:double>"
    rows = spark.createDataFrame([(1, "b", 0.5, (0.1, 0.2, 0.3), (0.4, 0.5, 0.6)), (0, "a", 0.1, (0.0, 0.0, 0.0), (1.0, 1.0, 0.0))],
                                 f"pos int, name string, training_time_minutes double, val_metrics {m}, test_metrics {m}")
    tables.write_results(tables.results_document(rows, "Stage 1", ["x", "y"]), str(tmp_path / "r"))
    doc = tables.read_results(spark, str(tmp_path / "r")).first()
    assert doc["num_labels"] == 2 and [x["name"] for x in doc["models"]] == ["a", "b"]
    assert doc["models"][1]["test_metrics"]["hamming_loss"] == 0.6


def page(key, text):
    return (key, f"https://h/{key}", f"<html><article><p>{text}</p></article></html>")


def test_replayed_batches_add_no_rows(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    one = spark.createDataFrame([page(1, "robot a " * 80), page(2, "robot b " * 80), page(3, "short")], schema)
    two = spark.createDataFrame([page(1, "robot a " * 80), page(4, "robot b " * 80), page(3, "robot c " * 80)], schema)
    out = str(tmp_path / "articles")
    read = lambda: sorted((r["batch_id"], r["page_id"]) for r in stream_ingest.article_history(spark, out).collect())
    assert stream_ingest.article_history(spark, out) is None
    stream_ingest.ingest_batch(one, 0, out, ["robot"])
    stream_ingest.ingest_batch(two, 1, out, ["robot"])
    assert read() == [(0, 1), (0, 2), (1, 3)]  # the failed page came back and was taken
    stream_ingest.ingest_batch(two, 1, out, ["robot"])
    assert read() == [(0, 1), (0, 2), (1, 3)]
    stream_ingest.ingest_batch(two, 1, out, ["nothing"])  # a replay that saves nothing
    assert read() == [(0, 1), (0, 2)]


@pytest.mark.parametrize("files_per_batch", [1, 2, None])
def test_stream_equals_one_run(spark, tmp_path, files_per_batch):
    schema = "page_id bigint, url string, html string"
    pages = [page(i, f"robot {'abc'[i % 3]} {i // 4} " * 80 if i % 7 else "short") for i in range(24)]
    pages += [(40 + i, f"https://h/{i}", p[2]) for i, p in enumerate(pages[:6])]
    for lot in range(0, 30, 6):
        spark.createDataFrame(pages[lot:lot + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken up in the order of their times
    out = str(tmp_path / "out")
    stream = stream_ingest.read_page_stream(spark, str(tmp_path / "in"), schema, files_per_batch)
    stream_ingest.ingest_stream(stream, out, str(tmp_path / "check"), ["robot"]).awaitTermination()
    saved = stream_ingest.article_history(spark, out)
    want = run_funnel(spark.createDataFrame(pages, schema), ["robot"]).articles
    assert sorted(r["page_id"] for r in saved.collect()) == sorted(r["page_id"] for r in want.collect())
    ids, hashes = stream_ingest.saved_keys(spark, out, 99)
    assert sorted(r[0] for r in ids.collect()) == sorted(r["id"] for r in saved.collect())
    assert sorted(r[0] for r in hashes.collect()) == sorted(r["content_hash"] for r in saved.collect())


def test_a_batch_reads_no_earlier_article(spark, tmp_path, monkeypatch):
    schema, out = "page_id bigint, url string, html string", str(tmp_path / "articles")
    rows = [page(i, f"robot {i} " * 80) for i in range(6)]
    stream_ingest.ingest_batch(spark.createDataFrame(rows[:4], schema), 0, out, ["robot"])
    for file in Path(out, "batch_id=0").glob("*.parquet"):
        file.write_bytes(b"no article can be read from here")
    again = [(9, *rows[1][1:]), (10, "https://h/10", rows[2][2]), *rows[4:]]
    stream_ingest.ingest_batch(spark.createDataFrame(again, schema), 1, out, ["robot"])
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{out}/batch_id=1").collect()) == [4, 5]


def test_keys_of_a_table_without_them(spark, tmp_path):
    schema, out = "page_id bigint, url string, html string", str(tmp_path / "articles")
    first = run_funnel(spark.createDataFrame([page(1, "robot a " * 80)], schema), ["robot"]).articles
    first.write.parquet(f"{out}/batch_id=0")
    stream_ingest.write_keys(stream_ingest.article_history(spark, out), 0, out)
    stream_ingest.ingest_batch(spark.createDataFrame([page(1, "robot a " * 80), page(2, "robot b " * 80)], schema), 1, out, ["robot"])
    assert sorted((r["batch_id"], r["page_id"]) for r in stream_ingest.article_history(spark, out).collect()) == [(0, 1), (1, 2)]


def test_stream_of_requests(spark, tmp_path):
    lex = Lexicon({"Artificial Intelligence": ["robot"], "Others": ["garden"]})
    bodies = [(1, '{"text": "robot robot robot"}'), (2, '{"text": "garden garden"}'), (3, "{}"), (4, "not json")]
    spark.createDataFrame(bodies, "id int, body string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, body string").parquet(str(tmp_path / "in"))
    texts = stream.select("id", stream_score.request_text(F.col("body")).alias("text"))
    stream_score.score_stream(texts, lexicon_stage(lex), lexicon_stage(Lexicon({"x": ["robot"]})),
                              str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    answers = spark.read.parquet(str(tmp_path / "out"))
    rows = {r["id"]: json.loads(r["response"]) for r in stream_score.response_json(answers).collect()}
    assert rows[1] == {"category": "Artificial Intelligence", "confidence": 0.6, "ethics": {"x": 0.6}}
    assert rows[2]["category"] == "Others" and rows[2]["ethics"] is None
    assert "error" in rows[3] and "error" in rows[4]


def test_page_cache(spark, tmp_path):
    df = spark.createDataFrame([("https://h/1", "<p>"), ("https://h/2", "<p>")], "url string, html string")
    tables.write_pages(df, str(tmp_path / "p"))
    back = tables.read_pages(spark, str(tmp_path / "p"), "url string, html string")
    assert {r["url"] for r in back.collect()} == {"https://h/1", "https://h/2"}
    assert back.where(F.substring("cache_key", 1, 2) != F.col("shard")).count() == 0
    assert schemas.scored("stage2").fieldNames()[0] == "stage2_bias_and_fairness" and netloc is not None

"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

from presswork.config import stage_keys

PAGES = "url string, html string, status int, headers map<string,string>"
SITES = "domain string, type string, feed string, url string, js boolean"
SOURCE_CONFIG = (
    f"sites array<struct<domain:string,type:string,feed:string,url:string,js:boolean>>, "
    "keywords array<string>, min_content_chars int, max_content_chars int, "
    "max_urls_per_site int, max_urls int, sitemap_max_nested int, "
    "crawl_max_depth int, crawl_fanout int"
)
ARTICLE = (
    "id string, url string, domain string, title string, content string, content_length int, "
    "content_hash string, keywords_found map<string,boolean>, scraped_at string"
)
ARTICLE_LABELLED = ARTICLE + ", label string"
ISSUE_FLAGS = "id string, _ai_ethics_binary map<string,int>"
MAIN_SPLIT = "text string, label string"
RESULTS = (
    "stage string, num_labels int, labels array<string>, models array<struct<"
    "name:string,training_time_minutes:double,"
    "val_metrics:struct<micro_f1:double,macro_f1:double,hamming_loss:double>,"
    "test_metrics:struct<micro_f1:double,macro_f1:double,hamming_loss:double>>>"
)


def scored(stage: str) -> T.StructType:
    """Wide probability columns of one stage."""
    return T.StructType([T.StructField(k, T.DoubleType()) for k in stage_keys(stage)])


def binary(stage: str) -> T.StructType:
    """Wide 0/1 columns of one stage."""
    return T.StructType([T.StructField(k, T.IntegerType()) for k in stage_keys(stage, binary=True)])


def split_schema(stage: str) -> T.StructType:
    """``content`` plus the binary labels of one stage."""
    return T.StructType([T.StructField("content", T.StringType()), *binary(stage).fields])

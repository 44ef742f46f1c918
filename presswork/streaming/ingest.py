"""Incremental ingest of stored pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork import schemas
from presswork.config import CrawlLimits
from presswork.operators.ingest import run_funnel

#: Readers of the article table pass over folders that start with an underscore.
KEY_FOLDER = "_keys"
KEYS = "id binary, content_hash binary"


def read_page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New page files of a directory as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of batches, or None when nothing has been written."""
    try:
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def article_history(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """Articles of earlier batches, or None when nothing has been written."""
    table = _table(spark, out, f"page_id bigint, {schemas.ARTICLE}")
    return table if table is None or before is None else table.where(F.col("batch_id") < before)


def saved_keys(spark: SparkSession, out: str, before: int) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """URL digests (``id``) and content hashes that batches before ``before`` saved, or nothing on the first one."""
    keys = _table(spark, f"{out.rstrip('/')}/{KEY_FOLDER}", KEYS)
    if keys is None:
        return None, None
    keys = keys.where(F.col("batch_id") < before)
    return tuple(keys.where(F.col(c).isNotNull()).select(F.lower(F.hex(c)).alias(c)) for c in ("id", "content_hash"))


def ingest_batch(
    pages: DataFrame, batch_id: int, out: str, keywords: list[str],
    limits: CrawlLimits = CrawlLimits(), scraped_at: Column | None = None,
) -> None:
    """One micro-batch: the funnel against earlier batches, written to the batch's own directory.

    The history is a table of keys beside the articles, 64 bytes per article, which a
    batch reads through once and never shuffles; no article of an earlier batch is read.
    It excludes this batch, and both directories of the batch are replaced whole, so a
    replayed batch, even one that saves nothing, ends in the same tables.  Failed pages
    stay out of the history, so they are tried again when they come back.
    """
    spark = pages.sparkSession
    urls, hashes = saved_keys(spark, out, batch_id)
    run = run_funnel(pages, keywords, limits, history_urls=urls, history_hashes=hashes, scraped_at=scraped_at)
    articles = f"{out.rstrip('/')}/batch_id={batch_id}"
    run.articles.write.mode("overwrite").parquet(articles)
    write_keys(spark.read.schema(f"page_id bigint, {schemas.ARTICLE}").parquet(articles), batch_id, out)


def write_keys(articles: DataFrame, batch_id: int, out: str) -> None:
    """The keys of a batch's articles, also for a table that was written without them."""
    keys = articles.select(F.unhex("id").alias("id"), F.unhex("content_hash").alias("content_hash"))
    keys.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{KEY_FOLDER}/batch_id={batch_id}")


def ingest_stream(
    pages: DataFrame, out: str, checkpoint: str, keywords: list[str],
    limits: CrawlLimits = CrawlLimits(), scraped_at: Column | None = None,
) -> StreamingQuery:
    """Start the incremental ingest over all pages that are available now."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, out, keywords, limits, scraped_at)

    return (
        pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

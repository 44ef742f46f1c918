"""Source configuration: sites, keywords and limits."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork import schemas
from presswork.config import CrawlLimits


@dataclass(frozen=True)
class SourceConfig:
    """``sites``: ``site_pos, domain, type, feed, url, js``. Keywords are lower-case."""

    sites: DataFrame
    keywords: list[str]
    limits: CrawlLimits


def site_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per site of each configuration document, in listed order."""
    return raw.select(*keep, F.posexplode("sites").alias("site_pos", "s")).select(*keep, "site_pos", "s.*")


def keyword_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per keyword of each configuration document, lower-case, in listed order."""
    return raw.select(*keep, F.posexplode("keywords").alias("pos", "k")).select(*keep, "pos", F.lower("k").alias("keyword"))


def limit_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per limit of each configuration document; absent limits have their defaults, NULL for unlimited."""
    limits = [F.struct(F.lit(f.name).alias("name"), F.coalesce(F.col(f.name), F.lit(f.default).cast("int")).alias("value"))
              for f in fields(CrawlLimits)]
    return raw.select(*keep, F.inline(F.array(*limits)))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCE_CONFIG).option("multiLine", True).json(path)


def read_site_table(spark: SparkSession, path: str) -> DataFrame:
    """The sites of a configuration document in listed order."""
    return site_rows(_documents(spark, path))


def read_keyword_table(spark: SparkSession, path: str) -> DataFrame:
    return keyword_rows(_documents(spark, path))


def read_sources(spark: SparkSession, path: str) -> SourceConfig:
    """A configuration file; absent limits take the defaults."""
    row = _documents(spark, path).select(F.transform("keywords", F.lower).alias("keywords"), *CrawlLimits.__dataclass_fields__).first()
    limits = CrawlLimits(**{
        k: row[k] for k in CrawlLimits.__dataclass_fields__ if row[k] is not None
    })
    return SourceConfig(read_site_table(spark, path), list(row["keywords"] or []), limits)

"""What can be reached over links, level by level."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage_path


class Bucketed:
    """A written table whose rows lie in buckets by ``columns``, so that joins on them do not move it."""

    def __init__(self, df: DataFrame, columns: list[str], name: str, parts: list[str] | None = None):
        self.spark, self.columns, self.parts, self.schema = df.sparkSession, columns, parts or [], df.schema
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.table = stage_path(self.spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        self.append(df)

    def append(self, df: DataFrame) -> None:
        """Add rows; a bucket gets one file."""
        writer = df.repartition(self.buckets, *self.columns).write.mode("append").format("parquet").option("path", self.path)
        if self.parts:
            writer = writer.partitionBy(*self.parts)
        writer.bucketBy(self.buckets, *self.columns).sortBy(*self.columns).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> DataFrame:
        """The rows as a plain table; the entry in the session's catalog goes, the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def reach(
    edges: DataFrame, seeds: DataFrame, start: int = 0, max_depth: int | None = None, fanout: int | None = None,
) -> DataFrame:
    """``site, url, depth`` of all that ``seeds`` (``site, url``) lead to over ``edges`` (``src, pos, url``).

    Breadth first from depth ``start``, to ``max_depth`` if given.  Each source passes on
    its targets, or its first ``fanout`` by ``pos``, that no earlier level of the site visited.
    A target that two sources of a level share is visited once.

    Edges lie in buckets by source and what was visited in buckets by site and URL, and a
    level appends to them, so neither moves again: a level shuffles its frontier and what
    that finds, and is one job and a look whether it found anything.
    """
    links = Bucketed(edges.select("src", "pos", "url"), ["src"], "reach-edges")
    first = seeds.select("site", "url").distinct().withColumn("depth", F.lit(start))
    seen = Bucketed(first, ["site", "url"], "reach-seen", ["depth"])
    by_source = Window.partitionBy("site", "src").orderBy("pos")
    for depth in count(start + 1) if max_depth is None else range(start + 1, max_depth + 1):
        frontier = seen.read().where(F.col("depth") == depth - 1).select("site", F.col("url").alias("src"))
        found = frontier.join(links.read(), "src")
        if fanout is None:
            found = found.select("site", "url").distinct()
        found = found.join(seen.read().select("site", "url"), ["site", "url"], "left_anti")
        if fanout is not None:
            found = found.withColumn("_rank", F.row_number().over(by_source)).where(F.col("_rank") <= fanout)
            found = found.select("site", "url").distinct()
        seen.append(found.withColumn("depth", F.lit(depth)))
        if seen.read().where(F.col("depth") == depth).isEmpty():
            break
    links.close()
    return seen.close()

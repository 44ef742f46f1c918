"""From documents to packed training sequences: quality, near copies, repeats, leaks, packing.

Each stage takes what the stage before it kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import table
from presswork.llm.decontaminate import contaminations
from presswork.llm.labelled import fold
from presswork.llm.packing import pack_documents
from presswork.llm.queries import query, tokenizer_path
from presswork.llm.rules import fit_quality, score_quality
from presswork.llm.simhash import near_duplicates
from presswork.llm.suffixes import remove_repeats
from presswork.session import stage, stage_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the model learns outside the fold that op7 holds out."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return score_quality(docs, model).where(F.col("score") >= 0.7).select(*COLUMNS)


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which tells rows apart that share a doc_id; rows without one come last.

    Rows that are equal in all columns have the same.
    """
    missing = F.col("doc_id").isNull()
    return docs.select(*COLUMNS, F.struct(
        missing.alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*COLUMNS).alias("digest")).alias("row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, once.

    Fingerprints of 3-word shingles that differ in 2 bits or fewer link rows. Rows
    that share a doc_id, or have none, are told apart by their other columns.
    """
    rows = with_row(docs)
    groups = near_duplicates(rows, key="row", shingle=3, tau=2)
    first = stage(groups.where(F.col("row") == F.col("component_id")).groupBy("row").count(), "pipeline-firsts")
    # nearly as many firsts as documents: the same sort-merge join at every size
    kept = rows.join(first.where("count = 1").hint("merge"), "row", "left_semi")
    repeated = first.where("count > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(repeated, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller doc_id has; a character that lost a byte goes."""
    kept = remove_repeats(docs, keep="text").withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; a row stays or goes by its own text, whatever its doc_id."""
    # written first, so that its size is known when the join is planned
    rows = with_row(docs)
    found = stage(contaminations(rows, table(spark, sf_dir, "benchmark"), key="row").select("row").distinct(), "pipeline-leaks")
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]
#: Trained models, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

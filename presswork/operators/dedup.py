"""First-wins deduplication, caps and exact ranks that tolerate hot keys.

One key may hold a third of all rows, so nothing here ranks an unbounded
group in one task: winners come from map-side combined aggregates, caps from
salted two-step ranks, and global rank cuts from bucket sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage

SALTS = 256
#: Hex digits that cut a bucket at a time, of how many, and most rows of a bucket that is sorted.
RANK_DIGITS, DIGEST_DIGITS = 3, 32
RANK_BUCKET_ROWS = 1 << 16


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (which must be unique within a key).

    ``min`` over a struct combines on the map side: a hot key sends one row per
    task, whatever its size.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest) if rest else F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg((F.min_by(row, F.struct(*order)) if rest else F.min(row)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def new_rows(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``history``.

    The join type is left to Catalyst: a small history is broadcast, a large one
    is sort-merged, and AQE splits a hot key on the left side.
    """
    return df.join(history.select(key), key, "left_anti")


def known_keys(history: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``rows`` that ``history`` holds.

    The history is the side that is read through: with few rows they are sent to it and
    it is never shuffled, however long it has grown.  What comes out is no larger than ``rows``.
    """
    return history.select(key).join(rows.select(key), key, "left_semi").distinct()


def cap_per_group(df: DataFrame, group: list[str], order: list[str], n: int, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, exactly.

    A first rank within (group, salt) keeps at most ``n`` rows per salt, so the
    second rank sees at most ``n * salts`` rows of any group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    by_salt = Window.partitionBy(*group, "_salt").orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(by_salt))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )


def cap_total(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows overall by (group, order), for groups that are already capped.

    Groups get their offsets in two levels: running counts inside ranges of groups, and
    the totals of the ranges before, one number per range.  No task sees all groups, and
    rows are ranked inside their group.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    ranged = stage(counts.repartitionByRange(*group).withColumn("_range", F.spark_partition_id()), "group-counts")
    totals = ranged.groupBy("_range").agg(F.sum("_rows").alias("rows")).agg(
        F.collect_list(F.struct(F.col("_range").alias("range"), "rows")).alias("totals")).scalar()
    before = F.aggregate(F.filter("_totals", lambda t: t["range"] < F.col("_range")), F.lit(0).cast("long"), lambda x, t: x + t["rows"])
    inside = Window.partitionBy("_range").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.withColumn("_totals", totals)
        .withColumn("_offset", before + F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .where(F.col("_offset") < n)
        .select(*[F.col(g).alias(f"_of_{g}") for g in group], "_offset")
    )
    within = Window.partitionBy(*group).orderBy(*order)
    return (
        df.join(offsets, _same(group))
        .withColumn("_rank", F.row_number().over(within) + F.col("_offset"))
        .where(F.col("_rank") <= n)
        .select(*df.columns)
    )


def _same(columns: list[str]) -> Column:
    """Rows of one group, NULL like any other, where the other side's columns are called ``_of_...``."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same


def rank_cutoffs(
    df: DataFrame, digest: Column, key: str, strata: list[str], ranks: dict[str, Column], bucket_rows: int = RANK_BUCKET_ROWS,
) -> DataFrame:
    """The (digest, key) pair found at given ranks of each stratum, as ``name`` columns.

    ``ranks`` are expressions over ``_size``, the stratum's rows.  Selection by digits: hex
    digests are uniform, so their first three cut even a dominant stratum into 4,096 even
    buckets, whose sizes tell which one holds a rank.  While such a bucket has more than
    ``bucket_rows`` rows, the next three digits cut it again; what is sorted in the end is
    within that bound at any size.  Equal (digest, key) pairs are counted, not sorted.
    Rows and buckets depend on the key alone, so a recomputed task gives the same answer.
    """
    slim = df.select(*strata, key, digest.alias("_digest"))
    of = [f"_of_{s}" for s in strata]
    stratum = [F.col(s).alias(o) for s, o in zip(strata, of)]
    sizes = slim.groupBy(*stratum, F.substring("_digest", 1, RANK_DIGITS).alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    # At most 4,096 rows per stratum and rank reach these windows.
    before = Window.partitionBy(*of).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("long").alias("_at")) for n, r in ranks.items()])
    targets = (
        sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_size", F.sum("_rows").over(Window.partitionBy(*of)))
        .select(*of, "_prefix", "_offset", "_rows", F.inline(wanted))
    )
    holds = (F.col("_at") > F.col("_offset")) & (F.col("_at") <= F.col("_offset") + F.col("_rows"))
    targets, digits = stage(targets.where(holds), "rank-buckets"), RANK_DIGITS
    while digits < DIGEST_DIGITS and (targets.agg(F.max("_rows")).first()[0] or 0) > bucket_rows:
        digits += RANK_DIGITS
        finer = F.substring("_digest", 1, digits).alias("_prefix")
        sizes = slim.join(targets.drop("_rows"), _in_bucket(slim, targets, strata, digits - RANK_DIGITS)).groupBy(
            *of, "_name", "_at", "_offset", finer).agg(F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy(*of, "_name").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_offset", F.col("_offset") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        targets = stage(sizes.where(holds), "rank-buckets")
    pairs = slim.join(targets.drop("_rows"), _in_bucket(slim, targets, strata, digits)).groupBy(
        *strata, "_name", "_at", "_offset", "_digest", key).agg(F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy(*strata, "_name").orderBy("_digest", key)
    found = pairs.withColumn("_rank", F.sum("_rows").over(within) + F.col("_offset")).where(
        (F.col("_rank") >= F.col("_at")) & (F.col("_rank") - F.col("_rows") < F.col("_at")))
    cut = F.struct(F.col("_digest").alias("digest"), F.col(key).alias("key"))
    return found.groupBy(*strata).agg(
        *[F.max(F.when(F.col("_name") == n, cut)).alias(n) for n in ranks]
    )


def _in_bucket(slim: DataFrame, targets: DataFrame, strata: list[str], digits: int) -> Column:
    return _same(strata) & (F.substring(slim["_digest"], 1, digits) == targets["_prefix"])

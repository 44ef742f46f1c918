"""SimHash near-duplicates: generalised pigeonhole with unequal thresholds.

Fingerprints that differ in at most ``tau`` bits are linked; connected fingerprints
form a group. Copies of a fingerprint are combined first, so a group of copies is
one row of all that follows.

1. Bits that agree more often than chance are put into the same of ``m`` partitions.
2. For thresholds t with ``sum(t) = tau - m + 1``, two linked fingerprints are within
   ``t_i`` bits in some partition i (a threshold of -1 leaves its partition out).
   Dynamic programming picks m and t with the least estimated work, which is rows
   shuffled and pairs to verify; the estimates come from all fingerprints.
3. Each fingerprint is filed under its value in partition i and the values within
   ``ceil(t_i / 2)`` bits of it, so two within ``t_i`` bits meet in one bucket.
4. A bucket is searched breadth first with exact distances. It gives one row per
   member that has a link, not its pairs.
5. A bucket of more than ``bucket_rows`` fingerprints is not searched in one task: its
   members are filed under all 64-bit values within ``ceil(tau / 2)`` bits, which for
   tau = 2 gives buckets of at most 65. This is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.components import connected_components
from presswork.session import stage

BITS = 64
SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Verifying a pair costs this part of shuffling a row.
PAIR_COST = 0.05
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 15


# ---- fingerprints ---------------------------------------------------------------
def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(spaces[:n - 1] + 1).tolist()]
    ends = [*spaces[shingle - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[low:low + CHUNK], ends[low:low + CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(F.col(text))


# ---- the plan of partitions and thresholds ----------------------------------------
def agreement(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set, over all of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.float64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            for low in range(0, len(bits), CHUNK):
                part = bits[low:low + CHUNK]
                both += part.T @ part
            n += len(bits)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "n"])

    rows = prints.select("fp").mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for row in rows:
        sums[row["at"]] = row["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows by the bit that correlates most with it."""
    share = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.outer(np.diag(cov), np.diag(cov)), 1e-12))
    strength = np.abs(cov / spread)
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for size in [BITS // m + (i < BITS % m) for i in range(m)]:
        order = sorted(left)
        group = [max(order, key=lambda b: (strength[b, order].sum(), -b))]
        while len(group) < size:
            group.append(max(sorted(left - set(group)), key=lambda b: (strength[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def within(disagree: np.ndarray, t: int) -> float:
    """Chance that independent bits with these chances of disagreeing differ in at most t places."""
    chances = np.zeros(t + 1)
    chances[0] = 1.0
    for p in disagree:
        chances[1:] = chances[1:] * (1 - p) + chances[:-1] * p
        chances[0] *= 1 - p
    return float(chances.sum())


def ball_size(bits: int, radius: int) -> int:
    size, term = 1, 1
    for r in range(1, radius + 1):
        term = term * (bits - r + 1) // r
        size += term
    return size


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up whose sum is ``total`` and whose summed cost is least; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for i, row in enumerate(costs):
        ahead: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for at, extra in enumerate(row):
                key = used + at - 1
                if key not in ahead or cost + extra < ahead[key][0]:
                    ahead[key] = (cost + extra, [*chosen, at - 1])
        best = ahead
    return best[total]


def plan(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition to file under."""
    share = np.diag(both) / max(n, 1)
    disagree = 2 * share * (1 - share)
    options = []
    for m in range(1, tau + 2):
        groups = group_bits(n, both, m)
        costs = [[0.0] + [
            n * ball_size(len(g), -(-t // 2)) + PAIR_COST * n * n / 2 * within(disagree[g], 2 * -(-t // 2))
            for t in range(tau + 1)] for g in groups]
        cost, chosen = allocate(costs, tau - m + 1)
        options.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options)[2]


# ---- filing and searching -----------------------------------------------------------
def _filed(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): every fingerprint under its keys."""
    tables = []
    for bits, t in parts:
        mask = sum(1 << (BITS - 1 - b) for b in bits)
        flips = [sum(1 << (BITS - 1 - b) for b in chosen) for r in range(-(-t // 2) + 1) for chosen in combinations(bits, r)]
        tables.append((np.uint64(mask), np.array(flips, np.uint64)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for part, (mask, flips) in enumerate(tables):
                step = max(1, (1 << 18) // len(flips))
                for low in range(0, len(fps), step):
                    own = fps[low:low + step]
                    values = ((own & mask)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(values), part, np.int32)), pa.array(values.view(np.int64)),
                        pa.array(np.repeat(own, len(flips)).view(np.int64))], ["part", "value", "fp"])

    return prints.select("fp").mapInArrow(file, "part int, value long, fp long")


def search(fps: np.ndarray, tau: int) -> list[tuple[np.ndarray, int]]:
    """Components of one bucket: (other members, smallest member), breadth first."""
    left, found = np.sort(fps), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        ahead, members = [root], []
        while ahead and len(left):
            near = np.bitwise_count((left ^ ahead.pop()).view(np.uint64)) <= tau
            if near.any():
                new = left[near]
                members.append(new)
                ahead.extend(new)
                left = left[~near]
        if members:
            found.append((np.concatenate(members), root))
    return found


def bucket_links(filed: DataFrame, tau: int, bucket_rows: int) -> DataFrame:
    """(u, v): members of a bucket and the smallest of their component there; v null: too large a bucket."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        key, held, large = None, np.empty(0, np.int64), False

        def settle(fps):
            return [(members, np.full(len(members), root)) for members, root in search(fps, tau)] if len(fps) > 1 else []

        for batch in batches:
            part, value, fps = (batch.column(i).to_numpy() for i in range(3))
            if not len(fps):
                continue
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            us, vs = [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                own = (int(part[low]), int(value[low]))
                if own != key:
                    for u, v in settle(held):
                        us.append(u)
                        vs.append(v)
                    key, held, large = own, np.empty(0, np.int64), False
                mine = fps[low:high]
                if not large and len(held) + len(mine) > bucket_rows:
                    large = True
                    yield rows(held, [None] * len(held))
                    held = np.empty(0, np.int64)
                if large:
                    yield rows(mine, [None] * len(mine))
                else:
                    held = np.concatenate([held, mine]) if len(held) else mine
            if us:
                yield rows(np.concatenate(us), np.concatenate(vs))
        for u, v in settle(held):
            yield rows(u, v)

    spark = filed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = filed.repartition(n, "part", "value").sortWithinPartitions("part", "value")
    return dealt.mapInArrow(link, "u long, v long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, tau: int = 2,
    bucket_rows: int = 1 << 15,
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    The fingerprint is 16 lowercase hex digits. component_id is the smallest key of
    all rows that links lead to, null only where no row of the group has a key. A
    null or empty text has fingerprint zero and is linked like any other. Repeated
    rows stay; an empty table gives an empty one.
    """
    printed = stage(docs.select(F.col(key).alias("key"), fingerprint_column(text, shingle).alias("fp")), "simhash-prints")
    prints = stage(printed.groupBy("fp").agg(F.min("key").alias("first")), "simhash-distinct")
    n, both = agreement(prints)
    links = stage(bucket_links(_filed(prints, plan(n, both, tau)), tau, bucket_rows), "simhash-links")
    edges = links.where(F.col("v").isNotNull())
    crowded = links.where(F.col("v").isNull()).select(F.col("u").alias("fp")).distinct()
    if not crowded.isEmpty():
        edges = edges.union(bucket_links(_filed(crowded, [(list(range(BITS)), tau)]), tau, 1 << 62))
    roots = connected_components(edges)
    grouped = prints.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    named = grouped.join(grouped.groupBy("root").agg(F.min("first").alias("lowest")), "root").select("fp", "lowest")
    groups = prints.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return printed.join(groups, "fp").select(F.col("key").alias(key), shown.alias("fingerprint"), "component_id")

"""Divergence of sources within a language over run-length columns.

1. Texts are counted into (language, source, term) where they are read; the terms in at
   least ``least_docs`` documents of a language are its vocabulary.
2. The vocabulary is reordered by the terms' counts in all sources and cut into blocks,
   so that equal counts stand together, and each source's column of a block is
   run-length encoded. A source that a block does not hold is one run of zeros.
3. Shares are integers of one part in ``UNIT``. Two sources differ by the sum of the
   differences of their shares: the bounds of their runs are intersected and each
   difference is multiplied by the length of the common run.

Columns meet block by block in tiles of ``TILE`` sources, so a task holds a bounded part of
two tiles however large the vocabulary or the number of sources is. A pair of
sources is one row, as is asked for; no pairs of documents or terms are made.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage

#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_TERMS = bytes((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256))
UNIT = 1_000_000_000
ADDED = 5
#: Entries counted in a task before they are passed on.
ENTRIES = 1 << 18
#: Different count vectors in a block, and sources in a tile.
BLOCK = 1 << 14
TILE = 64


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def entries():
        for (lang, source), (n, docs) in counts.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([t.decode() for t in n], pa.string()),
                pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names)
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
            n, docs = counts[lang, source]
            found = terms_of(text.as_py())
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in counts.values()) > ENTRIES:
            yield from entries()
    yield from entries()


def share(n: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * vocabulary)), exact below 9 * 10**15 terms."""
    whole = total + ADDED * vocabulary
    q, r = np.divmod(n + ADDED, whole)
    for _ in range(3):
        more, r = np.divmod(r * 1000, whole)
        q = q * 1000 + more
    return q + 1


def share_column(n: str, total: str, vocabulary: str) -> Column:
    return F.expr(f"1 + (cast({n} + {ADDED} as decimal(20, 0)) * cast({UNIT} as decimal(10, 0))) "
                  f"div cast({total} + {ADDED} * {vocabulary} as decimal(20, 0))")


# ---- run-length columns -----------------------------------------------------------------
def runs(rows: np.ndarray, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, value) of each run of a column with ``values`` at ``rows`` (ascending) and 0 elsewhere.

    ``ends`` are the rows' ends, counted in terms; the last run ends at the last of them.
    """
    n = len(ends)
    after = rows + 1
    gap = np.append(after[:-1] != rows[1:], after[-1] < n)
    starts = np.concatenate([rows, after[gap]])
    held = np.concatenate([values, np.zeros(gap.sum(), values.dtype)])
    if rows[0] > 0:
        starts, held = np.append(starts, 0), np.append(held, 0)
    order = np.argsort(starts)
    starts, held = starts[order], held[order]
    new = np.append(True, held[1:] != held[:-1])
    starts, held = starts[new], held[new]
    return np.append(ends[starts[1:] - 1], ends[-1]), held


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the absolute differences of two columns given as (ends, values) of their runs."""
    ends = np.union1d(a[0], b[0])
    lengths = np.diff(ends, prepend=0)
    return int((np.abs(a[1][np.searchsorted(a[0], ends)] - b[1][np.searchsorted(b[0], ends)]) * lengths).sum())


def _columns(block: int):
    """(lang, counts, terms) in order to the blocks' columns: (lang, block, size, g, ends, n); g null for the block itself."""
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("g", pa.int32()),
                        ("ends", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        held, lang = [], None

        def settle():
            nonlocal made
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ends = np.cumsum(np.array([m for _, m in held], np.int64))
            rows = np.repeat(np.arange(len(held)), [len(c) for c, _ in held])
            groups = np.array([e["g"] for c, _ in held for e in c], np.int32)
            values = np.array([e["n"] for c, _ in held for e in c], np.int64)
            order = np.argsort(groups, kind="stable")
            rows, groups, values = rows[order], groups[order], values[order]
            out = [(None, [], [])]
            for own in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(groups)) + 1):
                if len(own):
                    out.append((int(groups[own[0]]), *runs(rows[own], values[own], ends)))
            gs, es, ns = zip(*out)
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * len(gs), pa.string()), pa.array([number] * len(gs), pa.int64()), pa.array([int(ends[-1])] * len(gs), pa.int64()),
                pa.array(gs, pa.int32()), pa.array(es, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for own, counts, m in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (own != lang or len(held) == block):
                    yield settle()
                    held = []
                lang = own
                held.append((counts, m))
        if held:
            yield settle()

    return run


def _compare(group: pa.Table) -> pa.Table:
    """Sums of differences of all pairs of one block and pair of tiles."""
    rows = group.to_pylist()
    sides: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {0: {}, 1: {}}
    low, high = rows[0]["low"], rows[0]["high"]
    for row in rows:
        column = (np.array(row["ends"], np.int64), share(np.array(row["n"], np.int64), row["total"], row["vocabulary"]))
        for at, tile in enumerate((low, high)):
            if row["tile"] == tile:
                sides[at][row["g"]] = column
    us, vs, sums = [], [], []
    for u, one in sides[0].items():
        for v, other in sides[1].items():
            if u < v:
                us.append(u)
                vs.append(v)
                sums.append(difference(one, other))
    return pa.table({"lang": pa.array([rows[0]["lang"]] * len(us), pa.string()), "u": pa.array(us, pa.int32()),
                     "v": pa.array(vs, pa.int32()), "part": pa.array(sums, pa.int64())})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30,
                      top: int = 50, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources differ from the others, and by which terms.

    Part ``pair``: every other source of the language and the sum of the differences of
    the shares of all kept terms. Part ``term``: the ``top`` terms with a larger share than
    in the whole language, and by how much. Ranks start at 1, by falling value, then item.

    Null lang, source and text count as empty. A row is a document, repeated rows too;
    a source without terms takes part with counts of zero, and a language without
    kept terms has pairs of value 0. Other columns are ignored. An empty table gives an empty one.
    """
    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), blank).alias("lang"), F.coalesce(F.col(source).cast("string"), blank).alias("source"),
                       F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = stage(rows.select("lang", "source").distinct().withColumn("g", numbered), "divergence-sources")
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.struct("g", "n")
    terms = stage(counted.join(sources, ["lang", "source"]).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.sort_array(F.collect_list(entry)).alias("counts")).where(
        F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    single = terms.select("lang", "term", "all", F.explode_outer("counts").alias("c")).select("lang", "term", "all", "c.g", "c.n")
    languages = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("all").alias("language_total"))
    totals = single.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = stage(sources.join(languages, "lang", "left").join(totals, ["lang", "g"], "left").select(
        "lang", "source", "g", *[F.coalesce(c, zero).alias(c) for c in ("vocabulary", "language_total", "total")]), "divergence-groups")

    # equal count vectors are one row of the reordered vocabulary
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("m")).repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts")
    columns = stage(vectors.select("lang", "counts", "m").mapInArrow(
        _columns(block), "lang string, block long, size long, g int, ends array<long>, n array<long>"), "divergence-columns")
    present = columns.where(F.col("g").isNotNull()).drop("size")
    blocks = columns.where(F.col("g").isNull()).select("lang", "block", "size")
    whole = blocks.join(groups.select("lang", "g", "total", "vocabulary"), "lang").join(present, ["lang", "block", "g"], "left").select(
        "lang", "block", "g", "total", "vocabulary", F.floor(F.col("g") / tile).cast("int").alias("tile"),
        F.coalesce("ends", F.array("size")).alias("ends"), F.coalesce("n", F.array(zero)).alias("n"))
    tiles = groups.groupBy("lang").agg(F.floor(F.max("g") / tile).cast("int").alias("last"))
    dealt = whole.join(tiles, "lang").withColumn("other", F.explode_outer(F.sequence(F.lit(0), "last"))).select(
        "*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_compare, "lang string, u int, v int, part long").groupBy(
        "lang", "u", "v").agg(F.sum("part").alias("value"))
    ways = stage(sums, "divergence-sums")
    ways = ways.select("lang", F.col("u").alias("g"), F.col("v").alias("other"), "value").union(
        ways.select("lang", F.col("v").alias("g"), F.col("u").alias("other"), "value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other"))
    pairs = groups.select("lang", "source", "g").join(others, "lang").where(F.col("g") != F.col("other")).join(
        ways, ["lang", "g", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    shares = single.join(groups, ["lang", "g"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (share_column("n", "total", "vocabulary") - share_column("all", "language_total", "vocabulary")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = shares.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked)

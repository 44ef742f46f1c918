"""Sharding over a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` places on a ring of ``2**RING_BITS`` cells. A row's
cell is a digest of its id; the row belongs to the arc that ends at the next place
clockwise. A shard takes rows up to its load bound. What does not fit goes on
clockwise to the next place whose shard has room, as often as needed.

Only counts per arc (at most ``shards * virtual_nodes`` numbers) reach the driver,
where they flow round the ring; the answer is, per arc, which ranks go to which
shard. Rows meet it through their rank within the arc, so no row is moved but for
that ranking, and the window's groups are arcs, which the digest keeps even.

With ``slack=0`` the bounds add up to the number of rows, the remainder going to
the shards in order: counts are then at most one apart (law ``rows``). With a
positive slack no shard holds over ``ceil((1 + slack) * rows / shards)``.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 20
COARSE_BITS = 8
#: Cells of the ring that share one join key with the arcs.
COARSE = 1 << COARSE_BITS


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every place, in ring order; a cell that two places hit goes to the smaller shard."""
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("shards and virtual_nodes are positive")
    places: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}/{node}".encode()).digest()
            places.setdefault(int.from_bytes(digest[:8], "big") % (1 << RING_BITS), shard)
    return sorted(places.items())


def segments(places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(coarse, low, high, arc): the ring cut at the places and at multiples of COARSE.

    Arc ``a`` holds the cells after place ``a - 1`` up to place ``a``; cells after the
    last place belong to arc 0.
    """
    cut = []
    low = 0
    for arc, (cell, _) in [*enumerate(places), (0, ((1 << RING_BITS) - 1, 0))]:
        while low <= cell:
            high = min(cell, low | (COARSE - 1))
            cut.append((low >> COARSE_BITS, low, high, arc))
            low = high + 1
    return cut


def load_bounds(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def flow(counts: dict[int, int], places: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot): where the rows of every arc go.

    Rounds: each place offers what waits at it to its shard, in ring order; what the
    shard has no room for moves to the next place clockwise whose shard has room.
    Each round but the last fills a shard, so there are at most ``shards`` + 1.
    """
    room, filled = list(bounds), [0] * len(bounds)
    waiting = {arc: [(arc, 0, n)] for arc, n in sorted(counts.items()) if n}
    taken = []
    while waiting:
        for at in sorted(waiting):
            shard, rest = places[at][1], []
            for arc, low, high in waiting[at]:
                fits = min(room[shard], high - low)
                if fits:
                    taken.append((arc, low, low + fits, shard, filled[shard]))
                    room[shard] -= fits
                    filled[shard] += fits
                if low + fits < high:
                    rest.append((arc, low + fits, high))
            waiting[at] = rest
        following, ahead = {}, None
        for at in [*range(len(places)), *range(len(places))][::-1]:
            following[at] = ahead
            if room[places[at][1]]:
                ahead = at
        moved: dict[int, list] = {}
        for at in sorted(waiting):
            for part in waiting[at]:
                moved.setdefault(following[at], []).append(part)
        waiting = moved
    return taken


def ring_cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << RING_BITS))


def assign_shards(
    df: DataFrame, key: str = "doc_id", shards: int = 40, virtual_nodes: int = 128, slack: float = 0.0,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Rows with one key are ordered by ``ties``; rows that agree there as well are
    interchangeable. A null key is a key like any other. An empty table stays empty.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    places = ring(shards, virtual_nodes)
    arcs = F.broadcast(spark.createDataFrame(segments(places), "_coarse int, _low int, _high int, _arc int"))

    def on_ring(rows: DataFrame) -> DataFrame:
        cells = rows.withColumn("_cell", ring_cell(F.col(key)))
        near = F.shiftright(F.col("_cell"), COARSE_BITS).cast("int") == F.col("_coarse")
        return cells.join(arcs, near & F.col("_cell").between(F.col("_low"), F.col("_high")))

    counts = {r["_arc"]: r["count"] for r in on_ring(df.select(key)).groupBy("_arc").count().collect()}
    quotas = flow(counts, places, load_bounds(sum(counts.values()), shards, slack))
    # at most two rows per arc and shard, whatever the table holds
    owners = F.broadcast(spark.createDataFrame(
        quotas, "_owner_arc int, _from long, _to long, shard int, _slot long"))
    order = Window.partitionBy("_arc").orderBy(F.xxhash64(F.col(key)), F.col(key), *ties)
    ranked = on_ring(df.drop("shard", "slot")).withColumn("_rank", F.row_number().over(order) - F.lit(1).cast("long"))
    mine = (F.col("_arc") == F.col("_owner_arc")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(owners, mine).withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from"))
    return placed.drop("_cell", "_coarse", "_low", "_high", "_arc", "_rank", "_owner_arc", "_from", "_to", "_slot")

"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

DataFrame functions only. Keys hash to one of 2**16 cells of a ring; each shard owns virtual nodes at
cells, and a cell belongs to the next node clockwise. A shard takes at most its share of the rows
(counts differ by one at most); keys beyond that go on clockwise to the next node of a shard with
room. Only the number of keys per cell is needed to decide this, so the plan for the ring has a fixed
size whatever the number of rows; the keys are then placed by their rank within their cell.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

CELLS = 1 << 16
NODES = 512
#: A cell with more rows than this and than eight times the mean is ranked in parts.
CELL_ROWS = 200_000
_PARTS = 256


def ring_nodes(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, by cell; of two nodes at one cell the lower shard owns it."""
    at: dict[int, int] = {}
    for s in reversed(range(shards)):
        for v in range(nodes):
            at[int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:2], "big")] = s
    return sorted(at.items())


def cell_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(CELLS)).cast("int")


def capacities(total: int, shards: int) -> list[int]:
    """Rows each shard takes: as equal as whole rows allow."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, slot): keys of the cell with ranks from..to-1 get slots from ``slot`` on.

    Cells are served clockwise, first by their own shards up to capacity; what is left of a cell then
    goes on from node to node. Work and result depend on cells and nodes only.
    """
    ring = ring_nodes(shards, nodes)
    places = [c for c, _ in ring]
    room, used = capacities(sum(counts.values()), shards), [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int, int]] = []

    def take(cell: int, start: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            out.append((cell, start, start + got, shard, used[shard]))
            room[shard] -= got
            used[shard] += got
        return got

    for cell in sorted(counts):
        i = bisect.bisect_left(places, cell) % len(ring)
        got = take(cell, 0, counts[cell], ring[i][1])
        if got < counts[cell]:
            over.append((cell, got, counts[cell] - got, i))
    for cell, start, n, i in over:
        while n:
            i = (i + 1) % len(ring)
            got = take(cell, start, n, ring[i][1])
            start, n = start + got, n - got
    return out


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    A null text has size 8 and the crc32 of the empty text. Null ids hash like any other value. Equal
    texts spread over the ring by their ids; repeated rows are told apart by their place in the input,
    so that a row that makes up much of the table is still spread over parts of its cell.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("at"))
    rows = materialise(rows.withColumn("cell", cell_of("id", "crc")))
    spark: SparkSession = docs.sparkSession
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell at most
    most = max(CELL_ROWS, 8 * sum(counts.values()) // CELLS)
    full = [c for c, n in counts.items() if n > most]
    rows = rows.withColumn("part", F.when(F.col("cell").isin(full), F.pmod(F.xxhash64("at"), F.lit(_PARTS))).otherwise(F.lit(0)).cast("int") if full else F.lit(0))
    order = Window.partitionBy("cell", "part").orderBy("id", "crc", "size", "at")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    if full:  # the parts of a full cell follow one another
        sizes = rows.where(F.col("cell").isin(full)).groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()
        before: dict[int, int] = {}
        offsets = []
        for r in sorted(sizes):
            offsets.append((r["cell"], r["part"], before.get(r["cell"], 0)))
            before[r["cell"]] = before.get(r["cell"], 0) + r["n"]
        table = F.broadcast(spark.createDataFrame(offsets, "cell int, part int, before long"))
        ranked = ranked.join(table, ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    segments = F.broadcast(spark.createDataFrame(plan(counts, shards, nodes), "cell int, start long, stop long, shard int, slot long").withColumnRenamed("cell", "of"))
    inside = (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    placed = ranked.join(segments, inside)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("rank") - F.col("start")).cast("long").alias("slot"))

"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS equal cells; every shard owns several virtual nodes on it, and a cell belongs to
the first node at or after it. Keys enter clockwise. A key whose shard is full goes on clockwise to
the next node of a shard with room. Capacities add up to the number of rows, floor or ceiling of
the mean, so counts are at most one apart.

Only row counts reach the driver, one for each cell that has rows and PARTS for each of the at most HOT
cells that hold more than one row in HOT: CELLS + HOT * PARTS integers at most, at any size of the
input. The driver turns them into ranges: ranks lo..hi of a cell's part go to a shard from slot
slot0 on. Rows of a hot cell (one key may hold a third of all) so are ranked in PARTS tasks.

Defined cases: null text has size 1 and the checksum of no bytes; a very long text counts whole; rows
with a null key take their place from the text; repeated keys share a cell and are told apart by
checksum and size; rows that are equal in all three get neighbouring slots, or those of their part
of a hot cell, in either order; empty table, empty result; further input columns are ignored.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stored, work_dir

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: A cell with more than one row in HOT is ranked in PARTS parts.
HOT = 256
PARTS = 64
PLAN = "cell int, part int, lo bigint, hi bigint, shard int, slot0 bigint"


def ring_nodes(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order. A shard's nodes depend on its number
    alone, so a further shard adds nodes and moves none."""
    nodes: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - CELL_BITS), s)
    return sorted(nodes.items())


def plan_ranges(counts: dict[tuple[int, int], int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN for the row counts of the cells' parts."""
    nodes = ring_nodes(shards, vnodes)
    at = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    plan = []
    for cell, part in sorted(counts):
        lo, left, k = 0, counts[cell, part], bisect.bisect_left(at, cell)
        while left:
            s = nodes[k % len(nodes)][1]
            if take := min(left, room[s]):
                plan.append((cell, part, lo, lo + take, s, used[s]))
                used[s] += take
                room[s] -= take
                lo += take
                left -= take
            k += 1
    return plan


def shard_ring(
    docs: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per input row.

    Texts are read once; their 50-byte rows are stored, then shuffled once, by cell. The plan has at
    most CELLS + HOT * PARTS + shards * vnodes rows (about 4 MB), so it is broadcast at any size.
    """
    spark = docs.sparkSession
    src = keyed(docs, doc_id=id_col, text=text_col)
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = src.select(
        "doc_id",
        (F.octet_length(payload) + 1).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        # Only rows equal in all three need it; stored, it is the same for all that follows.
        F.pmod(F.spark_partition_id() + F.xxhash64("doc_id", "text"), F.lit(PARTS)).cast("int").alias("part"),
    ).withColumn(
        "point", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    )
    rows = rows.withColumn("cell", F.shiftrightunsigned("point", 64 - CELL_BITS).cast("int"))
    rows = stored(rows, f"{work_dir(spark)}/rows")
    counts = {(r["cell"], 0): r["count"] for r in rows.groupBy("cell").count().collect()}
    hot = [cell for (cell, _), n in counts.items() if n * HOT > sum(counts.values()) and n > PARTS]
    if hot:
        parts = rows.where(F.col("cell").isin(hot)).groupBy("cell", "part").count().collect()
        counts = {k: n for k, n in counts.items() if k[0] not in hot} | {(r["cell"], r["part"]): r["count"] for r in parts}
    rows = rows.withColumn("part", F.when(F.col("cell").isin(hot), F.col("part")).otherwise(0) if hot else F.lit(0))
    plan = spark.createDataFrame(plan_ranges(counts, shards, vnodes), PLAN)
    order = Window.partitionBy("cell", "part").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    r, p = ranked.alias("r"), F.broadcast(plan).alias("p")
    inside = (F.col("r.cell") == F.col("p.cell")) & (F.col("r.part") == F.col("p.part"))
    inside = inside & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.hi"))
    return r.join(p, inside).select(
        "r.doc_id", "r.size", "r.text_crc32", "p.shard", (F.col("p.slot0") + F.col("r.rank") - F.col("p.lo")).alias("slot")
    )

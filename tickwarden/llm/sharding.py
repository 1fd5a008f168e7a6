"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring of 2^32 positions. A row's key is hashed to a
position and belongs to the arc that ends at the next point clockwise. A shard takes no more
than its capacity; what it cannot hold walks on clockwise to the next other shard, all arcs
walking in step, nearer arcs first. With ``slack`` 0 the capacities are exact quotas, so that
row counts differ by one at most; with more slack fewer rows leave their first shard.

Only the counts of the arcs (shards x vnodes numbers, whatever the input) reach the driver,
which turns them into intervals of the arcs' rows. Rows are ranked within cells: arcs are
cut into as many cells as their rows ask for, so that no task ranks more than a cell.

Nulls: a null key is placed by its text, a null text has 0 bytes. Very long texts: only their lengths and hashes are used. Ties: rows with equal hashes stand in the order of id, text and size. Repeated rows are each
placed. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, whole_text

RING = 1 << 32
#: Arcs are looked up by the first bits of a position.
SLOT_BITS = 12
#: Rows of a cell, on average.
CELL_ROWS = 4096

Segment = tuple[int, int, int, int, int]


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ascending order of position."""
    points = {xxhash.xxh32_intdigest(f"shard-{s}/vnode-{v}"): s for v in range(vnodes) for s in reversed(range(shards))}
    return sorted(points.items())


def arc_rows(ends: list[int]) -> list[tuple[int, int, int, int]]:
    """(slot, first position, last position, arc): the arcs, cut at the slots' borders."""
    spans = [(a, (ends[a - 1] + 1) if a else 0, end) for a, end in enumerate(ends)] + [(0, ends[-1] + 1, RING - 1)]
    shift = 32 - SLOT_BITS
    return [(s, max(low, s << shift), min(high, ((s + 1) << shift) - 1), a) for a, low, high in spans if low <= high for s in range(low >> shift, (high >> shift) + 1)]


def quotas(total: int, shards: int, slack: float) -> list[int]:
    """Capacities: exact shares of the total, or for a slack the share with that allowance."""
    if slack > 0:
        return [math.ceil(total / shards * (1 + slack))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan_segments(points: list[tuple[int, int]], counts: list[int], shards: int, slack: float) -> list[Segment]:
    """(arc, first row, end row, shard, slot of the first row), given the number of rows of each arc."""
    room, filled = quotas(sum(counts), shards, slack), [0] * shards
    n = len(points)
    order = []
    for a in range(n):  # the distinct shards met clockwise from the arc's end
        seen: dict[int, None] = {}
        for step in range(n):
            seen.setdefault(points[(a + step) % n][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    at, out = [0] * n, []
    for turn in range(shards):
        for a in range(n):
            if turn < len(order[a]) and at[a] < counts[a]:
                s = order[a][turn]
                if take := min(counts[a] - at[a], room[s] - filled[s]):
                    out.append((a, at[a], at[a] + take, s, filled[s]))
                    at[a], filled[s] = at[a] + take, filled[s] + take
    return out


def consistent_hash_shards(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """doc_id (the key), size, text_crc32, first_shard (the shard of the arc), shard and slot of each row."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole_text()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        F.when(F.col(key).isNull(), F.xxhash64(whole_text())).otherwise(F.xxhash64(F.col(key))).alias("hash"),
    ).withColumn("position", F.shiftrightunsigned("hash", 32))
    arcs = spark.createDataFrame(arc_rows([p for p, _ in points]), "slot long, low long, high long, arc int")
    in_arc = (F.shiftright("position", 32 - SLOT_BITS) == F.col("slot")) & F.col("position").between(F.col("low"), F.col("high"))
    slim = checkpoint(slim.join(F.broadcast(arcs), in_arc).drop("position", "slot", "low", "high"))
    rows = {r["arc"]: r["n"] for r in slim.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = [rows.get(a, 0) for a in range(len(points))]
    segments = plan_segments(points, counts, shards, slack)
    cells = spark.createDataFrame(
        [(a, max(1, math.ceil(n / CELL_ROWS)), points[a][1], [x[1:] for x in segments if x[0] == a]) for a, n in enumerate(counts)],
        "arc int, cells long, first_shard int, segments array<struct<first:long,end:long,shard:int,slot:long>>",
    )
    placed = slim.join(F.broadcast(cells), "arc").withColumn("cell", F.pmod(F.xxhash64("hash", "text_crc32", "size"), F.col("cells")))  # rows of one key are spread by their texts
    in_cell = Window.partitionBy("arc", "cell").orderBy("hash", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("in_cell", F.row_number().over(in_cell) - 1)
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("arc", "cell").agg(F.count("*").alias("n")).select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    rank = F.col("in_cell") + F.col("head")
    hit = F.element_at(F.filter("segments", lambda s: (s["first"] <= rank) & (rank < s["end"])), 1)
    return (
        ranked.join(heads, ["arc", "cell"])
        .withColumn("hit", hit)
        .select("doc_id", "size", "text_crc32", "first_shard", F.col("hit.shard").alias("shard"), (F.col("hit.slot") + rank - F.col("hit.first")).alias("slot"))
    )

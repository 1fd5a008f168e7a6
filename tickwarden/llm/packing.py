"""Hierarchical residual packing: best fit by groups, then the underfull bins again.

Documents are cut into pieces of at most ``capacity`` tokens. Groups of bounded size pack their
pieces best-fit decreasing; bins that are nearly full are done. What is left over, each bin now an
item of its fill, meets in fewer groups of the same bounded size, round after round, until one
group holds all of it or a round merges next to nothing (then hardly any two bins fit together).

Nulls: a null text counts as empty and still has its end id; a null doc_id stays null. Repeated
rows are each packed. Very long texts are encoded whole, one batch of texts at a time, and cut. Ties: of items of one size the one of the smaller id is
packed first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, tidy
from .tokens import encoder

BATCH = 512
#: Items of a group, on average.
GROUP_ITEMS = 2500
#: A bin with this share of the capacity is done before the last round.
NEARLY_FULL = 0.998
#: A round that leaves more than this share of its bins ends the rounds.
STALLED = 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """A document's pieces: full ones, the first perhaps shorter."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], np.uint32)
        for batch in tidy(batches):
            for i in range(0, batch.num_rows, BATCH):
                doc, number, start, length, crc = [], [], [], [], []
                for d, ids in zip(batch.column(0).slice(i, BATCH).to_pylist(), enc.encode(batch.column(1).slice(i, BATCH).to_pylist()), strict=True):
                    data, at = np.concatenate([ids, end]).astype("<u4"), 0
                    for n, size in enumerate(cut_lengths(len(data), capacity)):
                        doc.append(d), number.append(n), start.append(at), length.append(size), crc.append(zlib.crc32(data[at : at + size]))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def best_fit(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Bins of equal room are interchangeable."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins, n = 0, np.empty(len(order), np.int64), 0  # open_rooms: bit r is set if a bin has room r
    for i in order.tolist():
        size = int(sizes[i])
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if left := room - size:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins


def _spread(seed: int, groups: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), groups)


def pack(items: DataFrame, size: str, id: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The bin of each item: columns id, bin (a number) and offset; id must be unique, sizes 1 to capacity."""
    spark = items.sparkSession
    ship(spark)
    bins = checkpoint(items.select(F.struct(F.col(id).alias("id"), F.col(size).cast("int").alias("size")).alias("m"), F.col(size).cast("int").alias("size")).select(F.array("m").alias("members"), "size", F.col("m.id").cast("string").alias("id")))
    done: list[DataFrame] = []
    n, turn = bins.count(), 0
    while n:
        turn += 1
        groups = max(1, round(n / group_items))
        last = groups == 1
        full = 0 if last else int(capacity * NEARLY_FULL)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "id"], ignore_index=True)
            number = best_fit(pdf["size"].to_numpy(), capacity)
            out = pdf.assign(b=number).groupby("b", sort=False).agg(members=("members", lambda x: [y for z in x for y in z]), size=("size", "sum"), id=("id", "first"))
            return out.assign(done=out["size"] >= full)[["members", "size", "id", "done"]]

        shape = bins.schema["members"].dataType.simpleString()
        packed = checkpoint(bins.withColumn("g", _spread(turn, groups)).groupBy("g").applyInPandas(one, f"members {shape}, size int, id string, done boolean"))
        done.append(packed.where("done").drop("done"))
        bins = packed.where("not done").drop("done")
        left = bins.count()
        if last or left > STALLED * n:
            done.append(bins)
            break
        n = left
    if not done:
        done = [bins]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    sizes = F.col("members.size")
    placed = F.transform("members", lambda m, i: F.struct(m["id"].alias("id"), F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x).alias("offset")))
    numbered = out.select(F.monotonically_increasing_id().alias("bin"), placed.alias("placed"))  # a row is a bin, read from checkpoints
    return numbered.select("bin", F.explode("placed").alias("m")).select("m.id", "bin", F.col("m.offset").cast("long").alias("offset"))


def best_fit_sequences(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, key: str = "doc_id", group_items: int = GROUP_ITEMS) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity, key)
    # what a row is packed by: a piece's own facts and a number that tells repeated rows apart
    item = checkpoint(pieces.select(F.struct(F.monotonically_increasing_id().alias("n"), "doc_id", "piece", "start", "length", "ids_crc32").alias("id"), "length"))
    out = pack(item, "length", "id", capacity, group_items)
    return out.select("id.doc_id", "id.piece", "id.start", "id.length", "id.ids_crc32", F.col("bin").alias("sequence_id"), "offset")

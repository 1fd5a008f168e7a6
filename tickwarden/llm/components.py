"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, small, stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One round: every node's neighbours (the larger ones, or the smaller ones and itself) are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    out = both.join(least, "a")
    if larger:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _few(edges: DataFrame) -> DataFrame:
    """The components of a graph whose size was checked, in one task."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def of(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((of(a), of(b)))
                root[b] = a
        found = [(x, r) for x in root if (r := of(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], batch_type), pa.array([r for _, r in found], batch_type)], ["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    batch_type = pa.binary() if kind == "binary" else pa.string()
    return edges.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}")


def components(edges: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots; the root is the least node of its component. Nodes are binary or strings.

    Up to ``few`` edges are joined in one task. Beyond that, large and small stars alternate until the edges stay as they are, in about the logarithm of the longest
    path's length; no node's neighbours are ever gathered in one place. Both ways give the same result.
    """
    edges = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if small(edges, few):
        out = stored(_few(edges), "classes")
        discard(edges)
        return out
    mark = lambda df: df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    seen = mark(edges)
    while seen["n"]:
        before, edges = edges, stored(_stars(_stars(edges, True), False), "edges")
        discard(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    out = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "classes")
    discard(edges)
    return out

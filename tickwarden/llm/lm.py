"""Cross-entropy difference of two matched n-gram models.

The tokens are the UTF-8 bytes of the text in lower case with single spaces, so that both models
share one vocabulary of 256 tokens whatever the language. Each model interpolates the orders 1 to
``order``: p_k = (count of the k-gram + strength * p_(k-1)) / (count of its context + strength).
The target model counts the documents marked as target, the background model all documents. A
document's score is its mean loss per token under the target model less that under the
background model: the lower, the closer to the target.

A loss depends on a byte and the order - 1 bytes before it only. So the n-grams are counted exactly,
by a partial aggregation in the tasks and a sum in Spark; joins over the orders give the table of the losses of all
n-grams of the highest order, and a document's loss is the sum of its n-grams' entries. The table grows with
the corpus. It is broadcast in parts of ``table_rows`` n-grams, whatever their number: the documents are read
once for each part, and the sums of the parts are added up.

A target document is scored by models that counted it, as all others are by the background model.

Nulls: a null text counts as empty; texts without tokens have 0 tokens and losses of 0; a null id
is no target. Without targets the target model is uniform. Ties: scores may be equal; no row depends on another's. Repeated rows count and score each; equal texts get equal
scores. Very long texts are worked on in parts of 2 MB, with the same result. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, ship, shuffle_partitions, stored, text_key, tidy

ORDER = 5
STRENGTH = 5.0
#: n-grams of a part of the table of losses: 24 bytes each in a Python worker.
TABLE_ROWS = 1 << 23
#: Distinct n-grams that a task adds up before it passes them on.
HELD = 1 << 22
#: Bytes looked at together.
CHUNK = 1 << 21
#: Copies of a row that are made at once.
COPIES = 10_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def chunks(texts: list[str | None], order: int = ORDER, size: int = CHUNK) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of whole texts, or of parts of long ones, and (text, start, end) of each; order - 1 bytes stand before each."""
    gap = b"\0" * (order - 1)
    buf, spans = bytearray(), []
    for i, t in enumerate(texts):
        data = normal(t)
        for at in range(0, len(data), size):
            part = data[at : at + size]
            buf += (gap + data[max(0, at - order + 1) : at])[-order + 1 :] if order > 1 else b""
            spans.append((i, len(buf), len(buf) + len(part)))
            buf += part
            if len(buf) >= size:
                yield np.frombuffer(bytes(buf), np.uint8), spans
                buf, spans = bytearray(), []
    if spans:
        yield np.frombuffer(bytes(buf), np.uint8), spans


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte as a number, its last byte lowest (the first order - 1 wrap around)."""
    key = np.zeros(len(data), np.int64)
    for k in range(order):
        key |= np.roll(data, k).astype(np.int64) << (8 * k)
    return key


def counted(data: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which bytes to count: those of texts, and the last zero before a text as its start."""
    edge = np.zeros(len(data) + 1, np.int8)
    for _, s, e in spans:
        edge[s - (s > 0 and data[s - 1] == 0)] += 1
        edge[e] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(counts[at], first) if len(first) else counts


def _all_orders(keys: np.ndarray, counts: np.ndarray, order: int) -> Iterator[pa.RecordBatch]:
    """Rows of k, g and n: the n-grams of the highest order and those of the lower ones that end them."""
    for k in range(order, 0, -1):
        if k < order:
            keys, counts = added_up([(keys & ((1 << 8 * k) - 1), counts)])
        for i in range(0, len(keys), 100_000):
            g, n = keys[i : i + 100_000], counts[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g), pa.array(n)], ["k", "g", "n"])


def _tally(docs: DataFrame, order: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for data, spans in chunks(b.column(0).to_pylist(), order):
                held.append(np.unique(grams(data, order)[counted(data, spans)], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [added_up(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from _all_orders(*held[0], order)
                        held, size = [], 0
        if held:
            yield from _all_orders(*added_up(held), order)

    return docs.select(F.col("text").cast("string").alias("t")).mapInArrow(lambda batches: tidy(count(batches)), "k int, g long, n long")


def count_ngrams(docs: DataFrame, targets: DataFrame, order: int = ORDER, key: str = "doc_id") -> DataFrame:
    """k, g (the n-gram's bytes as a number), target and background: exact counts of all n-grams of the orders 1 to ``order``."""
    ship(docs.sparkSession)
    marks = targets.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    marked = docs.select(F.col(key).cast("long").alias("k"), "text").join(hinted(marks), "k", "left_semi")
    none = F.lit(0).cast("long")
    everything = _tally(docs, order).select("k", "g", none.alias("target"), F.col("n").alias("background"))
    parts = everything.unionAll(_tally(marked, order).select("k", "g", F.col("n").alias("target"), none.alias("background")))
    return parts.groupBy("k", "g").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def ngram_losses(counts: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """g, loss_target, loss_background and n: -log p under both models of each n-gram of the highest order, and how often it occurs."""
    models = ("target", "background")
    of = lambda k: counts.where(F.col("k") == k)
    totals = of(1).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in models)).first()
    p = {m: (F.col(m) + strength / 256) / (F.lit(float(totals[m])) + strength) for m in models}
    low = of(1).select("g", "background", *(p[m].alias(f"p_{m}") for m in models))
    for k in range(2, order + 1):  # at most 256 n-grams share a context or an ending
        endings = low.select(F.col("g").alias("ending"), *(F.col(f"p_{m}").alias(f"low_{m}") for m in models))
        contexts = of(k - 1).select(F.col("g").alias("context"), *(F.col(m).alias(f"context_{m}") for m in models))
        df = of(k).withColumns({"ending": F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)), "context": F.shiftright("g", 8)})
        df = df.join(endings, "ending").join(contexts, "context", "left")
        p = {m: (F.col(m) + strength * F.col(f"low_{m}")) / (F.coalesce(f"context_{m}", F.lit(0)) + strength) for m in models}
        low = df.select("g", "background", *(p[m].alias(f"p_{m}") for m in models))
    return low.select("g", *((-F.log(F.greatest(f"p_{m}", F.lit(1e-12)))).cast("float").alias(f"loss_{m}") for m in models), F.col("background").alias("n"))


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def indexed(keys: np.ndarray, losses: np.ndarray, n: np.ndarray) -> Table:
    """Keys and losses by hash, frequent ones first, and where the keys of each hash begin."""
    bits = max(1, len(keys).bit_length())
    place = _places(keys, bits)
    at = np.lexsort((-n, place))
    return keys[at], losses[at], np.searchsorted(place[at], np.arange((1 << bits) + 1)).astype(np.int32)


def looked_up(keys: np.ndarray, table: Table) -> np.ndarray:
    """The losses of keys; 0 for those that the table lacks."""
    known, losses, begin = table
    out = np.zeros((len(keys), 2), np.float32)
    place = _places(keys, (len(begin) - 1).bit_length() - 1)
    at, end = begin[place], begin[place + 1]
    left = np.flatnonzero(at < end)
    while len(left):
        hit = known[at[left]] == keys[left]
        out[left[hit]] = losses[at[left[hit]]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def _sums(slim: DataFrame, table: Table, order: int) -> DataFrame:
    """key, code, n_tokens and the sums of the losses that a part of the table holds."""
    shared = slim.sparkSession.sparkContext.broadcast(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            n, sums = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2))
            for data, spans in chunks(b.column(2).to_pylist(), order):
                loss = looked_up(grams(data, order), table)
                for i, s, e in spans:
                    n[i] += e - s
                    sums[i] += loss[s:e].sum(axis=0, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["key", "code", "n_tokens", "target", "background"])

    return slim.mapInArrow(lambda batches: tidy(add(batches)), "key long, code binary, n_tokens long, target double, background double")


def score_documents(docs: DataFrame, targets: DataFrame, order: int = ORDER, strength: float = STRENGTH, key: str = "doc_id", table_rows: int = TABLE_ROWS) -> DataFrame:
    """The key, n_tokens, loss_target and loss_background (nats a token) and score of each document; ``order`` is 7 at most."""
    spark = docs.sparkSession
    counts = stored(count_ngrams(docs, targets, order, key), "ngrams")
    losses = stored(ngram_losses(counts, order, strength), "losses")
    discard(counts)
    parts = max(1, -(-losses.count() // table_rows))
    code = text_key() if parts > 1 else F.lit(None).cast("binary")
    slim = docs.select(F.col(key).cast("long").alias("key"), code.alias("code"), F.col("text").cast("string").alias("text"))
    sums = None
    for part in range(parts):
        rows = losses.where(F.pmod(F.xxhash64("g"), F.lit(parts)) == part).toArrow()  # about table_rows rows
        table = indexed(rows.column("g").to_numpy(), np.stack([rows.column(c).to_numpy() for c in ("loss_target", "loss_background")], 1), rows.column("n").to_numpy())
        del rows
        found = _sums(slim, table, order)
        sums = found if sums is None else sums.unionAll(found)
    discard(losses)
    if parts > 1:  # rows of one key and one text have the same sums
        sums = sums.groupBy("key", "code").agg((F.count("*") / parts).cast("long").alias("copies"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("target", "background")))
        sums = sums.withColumns({c: F.col(c) / F.col("copies") for c in ("target", "background")})
        many = sums.withColumn("i", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}")))).repartition(shuffle_partitions(spark))
        sums = many.withColumn("j", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.expr(f"copies - i * {COPIES}")))))
    mean = {c: F.col(c) / F.greatest("n_tokens", F.lit(1)) for c in ("target", "background")}
    return sums.select(F.col("key").alias(key), "n_tokens", mean["target"].alias("loss_target"), mean["background"].alias("loss_background"), (mean["target"] - mean["background"]).alias("score"))

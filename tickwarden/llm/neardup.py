"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of shingles of five words, a shingle's weight its count in the
document times its inverse document frequency over the corpus. Weighted MinHash samples
(Ioffe's improved consistent weighted sampling) agree with the probability of the weighted
Jaccard similarity; bands of samples put similar documents into common buckets, and candidate
pairs are verified by the exact weighted Jaccard similarity of their whole texts.

* Document frequencies are counted over all documents in 2^DF_BITS places by the shingle's hash; what other shingles put
  into a place on average is taken off again, so that a rare shingle stays rare whatever the size of the corpus. The
  inverse frequency is damped by IDF_POWER, so that a group of copies that makes up much of the corpus, whose common
  shingles are frequent and whose edits are rare, stays as similar as it is.
* Exact copies share one node, the 16-byte key of the text. Only nodes that share a bucket with another one are looked at further;
  their sets of hashed shingles are written once, and texts are not read again.
* In each bucket every node is compared to one centre, the node with most bucket neighbours:
  comparisons grow with the rows, not with the square of a group. Linked nodes are joined into classes.
* Buckets whose nodes are then in several classes are compared again, once: every node outside a bucket's largest class to all of its nodes of other
  classes. Both sides are cut for that: the bucket's nodes into parts, those outside into turns, and each part meets each turn. That is exact, a task's
  memory is bounded, and the number of rounds does not depend on the data. The work grows with a bucket's nodes times its nodes outside.

No link between two different texts of one bucket is lost; pairs that share no band are never met.

Nulls: a null text counts as empty; texts of fewer than five words are one shingle; texts without
words are alike if they are equal. Rows with null or repeated ids are documents like others. Equal texts are one class. Very long
texts are hashed in parts and need about 40 bytes for each of their words. Ties: the class id is the least key, of equal keys
one row stays. An empty table gives no rows. Other columns are ignored, or pass through ``one_of_each``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, hinted, ship, stored, text_key, tidy, whole_text
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Nodes outside a bucket's largest class, and their shingles, that ask one part in one turn, on average.
OUTSIDE, OUTSIDE_SHINGLES = 512, 1 << 21
#: Nodes and shingles of a bucket's part, on average.
PART_NODES, PART_SHINGLES = 2048, 1 << 20
#: Slots of weight are this much wider each; what rounding may move a weight by.
SLOT, ROUNDING = float(np.log(1.05)), 1e-6
DF_BITS = 18
IDF_POWER = 0.125
#: Bytes hashed together, and texts.
CHUNK, TEXTS = 1 << 19, 500
#: Rows of each of the four tables that a shingle's draws are added up from.
DRAW_BITS = 13

_U = np.uint64
_BASE, _INVERSE = 0x100000001B3 | 1, pow(0x100000001B3 | 1, -1, 1 << 64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_DF_AT = _U(20)
_DF_MASK = _U(((1 << DF_BITS) - 1) << 20)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _power_tables(n: int) -> list[np.ndarray]:
    return [np.concatenate([np.ones(1, _U), np.full(n, b, _U)]).cumprod(dtype=_U) for b in (_U(_BASE), _U(_INVERSE))]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of the bytes, the last of which is no word's."""
    n = CHUNK
    while n < len(data) + 1:  # few sizes, so that few tables are remembered
        n *= 2
    up, down = _power_tables(n)
    edge = np.flatnonzero(np.diff(_IS_WORD[data].astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each run of WORDS words, the last ones cut off."""
    run = np.zeros(len(words), _U)
    for k, c in enumerate(_PLACES):
        run[: len(words) - k] += words[k:] * c
    return mix(run)


def _of_text(words: np.ndarray, run: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS:
        return run[: len(words) - WORDS + 1]
    if len(words):  # all the words there are
        return mix((words * _PLACES[: len(words)]).sum(keepdims=True) + _U(len(words)))
    return np.empty(0, _U)


def _long_text(data: bytes) -> np.ndarray:
    """The words of a text longer than CHUNK, cut where no word is."""
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and _IS_WORD[data[end - 1]]:
            end += 1
        found.append(_words(np.frombuffer(data[at:end] + b"\n", np.uint8))[0])
        at = end
    return np.concatenate(found)


def shingle_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles, in order. Words are runs of letters, digits and characters past ASCII, in lower case."""
    i = 0
    while i < len(texts):
        part, size = [], 0
        while i < len(texts) and size < CHUNK:
            data = (texts[i] or "").lower().encode("utf-8", "replace")
            if len(data) > CHUNK and part:
                break
            part.append(data)
            size += len(data) + 1
            i += 1
        if size > CHUNK and len(part) == 1:
            words = _long_text(part[0])
            yield _of_text(words, _shingles(words))
            continue
        words, starts = _words(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        run = _shingles(words)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in part]))
        for a, b in zip(bounds, bounds[1:]):
            yield _of_text(words[a:b], run[a:b])


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h & _DF_MASK) >> _DF_AT).astype(np.int64)


def weighted(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their weights."""
    h, n = np.unique(h, return_counts=True)
    return h, n * idf[_slot(h)]


def elements(h: np.ndarray) -> np.ndarray:
    """The shingles as a set in ascending order: each repetition of one is an element of its own, of the same weight."""
    h, n = np.unique(h, return_counts=True)
    if len(h) and n.max() > 1:
        first = np.repeat(h, n - 1)
        again = np.arange(len(first)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
        h = np.concatenate([h, mix(first + again.astype(_U) * _PLACES[0]) & ~_DF_MASK | first & _DF_MASK])
    return np.sort(h.view(np.int64))


def weights_of(els: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[_slot(els.view(_U))]


@cache
def _tables() -> list[np.ndarray]:
    """Exponential (two for r, two for c) and uniform draws (two for beta) for each sample."""
    rng = np.random.default_rng(20)
    shape = (1 << DRAW_BITS, SAMPLES)
    exponential = [rng.standard_exponential(shape, np.float32) + np.float32(1e-7) for _ in range(4)]
    return [*exponential, rng.random(shape, np.float32), rng.random(shape, np.float32)]


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of the set, as 64-bit numbers.

    A shingle's r and c, Gamma(2, 1), are sums of two exponential draws, its beta the sum of two uniform ones modulo 1; four parts of
    the shingle's hash say which draws, so that two shingles have all their draws in common only where 52 bits agree.
    """
    r1, r2, c1, c2, b1, b2 = _tables()
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, _U)
    log_w = np.log(w).astype(np.float32)[:, None]
    here = np.arange(SAMPLES)
    for i in range(0, len(h), 1024):
        part = h[i : i + 1024]
        f1, f2, f3, f4 = (((part >> _U(64 - DRAW_BITS * k)) & _U((1 << DRAW_BITS) - 1)).astype(np.int64) for k in (1, 2, 3, 4))
        r = r1[f1] + r2[f2]
        beta = b1[f1] + b2[f3]
        beta -= beta >= 1
        t = np.floor(log_w[i : i + 1024] / r + beta)
        a = np.log(c1[f3] + c2[f4]) - r * (t - beta + 1)
        k = a.argmin(axis=0)
        low = a[k, here]
        new = mix(part[k] + t[k, here].astype(np.int64).astype(_U) * _PLACES[0])
        closer = low < best
        best, out = np.where(closer, low, best), np.where(closer, new, out)
    return out


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of elements."""
    shared = weights_of(np.intersect1d(a, b, assume_unique=True), idf).sum()
    every = weights_of(a, idf).sum() + weights_of(b, idf).sum() - shared
    return float(shared / every) if every > 0 else 0.0


def beyond(x: np.ndarray, c: np.ndarray, linked: bool, threshold: float, idf: np.ndarray) -> np.ndarray:
    """What x has in common, beyond its centre c, with any node that is like x but in another class: elements and slots of weight. No query uses it."""
    w = weights_of(x, idf)
    inside = np.isin(x, c, assume_unique=True)
    shared, total = w[inside].sum(), w.sum()
    h, over = x[~inside], w[~inside]
    missing = threshold * total - shared
    if missing > ROUNDING * total:  # the first that two nodes have in common is followed by all the others
        h = h[np.cumsum(over[::-1])[::-1] >= missing - ROUNDING * total]
    slot = lambda v: int(np.floor(np.log(v) / SLOT))
    slots = set()
    if missing <= 2 * ROUNDING * total:
        slots.add(slot(total))
        most = shared * (1 + threshold) / threshold - total
        if not linked and most > 0:
            slots.update(range(slot(threshold * total * (1 - ROUNDING)), slot(most * (1 + ROUNDING)) + 1))
    return np.concatenate([h, np.array(sorted(slots), np.int64)])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The damped inverse document frequency of each place."""
    places = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(places, np.int64), 0
        for b in _parts(tidy(batches)):
            n += b.num_rows
            for h in shingle_hashes(b.column(0).to_pylist()):
                np.add.at(sums, _slot(np.unique(h)), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(sums[at], n))], ["slot", "n"])

    got = docs.select(whole_text().alias("t")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2^DF_BITS rows
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(places)
    df[slot[slot >= 0]] = n[slot >= 0]
    total = int(n[slot < 0].sum())
    df = np.clip(df - (df.sum() - df) / (places - 1), 1, max(total, 1))
    idf = 1 + np.log((1 + total) / (1 + df))
    return ((idf / (1 + np.log(1 + max(total, 1)))) ** IDF_POWER).astype(np.float32)


def _nodes(docs: DataFrame, idf) -> DataFrame:
    """node (the text's key), n_els (its elements) and bands of each distinct text with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        salt = np.arange(BANDS, dtype=_U)
        for part in _parts(tidy(batches)):
            use, size, bands = [], [], []
            for n, h in enumerate(shingle_hashes(part.column(1).to_pylist())):
                if len(h):
                    of = samples(*weighted(h, weights)).reshape(BANDS, ROWS)
                    use.append(n)
                    size.append(len(h))
                    bands.append(mix(mix(mix(mix(of[:, 0]) + of[:, 1]) + of[:, 2]) + of[:, 3] + salt).view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(use, pa.int64())), pa.array(size, pa.int64()), lists], ["node", "n_els", "bands"])

    signed = docs.select(text_key().alias("node"), whole_text().alias("t")).mapInArrow(sign, "node binary, n_els long, bands array<long>")
    return stored(signed.groupBy("node").agg(F.first("n_els").alias("n_els"), F.first("bands").alias("bands")), "nodes")


def _sets(docs: DataFrame, order: DataFrame) -> DataFrame:
    """node and els, its elements, of the nodes that share a bucket."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(tidy(batches)):
            found = [elements(h) for h in shingle_hashes(part.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))], ["node", "els"])

    keyed = docs.select(text_key().alias("node"), whole_text().alias("t")).join(hinted(order.select("node")), "node", "left_semi")
    return stored(keyed.dropDuplicates(["node"]).mapInArrow(hashed, "node binary, els array<long>"), "sets")


class Part:
    """The rows of one part of a bucket as an inverted index of their elements."""

    def __init__(self, sets: list[np.ndarray], idf: np.ndarray) -> None:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        self.n, self.total = len(sets), np.bincount(owner, weights_of(flat, idf), len(sets))
        by = np.argsort(flat, kind="stable")
        self.owner = owner[by]
        self.els, self.first, self.count = np.unique(flat[by], return_index=True, return_counts=True)

    def similarities(self, x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of a set to each row."""
        w = weights_of(x, idf)
        at = np.minimum(np.searchsorted(self.els, x), len(self.els) - 1)
        hit = self.els[at] == x
        at, wh = at[hit], w[hit]
        n = self.count[at]
        rows = self.owner[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(rows, np.repeat(wh, n), self.n)
        return shared / np.maximum(self.total + w.sum() - shared, 1e-300)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one key each; the first column is the key, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e == s:
                continue
            if held and held[0].column(0)[0].as_py() != int(keys[s]):
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.concat_batches(held)


def _cells(groups: DataFrame) -> DataFrame:
    """The groups with a key instead of g: a row for each cell, where one part of a group's nodes meets one turn of those that ask."""
    n, m = (lambda asks: F.count_if(asks)), (lambda asks: F.sum(F.when(asks, F.col("n_els"))))
    sized = groups.groupBy("g").agg(n(~F.col("asks")).alias("n"), m(~F.col("asks")).alias("m"), n(F.col("asks")).alias("asking"), m(F.col("asks")).alias("asking_m"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART_NODES), F.ceil(F.col("m") / PART_SHINGLES)).cast("int")
    turns = F.greatest(F.lit(1), F.ceil(F.col("asking") / max(1, OUTSIDE)), F.ceil(F.col("asking_m") / OUTSIDE_SHINGLES)).cast("int")
    many = hinted(sized.select("g", parts.alias("parts"), turns.alias("turns")).where("parts > 1 or turns > 1"))
    cut = groups.join(many, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("turns", F.coalesce("turns", F.lit(1)))
    own = lambda of: F.array(F.pmod(F.xxhash64("node"), F.col(of)).cast("int"))
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    cut = cut.withColumn("part", F.explode(F.when(F.col("asks"), every("parts")).otherwise(own("parts"))))
    cut = cut.withColumn("turn", F.explode(F.when(F.col("asks"), own("turns")).otherwise(every("turns"))))
    return cut.select(F.xxhash64("g", "part", "turn").alias("key"), "asks", "node", F.xxhash64("c").alias("c"))


def _compared(groups: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of one group.

    ``groups`` has rows of g, node, c (its class) and asks: the nodes that ask are compared to all others of their group. For each that asks and
    each other class of a part one link is given, if there is any.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for rows in _together(tidy(batches)):
            asks, kind = rows.column(1).to_numpy(zero_copy_only=False), rows.column(3).to_numpy()
            ends = rows.column(4).offsets.to_numpy()
            flat = rows.column(4).values.to_numpy()
            sets_ = [flat[s:e] for s, e in zip(ends, ends[1:])]
            other = np.flatnonzero(~asks)
            a, b = [], []
            if len(other):
                part = Part([sets_[i] for i in other], weights)
                for i in np.flatnonzero(asks):
                    found = other[part.similarities(sets_[i], weights) >= threshold - 1e-6]
                    found = found[kind[found] != kind[i]]
                    found = found[np.unique(kind[found], return_index=True)[1]]
                    a += [i] * len(found)
                    b += found.tolist()
            node = rows.column(2)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    full = _cells(groups).join(sets, "node").select("key", "asks", "node", "c", "els")
    full = full.repartition("key").sortWithinPartitions("key")
    return stored(full.mapInArrow(check, "a binary, b binary"), "links")


def _stars(members: DataFrame, order: DataFrame) -> DataFrame:
    """Groups in which the node with most neighbours of each bucket asks all others of its buckets."""
    centres = members.join(order, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("g"))
    rows = members.join(centres, "bucket").select("g", "node").distinct()
    rows = rows.where("g <> node").unionByName(rows.select("g", F.col("g").alias("node")).distinct())
    return rows.join(order.select("node", "n_els"), "node").select("g", "node", F.col("node").alias("c"), "n_els", (F.col("g") == F.col("node")).alias("asks"))


def _in_class(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    return nodes.join(hinted(classes.withColumnRenamed("root", "c")), "node", "left").withColumn("c", F.coalesce("c", "node"))


def _mixed(members: DataFrame, classes: DataFrame, order: DataFrame) -> DataFrame:
    """All members (bucket, node, c, n_els) of buckets with nodes of several classes, with the bucket's largest class."""
    own = _in_class(members, classes).join(order.select("node", "n_els"), "node")
    sizes = own.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    return stored(own.join(mixed.select("bucket", F.col("most.c").alias("largest")), "bucket"), "mixed")


def _all_pairs(mixed: DataFrame) -> DataFrame:
    """Groups in which the nodes outside a bucket's largest class ask all nodes; they are among those that are asked."""
    rows = mixed.select(F.col("bucket").alias("g"), "node", "c", "n_els", (F.col("c") != F.col("largest")).alias("outside"))
    return rows.select("g", "node", "c", "n_els", F.explode(F.when(F.col("outside"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("asks"))


def near_duplicate_nodes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) for each text, by its key, that is in a class with another text, but the root's own."""
    spark = docs.sparkSession
    ship(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    nodes = _nodes(docs, idf)
    buckets = nodes.select("node", "n_els", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    first = stored(buckets.join(shared, "bucket"), "members")
    discard(nodes)
    order = stored(first.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"), F.first("n_els").alias("n_els")), "order")
    members = first.select("bucket", "node")
    sets = _sets(docs, order)
    links = _compared(_stars(members, order), sets, idf, threshold)
    classes = components(links)
    mixed = _mixed(members, classes, order)
    found = _compared(_all_pairs(mixed), sets, idf, threshold)
    discard(links, mixed, first, order, sets)
    if not found.isEmpty():
        before, classes = classes, components(found.unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(before)
    discard(found)
    return classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The key and class_id of each document: the least key of its class (null only if all its keys are)."""
    classes = near_duplicate_nodes(docs, threshold)
    keyed = stored(docs.select(F.col(key), text_key().alias("node")), "keyed")
    least = keyed.groupBy("node").agg(F.min(key).alias("least"))
    rooted = least.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    of_node = rooted.join(ids, "root").select("node", "class_id")
    return keyed.join(of_node, "node").select(key, "class_id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """One document of each class, that with the least key, with the columns it came with, whatever their names."""
    classes = near_duplicate_nodes(docs, threshold)
    keyed = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id")).alias("id"), text_key().alias("node"))
    least = keyed.groupBy("node").agg(F.min("id").alias("id"))
    rooted = least.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("one")).select(F.col("one.node").alias("__dup_node"), F.col("one.id.id").alias("__dup_id"))
    kept = aside(docs, "__dup")
    marked = kept.withColumn("__dup_node", text_key()).withColumn("__dup_id", F.col(key))
    both = marked.join(stay, (marked["__dup_node"] == stay["__dup_node"]) & marked["__dup_id"].eqNullSafe(stay["__dup_id"]), "left_semi")
    return both.dropDuplicates(["__dup_node", "__dup_id"]).select(*kept.columns).toDF(*docs.columns)

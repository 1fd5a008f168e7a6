"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by size, their number of distinct shingles of five words. An item's sketch
holds, for each of the partition's hash functions, the shingle of least hash. A document that holds a share c of an item's
shingles holds each of these with probability c, however long the document is; the
partition says how many hash functions there are at least, and ``needed`` how many of their shingles must be found, such that an
item of containment ``threshold``, whatever it is, is missed with a chance below 1e-6. The smallest items
are sketched by all their shingles. Candidates are then verified on the shingles themselves: the
exact share of the item's distinct shingles that the document holds.

Words are runs of letters and digits in lower case. Nulls: a null text counts as empty, an item or
document of fewer than five words has no shingles and matches nothing, an item with a null id is
no item; rows that share an item id are one item. Equal texts match alike, so repeated rows are
reported each. Ties: all items that reach the threshold are reported. Texts of any length are read whole: a very long one costs its distinct sketched shingles. Empty tables give no rows. Other columns are ignored, or pass through
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, checkpoint, hinted, text_key, whole_text

WORDS = 5
THRESHOLD = 0.8
#: (least size, hash functions at least); with 0 hash functions all shingles are the sketch.
PARTITIONS = ((1, 0), (10, 10), (24, 16), (64, 32))
MISS = 1e-6


def sketch_sizes(threshold: float) -> list[tuple[int, int, int]]:
    """(least size, hash functions, shingles to find): as many to find as keep the chance of a miss below MISS, and functions enough for one."""

    def below(n: int, m: int) -> float:
        """The chance that fewer than n of m are found."""
        return sum(math.comb(m, i) * threshold**i * (1 - threshold) ** (m - i) for i in range(n))

    out = []
    for least, m in PARTITIONS:
        while m and below(1, m) > MISS and m < least:
            m += 1
        if m == 0 or below(1, m) > MISS:
            out.append((least, 0, 1))  # all shingles: nothing is missed
        else:
            out.append((least, m, max(n for n in range(1, m + 1) if below(n, m) <= MISS)))
    return out


def shingle_words(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns of ``keep`` and w0 to w4 of each place where five words follow each other."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    df = df.select(*keep, words.alias("__leak_w")).where(F.size("__leak_w") >= WORDS)
    shifted = [F.col("__leak_w").alias("w0"), *(F.slice("__leak_w", i + 1, F.size("__leak_w")).alias(f"w{i}") for i in range(1, WORDS))]
    return df.select(*keep, F.inline(F.arrays_zip(*shifted))).where(f"w{WORDS - 1} is not null")


def _w() -> list[Column]:
    return [F.col(f"w{i}") for i in range(WORDS)]


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(item, shingle, size) of all distinct shingles, and (h, item, function, needed) of the sketches."""
    shingles = shingle_words(items.where(F.col("item").isNotNull()), whole_text(), "item").select("item", F.concat_ws(" ", *_w()).alias("shingle"), F.xxhash64(*_w()).alias("h")).distinct()
    sizes = shingles.groupBy("item").agg(F.count("*").alias("size"))
    shingles = checkpoint(shingles.join(sizes, "item"))
    functions, needed = F.lit(0), F.lit(1)
    for least, m, need in sketch_sizes(threshold):
        functions, needed = F.when(F.col("size") >= least, m).otherwise(functions), F.when(F.col("size") >= least, need).otherwise(needed)
    sized = shingles.withColumn("functions", functions).withColumn("needed", needed)
    whole = sized.where("functions = 0").select("h", "item", F.col("h").alias("function"), "needed")
    drawn = sized.where("functions > 0").withColumn("function", F.explode(F.sequence(F.lit(1).cast("long"), F.col("functions").cast("long"))))
    least_of = drawn.groupBy("item", "function").agg(F.min_by("h", F.struct(F.xxhash64("function", "h"), "h")).alias("h"), F.first("needed").alias("needed"))
    return shingles.select("item", "shingle", "size"), checkpoint(whole.unionByName(least_of.select("h", "item", "function", "needed")))


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_key: str = "item_id") -> DataFrame:
    """__leak_key (a document's text key), item, size and containment of each item that a text holds."""
    items = items.select(F.col(item_key).alias("item"), F.col("text").cast("string").alias("text"))
    shingles, sketches = item_sketches(items, threshold)
    keyed = docs.select(text_key().alias("__leak_key"), whole_text().alias("text"))
    places = shingle_words(keyed, F.col("text"), "__leak_key").select("__leak_key", F.xxhash64(*_w()).alias("h"))
    hits = places.join(hinted(sketches), "h").groupBy("__leak_key", "item", "function").agg(F.first("needed").alias("needed"))
    candidates = checkpoint(hits.groupBy("__leak_key", "item").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n >= needed").select("__leak_key", "item"))
    texts = keyed.join(hinted(candidates.select("__leak_key").distinct()), "__leak_key", "left_semi").dropDuplicates(["__leak_key"])
    held = shingle_words(texts, F.col("text"), "__leak_key").select("__leak_key", F.concat_ws(" ", *_w()).alias("shingle")).distinct()
    wanted = candidates.join(hinted(shingles), "item")
    found = wanted.join(held, ["__leak_key", "shingle"]).groupBy("__leak_key", "item").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return checkpoint(found.select("__leak_key", "item", "size", (F.col("n") / F.col("size")).alias("containment")).where(F.col("containment") >= threshold))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """The key, item_id, item_shingles and containment for each document and item that it holds."""
    found = hinted(find_contained(docs, items, threshold, item_key))
    keyed = docs.select(F.col(key), text_key().alias("__leak_key"))
    return keyed.join(found, "__leak_key").select(key, F.col("item").alias("item_id"), F.col("size").alias("item_shingles"), "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_key: str = "item_id") -> DataFrame:
    """The documents that hold no item, with the columns they came with, whatever their names."""
    found = hinted(find_contained(docs, items, threshold, item_key).select("__leak_key").distinct())
    kept = aside(docs, "__leak")
    return kept.withColumn("__leak_key", text_key()).join(found, "__leak_key", "left_anti").select(*kept.columns).toDF(*docs.columns)

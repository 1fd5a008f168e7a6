"""How the sources of each language differ in their terms, in exact integers.

Terms are runs of Latin and other letters (everything but ASCII that is no letter), of which only A to Z
are lower-cased. A CountVectorizer with ``min_df`` and the largest vocabulary that an integer allows makes sparse vectors of the
documents. Terms carry their language, so that one fit gives each language a vocabulary of its own:
a document has one language, and the documents that a term is counted in are those of that language.
The vectors' entries are summed by (language, source) as integers, not by a summarizer's weighted means, which are inexact.

With c occurrences of a kept term in a group, N the group's sum over kept terms and V their number, the share is
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two shares differ by floor((p - q)^2 / (p + q)). A pair of sources adds that over all V
terms. Only terms that both sources have are met one by one: what a term adds that only one has, or
none, depends on the counts alone and comes from the number of terms by count.

The vocabulary is in the driver and with every executor while the vectors are made, as CountVectorizer works so: about a
hundred bytes for each term that ``min_df`` documents of a language hold. It does not depend on the number of documents but by that.

Nulls: null texts, languages and sources are empty strings. Empty texts have no terms; their groups are in the result all the same.
Very long texts are read whole. Ties are ordered by the item's UTF-8 bytes. Repeated rows each count as a
document. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, ship, stored, tidy

MIN_DF = 10
TOP = 10
SCALE = 1_000_000_000
MOST_TERMS = 2**31 - 1
#: Counts below this fit a long when they are scaled.
LONG_COUNT = 9_000_000_000
#: Entries of vectors that a task holds before it sums them, and sums of one batch that it gives.
MOST_ENTRIES, ENTRIES_OF_A_BATCH = 4_000_000, 100_000
#: Parts a term from its language; terms hold no such character.
MARK = "\x00"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())
_TABLE = bytes.maketrans(_LETTERS[0] + _OTHERS, _LETTERS[1] + b" " * len(_OTHERS))


def _word(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _lists(column: list[list[bytes]]) -> pa.Array:
    ends = [0]
    for x in column:
        ends.append(ends[-1] + len(x))
    flat = pa.array(chain.from_iterable(column), pa.binary(), size=ends[-1]) if ends[-1] else pa.array([], pa.binary())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.view(pa.string()))


def document_terms(docs: DataFrame) -> DataFrame:
    """lang, source, ``terms`` (each term of a document once, with its language) and ``more`` (its further occurrences)."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once, more = [], []
            for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                mark = MARK.encode() + lang
                counts = Counter(text.translate(_TABLE).split())
                terms = [w + mark for w in counts]
                once.append(terms)
                more.append([w for w, n in zip(terms, counts.values(), strict=True) if n > 1 for _ in range(n - 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(once), _lists(more)], ["lang", "source", "terms", "more"])

    return docs.select(_word("lang"), _word("source"), _word("text")).mapInArrow(lambda batches: tidy(work(batches)), "lang string, source string, terms array<string>, more array<string>")


def fitted(lists: DataFrame, min_df: int = MIN_DF) -> CountVectorizerModel:
    """The vocabularies of all languages. Rows that hold nothing but a mark keep the vocabulary from being empty."""
    marks = lists.sparkSession.range(min_df).select(F.array(F.lit(MARK)).alias("terms"))
    return CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(min_df), vocabSize=MOST_TERMS).fit(lists.select("terms").unionByName(marks))


def vocabulary(model: CountVectorizerModel, spark) -> DataFrame:
    """idx, lang and term, from the model's files: the terms don't pass through the driver's Python."""
    model.write().save(path := fresh_path(spark, "vocabulary"))
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("idx", "word")).where(F.col("word") != MARK)
    return words.select("idx", F.substring_index("word", MARK, 1).alias("term"), F.expr("substr(word, locate(char(0), word) + 1)").alias("lang"))


def document_vectors(lists: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """lang, source and the sparse vector ``counts`` of each document."""
    return model.setInputCol("all_terms").transform(lists.select("lang", "source", F.concat("terms", "more").alias("all_terms"))).select("lang", "source", "counts")


def _partial_sums(vectors: DataFrame) -> DataFrame:
    """source, idx and n: the vectors' entries, summed within each task by source as integers."""

    def reduced(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(np.concatenate(values)[order], first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, values = {}, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            k, v = reduced(keys, values)
            names = pa.array(list(number), pa.string())
            for i in range(0, len(k), ENTRIES_OF_A_BATCH):
                part = k[i : i + ENTRIES_OF_A_BATCH]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part >> 32)), pa.array((part & 0xFFFFFFFF).astype(np.int32)), pa.array(v[i : i + ENTRIES_OF_A_BATCH])], ["source", "idx", "n"])

        for batch in batches:
            indices, counts = batch.column(1), batch.column(2)
            flat = indices.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                of = np.array([number.setdefault(x, len(number)) for x in batch.column(0).to_pylist()], np.int64)
                lens = np.diff(indices.offsets.to_numpy())
                keys.append((np.repeat(of, lens) << 32) | flat.astype(np.int64))
                values.append(counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, keys)) > MOST_ENTRIES:
                k, v = reduced(keys, values)
                keys, values = [k], [v]
                if len(k) > MOST_ENTRIES // 2:  # little of it came twice
                    yield from rows()
                    number, keys, values = {}, [], []
        if keys:
            yield from rows()

    slim = vectors.select("source", F.unwrap_udt("counts")["indices"].alias("indices"), F.unwrap_udt("counts")["values"].alias("values"))
    return slim.mapInArrow(lambda batches: tidy(work(batches)), "source string, idx int, n bigint")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), in decimals where a long doesn't hold the product."""
    whole = total + 2 * terms
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.when(n < LONG_COUNT, F.call_function("div", F.lit(SCALE).cast("bigint") * (n + 2), whole)).otherwise(wide) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` has each other source of the language, part ``term`` the ``top`` terms that a source has more of than its language."""
    spark = docs.sparkSession
    lists = stored(document_terms(docs), "terms")
    model = fitted(lists, min_df)
    # a term's number tells its language
    sums = _partial_sums(document_vectors(lists, model)).groupBy("source", "idx").agg(F.sum("n").alias("n"))
    sums, words = stored(sums, "sums"), stored(vocabulary(model, spark), "words")
    named = sums.join(words, "idx")
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = named.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = lists.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    none = F.lit(0).cast("long")
    groups = stored(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(none, F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))), "groups")
    cells = stored(named.join(groups, ["lang", "source"]).select("lang", "source", "idx", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0"), "cells")
    discard(lists, sums)
    out = _pairs(cells, groups).unionByName(_terms(cells, sizes, top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda df, x: df.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "lang"))
    both = side(groups, "a").join(side(groups.select("lang", "source", "p0"), "b"), "lang").where("source_a <> source_b")
    # what a source's own terms change, if the other had none of them
    by_count = side(cells.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "a")
    flat = _apart(F.col("p0_a"), F.col("p0_b"))
    alone = by_count.join(both.select("lang", "source_a", "source_b", "p0_a", "p0_b"), ["lang", "source_a"]).groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("terms_a") * (_apart(F.col("p_a"), F.col("p0_b")) - flat)).alias("alone"))
    # what changes again for the terms that both have
    one = cells.select("lang", "idx", "source", "p", "p0")
    met = side(one, "a").join(side(one, "b").drop("lang"), F.col("idx_a") == F.col("idx_b")).where("source_a < source_b")
    change = _apart(F.col("p_a"), F.col("p_b")) - _apart(F.col("p_a"), F.col("p0_b")) - _apart(F.col("p0_a"), F.col("p_b")) + flat
    shared = met.groupBy("lang", "source_a", "source_b").agg(F.sum(change).alias("shared"))
    turned = lambda df, c: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), c)
    shared = shared.unionByName(turned(shared, "shared"))
    keys = ["lang", "source_a", "source_b"]
    parts = both.join(alone, keys, "left").join(turned(alone.withColumnRenamed("alone", "other"), "other"), keys, "left").join(shared, keys, "left")
    none = F.lit(0).cast("long")
    value = F.when(F.col("terms_a") > 0, F.col("terms_a") * flat + F.coalesce("alone", none) + F.coalesce("other", none) + F.coalesce("shared", none)).otherwise(none)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return parts.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(ranked))


def _terms(cells: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    of_lang = cells.groupBy("lang", "idx").agg(F.sum("n").alias("n"))
    whole = of_lang.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    shares = of_lang.join(whole, "lang").select("idx", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    more = cells.join(shares, "idx").where("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

"""The queries of this package, as the driver knows them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .chat import digest as chat_digest
from .chat import formatted_conversations
from .common import table
from .decontaminate import contaminated
from .divergence import divergence
from .idfiles import read_id_files, write_id_files
from .lm import score_documents
from .neardup import near_duplicates
from .packing import best_fit_sequences
from .pii import replace_private_data
from .quality import REJECT_BELOW, fit, held_out, with_scores
from .runs import digest as runs_digest
from .runs import periodic_runs
from .secrets import digest, find_secrets
from .sharding import consistent_hash_shards
from .tokens import vocabulary_path
from .topk import exact_top_k

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts, hash of the known forms and all spans."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and the number of mentions in each."""
    return replace_private_data(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_mentions")


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents against those labelled good and not toxic."""
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return score_documents(table(spark, sf_dir, "documents"), target)


def op5_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of the ring whose row counts differ by one at most."""
    out = consistent_hash_shards(table(spark, sf_dir, "documents"), shards=8, slack=0.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "first_shard")


def op7_nnpu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net, _ = fit(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= REJECT_BELOW).cast("int")
    return with_scores(docs, net).select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op8_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to packed files and read back."""
    return read_id_files(write_id_files(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=2))


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return best_fit_sequences(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents; a tenth of the documents, by the hash of the id, is made to repeat itself first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.crc32(F.col("doc_id").cast("string"))
    repeats = (number % 10 == 0) & F.col("text").isNotNull()
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.withColumn("g", F.floor(number / 10)).withColumn("words", F.when(repeats, words))
    n = F.size("words")
    at = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return runs_digest(periodic_runs(at.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, over all documents."""
    return divergence(table(spark, sf_dir, "documents"), min_df=10, top=10)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(formatted_conversations(rows.unionByName(odd)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_minhash_neardup,
    op2_entropy_secrets,
    op3_pii_surrogates,
    op4_cross_entropy_difference,
    op5_cover_tree_top_k,
    op6_bounded_ring_shards,
    op7_nnpu_quality,
    op8_bit_packed_ids,
    op9_residual_packing,
    op10_minhash_containment,
    op11_periodic_runs,
    op12_source_divergence,
    op13_chat_format,
    pipeline,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)

"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary
needs. Ids are packed in blocks of ``BLOCK`` ids that start at a byte, so that numpy unpacks a
block at once and any id is found without reading what lies before it.

    magic, bits (u16), reserved (u16), ids of a block (u32)
    blocks
    footer: doc_id (i64), null flag (u8) and first id (u64) of each document; offset (u64) of each block
    number of ids, documents and blocks and offset of the footer (u64 each), magic

Nulls: a null text counts as empty and still has its end id; a null doc_id is flagged and sorts
first. Very long texts are encoded whole, in one task. Ties: rows with equal ids stand in the order of their texts' checksums, then of the texts. Repeated rows are stored one after another. An empty table gives no files. Other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path, ship, shuffle_partitions, tidy, whole_text
from .tokens import encoder

MAGIC = b"TWIDS001"
BLOCK = 1 << 16
_HEAD, _TAIL = struct.Struct("<8sHHI"), struct.Struct("<QQQQ8s")
#: Documents encoded together.
BATCH = 512

MANIFEST = "file int, path string, documents long, ids long, bytes long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell the ids of a vocabulary apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Appends documents to one file; holds one block and 17 bytes a document."""

    def __init__(self, sink, bits: int) -> None:
        self.sink, self.bits, self.held, self.n_held, self.n = sink, bits, [], 0, 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.at = sink.write(_HEAD.pack(MAGIC, bits, 0, BLOCK)) or _HEAD.size

    def add(self, docs: np.ndarray, nulls: np.ndarray, ids: list[np.ndarray]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.docs.append(docs), self.nulls.append(nulls), self.firsts.append(self.n + np.cumsum(lens) - lens)
        self.held += ids
        self.n, self.n_held = self.n + int(lens.sum()), self.n_held + int(lens.sum())
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.sink.write(data := pack(ids, self.bits)) or len(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs, nulls, firsts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.docs, self.nulls, self.firsts))
        for x in (docs.astype("<i8"), nulls.astype("u1"), firsts.astype("<u8"), np.array(self.offsets, "<u8")):
            self.sink.write(x.tobytes())
        self.sink.write(_TAIL.pack(self.n, len(docs), len(self.offsets), self.at, MAGIC))
        self.n_docs = len(docs)
        self.size = self.at + 17 * len(docs) + 8 * len(self.offsets) + _TAIL.size


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(source.size() - _TAIL.size)
        self.n, n_docs, n_blocks, footer, magic = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(0)
        head, self.bits, _, self.block_ids = _HEAD.unpack(source.read(_HEAD.size))
        if (head, magic) != (MAGIC, MAGIC):
            raise ValueError("not a file of packed ids")
        source.seek(footer)
        self.docs = np.frombuffer(source.read(8 * n_docs), "<i8")
        self.nulls = np.frombuffer(source.read(n_docs), "u1").astype(bool)
        self.firsts = np.append(np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64), self.n)
        self.offsets = np.append(np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64), footer)
        self.last = (-1, np.empty(0, np.uint32))

    def block(self, b: int) -> np.ndarray:
        if self.last[0] != b:
            self.source.seek(int(self.offsets[b]))
            n = min(self.block_ids, self.n - b * self.block_ids)
            self.last = (b, unpack(self.source.read(int(self.offsets[b + 1] - self.offsets[b])), self.bits, n))
        return self.last[1]

    def spans(self, d: int) -> Iterator[np.ndarray]:
        """The ids of document number d, a block at a time."""
        at, end = int(self.firsts[d]), int(self.firsts[d + 1])
        while at < end:
            b, i = divmod(at, self.block_ids)
            got = self.block(b)[i : i + end - at]
            yield got
            at += len(got)

    def ids(self, d: int) -> np.ndarray:
        return np.concatenate([*self.spans(d), np.empty(0, np.uint32)]).astype(np.uint32)


def write_id_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, files: int | None = None, key: str = "doc_id") -> DataFrame:
    """Encode all texts, append ``end_id`` to each and write them in ascending order of ``key``.

    Returns the manifest: file (ascending with the documents), path, documents, ids and bytes. A
    task writes its file under a name of its own attempt, so that a repeated task never touches a
    file that the manifest names.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, files = path or fresh_path(spark, "ids"), files or shuffle_partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        bits = bits_for(max(enc.whole.get_vocab_size(), end_id + 1))
        where, part = None, TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            if where is None:
                store, root = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])
                store.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                where = f"{root}/{name}"
                out = Writer(store.open_output_stream(where), bits)
            doc = batch.column(0)
            docs_, nulls = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
            for i in range(0, batch.num_rows, BATCH):
                ids = enc.encode(batch.column(1).slice(i, BATCH).to_pylist())
                out.add(docs_[i : i + BATCH], nulls[i : i + BATCH], [np.concatenate([x, end]) for x in ids])
        if where is not None:
            out.close()
            out.sink.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "documents": [out.n_docs], "ids": [out.n], "bytes": [out.size]})

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col("text").cast("string").alias("t")).repartitionByRange(files, F.col("k").asc_nulls_first(), F.crc32(whole_text("t")))
    ordered = ordered.sortWithinPartitions(F.col("k").asc_nulls_first(), F.crc32(whole_text("t")), "t")
    return checkpoint(ordered.mapInArrow(write, MANIFEST))


def read_id_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each stored document: the key, start (ids of all documents before it), n_tokens and ids_crc32."""
    ship(manifest.sparkSession)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(where if "://" in where or not where.startswith("file:") else "file://" + where[5:])
                with store.open_input_file(name) as source:
                    got = Reader(source)
                    for i in range(0, len(got.docs), 10_000):
                        n = range(i, min(i + 10_000, len(got.docs)))
                        crc = []
                        for d in n:
                            c = 0
                            for span in got.spans(d):
                                c = zlib.crc32(span.astype("<u4"), c)
                            crc.append(c)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(got.docs[i : n.stop], pa.int64(), mask=got.nulls[i : n.stop]),
                                pa.array(base + got.firsts[i : n.stop], pa.int64()),
                                pa.array(np.diff(got.firsts[i : n.stop + 1]), pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            [key, "start", "n_tokens", "ids_crc32"],
                        )

    spread = files.select("path", "base").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")

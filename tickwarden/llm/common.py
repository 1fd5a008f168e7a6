"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows of fixed width; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000

#: Rows of an Arrow batch; Spark's own number is 10,000.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()
#: Stored frames by identity, and where their files are.
_files: dict[int, tuple[DataFrame, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark runs in one process a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tickwarden-"))
    return spark.conf.get("spark.checkpoint.dir", None) or os.path.dirname(sc.getCheckpointDir())


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage is cut, and the size is that of the files. ``discard`` removes the files."""
    df.write.parquet(path := fresh_path(df.sparkSession, name))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _files[id(out)] = (out, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing needs any more; other frames are left alone."""
    for df in frames:
        _, path = _files.pop(id(df), (None, None))
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, and batches of fewer rows where the session has Spark's own number: rows here hold whole texts."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="tickwarden-")) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def tidy(batches: Iterator) -> Iterator:
    """The batches; when they end, what Arrow and the C library keep of freed memory goes back, as Python workers live on after a task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(whole_text(column)))


def aside(docs: DataFrame, prefix: str) -> DataFrame:
    """The documents with new names for columns that begin as names used inside do; the order stays, so that ``toDF`` gives the old names back."""
    taken, names = {c.lower() for c in docs.columns}, []
    for c in docs.columns:
        new = c
        while new.lower().startswith(prefix) or (new != c and new.lower() in taken):
            new = f"x{new}"
        taken.add(new.lower())
        names.append(new)
    return docs.toDF(*names)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has so few rows that it may be broadcast; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its size was checked to be small, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

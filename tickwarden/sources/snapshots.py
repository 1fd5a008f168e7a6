"""Tables that change together: versioned Parquet snapshots, committed by one rename.

A store is a folder. Its state is the manifest with the highest number: a small JSON file that lists, for each
table, the Parquet folders that hold its rows, and for each stream the last micro-batch that went in. A
transaction writes its frames to folders of their own, which nobody reads yet; ``commit`` puts all of them
into force at once, as it renames the finished manifest to the next number. If that number
is taken, another writer was first: ``Conflict`` is raised and nothing has changed. Whatever happens before the rename,
a lost executor or driver included, leaves the tables as they were; a micro-batch that comes again
after the rename finds its number in the manifest and does nothing.

Appending adds a folder. Keyed tables lie in buckets by the key's hash: an upsert reads and writes only the buckets that its rows
fall in, and joins them on the key. Readers of a version are not disturbed by later ones; ``vacuum`` removes what no kept version lists.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another transaction was committed first."""


@dataclass(frozen=True)
class Table:
    schema: str
    parts: dict[str, list[str]]  # folders by bucket; "" where rows lie in none
    key: str | None = None
    buckets: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        tables = {n: {"schema": x.schema, "parts": x.parts, "key": x.key, "buckets": x.buckets} for n, x in self.tables.items()}
        return json.dumps({"version": self.version, "tables": tables, "batches": self.batches}, sort_keys=True)

    @staticmethod
    def of(text: str) -> Manifest:
        x = json.loads(text)
        return Manifest(x["version"], {n: Table(**v) for n, v in x["tables"].items()}, x["batches"])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark runs in one process a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="tickwarden-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Versioned tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        where = self._path("")
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *(p for p in parts if p))))

    def versions(self) -> list[int]:
        """The numbers of all manifests that are still there."""
        folder = self._path("versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest()
        stream = self._fs.open(self._path("versions", f"{known[-1] if version is None else version:012d}"))
        try:
            return Manifest.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version).tables[name])

    def _read(self, table: Table, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        folders = [f"{self.root}/{p}" for b, parts in sorted(table.parts.items()) if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def publish(self, manifest: Manifest) -> None:
        """Put a manifest into force under its number; raises Conflict if that is taken."""
        draft, final = self._path("versions", f"draft-{uuid.uuid4().hex}"), self._path("versions", f"{manifest.version:012d}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(manifest.text().encode()))
        finally:
            out.close()
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, final, rename)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {manifest.version} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove the manifests before the last ``keep`` and all folders that no kept one lists; returns how many folders went. No transaction may be open."""
        known = self.versions()
        kept = {p.split("/")[1] for v in known[-keep:] for t in self.manifest(v).tables.values() for parts in t.parts.values() for p in parts}
        for v in known[:-keep]:
            self._fs.delete(self._path("versions", f"{v:012d}"), False)
        folder, gone = self._path("data"), 0
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


class Transaction:
    """Changes of several tables that come into force together, or not at all."""

    def __init__(self, store: Store, base: Manifest) -> None:
        self.store, self.base = store, base
        self.tables = dict(base.tables)
        self._scratch: list[str] = []

    def table(self, name: str) -> DataFrame:
        """A table with what this transaction did to it so far."""
        return self.store._read(self.tables[name])

    def has(self, name: str) -> bool:
        return name in self.tables

    def _write(self, df: DataFrame, name: str, *by: str) -> str:
        path = f"data/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.store.root}/{path}") if by else df.write.parquet(f"{self.store.root}/{path}")
        return path

    def staged(self, df: DataFrame) -> DataFrame:
        """The frame written down and read again, for what several changes are made of; it goes with the commit."""
        self._scratch.append(path := self._write(df, "staged"))
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{path}")

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; a table that isn't there is made. Rows get the table's columns: missing ones are null, unknown ones an error."""
        old = self.tables.get(name, Table(df.schema.json(), {}))
        if old.key is not None:
            raise ValueError(f"{name} has a key: upsert or insert_missing")
        path = self._write(_fitted(df, old), name)
        self.tables[name] = Table(old.schema, {**old.parts, "": [*old.parts.get("", []), path]})

    def replace(self, name: str, df: DataFrame, key: str | None = None, buckets: int = BUCKETS) -> None:
        """The frame instead of the table, with the frame's columns. With a key the table is laid out for upserts."""
        if key is None:
            self.tables[name] = Table(df.schema.json(), {"": [self._write(df, name)]})
        else:
            self.tables[name] = Table(df.schema.json(), {}, key, buckets)
            self._put(name, self.staged(df.withColumn(_BUCKET, _bucket_of(key, buckets))), lambda old, new: new)

    def upsert(self, name: str, df: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """Rows replace those with their key; other keys are new. One row for each key is the caller's duty."""
        self._keyed(name, df, key, buckets, lambda old, new: old.join(new.select(F.col(key).alias("__new")), F.col(key).eqNullSafe(F.col("__new")), "left_anti").unionByName(new))

    def insert_missing(self, name: str, df: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """Rows whose key is not there yet, one of each; rows that are there stay as they are."""
        self._keyed(name, df.dropDuplicates([key]), key, buckets, lambda old, new: old.unionByName(new.join(old.select(F.col(key).alias("__old")), F.col(key).eqNullSafe(F.col("__old")), "left_anti")))

    def _keyed(self, name: str, df: DataFrame, key: str, buckets: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        old = self.tables.setdefault(name, Table(df.schema.json(), {}, key, buckets))
        if old.key != key:
            raise ValueError(f"the key of {name} is {old.key}")
        self._put(name, self.staged(_fitted(df, old).withColumn(_BUCKET, _bucket_of(key, old.buckets))), merged)

    def _put(self, name: str, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        table = self.tables[name]
        touched = [str(r[0]) for r in new.select(_BUCKET).distinct().collect()]  # at most as many as there are buckets
        if touched:
            rows = merged(self.store._read(table, touched), new.drop(_BUCKET)).withColumn(_BUCKET, _bucket_of(table.key, table.buckets))
            path = self._write(rows.repartition(_BUCKET, F.pmod(F.xxhash64(F.lit(1), table.key), F.lit(8))), name, _BUCKET)
            self.tables[name] = Table(table.schema, {**table.parts, **{b: [f"{path}/{_BUCKET}={b}"] for b in touched}}, table.key, table.buckets)

    def compact(self, name: str) -> None:
        """One folder instead of many for a table that was appended to often."""
        self.replace(name, self.table(name))

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """Put all changes into force; returns the version. ``batch`` is the stream and number of the micro-batch that they come from."""
        batches = {**self.base.batches, **({batch[0]: batch[1]} if batch else {})}
        new = Manifest(self.base.version + 1, self.tables, batches)
        if new.tables == self.base.tables and new.batches == self.base.batches:
            return self.base.version
        self.store.publish(new)
        for path in self._scratch:
            with contextlib.suppress(Py4JJavaError):  # vacuum finds it later
                self.store._fs.delete(self.store._path(path), True)
        return new.version


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _fitted(df: DataFrame, table: Table) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(table.schema))
    if unknown := set(df.columns) - set(schema.names):
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def batch_sink(root: str, stream: str, apply: Callable[[Transaction, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes: each micro-batch is one transaction, and one that was committed already does nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root)
        transaction = store.begin()
        if transaction.base.batches.get(stream, -1) < number:
            apply(transaction, batch)
            transaction.commit((stream, number))

    return write

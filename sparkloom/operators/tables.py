"""A table of documents' rows in buckets of keys: a write touches only the buckets of the keys it replaces, and all or nothing of it is seen.

Each write puts the buckets that it changes into a folder of its own and then names, in a new manifest, the folder of every bucket; the
manifest gets its name when it is complete, so a write that fails or is cut off leaves the state before it.  A manifest keeps
the number of the last batch, so a batch that is run again does nothing.  It has one entry for each of a fixed number of buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hierarchy as H

#: Keys that are broadcast to the rows they belong to.
BROADCAST_KEYS = 500_000


class Buckets:
    """Rows by key, any number for each; the schema is fixed, and ``key`` is one of its columns."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version, batch (last that was written) and files: the folder of each bucket that has rows."""
        fs, at = self._files(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        versions = [int(n) for n in names if n.isdigit()]
        if not versions:
            return {"version": -1, "batch": -1, "files": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{max(versions):012d}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, part, name = self._files(), self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:012d}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(part, name):
            raise RuntimeError(f"another writer made version {manifest['version']}")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, files: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some; other buckets' files are not opened."""
        paths = [f"{folder}/bucket={b}" for b, folder in files.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["files"])

    def _few(self, keys: DataFrame) -> DataFrame:
        """Keys, written; to be broadcast where they are few, else both sides of their joins are dealt by key."""
        keys = H.written(keys, f"{self.folder}/work")
        return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys

    def replace(self, keys: DataFrame, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Takes all rows of the keys away and puts new rows in their place; returns the buckets that were written.

        ``rows`` may only have keys that are among ``keys``.  A null key is a key.  Rows that stay are copied bucket by bucket where they
        lie; only new ones are dealt to buckets."""
        now = self.manifest()
        if batch is not None and batch <= now["batch"]:
            return []
        gone = self._few(keys.select(F.col(self.key).alias("_key")).distinct())
        touched = sorted(r.b for r in gone.select(self.bucket(F.col("_key")).alias("b")).distinct().collect())  # `buckets` numbers at most
        folder, files = f"{self.folder}/data/{now['version'] + 1:012d}-{uuid.uuid4().hex}", dict(now["files"])
        if touched:
            numbered = lambda df: df.select(*self.schema.names).withColumn("bucket", self.bucket(F.col(self.key)))
            if any(str(b) in files for b in touched):
                kept = self._rows(files, touched).join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
                numbered(kept).write.mode("append").partitionBy("bucket").parquet(folder)
            numbered(rows).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)
            fs, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
            for b in touched:
                files.pop(str(b), None)
                if fs.exists(path(f"{folder}/bucket={b}")):
                    files[str(b)] = folder
        self._commit({"version": now["version"] + 1, "batch": now["batch"] if batch is None else batch, "files": files})
        return touched

    def upsert(self, changes: DataFrame, order: str, deleted: Column, digest: str | None = None, batch: int | None = None) -> list[int]:
        """Applies puts and deletes: of each key the last by ``order`` counts (null first, then a hash of the row); a put whose digest is
        the stored one changes nothing.  What wins is found from keys, orders and hashes; other columns move once, those of winners."""
        if batch is not None and batch <= self.manifest()["batch"]:
            return []
        told = changes.withColumns({"_deleted": F.coalesce(deleted, F.lit(False)), "_hash": F.xxhash64(*changes.columns)})
        marks = told.groupBy(self.key, F.col(order).alias("_order"), "_hash", "_deleted", *([F.col(digest).alias("_digest")] if digest else [])).agg(F.count("*").alias("_n"))
        mine = F.struct(*[c for c in marks.columns if c != self.key])
        last = marks.groupBy(self.key).agg(F.max_by(mine, F.struct("_order", "_hash")).alias("r")).select(F.col(self.key).alias("_key"), "r.*")
        if digest:
            old = self.read().select(F.col(self.key).alias("_k"), F.col(digest).alias("_old"))
            same = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_digest").eqNullSafe(F.col("_old"))
            last = last.where("_deleted").unionByName(last.where("NOT _deleted").join(old, same, "left_anti"))
        last = self._few(last.select("_key", "_order", F.col("_hash").alias("_h"), F.col("_deleted").alias("_gone"), "_n"))
        won = F.col(self.key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order")) & (F.col("_hash") == F.col("_h")) & ~F.col("_gone")
        rows = told.join(last, won, "left_semi")
        if not last.where("_n > 1 AND NOT _gone").isEmpty():  # rows that are repeated whole
            rows = rows.dropDuplicates([self.key])
        return self.replace(last.select(F.col("_key").alias(self.key)), rows, batch)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what neither the last manifest nor the ``keep`` before it name; readers of older versions must be done."""
        fs, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(self._path("work"), True)
        found = sorted((s.getPath().getName() for s in fs.listStatus(self._path("manifests"))), reverse=True) if fs.exists(self._path("manifests")) else []
        names = [n for n in found if n.isdigit()]
        needed = set()
        for n in names[: keep + 1]:
            needed |= {f.rsplit("/", 1)[-1] for f in json.loads(self.spark.read.text(f"{self.folder}/manifests/{n}", wholetext=True).first()[0])["files"].values()}
        for n in names[keep + 1 :]:
            fs.delete(self._path(f"manifests/{n}"), False)
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if s.getPath().getName() not in needed:
                fs.delete(path(str(s.getPath())), True)

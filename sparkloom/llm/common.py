"""Shared helpers: word splitting as native columns, shared folder, plan cuts, worker shipping."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the task, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (functions shipped by value have no lasting globals)."""
    import pyspark

    return pyspark.__dict__.setdefault("_sparkloom_worker_cache", {})


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text (null: none), split at every ASCII character that is no letter or digit."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def let(value: Column, body) -> Column:
    """Bind a value once for use inside higher-order functions: body is a function of the bound column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh_texts(texts):
    """An Arrow column of texts (null: empty) as a new array without offset: some kernels misread slices of large strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(texts, "").take(pa.array(range(len(texts)), pa.int64())).cast(pa.large_string())


def text_steps(batches, text="text", size: int = 4_000_000):
    """The rows of Arrow batches in batches of about ``size`` bytes of text: small ones are joined, large ones cut."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, held_size = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            begun = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begun + size - held_size, "right")))
            held.append(batch.slice(at, to - at))
            held_size += int(ends[to - 1]) - begun
            at = to
            if held_size >= size or at < batch.num_rows:
                yield joined()
                held, held_size = [], 0
    if held:
        yield joined()


#: Rows of an Arrow batch: a few megabytes of usual documents, and far from the 2 GiB that a column of text may hold.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session hands Python small Arrow batches from here on, unless it was told to another size than Spark's own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def relax() -> None:
    """At the end of a task's Python part: gives memory back that this worker, which may idle for long, has freed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    # row groups that many writing tasks can hold at once
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a columnar batch of the Parquet reader: texts of a few kilobytes stay in arrays of about a megabyte.
READER_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; the session reads Parquet in small batches from here on, unless it was told to another size than Spark's own."""
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned(x: Column) -> Column:
    """A uniform double in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(x, 11).cast("double") * F.lit(2.0**-53)


class Store:
    """Byte files under a URI, for tasks: any file system that Arrow opens; remote files are copied once per worker to be mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.uri = uri
        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def write(self, name: str, data: bytes) -> None:
        """Atomic: a second attempt at the same task replaces the same bytes."""
        path, part = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(part, compression=None) as out:
            out.write(data)
        self.fs.move(part, path)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            return f.read()

    def path(self, name: str) -> str:
        """A local path of the file."""
        if self.local:
            return f"{self.root}/{name}"
        cache = worker_cache().setdefault("copies", {})
        if (key := f"{self.uri}/{name}") not in cache:
            with tempfile.NamedTemporaryFile(delete=False) as to:
                to.write(self.read(name))
            cache[key] = to.name
        return cache[key]

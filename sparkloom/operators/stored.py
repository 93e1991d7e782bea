"""Derived tables that are kept: written once for a state of their source, sorted by the key that readers prune by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hierarchy import shared_folder

#: Bytes of a row group of an index: small, so that a look-up reads little.
ROW_GROUP = 1 << 20


def source_state(table: DataFrame) -> str:
    """A digest of the files that a table is read from (names, sizes, times); no column of it is read."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{found['n']}-{int(found['h']) & (2**64 - 1):x}"


def keep(source: DataFrame, label: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """The table that ``make`` derives from a source, read from where it is kept; made and written only if it is not there yet.

    A folder gets its name when all of it is written, so one that a lost run left unfinished is never read."""
    spark: SparkSession = source.sparkSession
    folder = f"{shared_folder(spark)}/kept-{label}-{source_state(source)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        part = f"{folder}.{uuid.uuid4().hex}"
        (write or (lambda df, to: df.write.parquet(to)))(make(), part)
        if not files.exists(path(folder)):
            files.rename(path(part), path(folder))
    return spark.read.parquet(folder)


def write_index(df: DataFrame, path: str, keys: list[str], distinct: int = 100_000, group: int = ROW_GROUP, dealt: bool = True) -> None:
    """Parquet in ranges of the keys, sorted, in small row groups with a bloom filter on the first key; not dealt: each task's rows stay its own.

    Min and max of a row group answer prefix and point reads, the bloom filter point reads of keys that are not there; a key with
    many rows lies in several files, as the other keys part it."""
    ordered = (df.repartitionByRange(*keys) if dealt else df).sortWithinPartitions(*keys)
    options = {"parquet.block.size": group, f"parquet.bloom.filter.enabled#{keys[0]}": "true", f"parquet.bloom.filter.expected.ndv#{keys[0]}": distinct, "parquet.page.row.count.limit": 2_000}
    ordered.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the file scans of a frame hand on when it runs: what is left after files, row groups and pages are skipped."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        found += metric.get().value() if metric.isDefined() else 0
    return found

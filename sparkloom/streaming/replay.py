"""Tables replayed as streams: slices are put into a folder one after the other, and a query that keeps its place reads each as a batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.hierarchy import shared_folder


def replay(rows: DataFrame, slices: list, column: str, start: Callable[[DataFrame, str], object], label: str) -> None:
    """For each value of ``column`` in turn: writes its rows to a folder that a file stream reads, and runs ``start`` until all is read.

    ``start(stream, checkpoint)`` returns a started query with an available-now trigger; it is started anew for each slice from
    the same checkpoint, as a job that runs when files have come."""
    spark: SparkSession = rows.sparkSession
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = rows.drop(column).schema
    for one in slices:
        rows.where(rows[column] == one).drop(column).write.mode("append").parquet(f"{folder}/files")
        query = start(spark.readStream.schema(schema).parquet(f"{folder}/files"), f"{folder}/checkpoint")
        query.awaitTermination()


def to_files(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends what a stream gives to files; a batch that is run again is there once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

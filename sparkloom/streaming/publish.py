"""Diagnostics as a sink: with every micro-batch the full list of each document that it touches replaces the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_document(diagnostics: DataFrame, documents: DataFrame, uri: str = "uri") -> DataFrame:
    """(uri, diagnostics): a list for every document asked for, empty where there is nothing to tell."""
    others = [c for c in diagnostics.columns if c != uri]
    listed = diagnostics.join(documents.select(uri).distinct(), uri, "left_semi").groupBy(uri).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("diagnostics"))
    kind = listed.schema["diagnostics"].dataType
    return documents.select(uri).distinct().join(listed, uri, "left").withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast(kind)))


def publisher(path: str, check: Callable[[DataFrame], DataFrame], uri: str = "uri") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes, per batch, the lists that ``check`` (documents to rows of uri and diagnostics) gives.

    A batch that is run again replaces its own folder, so each is published once."""

    def publish(batch: DataFrame, number: int) -> None:
        by_document(check(batch), batch, uri).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return publish


def published(spark, path: str, uri: str = "uri") -> DataFrame:
    """(uri, diagnostics): the list last published for each document."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(uri).agg(F.max_by("diagnostics", "batch").alias("diagnostics"))



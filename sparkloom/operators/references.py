"""Reference postings by document, with a stored membership filter that says which documents to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import membership


def postings(references: DataFrame, uri: str, ref: str, at: str, places: bool = True) -> DataFrame:
    """(uri, ref, n, first, places): a document's places of each reference, in order (left out unless asked for)."""
    listed = [F.sort_array(F.collect_list(at)).alias("places")] if places else []
    return references.groupBy(uri, ref).agg(F.count("*").alias("n"), F.min(at).alias("first"), *listed)


def filters(references: DataFrame, uri: str, ref: str) -> DataFrame:
    """(uri, n_keys, filter): a membership filter of each document's references; hashes are put together before they are dealt out."""
    sets = references.select(uri, membership.hashed(F.col(ref)).alias("h")).groupBy(uri).agg(F.collect_set("h").alias("hashes"))
    return membership.filters(sets, uri, "hashes")


def search(references: DataFrame, stored: DataFrame, uri: str, ref: str, refs: list[str]) -> DataFrame:
    """Rows of some references: documents by their filters first, the names themselves decide."""
    return membership.only(references.where(F.col(ref).isin(*refs)), uri, membership.may_hold(stored, uri, refs))

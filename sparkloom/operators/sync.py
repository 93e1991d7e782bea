"""Change detection, replacement by document, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(listed: DataFrame, stored: DataFrame, uri: str = "uri", digest: str = "sha1") -> DataFrame:
    """Listed rows that are new or whose digest differs from the stored one."""
    old = stored.select(F.col(uri).alias("_u"), F.col(digest).alias("_d"))
    return listed.join(old, F.col(uri) == F.col("_u"), "left").where(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_u", "_d")


def reconcile(listed: DataFrame, stored: DataFrame, uri: str = "uri", digest: str = "sha1") -> DataFrame:
    """(uri, status): insert, update, keep or delete."""
    a, b = listed.select(F.col(uri), F.col(digest).alias("_a"), F.lit(True).alias("_l")), stored.select(F.col(uri), F.col(digest).alias("_b"), F.lit(True).alias("_s"))
    status = F.when(F.col("_s").isNull(), "insert").when(F.col("_l").isNull(), "delete").when(F.col("_a").eqNullSafe(F.col("_b")), "keep").otherwise("update")
    return a.join(b, uri, "full").select(uri, status.alias("status"))


def replace_documents(old: DataFrame, new: DataFrame, uris: DataFrame, uri: str = "uri") -> DataFrame:
    """Rows of the changed documents are replaced by the new ones; nothing of the old rows stays."""
    return old.join(uris.select(uri).distinct(), uri, "left_anti").unionByName(new)


def without_folder(df: DataFrame, uri: str, folder: str) -> DataFrame:
    """All but the documents under a folder; a path separator ends the folder's name."""
    root = folder.rstrip("/")
    return df.where(~(F.col(uri).startswith(root + "/") | (F.col(uri) == root)))


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    others = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def debounce(events: DataFrame, key: str, at: str, quiet: Column, value: Column) -> DataFrame:
    """The last event of each run without a pause of ``quiet`` or more."""
    w = Window.partitionBy(key).orderBy(at)
    runs = events.withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) < quiet, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(key, "_run").agg(F.max(at).alias(at), F.max_by(value, at).alias("value"), F.count("*").alias("n")).drop("_run")


def splice(text: Column, start: Column, end: Column, inserted: Column) -> Column:
    """The text with characters [start, end) replaced; a null start replaces it all."""
    return F.when(start.isNull(), inserted).otherwise(F.concat(F.substring(text, F.lit(1), start), inserted, F.substring(text, end + 1, F.length(text))))


def edit_fold(edits: DataFrame, key: str, order: str, base: DataFrame | None = None) -> DataFrame:
    """(key, text): edits struct(start int, end int, text) of each document applied in order to its base text (none: empty).

    What stands before a document's last replacement of the whole text is not gathered; the join and the gathering share a shuffle."""
    whole = edits.where("start is null").groupBy(key).agg(F.max(order).alias("_from"))
    edits = edits.join(whole, key, "left").where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_from")
    folded = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "start", "end", "text"))).alias("e"))
    if base is not None:
        folded = folded.join(base.select(key, F.col("text").alias("_t")), key, "left")
    first = F.coalesce(F.col("_t"), F.lit("")) if base is not None else F.lit("")
    return folded.select(key, F.aggregate("e", first, lambda t, x: splice(t, x["start"], x["end"], x["text"])).alias("text"))


def open_documents(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Documents whose last event is not `close`, with all columns of it: what an editor holds in memory."""
    return latest(events.where(F.col(kind).isin("open", "change", "close")), [key], [order]).where(F.col(kind) != "close")


def dispatch(requests: DataFrame, connection: str, order: str, parallel: Column) -> DataFrame:
    """Adds `wave` and `waits_for`: a request starts when those before it have finished or declared themselves parallel.

    A wave is a run of parallel requests and the one after it, which all may start together; waits_for is the last request of
    the connection that is not parallel, which must have finished (null: none)."""
    before = Window.partitionBy(connection).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    alone = F.when(parallel, F.lit(None)).otherwise(F.col(order))
    return requests.withColumns({"wave": F.coalesce(F.sum(F.when(parallel, 0).otherwise(1)).over(before), F.lit(0)).cast("long"), "waits_for": F.max(alone).over(before)})


def cancelled(requests: DataFrame, cancels: DataFrame, connection: str, number: str, order: str) -> DataFrame:
    """Requests without those that a later cancel of the same connection names."""
    last = cancels.groupBy(connection, number).agg(F.max(order).alias("_c"))
    return requests.join(last, [connection, number], "left").where(F.col("_c").isNull() | (F.col("_c") < F.col(order))).drop("_c")

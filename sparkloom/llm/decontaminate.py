"""Benchmark decontamination: prefix-filtered join of item windows with documents, native columns only.

A window is ``n`` consecutive words of an item (a shorter item is one window).  A document contains a window only if it
contains every word of it, so the window's rarest word over all documents (ties: the smaller word) is a sufficient
prefix.  Each place of that word in a document gives one possible start; starts whose window would pass an end of the
document fall away (length and position bounds) and the rest are verified word by word.

Places are kept by (doc_id, hash of the text), so rows that are repeated are looked at as one and each get the result; only
rows with a place are joined back to the documents.  While the windows fit a broadcast nothing but those places moves; beyond,
the documents' words are dealt out one by one as (document, place, word), and of the texts only those of documents with a candidate
move, which are picked out by a broadcast of their ids up to BROADCAST_IDS.

Defined cases: a null or empty text has no words; an item without words has no windows; a very long text is searched whole;
repeated document rows give a row each; windows that several items share count for each; a null item_id is listed as the
empty string; an empty table of documents gives no rows, an empty benchmark no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: The windows are broadcast up to this many bytes of text and rows; beyond, the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 32_000_000, 200_000
#: Ids of documents (two numbers each) that are broadcast.
BROADCAST_IDS = 2_000_000


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id string, window array<string>), distinct."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(n)).alias("window")).distinct()


def anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to each window its rarest word over all documents and that word's first place in the window."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    small = vocabulary.count() <= BROADCAST_ROWS
    found = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
    rarity = found.groupBy("word").agg(F.count("*").alias("df"))
    spread = windows.withColumn("wid", F.xxhash64("item_id", "window")).select("wid", F.posexplode("window").alias("rel", "word"))
    ranked = spread.join(rarity, "word", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "rel")).alias("best"))
    return windows.withColumn("wid", F.xxhash64("item_id", "window")).join(ranked, "wid").select("item_id", "window", F.col("best.word").alias("anchor"), F.col("best.rel").alias("rel"))


def places(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = BROADCAST_ROWS) -> DataFrame:
    """Verified window places: doc_id, th (hash of the text), a and b (first and last word), item_id."""
    anchors = cut(anchored(item_windows(benchmark, n), docs), "windows")
    bound = anchors.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(F.array_join("window", " "))), F.lit(0)).alias("bytes")).first()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("rel")
    inside = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    exact = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
    if bound["rows"] <= most and bound["bytes"] <= BROADCAST_BYTES:
        spots = rows.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        found = spots.join(F.broadcast(anchors), F.col("word") == F.col("anchor")).where(inside & exact)
    else:
        spots = rows.select("doc_id", "th", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        candidates = spots.join(anchors, F.col("word") == F.col("anchor")).where(inside).select(F.col("doc_id").alias("k"), F.col("th").alias("t"), "pos", "rel", "window", "item_id").distinct()
        candidates = cut(candidates, "candidates")
        some = cut(candidates.select("k", "t").distinct(), "ids")
        some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
        texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(some, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t")), "left_semi")
        texts = texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words(F.col("text")).alias("w"))
        found = candidates.join(texts, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))).where(exact)
    return found.select("doc_id", "th", start.alias("a"), (start + F.size("window") - 1).alias("b"), "item_id")


def _few(df: DataFrame, label: str) -> DataFrame:
    """The frame, written; to be broadcast where it is small."""
    df = cut(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    per = places(docs, benchmark, n, most).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))
    hit = _few(per.select(F.col("doc_id").alias("k"), F.col("th").alias("t"), F.size(covered).alias("n_hit"), F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "contaminated")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id", "n_words", count("n_hit").alias("n_hit"), count("n_items").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, without any window; texts are not shuffled when the few contaminated ids fit a broadcast."""
    bad = _few(places(docs, benchmark, n).select(F.col("doc_id").alias("k"), F.col("th").alias("t")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k"]) & (F.xxhash64(docs["text"]) == bad["t"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, iw.item_id FROM dg JOIN iw ON dg.g = iw.g AND dg.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

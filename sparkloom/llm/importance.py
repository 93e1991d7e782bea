"""Importance resampling towards a target: hashed n-gram features, log ratios, a draw by Gumbel keys.

A feature is a run of 1 to ``longest`` words joined by a space; its bucket is the CRC-32 of its bytes.  No run is ever made:
each word's CRC is computed once and runs are composed, crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shift multiplies by
the GF(2) matrix of so many zero bytes.  The matrices are kept by the four bytes of their argument: one for each length up to 63
and one for each power of two beyond, so a word of any length takes a few look-ups.

Both tables are read once for the counts by bucket (at most ``buckets`` sums a task and side move) and ``documents`` again for the
weights; ``buckets`` gains, whatever the size of the tables, go to the tasks.  Ranks come from a range shuffle of the scores with
the counts of its partitions, and only partitions that hold a part of the draw are put in order.

Defined cases: a null or empty text has no words, no features and weight 0; very long texts are read whole in pieces; a null
doc_id is drawn by the key of the empty id and comes last among equal scores; equal rows are judged alike and, where the draw ends
between them, any of them are drawn; an empty table of documents gives no rows, an empty benchmark holds no features; extra
columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import byte_table, mapped, word_pieces
from .common import by_value, cut, relax, small_batches, text_steps, worker_cache

by_value(__name__)

#: The reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Lengths below this have a matrix each.
SHORT = 64


def byte_steps() -> np.ndarray:
    """The remainder of each byte followed by 32 zero bits."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix, given as its products with the 256 values of each byte, times vectors."""
    return matrix[0][x & 255] ^ matrix[1][(x >> 8) & 255] ^ matrix[2][(x >> 16) & 255] ^ matrix[3][x >> 24]


class Shifts:
    """CRCs after so many zero bytes."""

    def __init__(self):
        self.step = byte_steps()
        at = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        short = [at]
        for _ in range(SHORT):
            short.append(self.step[short[-1] & 255] ^ (short[-1] >> 8))
        self.short = np.concatenate([m.ravel() for m in short[:SHORT]])
        self.powers = [short[SHORT]]  # of SHORT, 2 SHORT, 4 SHORT ... bytes

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        base = (length % SHORT) * 1024
        out = self.short[base + (crc & 255)] ^ self.short[base + 256 + ((crc >> 8) & 255)] ^ self.short[base + 512 + ((crc >> 16) & 255)] ^ self.short[base + 768 + (crc >> 24)]
        rest, k = length // SHORT, 0
        while rest.any():
            if len(self.powers) <= k:
                self.powers.append(times(self.powers[-1], self.powers[-1]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = times(self.powers[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out

    def words(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC of each word: a byte of all words of that length at a time, long ones by themselves."""
        length = end - first
        order = np.argsort(-length, kind="stable")
        at, crc = first[order], np.full(len(first), 0xFFFFFFFF, np.uint32)
        many = np.cumsum(np.bincount(np.minimum(length, SHORT), minlength=SHORT + 1)[::-1])[::-1]  # words of so many bytes or more
        long = int(many[SHORT])
        for k in range(SHORT):
            n = int(many[k + 1])
            if n <= long:
                break
            now = crc[long:n]
            crc[long:n] = self.step[(now ^ raw[at[long:n] + k]) & 255] ^ (now >> 8)
        crc ^= np.uint32(0xFFFFFFFF)
        for i in range(long):
            crc[i] = zlib.crc32(raw[at[i] : end[order[i]]].tobytes())
        out = np.empty_like(crc)
        out[order] = crc
        return out


def shifts() -> Shifts:
    cache = worker_cache()
    return cache["shifts"] if "shifts" in cache else cache.setdefault("shifts", Shifts())


def feature_pieces(texts: pa.Array, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, crc, words in the run) of all runs of 1 to ``longest`` consecutive words; runs go on from piece to piece."""
    shift = shifts()
    raw, ends = mapped(texts, byte_table(digits=True))
    space = np.uint32(zlib.crc32(b" "))
    #: of the words before this piece: row and CRC of the runs of 1, 2 ... words that end there, and the length
    rows, runs = np.full(longest, -1), [np.zeros(longest, np.uint32) for _ in range(longest)]
    for first, end, row in word_pieces(raw, ends):
        length = end - first
        word = shift.words(raw, first, end)
        spaced = shift(np.full(len(word), space), length) ^ word
        rows = np.concatenate([rows, row])
        runs[0] = np.concatenate([runs[0], word])
        yield row, word, 1
        for k in range(1, longest):
            before = runs[k - 1][longest - 1 : -1]
            runs[k] = np.concatenate([runs[k], shift(before, length + 1) ^ spaced])
            whole = rows[longest - k : -k] == row
            yield row[whole], runs[k][longest:][whole], k + 1
        rows, runs = rows[-longest:], [r[-longest:] for r in runs]


def bucket_counts(texts: DataFrame, side: str, buckets: int, longest: int = 3) -> DataFrame:
    """(side, bucket, n): features by bucket, a row per bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in text_steps(batches):
            for _, crc, _ in feature_pieces(b.column("text"), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        relax()
        yield pa.RecordBatch.from_arrays([pa.array([side] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["side", "bucket", "n"])

    return small_batches(texts).select("text").mapInArrow(run, "side string, bucket int, n long")


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 3) -> list[int]:
    """The gain of each bucket: floor(1000 ln(its smoothed share in the target over that in the documents))."""
    counted = bucket_counts(docs, "s", buckets, longest).unionByName(bucket_counts(target, "t", buckets, longest)).groupBy("side", "bucket").agg(F.sum("n").alias("n"))
    of = {"s": [0] * buckets, "t": [0] * buckets}
    for side, bucket, n in counted.collect():  # two numbers a bucket at most
        of[side][bucket] = n
    s, t = sum(of["s"]), sum(of["t"])
    return [math.floor(1000 * math.log(float((b + 1) * (s + buckets)) / float((a + 1) * (t + buckets)))) for a, b in zip(of["s"], of["t"], strict=True)]


def weights(docs: DataFrame, gain: list[int], longest: int = 3) -> DataFrame:
    """Per document row: doc_id, n_words, n_features, weight."""
    by_bucket = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            n = b.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, crc, k in feature_pieces(b.column("text"), longest):
                count = np.bincount(row, minlength=n)
                features += count
                words += count * (k == 1)
                weight += np.bincount(row, by_bucket[crc % np.uint32(len(by_bucket))], minlength=n).astype(np.int64)  # sums of a piece are exact in doubles
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        relax()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel_key(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``rank`` to the n highest scores (ties: smaller doc_id), null to the others.

    The rows are dealt to ranges of (score, doc_id, row), which splits equal ones too; the counts of the ranges say which hold ranks."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before, starts = 0, []
    for part, count in sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect()):  # a row per partition
        if before < n:
            starts.append((part, before))
        before += count
    first = spark.createDataFrame(starts, "_part int, _before long")
    inside = dealt.join(F.broadcast(first), "_part").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).drop("_before")
    others = dealt.join(F.broadcast(first), "_part", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return inside.unionByName(others).drop("_part", "_row")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Per document row: doc_id, n_features, weight, score, rank; drawn is the share of the documents with ``least_words`` or more."""
    weighed = weights(docs, gains(docs, target, buckets))
    scored = cut(weighed.withColumn("score", F.col("weight") + gumbel_key(F.col("doc_id"), seed)), "scores")
    enough = F.col("n_words") >= least_words
    can = scored.where(enough)
    drawn = ranked(can, can.count() * share[0] // share[1])
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS step),
x AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS (SELECT side, r, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k))),
c AS (SELECT g, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295) AS c FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM g), t),
f AS (SELECT side, r, xor(c, 4294967295) % 10000 AS b, count(*) AS n FROM g JOIN c USING (g) GROUP BY ALL),
n AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM f GROUP BY b),
z AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM n) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
q AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN z USING (b) WHERE side = 'd' GROUP BY r),
o AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN q USING (r) WHERE side = 'd'),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE words >= 20 QUALIFY rank <= count(*) OVER () * 5 // 100)
SELECT o.doc_id, n_features, weight, score, rank FROM o LEFT JOIN k ON o.doc_id = k.doc_id
"""

"""URL filters: nested prefix rules found by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's.  The canonical key of a
rule is its host's labels from last to first, a slash, and the path; a URL has such a key for its host and for each parent
domain, kept for label counts that rules have.  A rule fits a URL if its key is a prefix of one of them: the interval from
the key to the key followed by the highest characters.  Intervals of prefixes nest, so a sweep over keys in order, rules first,
keeps those that hold the place as a stack, and its top is the longest.

Keys are dealt to ranges by splitters, of which there is a bounded number of bounded length; equal keys between several splitters are
spread over all ranges between them, so a hot URL is no hot task.  A rule goes to each range that its interval meets: the one where it
begins and those whose first key lies in it, of which there are never more for one range than its first key has prefixes.

Of several rules that fit, the one with the longest text (host and path) wins, of equally long ones the one with the longer host;
of rules given twice with different verdicts, `block` does.  A URL without a rule is allowed unless it has no host.

Defined cases: a null URL, or one without ``://``, has an empty host and path; an empty label is a label; a path that is missing fits
only rules without one; a rule without a host is left out, its null path is empty; very long URLs are compared whole; repeated rows give
a row each; an empty table gives no rows; without rules every URL gets the default; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, by_value, cut

by_value(__name__)

#: Splitter candidates a range, and characters of a key that are compared with splitters.
PICKS, SPLITTER = 64, 512
#: The greatest character.
TOP = "\U0010ffff"


def host_path(url: Column) -> tuple[Column, Column]:
    """The host (lower-cased) between the first ``://`` and the next ``/``, ``?``, ``#``, and the path up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def key(reversed_labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(reversed_labels, "."), F.lit("/"), path)


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, rule, host_length, verdict, n_labels), one row per key."""
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    given = rules.where("host IS NOT NULL").select(key(labels(host), path).alias("key"), F.concat(host, path).alias("rule"), F.length(host).alias("host_length"), F.size(labels(host)).alias("n_labels"), F.col("verdict"))
    return given.groupBy("key", "rule", "host_length", "n_labels").agg(F.max("verdict").alias("verdict"))


def beyond(prefix: str) -> str:
    """The least text greater than all that begin with a prefix."""
    prefix = prefix.rstrip(TOP)
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def ranges_of_key(splitters: list[str], k: str) -> tuple[int, int]:
    """First and last range that may hold a key; several only where splitters are equal to what of it is compared."""
    k = k[:SPLITTER]
    low, high = bisect_left(splitters, k), bisect_right(splitters, k)
    return (low + 1, high) if high > low else (high, high)


def ranges_of_rule(splitters: list[str], k: str) -> tuple[int, int]:
    """First and last range that may hold a key which begins with a rule's."""
    return ranges_of_key(splitters, k)[0], bisect_left(splitters, beyond(k[:SPLITTER]))


def splitters_of(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """The bounds between the ranges: evenly spaced keys of a sample of PICKS a range; they decide where rows go and nothing else."""
    picked = keys.where("key IS NOT NULL").select(F.substring("key", 1, SPLITTER).alias("key")).sample(min(1.0, PICKS * ranges / max(rows, 1)), 1)
    picked = sorted(r.key for r in picked.collect())
    return [picked[i * len(picked) // ranges] for i in range(1, ranges)] if picked else []


def entries(pages: DataFrame, counts: list[int]) -> DataFrame:
    """(row, key, head, page_id, host, path): a row per page and label count that it has; the first of a page, or a row without key, is its head."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")).withColumn("labels", labels(F.col("host")))
    keys = F.array(*[F.when(F.size("labels") >= n, key(F.slice("labels", 1, n), F.col("path"))) for n in counts]) if counts else F.array().cast("array<string>")
    spread = rows.select("row", "page_id", "host", "path", F.posexplode_outer(F.filter(keys, lambda k: k.isNotNull())).alias("i", "key"))
    head = F.coalesce(F.col("i") == 0, F.lit(True))
    of_head = lambda c: F.when(head, F.col(c)).alias(c)
    return spread.select("row", "key", head.alias("head"), of_head("page_id"), of_head("host"), of_head("path"))


def dealt(df: DataFrame, splitters: list[str], rule: bool) -> DataFrame:
    """Adds the range of each row: of a rule all that its interval meets, of an entry one (equal keys are spread by row number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            rows = b.column("row").to_pylist() if not rule else None
            for i, k in enumerate(b.column("key").to_pylist()):
                if rule:
                    low, high = ranges_of_rule(splitters, k)
                    at += [i] * (high - low + 1)
                    found += range(low, high + 1)
                else:
                    low, high = ranges_of_key(splitters, k) if k is not None else (0, len(splitters))
                    found.append(low + rows[i] % (high - low + 1))
            if rule:
                b = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], [*b.schema.names, "range"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())]))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order of key, rules before entries: each entry with the top of the stack of rules that hold its key."""
    stack, now = [], None
    for b in batches:
        at, found = [], []
        columns = [b.column(c).to_pylist() for c in ("range", "key", "is_rule", "head")]
        for i, (where, k, is_rule, head) in enumerate(zip(*columns, strict=True)):
            if where != now:
                stack, now = [], where
            while stack and not (k or "").startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((k, {c: b.column(c)[i].as_py() for c in ("rule", "host_length", "verdict")}))
            elif head or stack:
                at.append(i)
                found.append(stack[-1][1] if stack else None)
        hit = lambda c: [f and f[c] for f in found]
        rows = b.select(["row", "page_id", "host", "path"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hit("rule"), pa.string()), pa.array(hit("host_length"), pa.int32()), pa.array(hit("verdict"), pa.string())], ["row", "page_id", "host", "path", "rule", "host_length", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", without_host: str = "block") -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict; rules: host, path, verdict."""
    spark = pages.sparkSession
    table = cut(rule_table(rules), "rules")
    counts = sorted(r.n_labels for r in table.select("n_labels").distinct().collect())  # as many as host names have labels
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = entries(pages, counts)
    splitters = splitters_of(places, pages.count() * max(len(counts), 1), ranges)
    page_id = pages.schema["page_id"].dataType.simpleString()
    none = lambda **kinds: [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    of_rules = dealt(table.select("key", "rule", "host_length", "verdict"), splitters, True).select(F.lit(True).alias("is_rule"), "*", *none(row="long", head="boolean", page_id=page_id, host="string", path="string"))
    of_pages = dealt(places, splitters, False).select(F.lit(False).alias("is_rule"), "*", *none(rule="string", host_length="int", verdict="string"))
    ordered = of_pages.unionByName(of_rules).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", F.col("key").asc_nulls_first(), F.col("is_rule").desc())
    swept = ordered.mapInArrow(sweep, f"row long, page_id {page_id}, host string, path string, rule string, host_length int, verdict string")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict"))).alias("best")
    one = swept.groupBy("row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), best)
    fallback = F.when(F.col("host") == "", without_host).otherwise(default)
    return one.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", fallback).alias("verdict"))


#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
r(h, s, v) AS (VALUES """ + ", ".join(map(str, RULES)) + r"""),
m AS (SELECT page_id, host, path, h || s AS rule, v AS verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || s) DESC, length(h) DESC) AS i FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, CASE WHEN p.host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.i = 1
"""

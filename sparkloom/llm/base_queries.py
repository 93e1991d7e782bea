"""What of the operators' results plain SQL can say too, as queries of their own: the same operators, fewer columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, ngram_lm, secrets, spotsigs
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASES_SQL = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for label, phrase, _ in licenses.BASE)


@query(
    rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), p(label, g, k) AS (VALUES {PHRASES_SQL}),
    x AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS place FROM d), y AS (SELECT r, place, x, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS x3, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS x4 FROM x WINDOW o AS (PARTITION BY r ORDER BY place)),
    h AS (SELECT r, label, place FROM y JOIN p ON g = CASE k WHEN 3 THEN x3 WHEN 4 THEN x4 END),
    s AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN s USING (r)"""
)
def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases of the license scan."""
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query(
    rf"""WITH t AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS step),
    d AS (SELECT doc_id, list_append(regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+'), chr(10)) AS w, xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ord(CAST(doc_id AS VARCHAR)[i])), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 5 = 1 AS held_out FROM documents, t),
    x AS (SELECT doc_id, held_out, unnest(w) AS token FROM d), k AS (SELECT token, count(*) AS c FROM x WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM k)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score FROM x LEFT JOIN k USING (token), n GROUP BY doc_id, held_out"""
)
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the base score of language-model scoring, to thousandths."""
    return ngram_lm.train_and_score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_SQL = "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query(
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '{ASSIGN_SQL}', 1), lambda x: length(x) >= 8)) AS n_assign, len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
    len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of each kind."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


@query(
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents), s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
    w AS (SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(n) OVER () AS whole FROM s),
    l AS (SELECT a.source, (a.whole - coalesce(sum(b.n * 3) FILTER (b.n * 3.0 / b.w < a.n * 3.0 / a.w), 0)) / nullif(sum(b.w) FILTER (b.n * 3.0 / b.w >= a.n * 3.0 / a.w), 0) AS level, a.n * 3.0 / a.w AS room FROM w a, w b GROUP BY a.source, a.n, a.w, a.whole),
    v AS (SELECT arg_min(level, room) FILTER (level <= room) AS level FROM l)
    SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(3.0 * n, coalesce(v.level * w, 3.0 * n)), 3) AS target FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source, v"""
)
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, to thousandths."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, t, length(t) AS n, length(t) // 4 AS q, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS u FROM d)
    SELECT doc_id, n AS n_chars, sha256(left(t, CAST(n - q AS BIGINT)) || left(u, CAST(q AS BIGINT))) AS edited_sha256 FROM x"""
)
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that fingerprints are compared with."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")

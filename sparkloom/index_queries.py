"""Queries over kept indexes and many searches at once, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import REFS, SEARCH_SQL, TOKENS_SQL, _symbols, _t, query
from .functions import tokens as T
from .operators import membership as M
from .operators import postings as G
from .operators import search as S
from .operators import stored as K


def kept_tokens(spark, d):
    """The token index of part names, kept in order of tokens."""
    part = _t(spark, d, "part")
    return K.keep(part, "tokens", lambda: S.token_index(_symbols(spark, d), F.col("name"), F.col("symbol_key"), T.tokens), lambda df, to: K.write_index(df, to, ["token", "symbol_key"]))


@query(f"SELECT token, symbol_key FROM ({TOKENS_SQL}) WHERE starts_with(token, 'wi')")
def stored_prefix(spark, d):
    """A prefix of tokens from the kept index: row groups of other tokens are skipped."""
    return S.prefix_scan(kept_tokens(spark, d), "token", "wi").select("token", "symbol_key")


@query(f"SELECT token, symbol_key FROM ({TOKENS_SQL}) WHERE token = 'widget'")
def stored_point(spark, d):
    """One token from the kept index."""
    return kept_tokens(spark, d).where("token = 'widget'").select("token", "symbol_key")


#: Symbols of a search in `many_searches`.
PER_SEARCH = 20


def _searches(spark, d):
    """A search of two words per customer: beginnings, of different length, of the words of a part's name."""
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("search")).withColumn("p_partkey", F.col("search") * 7 % F.lit(max(part.count(), 1)))
    words = F.split("p_name", " ")
    cut = lambda i, most: F.substring(F.lower(F.get(words, F.lit(i))), F.lit(1), (F.col("search") % most + 1).cast("int"))
    return asked.join(part, "p_partkey").select("search", F.posexplode(F.array(cut(1, 4), cut(0, 6))).alias("word_ord", "word"))


SEARCHES_SQL = "SELECT c_custkey AS search, 0 AS word_ord, substr(lower(string_split(p_name, ' ')[2]), 1, c_custkey % 4 + 1) AS word FROM customer JOIN part ON p_partkey = c_custkey * 7 % (SELECT count(*) FROM part) UNION ALL SELECT c_custkey, 1, substr(lower(string_split(p_name, ' ')[1]), 1, c_custkey % 6 + 1) FROM customer JOIN part ON p_partkey = c_custkey * 7 % (SELECT count(*) FROM part)"


@query(
    f"WITH t AS ({TOKENS_SQL}), s AS ({SEARCHES_SQL}), h AS (SELECT search, token, min(word_ord) AS word_ord FROM (SELECT DISTINCT token FROM t) JOIN s ON starts_with(token, word) GROUP BY ALL), f AS (SELECT search, symbol_key, min((word_ord, token)) AS b FROM h JOIN t USING (token) GROUP BY ALL), r AS (SELECT search, symbol_key, CAST(b[1] AS BIGINT) AS word_ord, b[2] AS token, row_number() OVER (PARTITION BY search ORDER BY b, symbol_key) AS place, count(*) OVER (PARTITION BY search) <= {PER_SEARCH} AS is_complete FROM f) SELECT * FROM r WHERE place <= {PER_SEARCH}"
)
def many_searches(spark, d):
    """Every customer's search in the kept token index: the first symbols of each and whether they are all."""
    return S.search_many(kept_tokens(spark, d), _searches(spark, d), PER_SEARCH)


PATTERN = "[a-zA-Z]+"


def kept_filters(spark, d):
    """A membership filter of the words of each document."""
    docs = _t(spark, d, "documents")
    hashes = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))), lambda w: M.hashed(w))
    return K.keep(docs, "filters", lambda: M.filters(docs.select("doc_id", hashes.alias("hashes")), "doc_id", "hashes"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[a-zA-Z]+'))) AS n_keys FROM documents")
def filter_sizes(spark, d):
    """The kept filters: as many keys as a document has different words."""
    return kept_filters(spark, d).select("doc_id", "n_keys")


@query(SEARCH_SQL)
def stored_filter_search(spark, d):
    """Documents whose kept filter may hold a name, then the name itself; the others' texts are not cut into words."""
    docs = M.only(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", M.may_hold(kept_filters(spark, d), "doc_id", REFS))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("ref"))
    return words.where(F.col("ref").isin(REFS)).groupBy("doc_id", "ref").agg(F.count("*").alias("n"))


def kept_postings(spark, d):
    docs = _t(spark, d, "documents")
    return K.keep(docs, "postings", lambda: G.build(docs, "doc_id", "text", PATTERN), lambda df, to: K.write_index(df, to, ["term", "block", "first_doc"], group=4 << 20, dealt=False))


def _phrases(spark, d):
    """The first two and the first three words of each benchmark item, and the second to the fourth."""
    w = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    some = F.array(F.slice("w", 1, 2), F.slice("w", 1, 3), F.slice("w", 2, 3))
    cut = _t(spark, d, "benchmark").select(w.alias("w")).where(F.size("w") >= 4).select(F.explode(some).alias("words"))
    return cut.select(F.array_join("words", " ").alias("phrase"), "words").distinct()


@query(
    "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents), b AS (SELECT regexp_extract_all(text, '[a-zA-Z]+') AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(x, ' ') AS phrase FROM (SELECT unnest([w[1:2], w[1:3], w[2:4]]) AS x FROM b WHERE len(w) >= 4)), g AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (2), (3)) v(k))) SELECT phrase, doc_id AS doc, count(*) AS n FROM g SEMI JOIN p USING (phrase) GROUP BY ALL"
)
def phrase_search(spark, d):
    """Phrases of benchmark items in all documents, by the kept positional postings."""
    return G.phrase_search(kept_postings(spark, d), _phrases(spark, d))


@query("SELECT w AS term, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM documents) GROUP BY w")
def postings_sizes(spark, d):
    """Documents of each term, from the heads of the kept segments alone."""
    return kept_postings(spark, d).groupBy("term").agg(F.sum("n_docs").alias("n_docs"))


def _roots(spark, d):
    """Sites and their first folders, folders before sites, as workspaces of a tree."""
    parts = F.split("url", "/", -1)
    cut = lambda n: F.when(F.size("p") > n, F.concat(F.array_join(F.slice("p", 1, n), "/"), F.lit("/")))
    roots = _t(spark, d, "pages").select(parts.alias("p")).select(F.explode(F.array(F.struct(F.lit(0).alias("depth"), cut(4).alias("root")), F.struct(F.lit(1).alias("depth"), cut(3).alias("root")))).alias("r")).select("r.*").where("root IS NOT NULL").distinct()
    return roots.select("root", F.struct("depth", "root").alias("ord"))


@query(
    "WITH s AS (SELECT url, string_split(url, '/') AS p FROM pages), r AS (SELECT DISTINCT * FROM (SELECT 0 AS depth, array_to_string(p[1:4], '/') || '/' AS root FROM s WHERE len(p) > 4 UNION ALL SELECT 1, array_to_string(p[1:3], '/') || '/' FROM s WHERE len(p) > 3)) SELECT page_id, url, (SELECT arg_min(root, (depth, root)) FROM r WHERE starts_with(pages.url, root)) AS root FROM pages"
)
def route_many(spark, d):
    """Each page under the first of all sites and folders that holds it."""
    return S.route_many(_t(spark, d, "pages").select("page_id", "url"), "url", _roots(spark, d)).select("page_id", "url", "root")

"""Queries of the code-intelligence kernels over the driver's tables, with their SQL.

The driver's data holds no source code, so parts stand for symbols, regions, nations and customers for namespaces, the heap
tree of part keys for inheritance, line items for members, documents and conversations for texts, events for streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import tokens as T
from .operators import hierarchy as H
from .operators import lookup as L
from .operators import positional as P
from .operators import references as R
from .operators import search as S
from .operators import sync as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _big(c) -> F.Column:
    return c.cast("bigint")


CAMEL = "replace(initcap(p_name), ' ', '')"
SQL_CAMEL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"


def _symbols(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_key"), F.expr(CAMEL).alias("name"), F.concat(F.lit("\\"), "p_type").alias("namespace"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def prefix_scan(spark, d):
    return S.prefix_scan(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "small")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def point_get(spark, d):
    return _t(spark, d, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


@query(
    "SELECT c_custkey, layer, v FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o) AS r FROM (SELECT c_custkey, 'memory' AS layer, c_acctbal + 1 AS v, 0 AS o FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'disk', c_acctbal, 1 FROM customer)) WHERE r = 1"
)
def layered_get(spark, d):
    c = _t(spark, d, "customer")
    memory = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("memory").alias("layer"), (F.col("c_acctbal") + 1).alias("v"))
    return S.layered([memory, c.select("c_custkey", F.lit("disk").alias("layer"), F.col("c_acctbal").alias("v"))], ["c_custkey"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def batch_last_op(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return S.last_operation(e, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "value")


def _fqns(spark, d):
    r, n = _t(spark, d, "region"), _t(spark, d, "nation")
    return _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name", "n_name", F.concat_ws("\\", F.lit(""), "r_name", "n_name", "c_name").alias("fqn"))


FQN_SQL = "SELECT c_custkey, r_name, n_name, c_name, '\\' || r_name || '\\' || n_name || '\\' || c_name AS fqn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT c_custkey, '\\' || r_name || '\\' || n_name AS scope, c_name AS short, '\\' || r_name || '\\' || n_name AS namespace, r_name AS first FROM ({FQN_SQL})")
def scope_split(spark, d):
    f = F.col("fqn")
    return _fqns(spark, d).select("c_custkey", N.scope_of(f).alias("scope"), N.last_segment(f).alias("short"), N.namespace_of(f).alias("namespace"), N.first_part(f).alias("first"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\\' || p_brand WHEN 1 THEN 'int' WHEN 2 THEN '\\' || p_type || '\\' || p_brand ELSE '\\' || p_brand END AS qualified FROM part"
)
def qualify_name(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("\\"), "p_brand")).when(k == 1, F.lit("int")).otherwise(F.col("p_brand"))
    return _t(spark, d, "part").select("p_partkey", N.qualify(name, F.when(k == 2, F.col("p_type")).otherwise(F.lit(""))).alias("qualified"))


@query(
    "SELECT p_partkey, p_type AS fqn, CAST(p_size % 3 AS BIGINT) AS array_level, p_type || repeat('[]', p_size % 3) AS shown, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || repeat('[]', p_size % 3 - 1) END AS element FROM part"
)
def array_suffix(spark, d):
    t = N.type_struct(F.concat("p_type", F.repeat(F.lit("[]"), (F.col("p_size") % 3).cast("int"))))
    return _t(spark, d, "part").select("p_partkey", t.alias("t")).select(
        "p_partkey", "t.fqn", "t.array_level", N.type_text(F.col("t")).alias("shown"), N.types_text(N.element_type(F.array("t"))).alias("element")
    )


@query(f"SELECT c_custkey, '\\' || r_name || '\\' || n_name || '\\' || lower(c_name) AS lookup_key FROM ({FQN_SQL})")
def class_key_lower(spark, d):
    return _fqns(spark, d).select("c_custkey", N.lookup_key(F.col("fqn")).alias("lookup_key"))


@query("SELECT page_id, starts_with(url, 'https://') AS secure, CASE WHEN starts_with(url, 'https://www.') THEN substr(url, 13) ELSE url END AS canonical FROM pages")
def uri_canonical(spark, d):
    return _t(spark, d, "pages").select("page_id", F.col("url").startswith("https://").alias("secure"), N.canonical_uri(F.col("url"), "https://www.").alias("canonical"))


@query(
    "SELECT conv_id, turn, turn || ':' || (length(text) % 50) AS shown, CAST(CASE WHEN (turn, length(text) % 50) < (1, 10) THEN -1 WHEN (turn, length(text) % 50) < (2, 25) THEN 0 ELSE 1 END AS BIGINT) AS side FROM conversations"
)
def position_compare(spark, d):
    p, at = N.position(F.col("turn"), F.length("text") % 50), lambda a, b: N.position(F.lit(a), F.lit(b))
    return _t(spark, d, "conversations").select("conv_id", "turn", N.position_text(p).alias("shown"), _big(N.compare_range(p, at(1, 10), at(2, 25))).alias("side"))


@query("SELECT conv_id, turn, regexp_extract(regexp_replace(text, '[^a-zA-Z0-9_]+$', ''), '[a-zA-Z0-9_\\x{80}-\\x{10FFFF}]*$') AS word FROM conversations")
def word_at_end(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", N.word_before(F.regexp_replace("text", r"[^a-zA-Z0-9_]+\z", "")).alias("word"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, d):
    return L.declared(_t(spark, d, "orders"), _t(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query(f"SELECT c_custkey, fqn FROM ({FQN_SQL}) WHERE starts_with(fqn, '\\ASIA\\')")
def namespace_subtree(spark, d):
    return S.prefix_scan(_fqns(spark, d).select("c_custkey", "fqn"), "fqn", "\\ASIA\\")


ROOTS = ["https://www.", "https://", "http://blog.", "http://"]


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'https://www.' WHEN starts_with(url, 'https://') THEN 'https://' WHEN starts_with(url, 'http://blog.') THEN 'http://blog.' WHEN starts_with(url, 'http://') THEN 'http://' END AS root FROM pages")
def route_prefix(spark, d):
    return S.route(_t(spark, d, "pages"), "url", ROOTS).select("page_id", "root")


TOKENS_SQL = f"SELECT DISTINCT p_partkey AS symbol_key, t AS token FROM (SELECT p_partkey, unnest(list_concat([lower(n)], list_transform(regexp_extract_all(n, '[A-Z][a-z]*')[2:], lambda x: lower(x)))) AS t FROM (SELECT p_partkey, {SQL_CAMEL} AS n FROM part))"


@query(TOKENS_SQL)
def token_index(spark, d):
    return S.token_index(_symbols(spark, d), F.col("name"), F.col("symbol_key"), T.tokens)


@query(
    f"SELECT symbol_key, word_ord, token FROM (SELECT symbol_key, CAST(o AS BIGINT) AS word_ord, token, row_number() OVER (PARTITION BY symbol_key ORDER BY o, token) AS r FROM (SELECT *, CASE WHEN starts_with(token, 'bo') THEN 0 WHEN starts_with(token, 'wi') THEN 1 END AS o FROM ({TOKENS_SQL})) WHERE o IS NOT NULL) WHERE r = 1 ORDER BY word_ord, token, symbol_key LIMIT 1000"
)
def token_search(spark, d):
    return S.token_search(token_index(spark, d), ["bo", "wi"])


@query(f"SELECT p_partkey AS symbol_key, {SQL_CAMEL} AS name FROM part WHERE p_type = 'PROMO' AND contains({SQL_CAMEL}, 'Bolt')")
def scoped_search(spark, d):
    return _symbols(spark, d).where((F.col("namespace") == "\\PROMO") & F.contains("name", F.lit("Bolt"))).select("symbol_key", "name")


NAMESPACE_SQL = "SELECT DISTINCT scope, lower(part) AS token, ns FROM (SELECT '' AS scope, r_name AS part, '\\' || r_name || '\\' || n_name AS ns FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '\\' || r_name, n_name, '\\' || r_name || '\\' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT scope, token, ns FROM ({NAMESPACE_SQL}) WHERE starts_with(token, 'a') OR starts_with(token, 'nation_1')")
def namespace_search(spark, d):
    ns = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("\\", F.lit(""), "r_name", "n_name").alias("ns"))
    return L.namespace_search(L.namespace_index(ns, "ns"), ["a", "nation_1"])


@query(
    "SELECT name, kind, CAST(kind_ord AS BIGINT) AS kind_ord FROM (SELECT p_name AS name, 'part' AS kind, 0 AS kind_ord FROM part UNION ALL SELECT c_name, 'customer', 1 FROM customer UNION ALL SELECT s_name, 'supplier', 2 FROM supplier UNION ALL SELECT n_name, 'nation', 3 FROM nation) WHERE contains(lower(name), 'er#00000001') OR starts_with(lower(name), 'small')"
)
def workspace_symbols(spark, d):
    def found(table, column):
        name = F.lower(column)
        return _t(spark, d, table).select(F.col(column).alias("name")).where(F.contains(name, F.lit("er#00000001")) | name.startswith("small"))

    return S.union_kinds([("part", found("part", "p_name")), ("customer", found("customer", "c_name")), ("supplier", found("supplier", "s_name")), ("nation", found("nation", "n_name"))])


@query("SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 10) <= 50 AS is_complete FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 50")
def limit_complete(spark, d):
    return S.limited(_t(spark, d, "part").where("p_size > 10").select("p_partkey"), ["p_partkey"], 50)


def _edges(spark, d):
    return _t(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


def _seeds(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("seed"))


CLOSURE_SQL = "WITH RECURSIVE walk(seed, node, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION SELECT seed, node // 2, depth + 1 FROM walk WHERE node > 0)"


@query(f"{CLOSURE_SQL} SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node")
def ancestor_closure(spark, d):
    return H.closure_of_all(_edges(spark, d), _seeds(spark, d))


def _members(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("owner"), _big(F.col("l_linenumber")).alias("name"), _big(F.col("l_linenumber") % 3).alias("visibility"), (F.col("l_returnflag") == "R").alias("static"), "l_orderkey")
    return H.first_wins(rows, ["owner", "name"], ["l_orderkey", "static"]).select("owner", "name", "visibility", "static")


def _nearest_of_all(spark, d, members):
    """(node, name, depth, ...) of the nearest of the members that a node has or inherits, by name."""
    return H.nearest_of_each(_edges(spark, d), members.withColumn("node", F.col("owner")), ["name"], ["owner"])


def _nearest(spark, d, members):
    """The same of the parts (seed)."""
    return _nearest_of_all(spark, d, members).withColumnRenamed("node", "seed").join(_seeds(spark, d).distinct(), "seed", "left_semi")


MEMBERS_SQL = "members AS (SELECT l_partkey AS owner, CAST(l_linenumber AS BIGINT) AS name, CAST(l_linenumber % 3 AS BIGINT) AS visibility, arg_min(l_returnflag = 'R', (l_orderkey, l_returnflag = 'R')) AS static FROM lineitem GROUP BY ALL)"


@query(
    f"{CLOSURE_SQL}, c AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node), {MEMBERS_SQL} SELECT seed, name, owner, visibility, depth FROM (SELECT seed, m.name, m.owner, m.visibility, depth, row_number() OVER (PARTITION BY seed, m.name ORDER BY depth, m.owner) AS r FROM c JOIN members m ON m.owner = c.node WHERE depth = 0 OR m.visibility <> 2) WHERE r = 1"
)
def inherited_members(spark, d):
    members = H.written(_members(spark, d), f"{H.shared_folder(spark)}/members")
    found = _nearest(spark, d, members.where("visibility <> 2"))
    own = _seeds(spark, d).distinct().join(members, F.col("seed") == F.col("owner")).withColumn("depth", F.lit(0).cast("long"))  # its own hide all others of a name
    columns = ["seed", "name", "owner", "visibility", "depth"]
    return H.first_wins(own.select(columns).unionByName(found.select(columns)), ["seed", "name"], ["depth", "owner"])


@query(
    f"{CLOSURE_SQL}, c AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node), {MEMBERS_SQL} SELECT how, seed, name, owner FROM (SELECT how, seed, m.name, m.owner, row_number() OVER (PARTITION BY how, seed, m.name ORDER BY depth, m.owner) AS r FROM c JOIN members m ON m.owner = c.node CROSS JOIN (VALUES ('parent'), ('relative'), ('name')) h(how) WHERE CASE how WHEN 'parent' THEN owner <> seed AND visibility <> 2 WHEN 'relative' THEN owner = seed OR visibility <> 2 ELSE static AND visibility = 0 END) WHERE r = 1"
)
def reduce_static(spark, d):
    """By what stands before the colons: ``parent`` asks the class above, the others the class itself."""
    members, columns = H.written(_members(spark, d), f"{H.shared_folder(spark)}/members"), ["how", "seed", "name", "depth", "owner"]
    seeds = _seeds(spark, d).distinct()
    own = seeds.join(members, F.col("seed") == F.col("owner")).withColumns({"how": F.lit("relative"), "depth": F.lit(0).cast("long")})
    open_ = _nearest_of_all(spark, d, members.where("visibility <> 2"))
    relative = open_.join(seeds.select(F.col("seed").alias("node")), "node", "left_semi").withColumnRenamed("node", "seed").withColumn("how", F.lit("relative"))
    parent = open_.join(_edges(spark, d).select(F.col("child").alias("seed"), F.col("parent").alias("node")).distinct(), "node").withColumns({"how": F.lit("parent"), "depth": F.col("depth") + 1})
    named = _nearest(spark, d, members.where("static AND visibility = 0")).withColumn("how", F.lit("name"))
    rows = own.select(columns).unionByName(relative.select(columns)).unionByName(parent.select(columns)).unionByName(named.select(columns))
    return H.first_wins(rows, ["how", "seed", "name"], ["depth", "owner"]).select("how", "seed", "name", "owner")


@query(f"{CLOSURE_SQL}, {MEMBERS_SQL} SELECT seed, arg_min(m.name, (depth, m.name)) AS name, min(depth) AS depth FROM walk JOIN members m ON m.owner = node WHERE visibility = 0 GROUP BY seed")
def reduce_first_public(spark, d):
    own = _members(spark, d).where("visibility = 0").select(F.col("owner").alias("node"), "name")
    found = H.nearest_of_each(_edges(spark, d), own, [], ["name"]).withColumnRenamed("node", "seed")
    return found.join(_seeds(spark, d).distinct(), "seed", "left_semi").select("seed", "name", "depth")


@query("SELECT l_suppkey, owner, name FROM (SELECT l_suppkey, l_partkey AS owner, CAST(l_linenumber AS BIGINT) AS name, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) AS r FROM lineitem) WHERE r = 1")
def merge_first_wins(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", _big(F.col("l_linenumber")).alias("name"), "l_orderkey", F.col("l_partkey").alias("owner"))
    return H.first_wins(rows, ["l_suppkey", "name"], ["l_orderkey", "owner"]).select("l_suppkey", "owner", "name")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey % 5 = p_partkey % 5)")
def relation_semi(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", F.expr("l_suppkey % 5").alias("m"))
    p = _t(spark, d, "part")
    return L.used_by(p, li, (p["p_partkey"] == li["l_partkey"]) & (p["p_partkey"] % 5 == li["m"])).select("p_partkey")


@query(
    f"{CLOSURE_SQL}, kept AS (SELECT p_partkey AS node FROM part WHERE p_size % 2 = 0), up AS (SELECT seed, w.node, min(depth) AS depth FROM walk w JOIN kept k ON w.node = k.node WHERE depth > 0 GROUP BY seed, w.node) SELECT k.node, a.parent, coalesce(a.n, 0) AS depth FROM kept k LEFT JOIN (SELECT seed, arg_min(node, depth) AS parent, count(*) AS n FROM up GROUP BY seed) a ON a.seed = k.node"
)
def outline_promote(spark, d):
    nodes = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return H.nearest_kept(nodes, _edges(spark, d), F.col("p_size") % 2 == 0)


TREE_SQL = "WITH RECURSIVE t(node, path) AS (SELECT p_partkey, [p_partkey] FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, list_append(path, p_partkey) FROM part JOIN t ON p_partkey // 2 = node AND p_partkey > 0)"


def _tree(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 2")).alias("parent"), F.lit(0).alias("ord"))


@query(f"{TREE_SQL}, n AS (SELECT a AS node, count(*) AS size FROM (SELECT unnest(path) AS a FROM t) GROUP BY a) SELECT node, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, size FROM t JOIN n USING (node)")
def tree_order(spark, d):
    """Places and subtree sizes of a walk of the heap tree of part keys: ancestor tests are ranges."""
    return H.tree_order(_tree(spark, d))


@query(
    f"{TREE_SQL}, s AS (SELECT p_partkey FROM part WHERE p_size % 10 = 0) SELECT node, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS place FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE p_partkey <> node AND list_contains(path, p_partkey))"
)
def tree_walk(spark, d):
    """The walk that does not go below parts of certain sizes."""
    return H.tree_walk(_tree(spark, d), _t(spark, d, "part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("node")))


WORDS_SQL = "SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS ref FROM documents"


ORDERED_SQL = "SELECT doc_id, list_extract(ws, i) AS ref, i - 1 AS place FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS ws, unnest(range(1, len(regexp_extract_all(text, '[a-zA-Z]+')) + 1)) AS i FROM documents)"


#: Characters of texts whose words a task counts.
CHARS_PER_TASK = 8_000_000


@query(f"SELECT doc_id, ref, count(*) AS n, CAST(min(place) AS BIGINT) AS first_place FROM ({ORDERED_SQL}) GROUP BY doc_id, ref")
def postings_build(spark, d):
    """Texts are dealt out by document, not their words with it: a document's words are counted where its text is."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_PER_TASK))
    words = docs.repartition(parts, "doc_id").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("place", "ref"))
    return R.postings(words, "doc_id", "ref", "place", places=False).select("doc_id", "ref", "n", _big(F.col("first")).alias("first_place"))


REFS = ["License", "password", "secret"]
SEARCH_SQL = f"SELECT doc_id, ref, count(*) AS n FROM ({WORDS_SQL}) WHERE ref IN ('License', 'password', 'secret') GROUP BY doc_id, ref"


@query(SEARCH_SQL)
def reference_search(spark, d):
    return postings_build(spark, d).where(F.col("ref").isin(REFS)).select("doc_id", "ref", "n")


@query(SEARCH_SQL)
def prefilter_verify(spark, d):
    """Documents that can hold a reference are found by plain containment first; the exact words decide."""
    docs = _t(spark, d, "documents").where(" or ".join(f"contains(text, '{r}')" for r in REFS))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("ref"))
    return words.where(F.col("ref").isin(REFS)).groupBy("doc_id", "ref").agg(F.count("*").alias("n"))


LINES_SQL = "SELECT doc_id, i - 1 AS line, lines[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query(f"SELECT doc_id, line, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(t) AS length FROM ({LINES_SQL})")
def line_table(spark, d):
    return P.line_table(_t(spark, d, "documents"), "doc_id", "text")


@query(
    f"SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, strlen(t) AS byte_length FROM ({LINES_SQL})"
)
def line_bytes(spark, d):
    return P.line_bytes(_t(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, strlen(left(text, CAST(length(text) // 2 AS BIGINT))) AS byte_ FROM documents")
def offset_to_byte(spark, d):
    return _t(spark, d, "documents").select("doc_id", P.byte_offset(F.col("text"), F.expr("length(text) div 2")).alias("byte_"))


@query("SELECT doc_id, length(text) // 2 AS offset_, CAST(length(left(text, CAST(length(text) // 2 AS BIGINT))) - length(replace(left(text, CAST(length(text) // 2 AS BIGINT)), chr(10), '')) AS BIGINT) AS line FROM documents")
def offset_to_line(spark, d):
    at = F.expr("length(text) div 2")
    return _t(spark, d, "documents").select("doc_id", at.alias("offset_"), P.offset_line(F.col("text"), at).alias("line"))


def _as_of(spark, d, inclusive):
    e = _t(spark, d, "events")
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    views = e.where("event_type = 'view'").select("user_id", hour.alias("h"), "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", hour.alias("h"), F.col("event_id").alias("probe"))
    return P.as_of(views, buys, "user_id", "h", F.col("event_id"), inclusive, "event_id").select("probe", F.col("found").alias("view_id"))


AS_OF_SQL = "WITH e AS (SELECT *, epoch_us(ts) // 3600000000 AS h FROM events) SELECT p.event_id AS probe, arg_max(v.event_id, (v.h, v.event_id)) AS view_id FROM e p LEFT JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.h {} p.h WHERE p.event_type = 'purchase' GROUP BY p.event_id"


@query(AS_OF_SQL.format("<="))
def asof_inclusive(spark, d):
    return _as_of(spark, d, True)


@query(AS_OF_SQL.format("<"))
def asof_strict(spark, d):
    return _as_of(spark, d, False)


@query(
    "WITH r AS (SELECT event_id AS rid, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 86400 + event_id % 7 * 3600 AS e FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type <> 'signup') SELECT p.event_id, arg_max(r.rid, (r.s, r.rid)) AS found, count(*) AS n_ranges FROM p JOIN r ON p.user_id = r.user_id AND p.at >= r.s AND p.at < r.e GROUP BY p.event_id"
)
def interval_stab(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    ranges = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("rid"), F.col("at").alias("s"), (F.col("at") + 86400 + F.col("event_id") % 7 * 3600).alias("e"))
    points = e.where("event_type <> 'signup'").select("user_id", "event_id", "at")
    return P.deepest(P.stab(ranges, points, "s", "e", "at", ["user_id"]), ["event_id"], ["s", "rid"], F.col("rid"))


@query("SELECT o_orderkey, count(*) FILTER (WHERE l_linenumber * 10 <= o_custkey % 70) AS active FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def active_param(spark, d):
    ends = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_big(F.col("l_linenumber") * 10)).alias("ends"))
    return _t(spark, d, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", P.active_parameter(F.col("ends"), F.col("o_custkey") % 70).alias("active"))


@query("SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def adjacent_doc(spark, d):
    return L.with_following(_t(spark, d, "conversations"), "conv_id", "turn", "role", "next_role")


@query("SELECT user_id, event_type, first_id FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type)")
def ordered_distinct(spark, d):
    return H.first_wins(_t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"]).withColumnRenamed("event_id", "first_id")


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY first_id) AS types FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def type_union(spark, d):
    firsts = ordered_distinct(spark, d)
    types = F.transform(F.sort_array(F.collect_list(F.struct("first_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("fqn"), F.lit(0).cast("long").alias("array_level")))
    return firsts.groupBy("user_id").agg(types.alias("t")).select("user_id", N.types_text(N.type_union(F.col("t"))).alias("types"))


def _versions(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("uri"), "text")
    listed = docs.where("uri % 11 <> 0").select("uri", F.sha1("text").alias("sha1"))
    stored = docs.where("uri % 7 <> 0").select("uri", F.sha1(F.when(F.col("uri") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha1"))
    return listed, stored


@query("SELECT doc_id AS uri, sha1(text) AS sha1 FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0)")
def change_detect(spark, d):
    return Y.changed(*_versions(spark, d))


@query(
    "SELECT doc_id AS uri, CASE WHEN doc_id % 7 = 0 THEN 'insert' WHEN doc_id % 11 = 0 THEN 'delete' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'keep' END AS status FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 <> 0"
)
def reconcile(spark, d):
    return Y.reconcile(*_versions(spark, d))


@query("SELECT doc_id AS uri, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN 'new' WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0")
def sync_upsert(spark, d):
    listed, stored = _versions(spark, d)
    new = Y.changed(listed, stored)
    return Y.replace_documents(stored.select("uri", F.lit("old").alias("version")), new.select("uri", F.lit("new").alias("version")), new)


@query("SELECT page_id FROM pages WHERE NOT (starts_with(url, 'http://blog.tionsh.example.net/') OR url = 'http://blog.tionsh.example.net')")
def folder_delete(spark, d):
    return Y.without_folder(_t(spark, d, "pages"), "url", "http://blog.tionsh.example.net/").select("page_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark, d):
    return Y.latest(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn DESC) AS text FROM (SELECT *, max(turn) FILTER (WHERE turn % 4 = 3) OVER (PARTITION BY conv_id) AS reset FROM conversations) WHERE reset IS NULL OR turn >= reset GROUP BY conv_id")
def edit_fold(spark, d):
    """Each turn is put before the text so far; every fourth replaces all."""
    c = _t(spark, d, "conversations")
    at = F.when(F.col("turn") % 4 != 3, F.lit(0))
    return Y.edit_fold(c.select("conv_id", "turn", at.alias("start"), at.alias("end"), "text"), "conv_id", "turn")


@query(
    "SELECT user_id, max(event_id) AS value, max(h) AS h, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY h) AS run FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h) < 43200 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS h FROM events))) GROUP BY user_id, run"
)
def debounce(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("h"))
    return Y.debounce(e, "user_id", "h", F.lit(43_200), F.col("event_id"))


@query(
    "SELECT c_custkey, CASE WHEN n_regionkey % 2 = 0 THEN '\\' || n_name ELSE '\\local\\' || 'N' || c_nationkey END AS resolved FROM customer JOIN nation ON n_nationkey = c_nationkey"
)
def resolve_alias(spark, d):
    """Names by an alias table where it has them, else under the current namespace."""
    aliases = _t(spark, d, "nation").where("n_regionkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("\\"), "n_name").alias("target"))
    uses = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("alias"))
    return L.aliased(uses, aliases, "alias", "target", F.lit("local")).select("c_custkey", "resolved")


@query("SELECT event_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts > v.ts)")
def unused_decl(spark, d):
    """Views that no later purchase follows."""
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return L.unread(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "ts").select("event_id")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type = 'PROMO') GROUP BY ALL")
def deprecated_refs(spark, d):
    flagged = _t(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    refs = _t(spark, d, "lineitem").select("l_orderkey", _big(F.col("l_linenumber")).alias("l_linenumber"), "l_partkey")
    return L.answered_by(refs, flagged, "l_partkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey) AS i FROM lineitem) SELECT a.l_orderkey, a.i - 1 AS i, l_partkey, l_suppkey FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.i = b.i"
)
def zip_signatures(spark, d):
    return L.zipped(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_suppkey", ["l_suppkey", "l_linenumber", "l_partkey"])


FUZZY_STEP = "list_transform(range(1, n + 1), lambda i: CASE WHEN c[i] = '{ch}' THEN list_max(list_transform(range(1, i), lambda j: s[j] + 16 + CASE WHEN j = i - 1 THEN greatest(b[i], 4) ELSE b[i] - 3 - (i - 2 - j) END)) END)"
FUZZY_SQL = f"""WITH t AS (SELECT p_partkey AS symbol_key, {SQL_CAMEL} AS name FROM part),
a AS (SELECT *, length(name) AS n, string_split(lower(name), '') AS c, list_transform(range(1, length(name) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(name[i - 1], '[A-Za-z0-9]') THEN 8 WHEN regexp_matches(name[i], '[A-Z]') AND regexp_matches(name[i - 1], '[a-z]') THEN 7 ELSE 0 END) AS b FROM t),
s1 AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN c[i] = 's' THEN 16 + 2 * b[i] END) AS s FROM a),
s2 AS (SELECT * REPLACE ({FUZZY_STEP.format(ch="m")} AS s) FROM s1),
s3 AS (SELECT * REPLACE ({FUZZY_STEP.format(ch="w")} AS s) FROM s2)
SELECT symbol_key, name, CAST(list_max(s) AS BIGINT) AS score FROM s3 WHERE list_max(s) > 0"""


@query(FUZZY_SQL)
def fuzzy_search(spark, d):
    """Names that a pattern matches as a subsequence, with their score."""
    rows = _symbols(spark, d).where(T.may_match(F.col("name"), "smw"))
    return rows.select("symbol_key", "name", T.fuzzy(F.col("name"), "smw").alias("score")).where("score > 0")


def _words(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("place", "ref"))


@query(
    "SELECT doc_id, CASE WHEN len(ls) <= 2 THEN length(text) ELSE least(length(ls[1]) + length(ls[2]) + 2 + 7, length(text)) END AS offset_ FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"
)
def position_to_offset(spark, d):
    """The place (line 2, character 7) of every document."""
    return _t(spark, d, "documents").where("text is not null").select("doc_id", P.position_offset(F.col("text"), F.lit(2), F.lit(7)).alias("offset_"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS versions FROM events GROUP BY user_id")
def ordered_insert(spark, d):
    got = P.ordered_versions(_t(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type"))
    return got.select("user_id", F.array_join("versions.value", "|").alias("versions"))


@query(
    "WITH e AS (SELECT *, epoch_us(ts) // 3600000000 AS h FROM events), b AS (SELECT user_id, h, max(event_id) AS event_id FROM e WHERE event_type = 'view' GROUP BY user_id, h) SELECT p.event_id AS probe, coalesce((SELECT arg_max(b.event_id, b.h) FROM b WHERE b.user_id = p.user_id AND b.h < p.h), (SELECT arg_min(b.event_id, b.h) FROM b WHERE b.user_id = p.user_id)) AS block FROM e p WHERE p.event_type = 'error'"
)
def import_block_asof(spark, d):
    """The last block that starts before a place, else the first."""
    e = _t(spark, d, "events").withColumn("h", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000"))
    blocks = e.where("event_type = 'view'").groupBy("user_id", "h").agg(F.max("event_id").alias("event_id"))
    probes = e.where("event_type = 'error'").select("user_id", "h", F.col("event_id").alias("probe"))
    return P.as_of_or_first(blocks, probes, "user_id", "h", F.col("event_id")).select("probe", F.col("found").alias("block"))


RANGES_SQL = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + l_orderkey % 9 AS e FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _ranges(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return rows.select("l_orderkey", "l_linenumber", "part", _big(F.col("l_linenumber") * 10).alias("s"), _big(F.col("l_linenumber") * 10 + 5 + F.col("l_orderkey") % 9).alias("e"))


def _points(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _big(F.col("o_custkey") % 75).alias("at"))


POINTS_SQL = "SELECT o_orderkey AS l_orderkey, o_custkey % 75 AS at FROM orders"


@query(f"SELECT p.l_orderkey, (SELECT arg_max(r.l_linenumber, r.s) FROM ({RANGES_SQL}) r WHERE r.l_orderkey = p.l_orderkey AND r.s <= p.at) AS line FROM ({POINTS_SQL}) p")
def node_before(spark, d):
    return P.before(_ranges(spark, d), _points(spark, d), "l_orderkey", "s", "at", F.col("l_linenumber")).select("l_orderkey", F.col("found").alias("line"))


@query(f"SELECT p.l_orderkey, (SELECT min(r.l_linenumber) FROM ({RANGES_SQL}) r WHERE r.l_orderkey = p.l_orderkey AND r.e > p.at) AS line FROM ({POINTS_SQL}) p")
def owner_of_position(spark, d):
    """The first range that does not end before a place."""
    return P.owner_of(_ranges(spark, d), _points(spark, d), "l_orderkey", "e", "l_linenumber", "at", F.col("l_linenumber")).select("l_orderkey", F.col("found").alias("line"))


@query(f"SELECT p.l_orderkey, string_agg(CAST(r.l_linenumber AS VARCHAR), '>' ORDER BY r.s, r.e DESC) AS spine FROM ({POINTS_SQL}) p JOIN ({RANGES_SQL}) r ON r.l_orderkey = p.l_orderkey AND p.at > r.s AND p.at <= r.e GROUP BY p.l_orderkey")
def spine_at_offset(spark, d):
    """All ranges around a place, outermost first."""
    got = P.spine(_ranges(spark, d), _points(spark, d), "s", "e", "at", ["l_orderkey"], F.col("l_linenumber").cast("string"))
    return got.select("l_orderkey", F.array_join("spine", ">").alias("spine"))


@query(f"SELECT p.l_orderkey, arg_max(r.l_linenumber, r.s) AS line FROM ({POINTS_SQL}) p JOIN ({RANGES_SQL}) r ON r.l_orderkey = p.l_orderkey AND p.at >= r.s AND p.at < r.e GROUP BY p.l_orderkey")
def scope_of_position(spark, d):
    """The innermost range that holds a place."""
    pairs = P.stab(_ranges(spark, d), _points(spark, d), "s", "e", "at", ["l_orderkey"])
    return P.deepest(pairs, ["l_orderkey"], ["s"], F.col("l_linenumber")).select("l_orderkey", F.col("found").alias("line"))


@query("SELECT user_id, string_agg(event_type || repeat('[]', lvl), '|' ORDER BY first_id) AS types FROM (SELECT user_id, event_type, min(event_id) AS first_id, CASE WHEN min(event_id) % 2 = 0 THEN 1 ELSE 0 END AS lvl FROM (SELECT * FROM events) GROUP BY user_id, event_type) GROUP BY user_id")
def type_union_shifted(spark, d):
    """The union of the types of odd events and, one array level up, of even ones, each type where it comes first."""
    e = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))
    one = lambda x: F.struct(x["event_type"].alias("fqn"), F.lit(0).cast("long").alias("array_level"))
    acc = F.aggregate("es", F.array().cast("array<struct<fqn:string,array_level:bigint>>"), lambda a, x: N.shift_union(a, F.array(one(x)), F.when(x["event_id"] % 2 == 0, 1).otherwise(0)))
    return e.select("user_id", N.types_text(acc).alias("types"))


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM part) WHERE r = 1")
def unique_values(spark, d):
    return S.unique_first(_t(spark, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", ["p_name", "p_partkey"])


@query("SELECT page_id, url FROM pages WHERE starts_with(replace(url, 'https://', 'file://'), 'file://')")
def navigatable_places(spark, d):
    return _t(spark, d, "pages").where(N.navigatable(F.replace("url", F.lit("https://"), F.lit("file://")))).select("page_id", "url")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_literal_set(spark, d):
    return _t(spark, d, "orders").where(S.in_set(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "1-URGENT"])).select("o_orderkey")


@query(
    "SELECT page_id, concat_ws('-', ss[len(ss)], array_to_string(list_transform(ss[1:len(ss)-1], lambda x: x[1]), ''), left(md5(url), 8)) AS short FROM (SELECT page_id, url, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS ss FROM pages)"
)
def short_uri_id(spark, d):
    return _t(spark, d, "pages").select("page_id", N.short_id(F.col("url")).alias("short"))


KINDS_SQL = "SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'close' ELSE event_type END AS kind FROM events"


def _kinds(spark, d):
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "change").when(F.col("event_type") == "purchase", "close").otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("user_id", "event_id", kind.alias("kind"))


@query(f"SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM ({KINDS_SQL}) WHERE kind IN ('open', 'change', 'close')) WHERE r = 1 AND kind <> 'close'")
def open_documents(spark, d):
    return Y.open_documents(_kinds(spark, d), "user_id", "event_id", "kind").select("user_id", "event_id", "kind")


@query(
    "SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER w, 0) AS BIGINT) AS wave, max(CASE WHEN event_type <> 'view' THEN event_id END) OVER w AS waits_for FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def ordered_dispatch(spark, d):
    """Views are parallel; everything else lets what follows wait."""
    return Y.dispatch(_t(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "view").select("event_id", "wave", "waits_for")


@query(f"WITH k AS ({KINDS_SQL}) SELECT event_id FROM k a WHERE kind = 'change' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.kind = 'close' AND b.user_id = a.user_id AND b.event_id % 10 = a.event_id % 10 AND b.event_id > a.event_id)")
def cancelled_requests(spark, d):
    k = _kinds(spark, d).withColumn("number", F.col("event_id") % 10)
    return Y.cancelled(k.where("kind = 'change'"), k.where("kind = 'close'"), "user_id", "number", "event_id").select("event_id")


@query(
    "SELECT d.doc_id AS uri, coalesce(string_agg(CAST(m.line AS VARCHAR), ',' ORDER BY m.line), '') AS lines FROM documents d LEFT JOIN (SELECT doc_id, i - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(ls[i], 'password')) m ON m.doc_id = d.doc_id WHERE d.doc_id % 3 = 0 GROUP BY d.doc_id"
)
def publish_lists(spark, d):
    """The full list of each document of a batch (here: a third of them), empty ones too."""
    from .streaming import publish

    docs = _t(spark, d, "documents")
    found = docs.select(F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).where(F.contains("t", F.lit("password"))).select("uri", "line")
    batch = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("uri"))
    return publish.by_document(found, batch).select("uri", F.array_join("diagnostics.line", ",").alias("lines"))


@query("SELECT p_partkey AS symbol_key FROM part WHERE regexp_matches(lower(replace(p_name, ' ', '')), 's.*m.*w')")
def fuzzy_candidates(spark, d):
    """Names that hold a pattern's characters in order: all that a fuzzy score can be positive for."""
    return _symbols(spark, d).where(T.may_match(F.col("name"), "smw")).select("symbol_key")

"""Requests on a code base that is derived from the driver's tables: a file of source per part, which grows with the table, with SQL.

Part k is a class below the class of part k div 2, with members, traits, interfaces, functions and constants by its key and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import _t, query
from .operators import lookup as L
from .operators import references as R
from .operators import stored as K
from .plans.engine import Catalog
from .sources import php


def _files(spark, d):
    """(uri, content): the source of each part, dealt out by key: the table's few bytes are one split, its files' work is not one task's.

    The part above is found by a merge: a table of few bytes may hold more rows than the driver has room to broadcast."""
    table = _t(spark, d, "part")
    part = table.select(F.col("p_partkey").cast("string").alias("k"), F.initcap("p_type").alias("t"), F.col("p_size").cast("string").alias("size"), "p_partkey", F.expr("p_partkey div 2").alias("up"))
    above = part.select(F.col("p_partkey").alias("up"), F.col("k").alias("pk"), F.col("t").alias("pt"))
    rows = part.join(above.hint("merge"), "up", "left").withColumn("pk", F.when(F.col("p_partkey") > 0, F.col("pk"))).repartition(php.tasks(spark, table.count()), "p_partkey")
    every = lambda n, *text: F.when(F.col("p_partkey") % n == 0, F.concat(*text)).otherwise("")
    c = lambda *x: F.concat(*[F.col(v[1:]) if v.startswith("@") else F.lit(v) for v in x])
    child = F.col("pk").isNotNull()
    content = F.concat(
        c("<?php\nnamespace App\\", "@t", ";\n"), F.when(child, c("use App\\", "@pt", "\\P", "@pk", ";\n")).otherwise(""), every(3, c("use App\\Tools\\Spare", "@k", ";\n")),
        every(10, c("/** Part.\n * @deprecated since ", "@size", "\n */\n")), c("class P", "@k"), F.when(child, c(" extends P", "@pk")).otherwise(""), every(5, c(" implements Sized", "@k")), F.lit(" {\n"),
        every(7, c("  use Marks", "@k", ";\n")), c("  const SIZE = ", "@size", ";\n  public $label;\n  protected $brand;\n  private static $count = 0;\n"),
        c("  public function show"), (F.col("p_partkey") % 4).cast("string"), c("() { $spare = 1; $made = make_", "@k", "(); return $made; }\n  protected function weigh() {}\n  private function hide() {}\n"),
        c("  public static function make() { return new P", "@k", "(); }\n}\n"),
        every(5, c("interface Sized", "@k", " { public function size(); }\n")), every(7, c("trait Marks", "@k", " { public function mark", "@k", "() {} }\n")),
        c("function make_", "@k", "($n = 1) { return new P", "@k", "(); }\nconst LIMIT_", "@k", " = ", "@size", ";\ndefine('FLAG_", "@k", "', 1);\n"),
    )
    return rows.select(F.concat(F.lit("file:///src/P"), "k", F.lit(".php")).alias("uri"), content.alias("content"))


def _code(spark, d) -> Catalog:
    """The catalog of those files, extracted once for a state of the table."""
    rows = K.keep(_t(spark, d, "part"), "code", lambda: php.extract(_files(spark, d)), lambda df, to: df.write.partitionBy("tag").parquet(to))
    return Catalog(rows.select(*php.COLUMNS))


#: The parts as classes: key, namespace, class, and the same of the part above.
CODE_SQL = r"""WITH RECURSIVE n AS (SELECT p_partkey AS k, '\App\' || upper(p_type[1]) || lower(p_type[2:]) AS ns, p_size AS size FROM part), c AS (SELECT n.k, n.ns, n.size, n.ns || '\P' || n.k AS cls, a.ns || '\P' || a.k AS up, a.k AS upk, 'file:///src/P' || n.k || '.php' AS uri FROM n LEFT JOIN n a ON n.k > 0 AND a.k = n.k // 2)"""
SYMBOLS_SQL = CODE_SQL + r""", s AS (
SELECT k, 'class' AS kind, '' AS owner, 'P' || k AS name, cls AS fqn FROM c UNION ALL SELECT k, 'class_const', cls, 'SIZE', 'SIZE' FROM c UNION ALL SELECT k, 'property', cls, x, x FROM c, (VALUES ('$label'), ('$brand'), ('$count')) v(x)
UNION ALL SELECT k, 'method', cls, x, x FROM c, (VALUES ('weigh'), ('hide'), ('make')) v(x) UNION ALL SELECT k, 'method', cls, 'show' || k % 4, 'show' || k % 4 FROM c
UNION ALL SELECT k, 'interface', '', 'Sized' || k, ns || '\Sized' || k FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'method', ns || '\Sized' || k, 'size', 'size' FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'trait', '', 'Marks' || k, ns || '\Marks' || k FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'method', ns || '\Marks' || k, 'mark' || k, 'mark' || k FROM c WHERE k % 7 = 0
UNION ALL SELECT k, 'function', '', 'make_' || k, ns || '\make_' || k FROM c UNION ALL SELECT k, 'const', '', 'LIMIT_' || k, ns || '\LIMIT_' || k FROM c UNION ALL SELECT k, 'define', '', 'FLAG_' || k, '\FLAG_' || k FROM c)"""
WALK_SQL = CODE_SQL + ", walk(seed, k, depth) AS (SELECT k, k, 0 FROM c UNION ALL SELECT seed, c.upk, depth + 1 FROM walk JOIN c USING (k) WHERE c.upk IS NOT NULL), w AS (SELECT s.cls AS seed, c.*, depth FROM walk JOIN c s ON s.k = seed JOIN c ON c.k = walk.k)"


@query(f"{SYMBOLS_SQL} SELECT kind, owner, name, fqn FROM s")
def source_symbols(spark, d):
    """All declarations of the code base."""
    return _code(spark, d).symbols.select("kind", "owner", "name", "fqn")


@query(
    f"{SYMBOLS_SQL} SELECT kind, owner, name, CASE WHEN name IN ('hide', '$count') THEN 2 WHEN name IN ('weigh', '$brand') THEN 1 ELSE 0 END AS visibility, CASE WHEN kind <> 'class_const' THEN name IN ('make', '$count') END AS is_static FROM s WHERE owner <> ''"
)
def source_members(spark, d):
    """Members with what restricts their access."""
    return _code(spark, d).symbols.where("owner <> ''").select("kind", "owner", "name", "visibility", "is_static")


@query(rf"{CODE_SQL} SELECT 'extends' AS kind, cls AS child, up AS parent FROM c WHERE up IS NOT NULL UNION ALL SELECT 'implements', cls, ns || '\Sized' || k FROM c WHERE k % 5 = 0 UNION ALL SELECT 'use', cls, ns || '\Marks' || k FROM c WHERE k % 7 = 0")
def source_edges(spark, d):
    """What classes extend, implement and use; names are resolved by imports and namespaces."""
    return _code(spark, d).edges.select("kind", "child", "parent")


@query(rf"{CODE_SQL} SELECT uri, 'P' || upk AS name, up AS fqn FROM c WHERE up IS NOT NULL UNION ALL SELECT uri, 'Spare' || k, '\App\Tools\Spare' || k FROM c WHERE k % 3 = 0")
def source_imports(spark, d):
    return _code(spark, d).imports.where("kind = 'class'").select("uri", "name", "fqn")


@query(rf"{CODE_SQL} SELECT uri, '\App\Tools\Spare' || k AS fqn FROM c WHERE k % 3 = 0")
def source_unused_imports(spark, d):
    return _code(spark, d).unused_imports().select("uri", "fqn")


@query(f"{CODE_SQL} SELECT uri, '$spare' AS name FROM c")
def source_unused_variables(spark, d):
    return _code(spark, d).unused_variables().select("uri", "name")


@query(f"{CODE_SQL} SELECT uri, cls AS ref, 3 AS n FROM c UNION ALL SELECT uri, up, 1 FROM c WHERE up IS NOT NULL")
def source_class_references(spark, d):
    """Postings of the classes: declared and made twice in their own file, once in the file of each class below."""
    code = _code(spark, d)
    classes = code.symbols.where("kind = 'class'").select("fqn").distinct()
    return R.postings(L.declared(code.references, classes, "ref", "fqn").drop("fqn"), "uri", "ref", "start_line", places=False).select("uri", "ref", "n")


@query(rf"{CODE_SQL} SELECT uri, ns || '\make_' || k || '()' AS ref, 2 AS n FROM c")
def source_function_references(spark, d):
    """Postings of the functions: declared once and called once."""
    code = _code(spark, d)
    names = code.symbols.where("kind = 'function'").select(F.concat("fqn", F.lit("()")).alias("fqn")).distinct()
    return R.postings(L.declared(code.references, names, "ref", "fqn").drop("fqn"), "uri", "ref", "start_line", places=False).select("uri", "ref", "n")


@query(f"{CODE_SQL} SELECT cls AS fqn, 'since ' || size AS deprecated, 2 AS n FROM c WHERE k % 10 = 0")
def source_deprecated(spark, d):
    """Uses of deprecated classes."""
    return _code(spark, d).deprecated_references().groupBy("fqn", "deprecated").agg(F.count("*").alias("n"))


@query(rf"{CODE_SQL} SELECT uri, 'P' || k AS used, cls AS fqn, 2 AS n FROM c UNION ALL SELECT uri, 'make_' || k, ns || '\make_' || k, 1 FROM c")
def source_definitions(spark, d):
    """Every access with the declaration that answers it."""
    return _code(spark, d).definitions().groupBy("uri", "used", "fqn").agg(F.count("*").alias("n"))


@query(rf"{CODE_SQL} SELECT DISTINCT '' AS scope, 'app' AS token, ns FROM c UNION SELECT '\App', lower(ns[6:]), ns FROM c")
def source_namespaces(spark, d):
    return _code(spark, d).namespaces()


@query(
    rf"{WALK_SQL}, m AS (SELECT seed, 'show' || k % 4 AS name, cls AS owner, 0 AS phase, depth FROM w UNION ALL SELECT seed, 'make', cls, 0, depth FROM w UNION ALL SELECT seed, 'mark' || k, ns || '\Marks' || k, 0, depth FROM w WHERE k % 7 = 0 UNION ALL SELECT seed, 'size', ns || '\Sized' || k, 1, depth FROM w WHERE k % 5 = 0) SELECT seed, name, arg_min(owner, (phase, depth)) AS owner FROM m GROUP BY seed, name"
)
def source_instance_methods(spark, d):
    """What an instance of each class has in public: its own methods, then those of traits, of the classes above and of interfaces."""
    code = _code(spark, d)
    return code.instance_members("method", code.symbols.where("kind = 'class'").select(F.col("fqn").alias("seed"))).select("seed", "name", "owner")


@query(f"{CODE_SQL} SELECT cls AS seed, 'SIZE' AS name, cls AS owner, CAST(size AS VARCHAR) AS value FROM c")
def source_class_consts(spark, d):
    """Constants of each class; one that a class states itself hides those above."""
    code = _code(spark, d)
    return code.static_members("class_const", code.symbols.where("kind = 'class'").select(F.col("fqn").alias("seed"))).select("seed", "name", "owner", "value")


@query(f"{CODE_SQL} SELECT cls AS seed, 'make' AS name, cls AS owner FROM c")
def source_static_methods(spark, d):
    code = _code(spark, d)
    return code.static_members("method", code.symbols.where("kind = 'class'").select(F.col("fqn").alias("seed"))).select("seed", "name", "owner")


def _names(spark, d):
    """A probe of each kind for each part, classes in another case."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("\\App\\"), F.initcap("p_type"), F.lit("\\")).alias("ns"))
    kinds = [("class", "p"), ("function", "make_"), ("const", "LIMIT_"), ("interface", "Sized"), ("trait", "Marks"), ("define", None)]
    of = [F.struct(F.lit(kind).alias("kind"), (F.concat("ns", F.lit(short), F.col("k").cast("string")) if short else F.concat(F.lit("\\FLAG_"), F.col("k").cast("string"))).alias("probe")) for kind, short in kinds]
    return part.select(F.explode(F.array(*of)).alias("x")).select("x.*")


@query(rf"{SYMBOLS_SQL} SELECT kind, CASE kind WHEN 'class' THEN regexp_replace(fqn, 'P(\d+)$', 'p\1') ELSE fqn END AS probe, fqn FROM s WHERE kind IN ('class', 'function', 'const', 'interface', 'trait', 'define')")
def source_lookups(spark, d):
    """Declarations by name, many at once; classes whatever the case of the last segment."""
    return _code(spark, d).find_many(_names(spark, d)).select("kind", "probe", "fqn")


WORDS = [("class", "p1"), ("interface", "sized2"), ("trait", "marks"), ("function", "make_1"), ("const", "limit_3"), ("define", "flag_"), ("method", "show2"), ("property", "lab"), ("class_const", "siz"), ("class", "zz")]
WORDS_SQL = ", ".join(f"({i}, '{kind}', '{word}')" for i, (kind, word) in enumerate(WORDS))


@query(f"{SYMBOLS_SQL}, q(search, kind, word) AS (VALUES {WORDS_SQL}) SELECT CAST(search AS BIGINT) AS search, least(count(*), 40) AS n, count(*) <= 40 AS is_complete FROM q JOIN s USING (kind) WHERE starts_with(lower(ltrim(name, '$')), word) GROUP BY search")
def source_searches(spark, d):
    """A search of each kind of symbol, all at once, with a limit each."""
    searches = spark.createDataFrame([(i, kind, 0, word) for i, (kind, word) in enumerate(WORDS)], "search long, kind string, word_ord int, word string")
    found = _code(spark, d).search_many(searches, 40)
    return found.groupBy("search").agg(F.count("*").alias("n"), F.first("is_complete").alias("is_complete"))

"""Requests at places, types and lookups on a small code base held here, with their expected rows as SQL values (worked out by hand)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import query
from .functions import names as N
from .plans.cursor import Cursor, markdown, symbol_rows
from .plans.engine import Catalog
from .sources import php

USER, OTHER, BASE, DRAFT = "file:///app/user.php", "file:///app/other.php", "file:///lib/base.php", "file:///app/draft.php"
FILES = {
    USER: r"""<?php
namespace App;
use Lib\Base;
use function Lib\help;
/** A <b>user</b>. */
class User extends Base implements Named {
  use Greets;
  /** @deprecated 2 use CAP */ const LIMIT = 5;
  /** @var Base */
  private $inner;
  private $made;
  public static $count = 0;
  /** @return static */
  public function copy() { return $this; }
  public function __construct(Base $b, $n = 1) { $this->inner = $b; $this->made = new Other(1, $n); }
  public function other(): Other { return $this->made; }
  /** @return Other[] */
  public function many() { return []; }
  public function go($list) {
    $x = $this->copy()->other()->deep($this->inner, 2);
    foreach ($this->many() as $k => $v) { $v->deep($x, $k); }
    try { $q = $x; } catch (Broken | Lost $e) { $e->text(); }
    if ($list instanceof Base) { $list->run(1); }
    $f = function ($z) use ($x) { return $x->run($z); };
    $s = static::make(); parent::run(2); self::$count; User::LIMIT; User::FAR;
    return help($x->id, 3)->run(4);
  }
}
/** @property int $size */
interface Named { public function many(); }
trait Greets { public function greet($who) { return FLAG . APP_KIND; } }
const APP_KIND = 'app';
define('FLAG', 1);
""",
    OTHER: r"""<?php
namespace App;
class Other {
  /** @return \Lib\Base */
  public function deep($a, $b) {}
  public function __construct($one, $two) {}
  private $hid;
}
""",
    BASE: r"""<?php
namespace Lib;
class Base {
  protected const FAR = 9;
  public $id;
  public function run($n) { return new \app\other(1, 2); }
  /** @return static */
  public static function make() {}
  private function own() {}
}
/** @return Base */
function help($a, $b) {}
/** @global Base $main */
global $main;
$main->run(5);
""",
}

_KEPT: dict[str, Cursor] = {}


def _cursor(spark: SparkSession) -> Cursor:
    """The code base and its inference, once for a session."""
    key = spark.sparkContext.applicationId
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Cursor(Catalog(php.extract(spark.createDataFrame(sorted(FILES.items()), "uri string, content string")).persist()))
    return _KEPT[key]


def _file(uri: str) -> F.Column:
    return F.regexp_extract(uri, "([a-z]+)\\.php$", 1)


def _types(spark: SparkSession, *kinds: str) -> DataFrame:
    c = _cursor(spark)
    nodes = c.inference.nodes.where(F.col("kind").isin(*kinds)).select("uri", "node", "name", F.col("start_line").alias("line"), "start_char")
    t = F.concat("fqn", F.repeat(F.lit("[]"), F.col("level").cast("int")))
    return nodes.join(c.inference.types, ["uri", "node"]).select(_file("uri").alias("file"), "line", F.col("start_char").alias("pos"), "name", t.alias("type"))


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, name, type FROM (VALUES
    ('user', 19, 16, 'copy', '\App\User'),
    ('user', 19, 24, 'other', '\App\Other'),
    ('user', 19, 33, 'deep', '\Lib\Base'),
    ('user', 20, 20, 'many', '\App\Other[]'),
    ('user', 20, 46, 'deep', '\Lib\Base'),
    ('user', 24, 17, 'make', '\App\User')
    ) t(file, line, pos, name, type)"""
)
def code_method_types(spark, d):
    return _types(spark, "method", "static_method")


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, name, type FROM (VALUES
    ('user', 14, 56, 'inner', '\Lib\Base'),
    ('user', 14, 75, 'made', '\App\Other'),
    ('user', 15, 49, 'made', '\App\Other'),
    ('user', 19, 45, 'inner', '\Lib\Base')
    ) t(file, line, pos, name, type)"""
)
def code_property_types(spark, d):
    return _types(spark, "property", "static_property")


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, name, type FROM (VALUES
    ('user', 25, 11, 'help', '\Lib\Base')
    ) t(file, line, pos, name, type)"""
)
def code_function_types(spark, d):
    return _types(spark, "function")


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, name, type FROM (VALUES
    ('base', 13, 7, '$main', '\Lib\Base'),
    ('base', 14, 0, '$main', '\Lib\Base'),
    ('user', 14, 35, '$b', '\Lib\Base'),
    ('user', 14, 64, '$b', '\Lib\Base'),
    ('user', 19, 4, '$x', '\Lib\Base'),
    ('user', 20, 36, '$v', '\App\Other'),
    ('user', 20, 36, '$v', '\App\Other'),
    ('user', 20, 42, '$v', '\App\Other'),
    ('user', 20, 51, '$x', '\Lib\Base'),
    ('user', 21, 10, '$q', '\Lib\Base'),
    ('user', 21, 15, '$x', '\Lib\Base'),
    ('user', 21, 42, '$e', '\App\Broken'),
    ('user', 21, 42, '$e', '\App\Lost'),
    ('user', 21, 48, '$e', '\App\Broken'),
    ('user', 21, 48, '$e', '\App\Lost'),
    ('user', 22, 33, '$list', '\Lib\Base'),
    ('user', 22, 8, '$list', '\Lib\Base'),
    ('user', 23, 28, '$x', '\Lib\Base'),
    ('user', 23, 41, '$x', '\Lib\Base'),
    ('user', 24, 4, '$s', '\App\User'),
    ('user', 25, 16, '$x', '\Lib\Base')
    ) t(file, line, pos, name, type)"""
)
def code_variable_types(spark, d):
    """By assignment, loop, catch, instanceof, closure, parameter and global."""
    return _types(spark, "variable", "element", "global", "parameter")


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, name, type FROM (VALUES
    ('base', 5, 39, '\app\other', '\app\other'),
    ('user', 13, 34, '$this', '\App\User'),
    ('user', 14, 49, '$this', '\App\User'),
    ('user', 14, 68, '$this', '\App\User'),
    ('user', 14, 86, 'Other', '\App\Other'),
    ('user', 15, 42, '$this', '\App\User'),
    ('user', 19, 38, '$this', '\App\User'),
    ('user', 19, 9, '$this', '\App\User'),
    ('user', 20, 13, '$this', '\App\User'),
    ('user', 21, 28, 'Broken', '\App\Broken'),
    ('user', 21, 37, 'Lost', '\App\Lost'),
    ('user', 24, 25, 'parent', '\Lib\Base'),
    ('user', 24, 41, 'self', '\App\User'),
    ('user', 24, 55, 'User', '\App\User'),
    ('user', 24, 68, 'User', '\App\User'),
    ('user', 24, 9, 'static', '\App\User'),
    ('user', 5, 19, 'Base', '\Lib\Base')
    ) t(file, line, pos, name, type)"""
)
def code_relative_scope_types(spark, d):
    return _types(spark, "class", "this", "new")


@query(
    r"""SELECT CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS type WHERE false"""
)
def code_constant_types(spark, d):
    """Constants have no types."""
    return _types(spark, "class_const", "const")


@query(
    r"""SELECT CAST(line AS INTEGER) AS line, kind, name, fqn, member, file, CAST(pos AS INTEGER) AS pos FROM (VALUES
    (14, 'new', 'Other', '\App\Other', '__construct', 'other', 5),
    (14, 'property', 'inner', '\App\User', '$inner', 'user', 9),
    (14, 'property', 'made', '\App\User', '$made', 'user', 10),
    (14, 'type', 'Base', '\Lib\Base', '', 'base', 2),
    (15, 'property', 'made', '\App\User', '$made', 'user', 10),
    (15, 'type', 'Other', '\App\Other', '', 'other', 2),
    (19, 'method', 'copy', '\App\User', 'copy', 'user', 13),
    (19, 'method', 'deep', '\App\Other', 'deep', 'other', 4),
    (19, 'method', 'other', '\App\User', 'other', 'user', 15),
    (19, 'property', 'inner', '\App\User', '$inner', 'user', 9),
    (20, 'method', 'deep', '\App\Other', 'deep', 'other', 4),
    (20, 'method', 'many', '\App\User', 'many', 'user', 17),
    (22, 'method', 'run', '\Lib\Base', 'run', 'base', 5),
    (22, 'type', 'Base', '\Lib\Base', '', 'base', 2),
    (23, 'method', 'run', '\Lib\Base', 'run', 'base', 5),
    (24, 'class', 'User', '\App\User', '', 'user', 5),
    (24, 'class', 'User', '\App\User', '', 'user', 5),
    (24, 'class', 'parent', '\Lib\Base', '', 'base', 2),
    (24, 'class', 'self', '\App\User', '', 'user', 5),
    (24, 'class', 'static', '\App\User', '', 'user', 5),
    (24, 'class_const', 'FAR', '\Lib\Base', 'FAR', 'base', 3),
    (24, 'class_const', 'LIMIT', '\App\User', 'LIMIT', 'user', 7),
    (24, 'static_method', 'make', '\Lib\Base', 'make', 'base', 7),
    (24, 'static_method', 'run', '\Lib\Base', 'run', 'base', 5),
    (24, 'static_property', '$count', '\App\User', '$count', 'user', 11),
    (25, 'function', 'help', '\Lib\help', 'help', 'base', 11),
    (25, 'method', 'run', '\Lib\Base', 'run', 'base', 5),
    (25, 'property', 'id', '\Lib\Base', '$id', 'base', 4),
    (30, 'const', 'APP_KIND', '\App\APP_KIND', '', 'user', 31),
    (30, 'const', 'FLAG', '\FLAG', '', 'user', 32),
    (5, 'class', 'Base', '\Lib\Base', '', 'base', 2),
    (5, 'interface', 'Named', '\App\Named', '', 'user', 29),
    (6, 'trait', 'Greets', '\App\Greets', '', 'user', 30)
    ) t(line, kind, name, fqn, member, file, pos)"""
)
def code_definitions_of_accesses(spark, d):
    c = _cursor(spark)
    nodes = c.inference.nodes.select("uri", "node", "kind", "name", F.col("start_line").alias("line"))
    return nodes.join(c.inference.definitions, ["uri", "node"]).where(F.col("uri") == USER).select("line", "kind", "name", "fqn", "member", _file("target_uri").alias("file"), F.col("target_line").alias("pos"))


@query(
    r"""SELECT fqn, member, CAST(target_line AS INTEGER) AS target_line FROM (VALUES
    ('\App\Other', 'deep', 4)
    ) t(fqn, member, target_line)"""
)
def code_definition_at(spark, d):
    return _cursor(spark).definition(USER, 19, 35).select("fqn", "member", "target_line")


@query(
    r"""SELECT markdown FROM (VALUES
    ('```php' || chr(10) || '\Lib\Base $x' || chr(10) || '```'),
    ('```php' || chr(10) || 'const \App\User::LIMIT = 5' || chr(10) || '```'),
    ('```php' || chr(10) || 'function \Lib\help($a, $b): \Lib\Base' || chr(10) || '```'),
    ('```php' || chr(10) || 'public function \App\Other::deep($a, $b): \Lib\Base' || chr(10) || '```')
    ) t(markdown)"""
)
def code_hover_at(spark, d):
    c = _cursor(spark)
    return reduce(DataFrame.unionByName, [c.hover(USER, *at) for at in ((19, 35), (23, 42), (2, 9), (25, 12), (24, 63))])


@query(
    r"""SELECT label, CAST(active AS BIGINT) AS active FROM (VALUES
    ('__construct($one, $two)', 1),
    ('deep($a, $b)', 1)
    ) t(label, active)"""
)
def code_signature_help(spark, d):
    c = _cursor(spark)
    return c.signature_help(USER, 19, 53).select("label", "active").unionByName(c.signature_help(USER, 14, 97).select("label", "active")).unionByName(c.signature_help(USER, 19, 53, ")").select("label", "active"))


@query(
    r"""SELECT CAST(line AS INTEGER) AS line, CAST(character AS INTEGER) AS character, CAST(i AS INTEGER) AS i, parameter FROM (VALUES
    (14, 92, 0, '$one'),
    (14, 95, 1, '$two'),
    (19, 38, 0, '$a'),
    (19, 52, 1, '$b'),
    (20, 51, 0, '$a'),
    (20, 55, 1, '$b'),
    (22, 44, 0, '$n'),
    (23, 49, 0, '$n'),
    (24, 37, 0, '$n'),
    (25, 16, 0, '$a'),
    (25, 24, 1, '$b'),
    (25, 32, 0, '$n')
    ) t(line, character, i, parameter)"""
)
def code_document_signatures(spark, d):
    return _cursor(spark).document_signatures(USER)


@query(
    r"""SELECT kind, CAST(line AS INTEGER) AS line, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(n AS BIGINT) AS n FROM (VALUES
    ('function', 25, 15, 26, 2),
    ('function', 32, 6, 17, 2),
    ('method', 19, 20, 22, 0),
    ('method', 19, 29, 31, 0),
    ('method', 19, 37, 54, 2),
    ('method', 20, 24, 26, 0),
    ('method', 20, 50, 58, 2),
    ('method', 21, 56, 58, 0),
    ('method', 22, 43, 46, 1),
    ('method', 23, 48, 52, 1),
    ('method', 25, 31, 34, 1),
    ('new', 14, 91, 98, 2),
    ('static_method', 24, 21, 23, 0),
    ('static_method', 24, 36, 39, 1)
    ) t(kind, line, a, b, n)"""
)
def code_argument_lists(spark, d):
    c = _cursor(spark)
    lists = c.catalog.rows.where(F.col("tag") == "arguments").select("uri", "seq", "kind", F.col("start_line").alias("line"), F.col("start_char").alias("a"), F.col("end_char").alias("b"))
    n = c.catalog.rows.where(F.col("tag") == "argument").groupBy("uri", F.col("value").cast("long").alias("seq")).agg(F.count("*").alias("n"))
    return lists.join(n, ["uri", "seq"], "left").where(F.col("uri") == USER).select("kind", "line", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    r"""SELECT CAST(line AS INTEGER) AS line, name, member, file, CAST(pos AS INTEGER) AS pos FROM (VALUES
    (14, 'Other', '__construct', 'other', 5),
    (19, 'copy', 'copy', 'user', 13),
    (19, 'deep', 'deep', 'other', 4),
    (19, 'other', 'other', 'user', 15),
    (20, 'deep', 'deep', 'other', 4),
    (20, 'many', 'many', 'user', 17),
    (22, 'run', 'run', 'base', 5),
    (23, 'run', 'run', 'base', 5),
    (24, 'make', 'make', 'base', 7),
    (24, 'run', 'run', 'base', 5),
    (25, 'help', 'help', 'base', 11),
    (25, 'run', 'run', 'base', 5)
    ) t(line, name, member, file, pos)"""
)
def code_callables(spark, d):
    c = _cursor(spark)
    nodes = c.inference.nodes.select("uri", "node", "name", F.col("start_line").alias("line"))
    return nodes.join(c.inference.callables, ["uri", "node"]).where(F.col("uri") == USER).select("line", "name", "member", _file("target_uri").alias("file"), F.col("target_line").alias("pos"))


@query(
    r"""SELECT ref, file, CAST(line AS INTEGER) AS line FROM (VALUES
    ('.deep()', 'other', 4),
    ('.deep()', 'user', 19),
    ('.deep()', 'user', 20),
    ('\Lib\help()', 'base', 11),
    ('\Lib\help()', 'user', 25)
    ) t(ref, file, line)"""
)
def code_references_at(spark, d):
    c = _cursor(spark)
    return c.references(USER, 19, 35).unionByName(c.references(USER, 25, 13)).select("ref", _file("uri").alias("file"), F.col("start_line").alias("line"))


@query(
    r"""SELECT CAST(line AS INTEGER) AS line, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, new_text FROM (VALUES
    (19, 4, 6, '$y'),
    (20, 51, 53, '$y'),
    (21, 15, 17, '$y'),
    (23, 28, 30, '$y'),
    (25, 16, 18, '$y')
    ) t(line, a, b, new_text)"""
)
def code_rename_variable(spark, d):
    return _cursor(spark).rename(USER, 19, 5, "$y").select(F.col("start_line").alias("line"), F.col("start_char").alias("a"), F.col("end_char").alias("b"), "new_text")


@query(
    r"""SELECT tag, kind, name FROM (VALUES
    ('argument', 'method', '0'),
    ('arguments', 'method', ''),
    ('expr', 'this', '$this'),
    ('scope', 'file', ''),
    ('scope', 'method', 'go'),
    ('symbol', 'class', 'User'),
    ('symbol', 'method', 'go')
    ) t(tag, kind, name)"""
)
def code_spine(spark, d):
    return _cursor(spark).spine(USER, 19, 41).select("tag", "kind", "name")


@query(
    r"""SELECT kind, name FROM (VALUES
    ('file', ''),
    ('function', ''),
    ('method', 'go')
    ) t(kind, name)"""
)
def code_scope_at(spark, d):
    c = _cursor(spark)
    return reduce(DataFrame.unionByName, [c.scope_at(USER, *at).select("kind", "name") for at in ((19, 5), (23, 42), (2, 3))])


@query(
    r"""SELECT fqn FROM (VALUES
    ('\App\Named'),
    ('\App\User'),
    ('\App\User')
    ) t(fqn)"""
)
def code_class_at(spark, d):
    """The class around a place, else the next one of the file."""
    c = _cursor(spark)
    return c.class_at(USER, 19, 5).select("fqn").unionByName(c.class_at(USER, 2, 0).select("fqn")).unionByName(c.class_at(USER, 28, 3).select("fqn"))


@query(
    r"""SELECT kind, name, CAST(depth AS INTEGER) AS depth FROM (VALUES
    ('class', 'Other', 0),
    ('method', '__construct', 1),
    ('method', 'deep', 1),
    ('property', '$hid', 1)
    ) t(kind, name, depth)"""
)
def code_traverse(spark, d):
    return _cursor(spark).traverse(OTHER).select("kind", "name", "depth")


@query(
    r"""SELECT kind, name FROM (VALUES
    ('method', 'copy')
    ) t(kind, name)"""
)
def code_node_before(spark, d):
    return _cursor(spark).node_before(USER, 19, 20).select("kind", "name")


@query(
    r"""SELECT space, imports FROM (VALUES
    ('\App', '\Lib\Base,\Lib\help')
    ) t(space, imports)"""
)
def code_namespace_at(spark, d):
    return _cursor(spark).imports_at(USER, 19, 5).select("space", F.array_join("imports.fqn", ",").alias("imports"))


@query(
    r"""SELECT word, file, fqn, label, edit, CAST(edit_line AS INTEGER) AS edit_line FROM (VALUES
    ('Ba', 'other', '\App\Other', 'Other', NULL, NULL),
    ('Ba', 'other', '\FLAG', 'FLAG', NULL, NULL),
    ('Ba', 'other', '\Lib\Base', 'Base', 'use Lib\Base;', 1),
    ('Ba', 'other', '\Lib\help', 'help', 'use function Lib\help;', 1),
    ('Ba', 'user', '\App\Other', 'Other', NULL, NULL),
    ('Ba', 'user', '\FLAG', 'FLAG', NULL, NULL),
    ('Ba', 'user', '\Lib\Base', 'Base', NULL, NULL),
    ('Ba', 'user', '\Lib\help', 'help', 'use function Lib\help;', 3),
    ('Lib\Ba', 'other', '\App\Other', 'Other', 'use App\Other;', 1),
    ('Lib\Ba', 'other', '\FLAG', 'FLAG', NULL, NULL),
    ('Lib\Ba', 'other', '\Lib\Base', 'Base', 'use Lib;', 1),
    ('Lib\Ba', 'other', '\Lib\help', 'help', 'use Lib;', 1),
    ('\Li', 'other', '\App\Other', 'Other', NULL, NULL),
    ('\Li', 'other', '\FLAG', 'FLAG', NULL, NULL),
    ('\Li', 'other', '\Lib\Base', 'Base', NULL, NULL),
    ('\Li', 'other', '\Lib\help', 'help', NULL, NULL)
    ) t(word, file, fqn, label, edit, edit_line)"""
)
def code_labels(spark, d):
    """Labels at a place of the user's file, with the import that each needs."""
    c = _cursor(spark)
    asked = c.catalog.symbols.where("fqn in ('\\\\Lib\\\\Base', '\\\\App\\\\Other', '\\\\Lib\\\\help', '\\\\FLAG') and kind <> 'method'")
    one = lambda at, word: c.labelled(asked, at, 14, 5, word).select(F.lit(word).alias("word"), _file("uri").alias("file"), "fqn", "label", F.trim(F.regexp_replace("edit_text", r"[\r\n]", "")).alias("edit"), "edit_line")
    return reduce(DataFrame.unionByName, [one(USER, "Ba"), one(OTHER, "Ba"), one(OTHER, "\\Li"), one(OTHER, "Lib\\Ba")])


@query(
    r"""SELECT variant, kind, label, insert_text FROM (VALUES
    ('member', 'method', '__construct', '__construct($0)'),
    ('member', 'method', 'deep', 'deep($0)'),
    ('this', 'property', 'inner', 'inner')
    ) t(variant, kind, label, insert_text)"""
)
def code_member_completion(spark, d):
    text = FILES[USER]
    c = _cursor(spark)
    at = text.index("deep($this->inner, 2)")
    variant, items = c.completion(USER, text, at)
    inner = c.completion(USER, text, text.index("inner, 2)") + 2)[1]
    return items.select(F.lit(variant).alias("variant"), "kind", "label", "insert_text").unionByName(inner.select(F.lit("this").alias("variant"), "kind", "label", "insert_text"))


@query(
    r"""SELECT variant, kind, label FROM (VALUES
    ('parent', 'class_const', 'FAR'),
    ('parent', 'method', 'make'),
    ('parent', 'method', 'run'),
    ('parent', 'property', '$id'),
    ('property', 'property', '$count'),
    ('scoped', 'class_const', 'FAR'),
    ('scoped', 'class_const', 'LIMIT'),
    ('scoped', 'method', 'make'),
    ('scoped', 'property', '$count')
    ) t(variant, kind, label)"""
)
def code_scoped_completion(spark, d):
    text = FILES[USER]
    c = _cursor(spark)
    variant, items = c.completion(USER, text, text.index("LIMIT; User::FAR"))
    parent = c.completion(USER, text, text.index("run(2)"))[1]
    props = c.completion(USER, text, text.index("count; User") + 1)[1]
    shown = lambda name, df: df.select(F.lit(name).alias("variant"), "kind", "label")
    return shown(variant, items).unionByName(shown("parent", parent)).unionByName(shown("property", props))


@query(
    r"""SELECT label, detail FROM (VALUES
    ('$x', '\Lib\Base')
    ) t(label, detail)"""
)
def code_variable_completion(spark, d):
    text = FILES[USER]
    return _cursor(spark).completion(USER, text, text.index("$x->run($z)") + 2)[1].select("label", "detail")


@query(
    r"""SELECT draft, variant, kind, label, insert_text, edit FROM (VALUES
    ('extends', 'class', 'class', 'Base', 'Base', 'use Lib\Base;'),
    ('flag', 'name', 'define', 'FLAG', 'FLAG', NULL),
    ('he', 'name', 'function', 'help', 'help($0)', 'use function Lib\help;'),
    ('implements', 'interface', 'interface', 'Named', 'Named', NULL),
    ('new', 'class', 'class', 'Other', 'Other', NULL),
    ('slash', 'name', 'namespace', '\Lib', 'Lib', NULL),
    ('trait', 'trait', 'trait', 'Greets', 'Greets', NULL),
    ('type', 'type', 'interface', 'Named', 'Named', NULL)
    ) t(draft, variant, kind, label, insert_text, edit)"""
)
def code_name_completion(spark, d):
    """Drafts that stand in no file yet: names, types, classes, interfaces, traits, and what a backslash finds."""
    c = _cursor(spark)
    drafts = {"he": "namespace App; function t() { he", "new": "namespace App; $a = new Ot", "extends": "namespace App; class A extends Ba", "implements": "namespace App; class A implements Na", "trait": "namespace App; class A { use Gr", "type": "namespace App; function f(Na", "flag": "namespace App; echo FL", "slash": "echo \\Li"}
    texts = {f"{DRAFT}/{label}": "<?php\n" + body for label, body in drafts.items()}
    rows = c.catalog.rows.unionByName(php.extract(spark.createDataFrame(list(texts.items()), "uri string, content string"))).persist()
    cursor, out = Cursor(Catalog(rows), c.inference), []
    for uri, text in texts.items():
        variant, items = cursor.completion(uri, text, len(text))
        out.append(items.select(F.lit(uri.rpartition("/")[2]).alias("draft"), F.lit(variant).alias("variant"), "kind", "label", "insert_text", F.trim(F.regexp_replace("edit_text", r"[\r\n]", "")).alias("edit")))
    return reduce(DataFrame.unionByName, out)


@query(
    r"""SELECT owner, name, types FROM (VALUES
    ('\App\Named', '$size', 'int')
    ) t(owner, name, types)"""
)
def code_interface_properties(spark, d):
    seeds = spark.createDataFrame([("\\App\\Named",)], "seed string")
    c = _cursor(spark).catalog
    return c.inherited("property", seeds).select("owner", "name", "types")


@query(
    r"""SELECT owner, name FROM (VALUES
    ('\App\Named', '$size'),
    ('\App\User', '$count'),
    ('\App\User', '$inner'),
    ('\App\User', '$made'),
    ('\Lib\Base', '$id')
    ) t(owner, name)"""
)
def code_inherited_properties(spark, d):
    seeds = spark.createDataFrame([("\\App\\User",)], "seed string")
    return _cursor(spark).catalog.instance_members("property", seeds, "\\App\\User", True).select("owner", "name")


@query(
    r"""SELECT one, other FROM (VALUES
    ('\App\User', '\Lib\Base'),
    ('\Lib\Base', '\App\User')
    ) t(one, other)"""
)
def code_relations(spark, d):
    seeds = spark.createDataFrame([("\\App\\User",)], "seed string")
    return _cursor(spark).catalog.relations(seeds)


@query(
    r"""SELECT name, owner FROM (VALUES
    ('FAR', '\Lib\Base'),
    ('LIMIT', '\App\User')
    ) t(name, owner)"""
)
def code_related_consts(spark, d):
    """A protected constant is reached by a class that inherits it; a protected method only where related members are asked for."""
    seeds = spark.createDataFrame([("\\App\\User",)], "seed string")
    return _cursor(spark).catalog.static_members("class_const", seeds, "\\App\\Other").select("name", "owner")


@query(
    r"""SELECT kind, fqn FROM (VALUES
    ('class', '\App\User'),
    ('class_const', 'LIMIT'),
    ('const', '\App\APP_KIND'),
    ('define', '\FLAG'),
    ('function', '\Lib\help'),
    ('global', '$main'),
    ('interface', '\App\Named'),
    ('property', '$id'),
    ('trait', '\App\Greets')
    ) t(kind, fqn)"""
)
def code_lookups(spark, d):
    c = _cursor(spark).catalog
    asked = [("class", "\\App\\USER"), ("interface", "\\App\\Named"), ("interface", "\\App\\NAMED"), ("trait", "\\App\\Greets"), ("function", "\\Lib\\help"), ("const", "\\App\\APP_KIND"), ("define", "\\FLAG")]
    found = [c.find(k, f).select("kind", "fqn") for k, f in asked] + [c.globals("$main").select("kind", "fqn"), c.members("property", "\\Lib\\Base", "$id").select("kind", "fqn"), c.members("class_const", "\\App\\User", "LI", True).select("kind", "fqn")]
    return reduce(DataFrame.unionByName, found)


@query(
    r"""SELECT kind, name FROM (VALUES
    ('class', 'Other'),
    ('class_const', 'LIMIT'),
    ('const', 'APP_KIND'),
    ('define', 'FLAG'),
    ('function', 'help'),
    ('interface', 'Named'),
    ('method', 'greet'),
    ('property', '$inner'),
    ('trait', 'Greets')
    ) t(kind, name)"""
)
def code_searches(spark, d):
    c = _cursor(spark).catalog
    asked = [("interface", "nam"), ("trait", "gre"), ("function", "he"), ("const", "kind"), ("define", "fl"), ("class_const", "lim"), ("property", "inn"), ("class", "App\\Oth"), ("method", "gr")]
    return reduce(DataFrame.unionByName, [c.search(k, w).select("kind", "name") for k, w in asked])


@query(
    r"""SELECT name, CAST(is_complete AS BOOLEAN) AS is_complete FROM (VALUES
    ('make', false),
    ('many', true),
    ('many', true)
    ) t(name, is_complete)"""
)
def code_limited_search(spark, d):
    c = _cursor(spark).catalog
    return c.search_limited("method", "m", 1).select("name", "is_complete").unionByName(c.search_limited("method", "many", 5).select("name", "is_complete"))


@query(
    r"""SELECT owner, name FROM (VALUES
    ('\App\Named', 'many'),
    ('\App\User', 'LIMIT'),
    ('\App\User', 'many'),
    ('\Lib\Base', 'FAR')
    ) t(owner, name)"""
)
def code_fuzzy_members(spark, d):
    seeds = spark.createDataFrame([("\\App\\User",)], "seed string")
    c = _cursor(spark).catalog
    return c.fuzzy_members("method", seeds, "mn").where("score > 0").select("owner", "name").unionByName(c.fuzzy_members("class_const", seeds, "").where("score = 0").select("owner", "name"))


@query(
    r"""SELECT kind, owner, fqn FROM (VALUES
    ('class', '', '\App\Other'),
    ('method', '\App\Other', '__construct'),
    ('method', '\App\Other', 'deep'),
    ('property', '\App\Other', '$hid')
    ) t(kind, owner, fqn)"""
)
def code_manifest(spark, d):
    return _cursor(spark).catalog.manifest(OTHER).select("kind", "owner", "fqn")


@query(
    r"""SELECT file, CAST(line AS INTEGER) AS line FROM (VALUES
    ('base', 14),
    ('base', 5),
    ('user', 22),
    ('user', 23),
    ('user', 24),
    ('user', 25)
    ) t(file, line)"""
)
def code_filtered_references(spark, d):
    c = _cursor(spark).catalog
    return c.find_filtered(c.filters(), [".run()"]).select(_file("uri").alias("file"), F.col("start_line").alias("line"))


@query(
    r"""SELECT kind, name, candidates FROM (VALUES
    ('const', 'APP_KIND', '\APP_KIND|\App\APP_KIND'),
    ('const', 'FLAG', '\FLAG|\App\FLAG'),
    ('function', 'define', '\define|\App\define'),
    ('function', 'help', '\Lib\help')
    ) t(kind, name, candidates)"""
)
def code_possible_names(spark, d):
    """Calls and constants with all the names that they may have, most likely first."""
    rows = _cursor(spark).inference.nodes.where("kind in ('function', 'const')")
    return rows.select("kind", "name", "candidates")


@query(
    r"""SELECT file, kind FROM (VALUES
    ('a', 'syntax'),
    ('b', 'syntax')
    ) t(file, kind)"""
)
def code_syntax_errors(spark, d):
    files = spark.createDataFrame([("file:///a.php", "<?php class A { function f( {"), ("file:///b.php", "<?php } echo 1;"), ("file:///c.php", "<?php class C {}")], "uri string, content string")
    return Catalog(php.extract(files)).errors().select(_file("uri").alias("file"), "kind").distinct()


@query(
    r"""SELECT label FROM (VALUES
    ('private $inner'),
    ('private $made'),
    ('public __construct'),
    ('public copy'),
    ('public go'),
    ('public many'),
    ('public other'),
    ('public static $count')
    ) t(label)"""
)
def code_display(spark, d):
    rows = _cursor(spark).catalog.symbols.where("owner = '\\\\App\\\\User' and kind in ('method', 'property')")
    return rows.select(N.member_label(F.col("visibility"), F.col("is_static"), F.col("name")).alias("label"))


@query("SELECT * FROM (VALUES ('self', true, false), ('static', true, false), ('$this', true, false), ('parent', false, true), ('A', false, false)) t(name, relative, parent)")
def code_relative_names(spark, d):
    names = spark.createDataFrame([("self",), ("static",), ("$this",), ("parent",), ("A",)], "name string")
    return names.select("name", N.is_relative(F.col("name")).alias("relative"), N.is_parent(F.col("name")).alias("parent"))


@query("SELECT * FROM (VALUES ('', true), ('\\', true), ('\\|', true), ('\\|A', false), ('int', false)) t(types, empty)")
def code_empty_types(spark, d):
    rows = spark.createDataFrame([("",), ("\\",), ("\\|",), ("\\|A",), ("int",)], "types string")
    return rows.select("types", N.is_empty_types(F.transform(F.split("types", r"\|"), N.type_struct)).alias("empty"))


@query("SELECT * FROM (VALUES ('real', '', 'real'), ('binary', 'App', 'binary'), ('iterable', 'App', '\\App\\iterable'), ('self', 'App', '\\App\\self'), ('__DIR__', 'App', '__DIR__')) t(name, space, qualified)")
def code_natives(spark, d):
    rows = spark.createDataFrame([("real", ""), ("binary", "App"), ("iterable", "App"), ("self", "App"), ("__DIR__", "App")], "name string, space string")
    return rows.select("name", "space", N.qualify(F.col("name"), F.col("space")).alias("qualified"))


@query("SELECT * FROM (VALUES ('<b>x</b> y', '**x** y'), ('<p>a<br>b</p>', 'a' || chr(10) || 'b'), ('see <a href=\"u\">it</a>', 'see it')) t(html, text)")
def code_markdown(spark, d):
    rows = spark.createDataFrame([("<b>x</b> y",), ("<p>a<br>b</p>",), ('see <a href="u">it</a>',)], "html string")
    return rows.select("html", F.regexp_replace(markdown(F.col("html")), r"^\s+|\s+$", "").alias("text"))


@query("SELECT * FROM (VALUES ('/a b/c.php', 'file:///a%20b/c.php'), ('C:\\d\\e.php', 'file:///C:/d/e.php')) t(path, uri)")
def code_paths(spark, d):
    rows = spark.createDataFrame([("/a b/c.php",), ("C:\\d\\e.php",)], "path string")
    return rows.select("path", N.path_to_uri(F.col("path")).alias("uri"))


@query("SELECT * FROM (VALUES ('\\Lib\\Sub\\Deep', '\\Lib\\Su', 'Sub\\Deep'), ('\\Lib', '\\Other', 'Lib')) t(full_name, typed, rest)")
def code_namespace_rest(spark, d):
    rows = spark.createDataFrame([("\\Lib\\Sub\\Deep", "\\Lib\\Su"), ("\\Lib", "\\Other")], "full_name string, typed string")
    return rows.select("full_name", "typed", N.insert_text(F.col("full_name"), F.col("typed")).alias("rest"))


@query("SELECT * FROM (VALUES ('getÉtatList', 'getétatlist'), ('getÉtatList', 'état'), ('getÉtatList', 'list'), ('BöseÜberraschung', 'böseüberraschung'), ('BöseÜberraschung', 'überraschung'), ('WP_Object_C', 'wp_object_c'), ('WP_Object_C', 'wp'), ('WP_Object_C', 'object'), ('WP_Object_C', 'c')) t(name, token)")
def code_name_tokens(spark, d):
    from .functions import tokens as T

    rows = spark.createDataFrame([("getÉtatList",), ("BöseÜberraschung",), ("WP_Object_C",)], "name string")
    return rows.select("name", F.explode(T.tokens(F.col("name"))).alias("token"))


@query(r"""SELECT CAST(line AS INTEGER) AS line, fqn, member, deprecated FROM (VALUES (24, '\App\User', 'LIMIT', '2 use CAP')) t(line, fqn, member, deprecated)""")
def code_deprecated_members(spark, d):
    return _cursor(spark).deprecated().select("line", "fqn", "member", "deprecated")


@query(
    r"""SELECT name, CAST(kind AS INTEGER) AS kind, container, CAST(line AS INTEGER) AS line, deprecated FROM (VALUES ('Other', 5, '\App', 2, false), ('deep', 6, '\App\Other', 4, false), ('__construct', 6, '\App\Other', 5, false), ('$hid', 7, '\App\Other', 6, false)) t(name, kind, container, line, deprecated)"""
)
def code_symbol_rows(spark, d):
    rows = symbol_rows(_cursor(spark).catalog.symbols.where(F.col("uri") == OTHER))
    return rows.select("name", "kind", "container", F.col("range.start.line").alias("line"), "deprecated")

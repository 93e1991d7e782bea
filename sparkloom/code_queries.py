"""Requests on a small code base held here, with their expected rows as SQL values (worked out by hand)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import query
from .plans.engine import Catalog
from .sources import php

FILES = {
    "file:///shop/cart.php": r"""<?php
namespace Shop;
use Base\Entity;
use Base\Money as Cash;
use Base\Clock;
use function Base\sum_up;
/** Holds lines.
 * @deprecated 3.1 use Basket
 */
class Cart extends Entity implements Countable {
  use Logs;
  const MAX_LINES = 50;
  protected $lines = [];
  private static $open = 0;
  /** @return Cash */
  public function total($rate = 1) { $spare = 0; $all = sum_up($this->lines); return new Cash($all * $rate); }
  private function lockUp() {}
  public static function openCart() { return new Cart(); }
}
interface Countable { public function total(); }
trait Logs { public function writeLog($text) { echo $text; } }
const SHOP_NAME = 'shop';
""",
    "file:///base/entity.php": r"""<?php
namespace Base;
abstract class Entity {
  const MAX_LINES = 1, VERSION = 2;
  protected $id;
  public function __construct() {}
  public function total() {}
  public function save() { $this->total(); }
  private function inner() {}
}
class Money { public $cents; }
function sum_up($list) { foreach ($list as $key => $item) { echo $item; } return 0; }
define('BASE_FLAG', 1);
""",
}


def _catalog(spark: SparkSession) -> Catalog:
    files = spark.createDataFrame(sorted(FILES.items()), "uri string, content string")
    return Catalog(php.extract(files))


def _cart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("\\Shop\\Cart",)], "seed string")


@query(
    r"SELECT * FROM (VALUES ('class', '\Base\Entity'), ('class', '\Base\Money'), ('class', '\Shop\Cart'), ('interface', '\Shop\Countable'), ('trait', '\Shop\Logs'), ('function', '\Base\sum_up'), ('const', '\Shop\SHOP_NAME'), ('define', '\BASE_FLAG')) t(kind, fqn)"
)
def code_symbols(spark, d):
    return _catalog(spark).symbols.where("owner = ''").select("kind", "fqn")


@query(
    r"SELECT * FROM (VALUES ('method', 'total', 0, false), ('method', 'lockUp', 2, false), ('method', 'openCart', 0, true), ('property', '$lines', 1, false), ('property', '$open', 2, true), ('class_const', 'MAX_LINES', 0, NULL)) t(kind, name, visibility, is_static)"
)
def code_members(spark, d):
    return _catalog(spark).symbols.where(F.col("owner") == "\\Shop\\Cart").select("kind", "name", "visibility", "is_static")


@query(r"SELECT * FROM (VALUES ('extends', '\Shop\Cart', '\Base\Entity'), ('implements', '\Shop\Cart', '\Shop\Countable'), ('use', '\Shop\Cart', '\Shop\Logs')) t(kind, child, parent)")
def code_edges(spark, d):
    return _catalog(spark).edges.select("kind", "child", "parent")


@query(r"SELECT * FROM (VALUES ('class', 'Entity', '\Base\Entity'), ('class', 'Cash', '\Base\Money'), ('class', 'Clock', '\Base\Clock'), ('function', 'sum_up', '\Base\sum_up')) t(kind, name, fqn)")
def code_imports(spark, d):
    return _catalog(spark).imports.select("kind", "name", "fqn")


@query(r"SELECT * FROM (VALUES ('total', '\Shop\Cart'), ('openCart', '\Shop\Cart'), ('writeLog', '\Shop\Logs'), ('__construct', '\Base\Entity'), ('save', '\Base\Entity')) t(name, owner)")
def code_instance_methods(spark, d):
    return _catalog(spark).instance_members("method", _cart(spark)).select("name", "owner")


@query(r"SELECT * FROM (VALUES ('total', '\Base\Entity'), ('__construct', '\Base\Entity'), ('save', '\Base\Entity'), ('writeLog', '\Shop\Logs')) t(name, owner)")
def code_parent_methods(spark, d):
    return _catalog(spark).static_members("method", _cart(spark), "\\Shop\\Cart", "parent").select("name", "owner")


@query(r"SELECT * FROM (VALUES ('MAX_LINES', '\Shop\Cart', '50'), ('VERSION', '\Base\Entity', '2')) t(name, owner, value)")
def code_class_consts(spark, d):
    return _catalog(spark).static_members("class_const", _cart(spark)).select("name", "owner", "value")


@query(r"SELECT '\Base\Entity' AS owner")
def code_constructor(spark, d):
    return _catalog(spark).constructor(_cart(spark)).select("owner")


@query(r"SELECT * FROM (VALUES ('method', 'total', '\Base\Entity'), ('method', 'total', '\Shop\Cart'), ('method', 'total', '\Shop\Countable')) t(kind, name, owner)")
def code_workspace_symbols(spark, d):
    return _catalog(spark).workspace_symbols("tot").select("kind", "name", "owner")


@query(r"SELECT * FROM (VALUES ('file:///base/entity.php', 11), ('file:///shop/cart.php', 15)) t(uri, line)")
def code_function_references(spark, d):
    return _catalog(spark).find_references("\\Base\\sum_up()").select("uri", F.col("start_line").alias("line"))


@query(r"SELECT * FROM (VALUES ('file:///shop/cart.php', '\Base\Clock')) t(uri, fqn)")
def code_unused_imports(spark, d):
    return _catalog(spark).unused_imports().select("uri", "fqn")


@query("SELECT * FROM (VALUES ('file:///base/entity.php', '$key'), ('file:///shop/cart.php', '$spare')) t(uri, name)")
def code_unused_variables(spark, d):
    return _catalog(spark).unused_variables().select("uri", "name")


@query(r"SELECT * FROM (VALUES ('file:///shop/cart.php', 17, '\Shop\Cart', '3.1 use Basket')) t(uri, line, fqn, deprecated)")
def code_deprecated_references(spark, d):
    return _catalog(spark).deprecated_references().select("uri", "line", "fqn", "deprecated")


@query("SELECT * FROM (VALUES ('', 'base'), ('', 'shop')) t(scope, token)")
def code_namespaces(spark, d):
    return _catalog(spark).namespaces().select("scope", "token")


@query("SELECT 'total($rate = 1)' AS label")
def code_signature(spark, d):
    return _catalog(spark).signature("method", "total").where("label like '%rate%'").select("label")

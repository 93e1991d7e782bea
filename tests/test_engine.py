import pytest
from pyspark.sql import functions as F

from sparkloom.plans.engine import Catalog
from sparkloom.sources import php

A = r"""<?php
namespace App;
use Lib\Base;
use Lib\Unused;
use function Lib\help;
/** A user.
 * @deprecated 2.0 use Person
 */
class User extends Base implements Named {
  use Greets;
  const LIMIT = 5;
  private $secret;
  public static $count = 0;
  /** @return string */
  public function getName($who = 'x') { $unused = 1; $n = help($who); return $n; }
  private function hidden() {}
}
interface Named { public function getName(); }
trait Greets { public function greet() { return 'hi'; } }
"""
B = r"""<?php
namespace Lib;
abstract class Base {
  const LIMIT = 1, OTHER = 2;
  protected $kept;
  public function __construct() {}
  public function getName() {}
  private function own() {}
  public function run() { return new \App\User(); }
}
function help($x) { return $x; }
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("code")
    (d / "sub").mkdir()
    (d / "a.php").write_text(A)
    (d / "sub" / "b.php").write_text(B)
    (d / "c.txt").write_text("no code")
    return d


@pytest.fixture(scope="module")
def catalog(spark, files):
    c = Catalog.of_folder(spark, str(files))
    c.save(f"file://{files}/saved")
    return Catalog.load(spark, f"file://{files}/saved")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_scan_takes_php_only(spark, files):
    assert php.scan(spark, str(files)).count() == 2


def test_symbols(catalog):
    assert names(catalog.symbols.where("kind in ('class', 'interface', 'trait', 'function')"), "kind", "fqn") == [
        ("class", "\\App\\User"), ("class", "\\Lib\\Base"), ("function", "\\Lib\\help"), ("interface", "\\App\\Named"), ("trait", "\\App\\Greets")
    ]
    assert catalog.find("class", "\\App\\USER").count() == 1


def test_inherited_methods(spark, catalog):
    own = catalog.instance_members("method", seeds(spark, "\\App\\User"))
    assert names(own, "name", "owner") == [("__construct", "\\Lib\\Base"), ("getName", "\\App\\User"), ("greet", "\\App\\Greets"), ("run", "\\Lib\\Base")]
    inside = catalog.instance_members("method", seeds(spark, "\\App\\User"), "\\App\\User", True)
    assert ("hidden",) in names(inside, "name")
    parent = catalog.static_members("class_const", seeds(spark, "\\App\\User"), "\\App\\User", "parent")
    assert names(parent, "name", "value") == [("LIMIT", "1"), ("OTHER", "2")]
    assert names(catalog.static_members("class_const", seeds(spark, "\\App\\User")), "name", "value") == [("LIMIT", "5"), ("OTHER", "2")]
    assert names(catalog.constructor(seeds(spark, "\\App\\User")), "owner") == [("\\Lib\\Base",)]


def test_search(catalog):
    assert names(catalog.search("method", "name"), "owner") == [("\\App\\Named",), ("\\App\\User",), ("\\Lib\\Base",)]
    assert names(catalog.search("class", "\\App\\Us"), "name") == [("User",)]
    assert names(catalog.workspace_symbols("limit"), "kind", "owner") == [("class_const", "\\App\\User"), ("class_const", "\\Lib\\Base")]
    assert catalog.workspace_symbols("").count() == 0
    assert names(catalog.namespaces(), "scope", "token") == [("", "app"), ("", "lib")]


def test_references_and_definitions(catalog):
    assert catalog.find_references("\\Lib\\help()").count() == 2  # its header and one call
    assert catalog.find_references(".getName()").count() == 3
    assert names(catalog.deprecated_references(), "fqn") == [("\\App\\User",)]
    assert ("help", "\\Lib\\help") in names(catalog.definitions(), "used", "fqn")


def test_unused(catalog):
    assert names(catalog.unused_imports(), "fqn") == [("\\Lib\\Unused",)]
    assert names(catalog.unused_variables(), "name") == [("$unused",)]


def test_hover_and_signature(catalog):
    assert "A user." in catalog.hover("class", "\\App\\User").first().markdown
    assert catalog.signature("method", "getname").where("parameters[0] = '$who = \\'x\\''").count() == 1


def test_sync_replaces_and_deletes(spark, files, catalog):
    stored = php.scan(spark, str(files)).select("uri", "sha1")
    listed = php.scan(spark, str(files)).where(~F.col("uri").endswith("b.php")).withColumn("content", F.lit(b"<?php class Fresh {}")).withColumn("sha1", F.sha1("content"))
    after = catalog.sync(listed, stored)
    assert names(after.symbols, "fqn") == [("\\Fresh",)]


def test_broken_and_empty_files(spark):
    df = spark.createDataFrame([("a", b"<?php class {{{ function ("), ("b", b""), ("c", None), ("d", b"\xff<?php $x = '"), ("e", b"}")], "uri string, content binary")
    assert php.extract(df).where("tag = 'symbol'").count() >= 0
    assert php.extract(df.limit(0)).count() == 0


def test_files_of_a_small_table_are_dealt_out_and_rows_handed_on_in_parts(spark, tmp_path):
    from sparkloom import source_queries

    spark.range(25_000).selectExpr("id AS p_partkey", "'PROMO TIN' AS p_type", "3 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = source_queries._files(spark, str(tmp_path))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 25_000 and max(sizes) <= 2 * php.PER_TASK and len(sizes) == php.tasks(spark, 25_000) > 1
    assert (php.tasks(spark, 0), php.tasks(spark, 10**6)) == (1, 100)
    many = dealt.limit(1_000).select("uri", F.encode("content", "utf-8").alias("content")).toArrow().to_batches()
    parts = [b.num_rows for b in php._extract(iter(many))]
    assert len(parts) > 1 and max(parts) < php.HELD + 1_000


def test_tokens_are_found_in_few_steps_with_the_same_places():
    text = "<?php\r\nclass Ä\\B\xa0{ /* c */ #[At(1)]\n public $é = 'a;b'; } $x?->y(...) <=> 1.5e3; ?> html <?= <<<E\n t\n E;"
    assert [(t.kind, t.text) for t in php.lex(text)] == [
        ("name", "class"), ("name", "Ä\\B\xa0"), ("op", "{"), ("op", "#["), ("name", "At"), ("op", "("), ("number", "1"), ("op", ")"), ("op", "]"), ("name", "public"), ("var", "$é"), ("op", "="), ("string", "'a;b'"), ("op", ";"), ("op", "}"),
        ("var", "$x"), ("op", "?->"), ("name", "y"), ("op", "("), ("op", "..."), ("op", ")"), ("op", "<=>"), ("number", "1.5e3"), ("op", ";"), ("op", ";"), ("heredoc", "<<<E\n t\n E"), ("op", ";"),
    ]
    assert all(text[t.start : t.end] == t.text or text[t.start : t.end] == "?>" for t in php.lex(text))
    rows = php.Extractor("u", "<?php try { f(); } catch (A | B $e) {\n $e->x(); }").run()
    assert all(len(r) == len(php.COLUMNS) for r in rows) and [r[php.SEQ] for r in rows] == list(range(len(rows)))
    assert [r[php.TYPES] for r in rows if r[php.TAG] == "expr" and r[php.NAME] == "$e"][0] == "\\A|\\B"


def test_members_of_most_classes_without_a_row_for_each_class_above(spark, monkeypatch):
    import random

    from sparkloom.operators import hierarchy as H

    rnd, texts = random.Random(3), []
    some = lambda kind, n: rnd.sample([f"{kind}{i}" for i in range(n)], rnd.randrange(3))
    for i in range(8):
        body = [f"use {', '.join(t)};" for t in [some("T", 6)] if t] + [f"const K{rnd.randrange(4)} = {i};", f"protected const L{rnd.randrange(3)} = {i};"]
        body += [f"{rnd.choice(['public', 'protected', 'private'])} {rnd.choice(['', 'static '])}function m{m}() {{}}" for m in rnd.sample(range(8), 3)]
        faces = some("I", 8)
        above = f" extends C{3 if i == 0 else max(i - rnd.randrange(1, 4), 0)}"  # C0 and C3 are on a cycle
        texts.append(f"<?php class C{i}{above}{' implements ' + ', '.join(faces) if faces else ''} {{ {' '.join(body)} }}")
    texts += [f"<?php interface I{i}{' extends ' + ', '.join(up) if (up := some('I', 8)) else ''} {{ const K{i % 4} = 'i'; public function m{i % 8}(); public static function s{i}(); }}" for i in range(8)]
    texts += [f"<?php trait T{i} {{ public function m{i}() {{}} protected static function m{i + 1}() {{}} public static function s{i}() {{}} }}" for i in range(6)]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "uri string, content string")
    catalog = Catalog(php.extract(files)).kept()
    classes = catalog.symbols.where("kind = 'class'").select(F.col("fqn").alias("seed"))
    asks = [lambda: catalog.instance_members("method", classes), lambda: catalog.static_members("class_const", classes), lambda: catalog.static_members("method", classes, related=True)]
    def answers():
        return [(found.columns, sorted(map(str, found.collect()))) for found in (ask() for ask in asks)]

    plain = answers()
    monkeypatch.setattr(H, "most", lambda edges, seeds: True)
    monkeypatch.setattr(Catalog, "inherited", None)
    assert answers() == plain and all(rows for _, rows in plain)


def test_rows_made_of_a_small_table_do_not_go_through_the_driver(spark, catalog, tmp_path):
    from sparkloom import source_queries

    joins = lambda df: [j for j in ("BroadcastHashJoin", "SortMergeJoin") if j in df._jdf.queryExecution().executedPlan().toString()]
    spark.range(30_000).selectExpr("id AS p_partkey", "'PROMO TIN' AS p_type", "3 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert joins(source_queries._files(spark, str(tmp_path))) == ["SortMergeJoin"]
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(name), F.when(F.col("p_partkey") > 0, F.col("p_partkey").cast("string")).otherwise("")).alias("probe")) for kind, name in [("class", "\\Lib\\BASE"), ("function", "\\Lib\\help")]])
    probes = spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", F.explode(asked).alias("x")).select("p_partkey", "x.*")  # 60,000, of which two find something
    want = [("class", "\\Lib\\BASE", "\\Lib\\Base"), ("function", "\\Lib\\help", "\\Lib\\help")]
    for of, join in [(probes, "SortMergeJoin"), (probes.where("p_partkey < 100"), "BroadcastHashJoin")]:
        found = catalog.find_many(of.select("kind", "probe"))
        assert joins(found) == [join] and names(found, "kind", "probe", "fqn") == want


def test_streams(spark, tmp_path):
    from sparkloom.streaming import edits

    rows = spark.createDataFrame([("u", 1, None, None, "abc"), ("u", 2, 1, 2, "X"), ("v", 1, None, None, "z")], "uri string, seq long, start int, end int, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = edits.folded_texts(stream, "uri").writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert names(spark.table("folded"), "uri", "text") == [("u", "aXc"), ("v", "z")]
    timed = spark.sql("SELECT * FROM VALUES ('u', timestamp'2024-01-01 00:00:00', 1), ('u', timestamp'2024-01-01 00:00:01', 2), ('u', timestamp'2024-01-01 00:01:00', 3) t(uri, ts, n)")
    timed.write.parquet(f"{tmp_path}/timed")
    stream = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/timed")
    q = edits.latest_per_key(stream, "uri", "ts").writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.last.n for r in spark.table("latest").collect()] == [3]


def test_windows_and_repeats_of_streams(spark, tmp_path):
    from sparkloom.streaming import edits

    rows = spark.sql("SELECT * FROM VALUES ('u', timestamp'2024-01-01 00:00:01', 1), ('u', timestamp'2024-01-01 00:00:02', 1), ('u', timestamp'2024-01-01 00:00:07', 2), ('v', timestamp'2024-01-01 00:09:00', 3) t(uri, ts, n)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    run(edits.windowed(stream, "uri", "ts", "5 seconds", late="1 minute"), "tumbling")
    assert sorted(r.n for r in spark.table("tumbling").where("uri = 'u'").collect()) == [1, 2]
    run(edits.windowed(stream, "uri", "ts", "10 seconds", "5 seconds", late="1 minute"), "sliding")
    assert sorted(r.n for r in spark.table("sliding").where("uri = 'u'").collect()) == [1, 2, 3]
    run(edits.once(stream, ["uri", "n"], "ts", "1 minute"), "once")
    assert sorted(r.n for r in spark.table("once").collect()) == [1, 2, 3]

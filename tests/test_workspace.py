"""What has no SQL: workspaces, the version gate, files behind a client, published diagnostics, contexts of completion, broken texts."""

import io
import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.cursor import Cursor, context
from sparkloom.plans.engine import STUBS, Catalog, Workspace, migrate, read_version, write_version
from sparkloom.sources import php, remote


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.php").write_text("<?php class A { function f() { $x = strlen('a'); } }")
    (tmp_path / "stubs" / "core").mkdir(parents=True)
    (tmp_path / "stubs" / "core" / "s.php").write_text("<?php /** @return int */ function strlen($text) {}")
    return tmp_path


def test_stubs_are_scanned_under_their_scheme(spark, folder):
    c = Catalog.of_folder(spark, str(folder / "code"), str(folder / "stubs"))
    uris = {r.uri for r in c.symbols.select("uri").collect()}
    assert f"{STUBS}://core/s.php" in uris and len(uris) == 2
    i = Cursor(c).inference
    assert names(i.functions, "fqn") == [("\\strlen",)]
    assert i.definitions.where("fqn = '\\\\strlen'").count() == 0  # no editor can open it
    stored = php.scan(spark, str(folder / "stubs"), STUBS).select("uri", F.lit("old").alias("sha1"))
    assert names(c.sync_stubs(str(folder / "stubs"), stored).symbols.where("kind = 'function'"), "fqn") == [("\\strlen",)]


def test_version_gate(spark, folder, tmp_path):
    path = f"file://{tmp_path}/saved"
    Catalog.of_folder(spark, str(folder / "code")).save(path)
    assert not migrate(spark, path) and Catalog.load(spark, path).symbols.count() == 2
    write_version(spark, path, ("broken",))
    assert not migrate(spark, path) and Catalog.load(spark, path).symbols.count() == 2  # what cannot be read changes nothing
    write_version(spark, path, (0, 0, 9))
    assert Catalog.load(spark, path).symbols.count() == 0 and read_version(spark, path) != "0.0.9"
    assert read_version(spark, f"file://{tmp_path}/nowhere") == "0.0.0"


def test_workspace(spark, folder, tmp_path):
    w = Workspace(spark)
    saved = f"file://{tmp_path}/kept"
    Catalog.of_folder(spark, str(folder / "code")).save(saved)
    w.add("file:///one", str(folder / "code"), saved)
    assert "rename" in w.open({"file:///two": str(folder / "code")})
    assert w.route("file:///one/x.php") is w.catalogs["file:///one"] and w.route("file:///three") is None
    rows = w.routed(spark.createDataFrame([("file:///two/y.php",), ("file:///z.php",)], "uri string"))
    assert {r.uri: r.root for r in rows.collect()} == {"file:///two/y.php": "file:///two", "file:///z.php": None}
    kept = w.catalogs["file:///one"].memo("classes", lambda: w.catalogs["file:///one"].symbols.where("kind = 'class'"))
    assert kept is w.catalogs["file:///one"].memo("classes", None)
    w.close()
    assert not w.catalogs


def test_documents_of_an_editor(spark, folder):
    c = Catalog.of_folder(spark, str(folder / "code"))
    uri = c.symbols.first().uri
    assert names(c.with_document(uri, "<?php class B {}").manifest(uri), "fqn") == [("\\B",)]
    files = spark.createDataFrame([("file:///new.php", "<?php class N {}")], "uri string, content string")
    assert c.document("file:///new.php", files).where("tag = 'symbol'").count() == 1 and c.document(uri).count() > 1


def test_frames():
    message = {"id": 1, "text": "é"}
    assert remote.read_message(io.BytesIO(b"X-Other: 1\r\n" + remote.frame(message))) == message
    assert list(remote.messages(io.BytesIO(remote.frame(message) * 2))) == [message, message]
    for bad in (b"Content-Length: 0\r\n\r\n", b"Other: 1\r\n\r\n", b"Content-Length: 9\r\n\r\n{}", b"Content-Le"):
        with pytest.raises(ValueError):
            remote.read_message(io.BytesIO(bad))


def test_files_behind_a_client(spark):
    texts = {f"file:///{i}.php": f"<?php class C{i} {{}}" for i in range(5)} | {"file:///x.txt": "no"}

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            for m in remote.messages(self.rfile):
                if m["method"] == "workspace/xfiles":
                    result = [{"uri": u} for u in texts]
                else:
                    result = {"text": texts[m["params"]["textDocument"]["uri"]]}
                self.wfile.write(remote.frame({"id": 0, "result": "another's"}) + remote.frame({"id": m["id"], "result": result}))
                self.wfile.flush()

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        files = remote.scan(spark, "127.0.0.1", server.server_address[1], files=2)
        assert names(Catalog(php.extract(files)).symbols, "fqn") == [(f"\\C{i}",) for i in range(5)]
        server.shutdown()


def test_published_diagnostics(spark, tmp_path):
    from sparkloom.streaming import publish

    def check(docs):
        return Catalog(php.extract(docs)).errors().select("uri", "kind", "start_line")

    schema = "uri string, content string"
    spark.createDataFrame([("a", "<?php }"), ("b", "<?php class B {}")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(publish.publisher(f"file://{tmp_path}/out", check)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
    assert {r.uri: len(r.diagnostics) for r in publish.published(spark, f"file://{tmp_path}/out").collect()} == {"a": 1, "b": 0}
    spark.createDataFrame([("a", "<?php class A {}")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(publish.publisher(f"file://{tmp_path}/out", check)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
    assert {r.uri: len(r.diagnostics) for r in publish.published(spark, f"file://{tmp_path}/out").collect()} == {"a": 0, "b": 0}


@pytest.mark.parametrize(
    ("text", "variant", "word"),
    [
        ("<?php $a->", "member", ""), ("<?php $a->b()->co", "member", "co"), ("<?php A::", "scoped", ""), ("<?php self::$x", "static_property", "$x"), ("<?php $ab", "variable", "$ab"),
        ("<?php new \\A\\B", "class", "\\A\\B"), ("<?php class A extends Fo", "class", "Fo"), ("<?php interface A extends Fo", "interface", "Fo"), ("<?php class A implements B, C", "interface", "C"),
        ("<?php class A { use T", "trait", "T"), ("<?php use T", "name", "T"), ("<?php class A {} use T", "name", "T"), ("<?php $a instanceof Fo", "type", "Fo"), ("<?php function f(Fo", "type", "Fo"), ("<?php f(Fo", "name", "Fo"),
        ("<?php function f(): Fo", "type", "Fo"), ("<?php try {} catch (Fo", "type", "Fo"), ("<?php stru", "name", "stru"), ("<?php 1 + ", None, ""), ("plain", None, "plain"),
    ],
)
def test_contexts(text, variant, word):
    got = context(text, len(text))
    assert (got.variant, got.word) == (variant, word)


def test_inference_of_broken_and_empty_code(spark):
    rows = php.extract(spark.createDataFrame([("a", "<?php $x->(; foo(]) $y = ; class { function ( }"), ("b", ""), ("c", "<?php $a = $a->b($a)->c; function f($x = [1, [2, 3]], $y) { return $this->; }")], "uri string, content string"))
    i = Cursor(Catalog(rows)).inference
    assert i.types.count() == 0 and i.definitions.count() == 0
    assert Cursor(Catalog.empty(spark)).inference.types.count() == 0


def test_cycles_end(spark):
    code = r"<?php class A { public $p; /** @return A */ function n() {} function __construct(B $b) { $this->p = $b; $this->p = $this->p->q; } } class B { /** @var A */ public $q; } $a = new A(1); while (1) { $a = $a->n(); $a = $a->p; }"
    i = Cursor(Catalog(php.extract(spark.createDataFrame([("a", code)], "uri string, content string")))).inference
    found = {(r.name, r.fqn) for r in i.types.join(i.nodes, ["uri", "node"]).collect()}
    assert {("n", "\\A"), ("p", "\\A"), ("p", "\\B"), ("q", "\\A")} <= found


def test_messages_are_plain_json():
    body = remote.frame({"a": [1, "ü"]}).split(b"\r\n\r\n", 1)[1]
    assert json.loads(body) == {"a": [1, "ü"]}


def test_extraction_runs_on_workers_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(php._extract))
    code = "import pickle, pyarrow as pa; f = pickle.load(open('f', 'rb')); b = pa.record_batch([pa.array(['u']), pa.array([b'<?php class A { function f() { return self::g(); } }'])], ['uri', 'content']); print(sum(x.num_rows for x in f(iter([b]))) > 3)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.strip() == "True", out.stderr

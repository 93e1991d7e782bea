import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names as N
from sparkloom.functions.tokens import ascii_tokens, exact_tokens
from sparkloom.operators import hierarchy, positional, sync

VECTORS = {
    "userName": ["userName", "Name"],
    "ABClass": ["ABClass", "Class"],
    "GL11Version": ["GL11Version", "11", "Version"],
    "_private": ["_private", "private"],
    "array_map": ["array_map", "array", "map"],
    "a_b": ["a_b", "b"],
    "": [],
}


@pytest.mark.parametrize("name", VECTORS)
def test_exact_tokens(name):
    assert [t.decode() for t in exact_tokens(name.encode())] == VECTORS[name]


def test_tokens_split_at_invalid_bytes():
    assert exact_tokens(b"ab\xffcd") == [b"ab\xffcd", b"cd"]


def test_native_tokens(spark):
    df = spark.createDataFrame([("userName",), ("GL11Version",)], "n string")
    assert [r[0] for r in df.select(ascii_tokens(F.col("n"))).collect()] == [["username", "name"], ["gl11version", "11", "version"]]


def test_names(spark):
    rows = [("", "\\", ""), ("A", "", "A"), ("\\A", "\\", "A"), ("\\N\\A", "\\N", "A"), ("N\\A", "\\N", "A")]
    df = spark.createDataFrame(rows, "n string, scope string, short string")
    assert df.where((N.scope_of(F.col("n")) != F.col("scope")) | (N.last_segment(F.col("n")) != F.col("short"))).count() == 0


def test_types(spark):
    df = spark.createDataFrame([(["boolean", "A[][]", "A", "int"],)], "t array<string>").select(F.transform("t", N.type_struct).alias("t"))
    row = df.select(N.types_text(N.type_union(F.col("t"))).alias("u"), N.types_text(N.element_type(F.col("t"))).alias("e")).first()
    assert (row.u, row.e) == ("bool|A[][]|int", "A[]")


def test_uri_round_trip(spark):
    df = spark.createDataFrame([("/a b/c+d/é.php",)], "p string").select("p", N.path_to_uri(F.col("p")).alias("u"))
    row = df.select("p", "u", N.uri_to_path(F.col("u")).alias("back")).first()
    assert row.back == row.p and row.u == "file:///a%20b/c%2Bd/%C3%A9.php"


def test_closure_ends_on_cycles_and_equals_loop(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "child long, parent long")
    seeds = spark.createDataFrame([(1,), (4,), (5,), (9,)], "seed long")
    a = sorted(map(tuple, hierarchy.closure(edges, seeds).collect()))
    b = sorted((r.seed, r.node, r.depth) for r in hierarchy.closure_loop(edges, seeds, f"file://{tmp_path}").collect())
    assert a == b and (4, 3, 3) in a and (9, 9, 0) in a


def test_outline_deeper_than_recursive_queries(spark):
    edges = spark.range(1, 116).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    nodes = spark.range(0, 116).select(F.col("id").alias("node"))
    got = hierarchy.nearest_kept(nodes, edges, F.col("node").isin(0, 115)).collect()
    assert sorted((r.node, r.parent, r.depth) for r in got) == [(0, None, 0), (115, 0, 1)]


def test_line_starts_and_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nbc\n\nd\re")], "k long, t string")
    assert df.select(positional.line_starts(F.col("t"))).first()[0] == [0, 3, 6, 7, 9]
    assert [r.start for r in positional.line_table(df, "k", "t").orderBy("line").collect()] == [0, 3, 6, 7, 9]


def test_edit_fold(spark):
    base = spark.createDataFrame([("u", "héllo")], "uri string, text string")
    edits = spark.createDataFrame([("u", 2, 0, 1, "J"), ("u", 1, 1, 2, "e"), ("v", 1, None, None, "new")], "uri string, seq long, start int, end int, text string")
    assert {r.uri: r.text for r in sync.edit_fold(edits, "uri", "seq", base).collect()} == {"u": "Jello", "v": "new"}
    assert sync.edit_fold(edits.limit(0), "uri", "seq").count() == 0


def test_reconcile_is_idempotent(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "uri string, sha1 string")
    assert {r.status for r in sync.reconcile(a, a).collect()} == {"keep"}
    assert sync.changed(a, a).count() == 0

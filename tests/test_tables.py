"""Bucketed tables, replayed streams, trees and closures by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import hierarchy as H
from sparkloom.operators.tables import Buckets


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "uri string, v long, digest string").schema
    return Buckets(spark, f"file://{tmp_path}/t", "uri", schema, 8)


def put(spark, rows):
    return spark.createDataFrame(rows, "uri string, v long, digest string, seq int, gone boolean")


def state(table):
    return {r.uri: r.v for r in table.read().collect()}


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    rows = [(f"u{i}", i, f"d{i}", 0, False) for i in range(200)]
    assert table.upsert(put(spark, rows), "seq", F.col("gone"), "digest") == list(range(8))
    before = table.manifest()["files"]
    written = table.upsert(put(spark, [("u7", 70, "x", 1, False), ("u7", 71, "y", 2, False), ("u9", 9, "d9", 1, False)]), "seq", F.col("gone"), "digest")
    assert len(written) == 1  # u9 is as it was
    after = table.manifest()["files"]
    assert {b for b in after if after[b] != before[b]} == {str(written[0])}
    assert len(list((tmp_path / "t" / "data").glob("000000000001-*/bucket=*"))) == 1
    assert state(table) == {f"u{i}": i for i in range(200)} | {"u7": 71}
    assert not re.search("Join|Union", table.read()._jdf.queryExecution().toString())  # plans do not grow


def test_deletes_nulls_and_empty_batches(spark, table):
    table.upsert(put(spark, [("a", 1, "1", 0, False), (None, 2, None, 0, False), ("b", 3, None, 0, False)]), "seq", F.col("gone"), "digest")
    assert state(table) == {"a": 1, None: 2, "b": 3}
    table.upsert(put(spark, [("a", None, None, 1, True), (None, 5, "5", 1, False), ("zz", None, None, 1, True)]), "seq", F.col("gone"), "digest")
    assert state(table) == {None: 5, "b": 3}
    assert table.upsert(put(spark, []), "seq", F.col("gone"), "digest") == []
    table.upsert(put(spark, [("b", None, None, 1, True), (None, None, None, 1, True)]), "seq", F.col("gone"))
    assert state(table) == {} and table.manifest()["files"] == {}


def test_a_batch_counts_once(spark, table):
    for number, v in ((0, 1), (1, 2), (1, 99), (0, 98), (2, 3)):
        table.upsert(put(spark, [("a", v, str(v), 0, False)]), "seq", F.col("gone"), "digest", number)
    assert state(table) == {"a": 3} and table.manifest()["version"] == 2


def test_a_failed_write_leaves_the_old_state(spark, table):
    table.upsert(put(spark, [(f"u{i}", i, "d", 0, False) for i in range(50)]), "seq", F.col("gone"))
    broken = put(spark, [("u1", 5, "e", 1, False)]).withColumn("v", F.when(F.col("uri") == "u1", F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.upsert(broken, "seq", F.col("gone"))
    assert state(table) == {f"u{i}": i for i in range(50)} and table.manifest()["version"] == 0
    other = Buckets(spark, table.folder, "uri", table.schema, 8)
    stale = other.manifest()
    table.upsert(put(spark, [("u1", 5, "e", 1, False)]), "seq", F.col("gone"))
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit({**stale, "version": stale["version"] + 1})
    assert state(table)["u1"] == 5


def test_repeats_ties_and_null_orders(spark, table):
    rows = [("a", 1, "x", 5, False)] * 3 + [("b", 1, "x", None, False), ("b", 2, "y", 0, False), ("c", 1, "x", 7, False), ("c", 2, "y", 7, False), ("d", 4, "z", None, None)]
    table.upsert(put(spark, rows), "seq", F.col("gone"), "digest")
    got = [(r.uri, r.v) for r in table.read().collect()]
    assert sorted(got) in ([("a", 1), ("b", 2), ("c", v), ("d", 4)] for v in (1, 2))


def test_old_versions_are_cleared(spark, table, tmp_path):
    for n in range(5):
        table.upsert(put(spark, [(f"u{i}", n, str(n), n, False) for i in range(40)]), "seq", F.col("gone"), "digest", n)
        table.vacuum()
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and not (tmp_path / "t" / "work").exists()
    assert state(table) == {f"u{i}": 4 for i in range(40)} and table.manifest()["version"] == 4
    table.vacuum(0)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and len(state(table)) == 40


def test_many_rows_of_a_key_are_replaced_together(spark, table):
    rows = spark.createDataFrame([("a", i, "x") for i in range(5)] + [("b", 9, "x")], table.schema)
    table.replace(rows.select("uri"), rows)
    new = spark.createDataFrame([("a", 100, "y")], table.schema)
    table.replace(new.select("uri"), new)
    assert sorted((r.uri, r.v) for r in table.read().collect()) == [("a", 100), ("b", 9)]


def test_catalog_in_a_table(spark, tmp_path):
    from sparkloom.plans.engine import Catalog
    from sparkloom.sources import php

    src = tmp_path / "src"
    src.mkdir()
    for name in "ABC":
        (src / f"{name}.php").write_text(f"<?php class {name} {{ function f() {{}} }}")
    kept = Catalog.table(spark, f"file://{tmp_path}/catalog", 4)
    names = lambda c: sorted(r.name for r in c.symbols.where("kind = 'class'").collect())
    listed = php.scan(spark, str(src))
    first = Catalog.sync_table(kept, listed, listed.limit(0))
    assert names(first) == ["A", "B", "C"]
    stored = spark.createDataFrame(listed.collect(), listed.schema)
    (src / "A.php").write_text("<?php class Z { }")
    (src / "B.php").unlink()
    second = Catalog.sync_table(kept, php.scan(spark, str(src)), stored)
    assert names(second) == ["C", "Z"] and kept.manifest()["version"] == 1


# --- trees and closures


def walk(nodes, stops=frozenset()):
    known = {n for n, _, _ in nodes}
    below = {}
    for n, p, o in nodes:
        below.setdefault(p if p in known else None, []).append((o is not None, o, n))
    out, order = {}, []

    def visit(n, depth):
        at = len(order)
        order.append(n)
        out[n] = [depth, at, 0]
        if n not in stops:
            for *_, c in sorted(below.get(n, [])):
                visit(c, depth + 1)
        out[n][2] = len(order) - at

    for *_, n in sorted(below.get(None, [])):
        visit(n, 0)
    return out


@pytest.fixture(scope="module")
def tree(spark):
    r = random.Random(4)
    nodes = [(0, None, 1)] + [(i, r.randrange(i) if i % 9 else None, r.randrange(4)) for i in range(1, 300)]
    nodes += [(i, i - 1, 0) for i in range(1000, 1070)] + [(2000, 5555, 2)]  # a chain (999 is no node); a root by an unknown parent
    cyclic = [(3000, 3001, 0), (3001, 3002, 0), (3002, 3000, 0), (3003, 3000, 0), (3004, 3004, 0), (3005, 3003, 1)]
    return nodes, cyclic, spark.createDataFrame(nodes + cyclic, "node int, parent int, ord int")


def test_tree_order(tree):
    nodes, _, frame = tree
    assert {r.node: [r.depth, r.pre, r.size] for r in H.tree_order(frame).collect()} == walk(nodes)


def test_tree_walk_with_stops(spark, tree):
    nodes, _, frame = tree
    stops = {0, 7, 30, 1010, 77777}
    got = H.tree_walk(frame, spark.createDataFrame([(s,) for s in stops] * 2, "node int")).collect()
    assert {r.node: [r.depth, r.place] for r in got} == {n: v[:2] for n, v in walk(nodes, stops).items()}
    assert H.tree_order(frame.limit(0)).collect() == []


def test_closure_of_all(spark, tree):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (3, None), (None, 4)]
    seeds = [*range(60), 100, 139, 500]
    near = {}
    for s in seeds:
        found, edge = {s: 0}, [s]
        while edge:
            edge = [b for a, b in edges if a in edge and b is not None and b not in found and not found.update({b: found[a] + 1})]
        near |= {(s, n): d for n, d in found.items()}
    frame = spark.createDataFrame(edges, "child int, parent long")
    for closure in (H.closure_of_all, H.whole_closure):
        got = closure(frame, spark.createDataFrame([(s,) for s in seeds], "seed int"))
        assert {(x.seed, x.node): x.depth for x in got.collect()} == near


def test_late_rows_are_counted(spark):
    from sparkloom import stream_queries

    rows = stream_queries.stream_tumbling(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_late for r in rows) > 0 and sum(r.n + r.n_late for r in rows) == 1000


def test_a_call_that_changes_no_timer_asks_the_state_once():
    import pandas as pd

    from sparkloom.streaming.timers import Quiet

    asked = []

    class Fake:
        held = (7, 100, 2)

        def __getattr__(self, name):
            return lambda *a: asked.append((name, *a)) or (self.held if name == "get" else None)

    quiet = Quiet("user", 10)
    quiet.handle = quiet.pending = Fake()
    calls = pd.DataFrame({"at": [100, 99], "value": [9, 8]})
    assert list(quiet.handleInputRows(("u",), iter([calls]), None)) == []
    assert asked == [("get",), ("update", (9, 100, 4))]
    later = pd.DataFrame({"at": [120], "value": [1]})
    assert [tuple(r) for p in quiet.handleInputRows(("u",), iter([later]), None) for r in p.itertuples(index=False)] == [("u", 7, 100, 2)]
    assert asked[2:] == [("get",), ("update", (1, 120, 1)), ("deleteTimer", 110_000), ("registerTimer", 130_000)]


def test_postings_move_texts_and_not_their_words(spark, tmp_path):
    from sparkloom.catalog_queries import postings_build

    spark.sql("SELECT * FROM VALUES (1L, 'b a b'), (2L, 'c'), (1L, 'a'), (3L, NULL) t(doc_id, text)").write.parquet(f"{tmp_path}/documents.parquet")
    df = postings_build(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a", 2, 0), (1, "b", 2, 0), (2, "c", 1, 0)]
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "ref" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])

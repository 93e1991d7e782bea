"""Kept indexes, many searches, filters, postings and routing: plans, what is read, and brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import membership as M
from sparkloom.operators import postings as G
from sparkloom.operators import search as S
from sparkloom.operators import stored as K


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(1)
    tokens = ["".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = {(t, k) for k in range(300) for t in ["hot", *r.sample(tokens, r.randint(0, 4))]}
    return spark.createDataFrame(sorted(rows), "token string, symbol_key long")


def searched(index, searches, limit):
    rows, out = [tuple(r) for r in index.collect()], []
    for s in {s for s, _, _ in searches}:
        best = {}
        for n, o, w in searches:
            if n == s and w is not None:
                for t, k in rows:
                    if t.startswith(w):
                        best[k] = min(best.get(k, (o, t)), (o, t))
        found = sorted((b, k) for k, b in best.items())
        out += [(s, k, b[0], b[1], i + 1, len(found) <= limit) for i, (b, k) in enumerate(found[:limit])]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 3, 25, 1000])
def test_many_searches(spark, index, limit):
    r = random.Random(2)
    words = ["", "a", "ab", "hot", "hotter", "abc", "cab", "zz", None, "abca", "bcabc", "h"]
    searches = [(s, o, r.choice(words)) for s in range(40) for o in range(r.randint(1, 3))]
    frame = spark.createDataFrame(searches, "search int, word_ord int, word string")
    got = S.search_many(index, frame, limit)
    assert sorted(map(tuple, got.collect())) == searched(index, searches, limit)
    assert not re.search("NestedLoop|Cartesian", plan(got))


def test_many_searches_of_nothing(spark, index):
    none = spark.createDataFrame([], "search int, word_ord int, word string")
    some = spark.createDataFrame([(1, 0, "a")], "search int, word_ord int, word string")
    assert S.search_many(index, none).collect() == []
    assert S.search_many(index.limit(0), some).collect() == []


def test_kept_index_skips_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("t"), F.lpad((F.col("id") % 20_000).cast("string"), 6, "0")).alias("token"), F.col("id").alias("symbol_key"))
    K.write_index(rows, str(tmp_path / "i"), ["token", "symbol_key"], group=64 << 10)
    read = lambda: spark.read.parquet(str(tmp_path / "i"))
    for found, n in ((read().where("token = 't000042'"), 10), (S.prefix_scan(read(), "token", "t00123"), 100)):
        assert found.count() == n
        assert K.rows_scanned(found) < 10_000  # of 200,000
    assert K.rows_scanned(read().where("token = 't000042x'")) == 0  # between min and max of a row group: the bloom filter
    assert K.rows_scanned(read().where("symbol_key >= 0")) == 200_000


def test_tables_are_kept_once_for_a_state(spark, tmp_path):
    path, made = str(tmp_path / "s"), []

    def make():
        made.append(1)
        return spark.read.parquet(path).groupBy().agg(F.sum("id").alias("s"))

    spark.range(10).write.parquet(path)
    assert [K.keep(spark.read.parquet(path), "sums", make).first().s for _ in range(3)] == [45] * 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert K.keep(spark.read.parquet(path), "sums", make).first().s == 55 and len(made) == 2


def test_filters_lose_nothing():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(-(2**63), 2**63 - 1, n)) for n in [0, 1, 2, 3, 7, 50, 1000, 30_000, *r.integers(0, 400, 300)]]
    built = M.build(sets)
    assert built[0] == b"" and all((len(f) - 8) / max(len(s), 1) < 1.3 for f, s in zip(built, sets) if len(s) > 1000)
    for i in (1, 2, 5, 6, 7):
        for key in sets[i][:200]:
            assert M.held(built, np.array([key]))[i]
    strange = r.integers(-(2**63), 2**63 - 1, 3000)
    passed = sum(M.held([f], np.array([k]))[0] for k in strange for f in built[6:8])
    assert passed / 6000 < 0.01
    assert not M.held(built, np.zeros(0, np.int64)).any()


def test_a_set_that_gets_stuck_is_tried_again(monkeypatch):
    monkeypatch.setattr(M, "LEAST", 0)
    monkeypatch.setattr(M, "ROOM", 1.23)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**62, 9)) for _ in range(400)]
    built = M.build(sets)
    assert any(f[:4] != b"\0\0\0\0" for f in built)  # a later seed
    assert all(M.held([f], s[k : k + 1])[0] for f, s in zip(built, sets) for k in range(9))


def test_filters_as_frames(spark):
    texts = [(1, ["a", "b"]), (2, []), (3, None), (4, ["c"]), (None, ["a"])]
    sets = spark.createDataFrame(texts, "uri long, w array<string>").select("uri", F.transform("w", lambda w: M.hashed(w)).alias("h"))
    stored = M.filters(sets, "uri", "h")
    assert {(r.uri, r.n_keys) for r in stored.collect()} == {(1, 2), (2, 0), (3, 0), (4, 1), (None, 1)}
    assert {1, None} <= {r.uri for r in M.may_hold(stored, "uri", ["a", "a"]).collect()}
    assert M.may_hold(stored, "uri", []).collect() == []
    table = spark.createDataFrame([(1, "x"), (1, "y"), (4, "z")], "uri long, t string")
    assert sorted(r.t for r in M.only(table, "uri", spark.createDataFrame([(1,)], "uri long")).collect()) == ["x", "y"]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_numbers_are_packed(n):
    r = np.random.default_rng(n)
    numbers = r.integers(0, 2 ** r.integers(1, 63, n)) if n else np.zeros(0, np.int64)
    raw, size = G.pack(numbers)
    assert (G.unpack(raw.tobytes()) == numbers).all() and len(raw) == size.sum()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    rows = [(i * 3, " ".join(r.choice(["the", "the", "a", "cat", "sat", "on", "mat", f"w{i % 50}"]) for _ in range(r.randint(0, 60)))) for i in range(700)]
    return [*rows, (5000, None), (5001, ""), (5003, "the cat " * 20_000), (None, "the cat sat")]


@pytest.mark.parametrize("block", [500, 2_000_000])
def test_phrases(spark, texts, block, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", block)
    phrases = [["the", "cat"], ["cat", "sat", "on"], ["the", "the", "the"], ["mat"], ["no", "cat"], ["w7", "the"], []]
    stored = G.build(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), "doc_id", "text", "[a-z0-9]+")
    got = G.phrase_search(stored, spark.createDataFrame([(" ".join(p), p) for p in phrases], "phrase string, words array<string>"))
    want = []
    for p in phrases:
        for i, t in texts:
            w = re.findall("[a-z0-9]+", t or "")
            n = sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) if p and i is not None else 0
            want += [(" ".join(p), i, n)] * (n > 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_segments_are_skipped():
    ids = list(range(0, 4000))
    batch = G.coded(0, ids, [["common"] + ["rare"] * (i in (17, 3900)) for i in ids])
    rows = {}
    for r in batch.to_pylist():
        rows.setdefault(r["term"], []).append(r)
    common, rare = G.Segments(rows["common"]), G.Segments(rows["rare"])
    assert (G.starts([common, rare], [0, 1]) // G.SPAN).tolist() == [17, 3900]
    assert len(common.rows) == 32 and common.decoded == 2
    assert sum(len(r["docs"]) + len(r["counts"]) + len(r["places"]) for r in rows["common"]) == 3 * 4000  # a byte each


def test_routes(spark):
    roots = [("http://a/", 2), ("http://a/b/", 1), ("http://a/b/c/", 3), ("http://x", 4), ("http://a/b/", 9)]
    uris = ["http://a/b/c/d", "http://a/z", "http://a", "http://ab/b/", "http://x", "http://x/y", None, "", "http://a/b/c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i int, url string")
    got = S.route_many(df, "url", spark.createDataFrame(roots, "root string, ord int"))
    assert [r.root for r in got.orderBy("i").collect()] == ["http://a/b/", "http://a/", None, None, "http://x", None, None, None, "http://a/b/"]
    assert not re.search("NestedLoop|Cartesian", plan(got))
    assert {r.root for r in S.route_many(df, "url", spark.createDataFrame([], "root string, ord int")).collect()} == {None}


def test_coded_block_of_empty_texts():
    assert G.coded(3, [1, 2], [[], []]).num_rows == 0
    assert isinstance(G.coded(3, [1], [["a"]]), pa.RecordBatch)


def test_fuzzy_column_is_the_score(spark):
    from sparkloom.functions import tokens as T

    r = random.Random(6)
    names = ["", None, "s", "SmallWidget", "SomeMallow", "smw", "s_m_w", "XMLReader2", "aB3c", "ÉtéÜber", "日本smw", *("".join(r.choice("smwSMW_x1") for _ in range(r.randint(1, 14))) for _ in range(150))]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for pattern in ("smw", "s", "mm", "w1", "", "zz"):
        got = frame.select("name", T.fuzzy(F.col("name"), pattern).alias("score")).collect()
        assert [(x.name, x.score) for x in got] == [(n, T.fuzzy_score(n or "", pattern)) for n in names]


def test_offsets_of_positions(spark):
    from sparkloom.operators import positional as P

    texts = ["one\ntwo\nthree", "a\r\nb\r\nc", "a\rb\nc\r\n", "", "\n\n", "x", "é\n日本\n"]
    rows = [(t, i, c) for t in texts for i in range(5) for c in (0, 1, 50)]
    got = spark.createDataFrame(rows, "t string, line int, c int").select("t", "line", "c", P.position_offset(F.col("t"), F.col("line"), F.col("c")).alias("o")).collect()
    for x in got:
        starts = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", x.t)]
        assert x.o == (len(x.t) if x.line >= len(starts) else min(starts[x.line] + x.c, len(x.t))), x


def test_unread_declarations(spark):
    from sparkloom.operators import lookup as L

    d = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), (None, 3)], "scope string, at int")
    u = spark.createDataFrame([("a", 3), ("a", 2), ("b", 1)], "scope string, at int")
    assert sorted((r.scope or "", r.at) for r in L.unread(d, u, ["scope"], "at").collect()) == [("", 3), ("a", 5), ("b", 2)]


def test_stabbing_by_cells_of_all_sizes(spark):
    from sparkloom.operators import positional as P

    r = random.Random(8)
    ranges = [(i, k, s := r.randrange(-5000, 5000), s + r.choice([0, 1, 2, 3, 7, 64, 65, 1000, 9000])) for i in range(300) for k in [r.randrange(2)]]
    points = [(j, r.randrange(2), r.randrange(-6000, 14_000)) for j in range(300)]
    a, b = spark.createDataFrame(ranges, "i int, k int, s int, e long"), spark.createDataFrame(points, "j int, k int, at int")
    got = P.stab(a, b, "s", "e", "at", ["k"])
    assert sorted((x.j, x.i) for x in got.collect()) == sorted((j, i) for j, k, at in points for i, k2, s, e in ranges if k == k2 and s <= at < e)
    assert not re.search("NestedLoop|Cartesian", plan(got))
    assert P.stab(a.limit(0), b, "s", "e", "at", ["k"]).collect() == []


def test_nearest_of_each_is_what_the_closure_gives(spark):
    import random

    from sparkloom.operators import hierarchy as H

    rnd = random.Random(3)
    ways = [(i, i // 2) for i in range(1, 60)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(12)] + [(n, n + 1) for n in range(100, 140)] + [(140, 100)]  # trees, more parents, a long cycle
    own = [(n, k, rnd.randrange(3)) for n in (0, 3, 17, 40, 59, 120, 120) for k in ("a", "b", None) if rnd.random() < 0.8]
    edges = spark.createDataFrame(ways, "child long, parent long")
    rows = spark.createDataFrame(own, "node long, key string, more long")
    got = H.nearest_of_each(edges, rows.withColumn("of", F.col("node")), ["key"], ["of", "more"])
    seeds = spark.createDataFrame([(n,) for n in {x for w in ways for x in w}], "seed long")
    reach = [tuple(r) for r in H.whole_closure(edges, seeds).collect()]
    want = {}
    for seed, node, depth in reach:
        for n, k, more in own:
            if n == node:
                want[seed, k] = min(want.get((seed, k), (99, 0, 0)), (depth, n, more))
    assert {(r.node, r.key): (r.depth, r.of, r.more) for r in got.collect()} == want
    assert got.count() == len(want)


def test_inherited_members_hold_no_row_for_each_pair_of_a_chain(spark, tmp_path, monkeypatch):
    from sparkloom import catalog_queries as C
    from sparkloom.operators import hierarchy as H

    monkeypatch.setattr(H, "closure_of_all", None)  # a row for each class and each one above it is never made
    spark.range(200).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id AS l_orderkey", "id % 200 AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (C.inherited_members, C.reduce_static, C.reduce_first_public):
        assert query(spark, str(tmp_path)).groupBy("seed").count().count() == 200


def test_a_block_holds_a_word_in_four_bytes():
    import tracemalloc

    held, text = G.Block(), " ".join(f"word{i % 5000}" for i in range(20_000))
    tracemalloc.start()
    for key in range(30):
        held.add(key, text.split(), len(text))
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held.terms) == 600_000 and size < 4_500_000  # as texts: 5 MB of references and 30 MB of words
    assert G.segments(0, held)["n_places"].to_pylist()[0] == 30 * 4


def test_a_search_meets_rows_for_its_limit_only(spark):
    index = spark.range(6_000).selectExpr("concat('w', lpad(id % 300, 3, '0')) AS token", "id AS symbol_key")
    searches = spark.range(50).selectExpr("id AS search", "0 AS word_ord", "'w' AS word")
    found = S.search_many(index, searches, 5)
    assert found.count() == 250 and {(r.token, r.is_complete) for r in found.collect()} == {("w000", False)}
    plan = found._jdf.queryExecution()
    found.collect()
    metrics = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in node.nodeName() and node.metrics().get("numOutputRows").isDefined():
            metrics.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.executedPlan())
    assert metrics and max(metrics) <= 50 * 6 * 2  # each search met all 300 tokens before: 15,000 rows

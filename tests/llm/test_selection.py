"""Importance resampling, source divergence and URL filters against brute force and their SQL."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import bytewords, divergence, importance, queries, urlrules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_source_divergence", "op13_url_filters", "license_base", "lm_base", "secret_counts", "mix_targets", "edited_texts"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[k] for k in columns) for r in got.collect()) == Counter(want.select(*map(duckdb.ColumnExpression, columns)).fetchall())


# --- words in bytes, CRC algebra


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 20])
def test_words_in_pieces(size):
    texts = ["Ab c9", None, "", "x", "y z", "...", "longer" * 9 + " Ünï日本 e", "a"]
    raw, ends = bytewords.mapped(pa.array(texts), bytewords.byte_table(digits=True))
    got = [(int(r), raw[a:b].tobytes().decode()) for at, to, row in bytewords.word_pieces(raw, ends, size) for a, b, r in zip(at, to, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall((t or "").translate(LOWER))]


def test_shifted_crcs_compose():
    shift = importance.Shifts()
    r = np.random.default_rng(1)
    for n in [0, 1, 5, 63, 64, 65, 127, 128, 1000, 70_001]:
        a, b = r.bytes(9), r.bytes(n)
        joined = shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert joined == zlib.crc32(a + b)


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_features_are_those_of_joined_words(piece, monkeypatch):
    monkeypatch.setattr(importance, "word_pieces", lambda raw, ends: bytewords.word_pieces(raw, ends, piece))
    texts = ["One two  three FOUR five", None, "single", "a b", "", "w" * 200 + " " + "v" * 64 + " é " + "u" * 63, "a b a b a b"]
    got = Counter((int(r), int(c), k) for rows, crcs, k in importance.feature_pieces(pa.array(texts)) for r, c in zip(rows, crcs))
    want = Counter()
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        want.update((i, zlib.crc32(" ".join(w[j : j + k]).encode()), k) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    assert got == want


# --- resampling


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[j : j + k]).encode()) % 10000 for k in (1, 2, 3) for j in range(len(w) - k + 1))


def resampled(docs, bench, share=(5, 100), least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in bench:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain(b) * c for b, c in f.items())
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    taken = can[: len(can) * share[0] // share[1]]
    return rows, taken


@pytest.fixture(scope="module")
def prose():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abdeilnorst"), r.integers(2, 7))) for _ in range(300)]
    docs = [(i, " ".join(r.choice(words, r.integers(1, 60)))) for i in range(120)] + [(None, " ".join(words[:40])), (None, " ".join(words[:40])), (3, None), (4, ""), (500, " ".join(r.choice(words, 30_000)))]
    return docs + [docs[7]] * 40, [" ".join(words[:50]), None, "", " ".join(words[10:30])]


@pytest.mark.parametrize("share", [(5, 100), (60, 100), (1, 1), (0, 1)])
def test_resampling(spark, prose, share):
    docs, bench = prose
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, weight string, rank int, score int").repartition(5)
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in bench], "text string"), share).collect()
    rows, taken = resampled(docs, bench, share)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in rows)
    ranks = sorted((r.rank, r.score, r.doc_id) for r in got if r.rank is not None)
    assert ranks == [(k + 1, r[3], r[0]) for k, r in enumerate(taken)]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [tuple(r) for r in importance.resample(some, none.select("text")).select("doc_id", "n_features", "rank").collect()] == [(1, 3, None)]


# --- divergence


def audited(docs, least=10, top=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    held = defaultdict(Counter)
    for lang, _, text in docs:
        held[lang].update(set(TERM.findall(text.translate(LOWER))))
    out = Counter()
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in held[lang].items() if n >= least}
        sources = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, text in docs:
            if la == lang:
                sources[s].update(t for t in TERM.findall(text.translate(LOWER)) if t in kept)
        share = lambda c: {t: 1 + math.floor(Fraction(10**9 * (c[t] + 2), c.total() + 2 * len(kept))) for t in kept}
        p, q = {s: share(c) for s, c in sources.items()}, share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out.update((lang, s, part, item, v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found))
    return out


@pytest.fixture(scope="module")
def sourced():
    r = np.random.default_rng(5)
    words = ["t%s" % "".join(r.choice(list("abcdeé"), 3)) for _ in range(60)] + ["日本", "Straße", "y" * 300]
    rows = []
    for i in range(400):
        source, lang = f"s{i % 7}", ["en", "fr", None, ""][i % 4]
        rows.append((lang, source if i % 5 else None, ", ".join(r.choice(words, r.integers(0, 25), p=np.roll(np.arange(63) / 1953, i % 7 * 9)))))
    rows += [("en", "hot", "same text, over and over again")] * 150 + [("en", "empty", ""), ("en", "none", None), ("de", "a", "one two"), ("de", "b", None), ("xx", "alone", "solo"), ("en", "long", "taaa " * 40_000 + "123 x9y")]
    return rows


@pytest.mark.parametrize("core", [0, 5, 100_000])
def test_divergence(spark, sourced, core):
    frame = spark.createDataFrame([(*d, 1, "p") for d in sourced], "lang string, source string, text string, value int, part string").repartition(6)
    got = divergence.audit(frame, core=core)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert Counter(map(tuple, got.collect())) == audited(sourced)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    pairs = [(c, n) for n in (5, 10**9 + 7, 8 * 10**13 + 1) for c in (2, n // 3, n - 1, n)]
    got = spark.createDataFrame(pairs, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * c // n for c, n in pairs]


# --- URL filters


def judged(urls, rules):
    out = Counter()
    for i, url in urls:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        fit = [(len(h + (p or "")), len(h), h.translate(LOWER) + (p or ""), v) for h, p, v in rules if h is not None and (host == h.translate(LOWER) or host.endswith("." + h.translate(LOWER))) and path.startswith(p or "")]
        best = max(fit, default=None)
        out[i, host, path, best and best[2], best[3] if best else ("allow" if host else "block")] += 1
    return out


def test_url_rules(spark):
    hosts = ["example.org", "a.example.org", "notexample.org", "org", "b.a.example.org", "x.com", "com", "a..b", "b", "", "EXAMPLE.org", "x.com:80", "u@x.com", "日本.org"]
    paths = ["", "/", "/en/1", "/en/12/x", "/en", "/fr/", "/fr/y?z=://q", "/de/#/fr/", "?q=/de/", "/es/a b\nc", "/EN/1"]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    urls += [(1000, None), (1001, ""), (1002, "no scheme/en/1"), (1003, "ftp://x.com/fr/" + "z" * 5000), (None, "http://x.com/fr/")] + [(7, "http://hot.example.org/en/1")] * 500 + [(i, "http://hot.example.org/en/1") for i in range(2000, 2300)]
    rules = [*urlrules.RULES, ("A.Example.org", "/en", "allow"), ("example.org", "/en/12", "allow"), ("b", None, "block"), (None, "/", "block"), ("org", "/", "block"), ("x.com", "/fr/" + "z" * 4000, "block"), ("com", "/fr/zz", "block"), ("a..b", "/de/", "allow"), ("日本.org", "/e", "block")]
    frame = spark.createDataFrame([(i, u, "h", 1) for i, u in urls], "page_id long, url string, host string, row int").repartition(4)
    for given in (rules, rules[:2], []):
        got = urlrules.judge(frame, spark.createDataFrame(given, "host string, path string, verdict string"))
        given = list({(h and h.translate(LOWER), p): (h and h.translate(LOWER), p, v) for h, p, v in sorted(given, key=lambda r: r[2])}.values())  # block wins
        assert Counter(map(tuple, got.collect())) == judged(urls, given)


def test_url_rules_of_no_pages(spark):
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")).collect() == []


def test_ranges_hold_what_begins_with_a_rule():
    r = np.random.default_rng(2)
    text = lambda n: "".join(r.choice(list("ab/\U0010ffff"), n)) + "/"
    keys = sorted(text(r.integers(0, 5)) for _ in range(300)) + ["hot/x" * 200] * 60
    splitters = sorted(k[: urlrules.SPLITTER] for k in r.choice(keys, 40))
    for rule in {*keys, "a", "b/", "hot"}:
        if rule.strip(urlrules.TOP):
            low, high = urlrules.ranges_of_rule(splitters, rule)
            for k in keys:
                if k.startswith(rule):
                    first, last = urlrules.ranges_of_key(splitters, k)
                    assert low <= first <= last <= high


# --- order of documents


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 3], list(range(0, 1000, 7))])
def test_blocks_by_cuts(spark, cuts):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    from sparkloom.llm import spotsigs

    got = spark.range(-3, 1010).select("id", spotsigs._bucket(F.col("id"), cuts).alias("b")).collect()
    assert [r.b for r in got] == [bisect_right(cuts, r.id) for r in got]


def test_many_rows_without_an_id_are_ordered_in_time(spark):
    import time

    from pyspark.sql import functions as F

    from sparkloom.llm import spotsigs

    rows = spark.range(100_000).select(F.when(F.col("id") < 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = spotsigs.with_next(rows, block=10)
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())
    pairs = {r.text: r.next_text for r in got.collect()}
    assert time.time() - began < 60
    at, seen = "text 0", set()
    while at not in seen:
        seen.add(at)
        at = pairs[at]
    assert len(seen) == 100_000  # one ring of all texts


# --- decontamination beyond the broadcast


def test_only_candidate_texts_move(spark):
    from sparkloom.llm import decontaminate

    docs = spark.createDataFrame([(i, f"plain words number {i} and nothing more") for i in range(500)] + [(7000, "so one two three four five six seven eight nine ten it goes")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    found = decontaminate.places(docs, bench, most=0)
    assert [(r.doc_id, r.a, r.b, r.item_id) for r in found.collect()] == [(7000, 1, 10, "1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [doc_id") :] if "Aggregate [doc_id" in plan else plan[plan.index("Deduplicate") :]
    assert "LeftSemi" in below and "broadcast" in below  # what is brought together by document was picked out first
    same = [sorted(map(tuple, decontaminate.contamination(docs, bench, most=m).collect())) for m in (0, 200_000)]
    assert same[0] == same[1] and sum(r[-1] for r in same[0]) == 1


# --- the linear models and the chain by plain loops


def test_fit_is_that_of_a_plain_solver():
    from sparkloom.llm import toxicity

    r = np.random.default_rng(9)
    n, m, k = 200, 6, 2
    held = r.random((n, m)) < 0.3
    row, col = np.nonzero(held)
    dense = r.random((n, k))
    y = (r.random(n) < 1 / (1 + np.exp(-(held @ r.normal(size=m) * 2 + dense @ [1.5, -1] - 0.5)))).astype(float)
    penalty = 0.01

    def loss(w, v, b):
        z = held @ w + dense @ v + b
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z) + penalty * np.abs(w).sum()

    w, v, b = toxicity._fit(row, col, m, dense, y, penalty, rounds=5000)
    # plain proximal gradient, one small step after the other
    u, step = np.zeros(m + k + 1), 0.2
    wide = np.hstack([held, dense, np.ones((n, 1))])
    for _ in range(40_000):
        u = u - step * wide.T @ (1 / (1 + np.exp(-wide @ u)) - y) / n
        u[:m] = np.sign(u[:m]) * np.maximum(np.abs(u[:m]) - step * penalty, 0)
    assert loss(w, v, b) == pytest.approx(loss(u[:m], u[m:-1], u[-1]), abs=1e-5)
    assert np.concatenate([w, v, [b]]) == pytest.approx(u, abs=0.02)


def test_chain_by_a_loop():
    from sparkloom.llm import toxicity

    links = [toxicity.Link("a", -1.0, {"bad": 2.0, "!!": 0.5}), toxicity.Link("b", -2.0, {"bad": 1.0, "worse": 3.0}, {"a": 1.5}), toxicity.Link("c", 0.25, {}, {"a": -1.0, "b": 2.0})]
    texts = ["a BAD day", "worse, worse", None, "", "bad worse !!", "nothing here"]
    got = toxicity.probabilities(pa.array(texts, pa.string()), links)
    for i, t in enumerate(texts):
        have, before = set(re.findall(toxicity.FEATURE, (t or "").lower())), {}
        for link, p in zip(links, got, strict=True):
            z = link.bias + sum(x for w, x in link.weights.items() if w in have) + sum(x * before[e] for e, x in link.earlier.items())
            before[link.name] = 1 / (1 + math.exp(-z))
            assert p[i] == pytest.approx(before[link.name], abs=1e-9)


def test_recall_of_near_duplicates(spark):
    """All links of similarity 0.8 or more among many edited copies end in one class, and no class holds texts without such links."""
    from sparkloom.llm import dartminhash

    r = np.random.default_rng(12)
    words = ["".join(r.choice(list("abdeilnorst"), r.integers(2, 8))) for _ in range(4000)]
    texts = []
    for _ in range(150):
        base = list(r.choice(words, r.integers(30, 200)))
        for edits in r.integers(0, 6, 5):
            t = list(base)
            for _ in range(edits):
                t[int(r.integers(0, len(t)))] = str(r.choice(words))
            texts.append(" ".join(t))
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = []
    for i in range(len(texts)):
        for j in range(i // 5 * 5, i):  # copies of one text; others share next to nothing
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                links.append((i, j))
                top[max(find(i), find(j))] = min(find(i), find(j))
    got = {x.doc_id: x.class_id for x in dartminhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(links) > 250
    assert sum(got[i] == got[j] for i, j in links) / len(links) >= 0.99
    assert all(find(i) == find(j) for i, j in zip(got, got.values()))  # class ids are of the same class


# --- votes of several rare words


def test_license_words_must_agree_on_a_start(spark):
    from sparkloom.llm import licenses

    texts = [
        "GNU General Public License, version 3",  # begins within a template
        "version 3 and GNU Lesser something General Public License",  # all words, not at their places
        "x GNU Affero General Public License version 3 y",
        "general public license gnu " * 300 + "GNU General Public License version 2",
        "Mozilla Public License 2.0",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = {r.doc_id: (r.labels, [m["label"] for m in r.matches]) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i in range(5)] == ["gpl-3", "", "agpl-3", "gpl-2", "mpl-2"]
    assert got[3][1] == ["gpl-2"]
    rare = licenses.indexed(licenses.TEMPLATES, {w: 1.0 for _, t, _ in licenses.TEMPLATES for w in licenses.plain(t)})
    for (_, text, keys), (_, ws, places, phrases) in zip(licenses.TEMPLATES, rare):
        assert 1 <= len(places) <= licenses.RARE and all(ws[i] == w for w, i in places)
        assert any(set(w for w, _ in places) <= set(ph) and off == 0 for ph, _, off in phrases)


# --- names are no secrets


def test_names_are_no_secrets():
    from sparkloom.llm import secrets

    for t in ("src/main/java/Foo2Bar/BazQux3Impl/Thing", "SomeVeryLongCamelCaseClassName2WithNumber", "com/example/ServerFactory2Test", "my-app/node_modules/SomePackage/index2"):
        assert secrets.entropy_spans(f"see {t} here") == [], t
    r = np.random.default_rng(4)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(r.choice(alphabet, 32)) for _ in range(500)]
    assert not any(map(secrets.reads_as_name, keys))
    assert sum(secrets.entropy_spans(k) == [(0, 32)] for k in keys) >= 495

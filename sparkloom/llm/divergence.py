"""Source divergence audit: how the vocabulary of each source differs from the others of its language.

The first pass counts, exactly, the documents of a language that hold each term; terms in ``least`` of them or more are kept.  The
second pass recounts occurrences: the texts of a (language, source) group are joined with delimiters and read by an Aho-Corasick automaton of
the kept terms, each padded with delimiters on both sides, so only whole terms match, neighbours too.  An automaton holds the CORE terms in
most documents, none longer than CORE_CHARS, which bounds what goes to tasks; places between delimiters that it does not match are rarer terms,
which are counted by themselves and meet the rest of the kept vocabulary in a join.  Both ways are always taken, at every size.

Counts stay sparse: a row per (language, source, term) that occurs.  A value of a pair sums, over all kept terms, a function f(p, q) of the
shares p and q that the two sources give a term.  With p0 and q0 the shares of a term that does not occur, that sum is

    sum of f(p, q0) over terms of the first + sum of f(p0, q) over terms of the second + f(p0, q0) (V - their number)
    + sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

so only terms of both are joined, and the first two sums go over the different shares p of a source, not its terms.  All sums are of whole
numbers; a share is divided in two steps so that nothing passes 63 bits up to 9e13 occurrences.

Defined cases: a null text, lang or source is the empty string; a group without terms counts none and is compared; a language without kept
terms has value 0 for all pairs and no terms; very long texts and terms are read whole; equal rows count each; ties of value go by the item's
UTF-8 bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import byte_table, mapped
from .common import by_value, cut, relax, small_batches, text_steps, worker_cache

by_value(__name__)

#: Terms of an automaton, and their longest.
CORE, CORE_CHARS = 200_000, 32
#: Counts a task holds before it hands them on.
HELD = 500_000
#: Bytes of text read together.
STEP = 1 << 21
#: A share of 1.
ONE = 1_000_000_000
#: Parts over which the sources of a language are dealt while pairs of them are made.
DEALT = 32


def padded_groups(b: pa.RecordBatch) -> Iterator[tuple[str, str, bytes, np.ndarray]]:
    """(lang, source, the batch's bytes with all but terms as spaces, first and end byte of each text) of each group of a batch."""
    raw, ends = mapped(b.column("text"), byte_table(digits=False))
    raw[raw == 0] = 32
    whole = raw.tobytes()
    groups = defaultdict(list)
    for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)):
        groups[key].append(i)
    for (lang, source), at in groups.items():
        yield lang, source, whole, np.stack([ends[at], ends[np.array(at) + 1]], axis=1)


def normal(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def handed_on(counts: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of counts by key, which are cleared."""
    if counts:
        columns = [pa.array(c, pa.string()) for c in zip(*counts, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], [*names, "n"])
        counts.clear()


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
            held.clear()

        for b in text_steps(batches, size=STEP):
            for lang, _, whole, spans in padded_groups(b):
                counts = held[lang]
                for first, end in spans.tolist():
                    counts.update(set(whole[first:end].split()))
            if sum(map(len, held.values())) >= HELD:
                yield from out()
        yield from out()
        relax()

    return rows.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df"))


def core_terms(kept: DataFrame, core: int) -> dict[str, list[str]]:
    """The kept terms in most documents, by language: at most ``core`` of at most CORE_CHARS characters.

    Terms are counted by the seven leading bits of their document frequency, a few thousand levels, and whole levels are taken from the
    top on, so no task or driver sorts or merges the vocabulary."""
    bits = F.length(F.bin("df"))
    level = bits * 128 + F.call_function("shiftright", F.col("df"), F.greatest(bits - 7, F.lit(0))).cast("int")
    short = kept.where(F.length("term") <= CORE_CHARS).withColumn("level", level)
    total, least = 0, None
    for r in sorted(short.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > core:
            break
        least = r["level"]
    terms = defaultdict(list)
    if least is not None:
        for lang, term in short.where(F.col("level") >= least).select("lang", "term").collect():  # ``core`` rows at most
            terms[lang].append(term)
    return {lang: sorted(found) for lang, found in terms.items()}


def automaton(name: str, lang: str, terms: list[str]):
    """The automaton of a language's padded terms, made once in a worker."""
    import ahocorasick

    cache = worker_cache()
    if cache.get("automata_of") != name:
        cache["automata_of"], cache["automata"] = name, {}
    if lang not in cache["automata"]:
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term} ", i)
        made.make_automaton()
        cache["automata"][lang] = made
    return cache["automata"][lang]


def counted_terms(text: str, found, n_terms: int) -> tuple[np.ndarray, list[str]]:
    """How often each of the automaton's terms stands in a padded text, and the terms that it does not hold, as often as they stand."""
    at = np.fromiter((x for hit in found.iter(text) for x in hit), np.int64).reshape(-1, 2) if n_terms else np.zeros((0, 2), np.int64)
    gap = np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32
    last = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1  # delimiters behind terms
    if len(last) == len(at):
        return np.bincount(at[:, 1], minlength=n_terms), []
    first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    known = np.zeros(len(text), bool)
    known[at[:, 0]] = True
    rest = ~known[last]
    return np.bincount(at[:, 1], minlength=n_terms), [text[a:b] for a, b in zip(first[rest].tolist(), last[rest].tolist(), strict=True)]


class Sums:
    """Counts by (group, term), as sorted pairs of numbers."""

    def __init__(self):
        self.keys, self.counts, self.new, self.n_new = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, group: int, counts: np.ndarray) -> None:
        some = np.flatnonzero(counts)
        self.new.append((some + (group << 32), counts[some]))
        self.n_new += len(some)

    def size(self) -> int:
        """Different pairs; new ones are only merged where they could matter."""
        if len(self.keys) + self.n_new >= HELD:
            keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
            counts = np.concatenate([self.counts, *(c for _, c in self.new)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.keys, self.counts, self.new, self.n_new = keys[first], np.add.reduceat(counts, first) if len(first) else counts, [], 0
        return len(self.keys) + self.n_new

    def blocks(self, rows: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs with their counts, which are forgotten."""
        self.n_new += HELD  # merge
        self.size()
        keys, counts = self.keys, self.counts
        self.__init__()
        for at in range(0, len(keys), rows):
            yield keys[at : at + rows], counts[at : at + rows]


def occurrences(rows: DataFrame, terms: dict[str, list[str]], name: str) -> DataFrame:
    """(lang, source, term, n): occurrences of all terms, kept or not; those of the core are recounted by its automaton."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        core, rest = Sums(), Counter()

        def out():
            names = list(groups)
            of = [n for n, _ in names]
            for key, n in core.blocks():
                group, term = key >> 32, key & (2**32 - 1)
                yield pa.RecordBatch.from_arrays([pa.array([of[g] for g in group], pa.string()), pa.array([names[g][1] for g in group], pa.string()), pa.array([shared.value[of[g]][t] for g, t in zip(group.tolist(), term.tolist(), strict=True)], pa.string()), pa.array(n)], ["lang", "source", "term", "n"])
            yield from handed_on(rest, ["lang", "source", "term"])

        for b in text_steps(batches, size=STEP):
            for lang, source, whole, spans in padded_groups(b):
                n = len(shared.value.get(lang, ()))
                text = f" {b' '.join(whole[a:z] for a, z in spans.tolist()).decode()} "
                counts, others = counted_terms(text, automaton(name, lang, shared.value[lang]) if n else None, n)
                core.add(groups.setdefault((lang, source), len(groups)), counts)
                rest.update((lang, source, t) for t in others)
            if len(rest) + core.size() >= HELD:
                yield from out()
        yield from out()
        relax()

    found = rows.mapInArrow(run, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(ONE count / total) of whole numbers, count <= total <= 9e13, in two steps."""
    step = 100_000
    high = F.call_function("div", count * step, total)
    rest = count * step - high * total
    return high * (ONE // step) + F.call_function("div", rest * (ONE // step), total) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def measure(docs: DataFrame, least: int = 10, core: int = CORE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kept: (lang, term, df); groups: (lang, source, kept_terms, total, n_terms, p0); posts: (lang, source, term, n, p, p0, q), q the language's share."""
    rows = normal(docs)
    kept = cut(document_frequencies(rows).where(F.col("df") >= least), "kept")
    terms = core_terms(kept, core)
    found = occurrences(rows, terms, uuid.uuid4().hex)
    found = cut(found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi"), "found")
    size = kept.groupBy("lang").agg(F.count("*").alias("kept_terms"))
    of = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = rows.select("lang", "source").distinct().join(of, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["total", "n_terms", "kept_terms"])
    absent = F.when(F.col("kept_terms") > 0, share(F.lit(2).cast("long"), F.col("total") + 2 * F.col("kept_terms")))
    groups = cut(groups.withColumn("p0", absent), "groups")
    in_all = found.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("kept_terms").alias("all_terms"))
    in_all = in_all.join(langs, "lang").select("lang", "term", share(F.col("all") + 2, F.col("all_total") + 2 * F.col("all_terms")).alias("q"))
    posts = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n") + 2, F.col("total") + 2 * F.col("kept_terms")).alias("p"), "p0")
    return kept, groups, cut(posts.join(in_all, ["lang", "term"]), "posts")


def pair_values(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of different sources of a language."""
    one = groups.select("lang", "source", "kept_terms", "n_terms", "p0", F.pmod(F.xxhash64("source"), F.lit(DEALT)).alias("part"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("n_terms").alias("item_terms"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("part"))
    pairs = cut(one.join(two, ["lang", "part"]).where("source <> item").drop("part"), "pairs")
    levels = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alone = levels.join(pairs.select("lang", "source", "item", "q0"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * apart(F.col("p"), F.col("q0"))).alias("v"))
    a = posts.select("lang", "term", "source", "p", "p0")
    b = posts.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("v"))
    absent = pairs.where("source < item").select("lang", "source", "item", F.when(F.col("kept_terms") > 0, (F.col("kept_terms") - F.col("n_terms") - F.col("item_terms")) * apart(p0, q0)).otherwise(0).alias("v"))
    low, high = F.least("source", "item"), F.greatest("source", "item")
    total = alone.unionByName(both).unionByName(absent).groupBy("lang", low.alias("low"), high.alias("high")).agg(F.sum("v").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return total.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, least: int = 10, top: int = 10, core: int = CORE) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources and each group's ``top`` terms that set it off from its language."""
    _, groups, posts = measure(docs, least, core)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(groups, posts).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = posts.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM x JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + CAST(1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY lang, term) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT * FROM pr UNION ALL SELECT * FROM tr)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 10
"""

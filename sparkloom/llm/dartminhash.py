"""Near-duplicate documents by DartMinHash over five-word shingles weighted by their counts.

Each shingle owns the half-line of its weight; hashed darts land on (weight, rank) in order of rank, as a Poisson process
of unit rate that depends on the shingle alone.  A document is hit by the darts below its shingles' weights; each dart
has a coordinate, and the earliest dart of each coordinate is the signature, so two documents agree in a coordinate with
the probability of their weighted Jaccard similarity.  Only darts below a rank of about k ln k / (total weight) are thrown,
so the cost is a few darts per coordinate however long the text is; where a coordinate stays empty, the rank is doubled.

Signatures are cut in bands; documents (after exact copies are collapsed to one node) that share a band are candidates.
Each bucket compares its members with a head, the one that meets most others over all buckets.
Members of a bucket that are then still in different components are weighed against each other by their whole
signatures and then their shingles, in blocks within classes of similar length; a bucket of more than CELL members is dealt
to cells over many tasks.  Of these only links that join components, fewer than a cell's members, are made into rows.  Every link is verified by the exact weighted Jaccard similarity of the shingles;
classes are the connected components of the links.

Defined cases: a null or empty text has no words; texts with the same words in the same order (none, too) are copies; fewer
than five words make one shingle; a very long text is read whole; repeated rows are copies; a class is named by its smallest
doc_id (null only if all are), of rows that share it by the smallest hash of the text; an empty table gives no rows; extra
columns, also of the names used here, are ignored by `classes` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, by_value, cut, fresh_texts, relax, small_batches, text_steps

by_value(__name__)

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 20, 6
#: Rows up to which a list of ids is broadcast (under 50 MB as a hash table).
BROADCAST_ROWS = 500_000
#: Members of one block of a large bucket; a cell, weighed in one task, holds about two blocks.
CELL = 4_096
#: Documents whose darts are thrown together.
STEP = 1_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each document's offsets in them."""
    import xxhash

    low = pc.ascii_lower(fresh_texts(texts))
    split = pc.split_pattern_regex(low, WORD_GAP)
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64) if names else np.zeros(0, np.uint64)
    index = coded.indices.to_numpy()
    real = np.ones(len(index), bool)
    if "" in names:
        real = index != names.index("")
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    return table[index[real]], np.concatenate([[0], np.cumsum(real)])[offsets].astype(np.int64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted shingle hashes of one document, repeats kept."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(SHINGLE, n)
    g = np.full(n - size + 1, np.uint64(size))
    for j in range(size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - size + 1 + j]
    return np.sort(_mix(g))


def signatures(elements: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """float64[n, k] ranks of the earliest dart per coordinate, for n documents; inf throughout for a document without elements.

    elements, counts, owner: the distinct shingles of all documents, their weights (real, positive) and documents."""
    best = np.full((n, k), np.inf)
    total = np.bincount(owner, counts, n) if len(owner) else np.zeros(n)
    limit = np.where(total > 0, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0)
    # weights are cut in [0, 1), [1, 2), [2, 4), ... so that an element's darts are the same whatever its weight in a document
    top = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1.0))).astype(np.int64), 0)
    cell = np.repeat(np.arange(len(elements)), top + 1)
    band = np.arange(len(cell)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low, width = np.where(band == 0, 0.0, 2.0 ** (band - 1)), np.where(band == 0, 1.0, 2.0 ** (band - 1))
    todo = np.ones(n, bool) & (total > 0)
    flat = best.reshape(-1)
    while todo.any():
        now = todo[owner[cell]]
        e, lo, wd = cell[now], low[now], width[now]
        state, rank = _mix(elements[e] + (band[now].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), np.zeros(len(e))
        while len(e):
            state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_unit(state)) / wd
            live = rank < limit[owner[e]]
            e, lo, wd, state, rank = e[live], lo[live], wd[live], state[live], rank[live]
            where = _mix(state ^ np.uint64(0xA0761D6478BD642F))
            hit = lo + _unit(_mix(where + np.uint64(1))) * wd <= counts[e]
            np.minimum.at(flat, owner[e[hit]] * k + (where[hit] % np.uint64(k)).astype(np.int64), rank[hit])
        todo &= np.isinf(best).any(axis=1)
        limit[todo] *= 2
    return best


def bands(ranks: np.ndarray) -> np.ndarray:
    """uint64[n, BANDS] hashes of the bands."""
    bits = ranks.view(np.uint64).reshape(len(ranks), BANDS, ROWS)
    h = np.full(bits.shape[:2], np.uint64(0x243F6A8885A308D3)) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return h


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in text_steps(batches):
        for at in range(0, whole.num_rows, STEP):
            b = whole.slice(at, STEP)
            hashes, offsets = word_hashes(b.column("text"))
            n = b.num_rows
            nodes, sets = [], []
            for i in range(n):
                own = hashes[offsets[i] : offsets[i + 1]]
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sets.append(np.unique(shingles(own), return_counts=True))
            elements = np.concatenate([s for s, _ in sets])
            counts = np.concatenate([c for _, c in sets]).astype(np.float64)
            owner = np.repeat(np.arange(n), [len(s) for s, _ in sets])
            ranks = signatures(elements, counts, owner, n)
            h = bands(ranks).view(np.int64)
            short = (_mix(ranks.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
            weight = np.bincount(owner, counts, n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(h.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(nodes, pa.binary()), pa.array(weight), lists, pa.array([r.tobytes() for r in short], pa.binary())], ["doc_id", "th", "node", "weight", "bands", "sig"])
    relax()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, offsets = word_hashes(b.column("text"))
        sets = [shingles(hashes[offsets[i] : offsets[i + 1]]) for i in range(b.num_rows)]
        short = [np.sort(s.astype(np.uint32)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(short, pa.binary())], ["node", "blob", "short"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays with repeats."""
    if not len(a) and not len(b):
        return 1.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[i], cb[j]).sum())
    return common / (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def _links(least: float, kind=np.uint32):
    """Links of a bucket's cell and length class that join different components, at most one less than members.

    Shingles are compared by hashes of a kind: short ones, or whole ones where short ones named a pair that was not one.

    Pairs of different components are weighed by their signatures in blocks; those that agree in as many coordinates as
    similar ones do but for one in thousands are compared by their shingles, unless links found here join them already."""
    k = BANDS * ROWS
    agree = k * least - 4 * math.sqrt(k * least * (1 - least))

    def run(table: pa.Table) -> pa.Table:
        node, own, part = table["node"].combine_chunks(), table["own"].to_numpy(), table["part"][0].as_py()
        weight = table["weight"].to_numpy().astype(np.float64)
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, k)
        sets = [np.frombuffer(x, kind) for x in table["shingles"].to_pylist()]
        left, right = [], []
        mine = np.flatnonzero(own == part)  # pairs within this class or with the one before; those within that are its own
        for at in range(0, len(mine), step := max(1, 30_000_000 // (k * max(1, len(sig))))):
            a = mine[at : at + step]
            ok = (label[a][:, None] != label[None]) & (np.minimum(weight[a][:, None], weight[None]) >= least * np.maximum(weight[a][:, None], weight[None]))
            ok &= (own[None] != part) | (a[:, None] < np.arange(len(own))[None])
            i, j = np.nonzero(ok)
            same = np.concatenate([np.zeros(0, bool)] + [(sig[a[i[x : x + 100_000]]] == sig[j[x : x + 100_000]]).sum(1) >= agree for x in range(0, len(i), 100_000)])
            for x, y in zip(a[i[same]].tolist(), j[same].tolist(), strict=True):
                if label[x] != label[y] and jaccard(sets[x], sets[y]) >= least:
                    label[label == label[y]] = label[x]
                    left.append(x)
                    right.append(y)
        return pa.table([node.take(pa.array(v, pa.int64())) for v in (left, right)], ["node", "other"])

    return run


def deal(members: DataFrame, mixed: DataFrame, most: int = CELL) -> DataFrame:
    """Members of the mixed buckets (band, n) with their `cells`: any two of a bucket with different labels meet in one.

    Up to `most` members are one cell.  Else the commonest label, whose members need not meet each other, and the others are
    cut into blocks of about `most` rows, and each two blocks but those of the commonest label make a cell."""
    large = _maybe_broadcast(cut(mixed.where(F.col("n") > most).select("band"), "large"))
    counts = members.join(large, "band").groupBy("band", "label").agg(F.count("*").alias("c"))
    chiefs = counts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    chiefs = chiefs.select("band", F.col("top.label").alias("chief"), F.ceil((F.col("all") - F.col("top.c")) / most).alias("k"), F.ceil(F.col("top.c") / most).alias("l"))
    h, k, w = F.xxhash64("node"), F.col("k"), F.col("k") + F.col("l")
    others, chief = F.sequence(F.lit(0).cast("long"), k - 1), F.sequence(k, w - 1)
    own = F.pmod(h, k)
    stray = F.concat(F.transform(others, lambda x: F.least(own, x) * w + F.greatest(own, x)), F.transform(chief, lambda x: own * w + x))
    common = F.transform(others, lambda x: x * w + k + F.pmod(h, F.col("l")))
    cells = F.when(k.isNull(), F.array(F.lit(0).cast("long"))).when(F.col("label") == F.col("chief"), common).otherwise(stray)
    of_mixed = members.join(_maybe_broadcast(mixed.select("band")), "band")
    return of_mixed.join(_maybe_broadcast(cut(chiefs, "chiefs")), "band", "left").withColumn("cells", cells).drop("chief", "k", "l")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b), by label exchange and pointer jumping."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jumped = nearer.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        jumped = cut(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document row: doc_id, th (hash of the text), class_id, class_size, keep_id and keep_th (the row that stays for its class)."""
    rows = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("th"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut(rows.mapInArrow(_fingerprint, f"doc_id {kind}, th long, node binary, weight long, bands array<long>, sig binary"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    # exact copies collapse here, before anything is compared
    nodes = cut(prints.groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    spread = cut(nodes.where("weight > 0").select("node", "weight", F.explode("bands").alias("band")), "bands")
    sizes = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(spread.join(_maybe_broadcast(cut(sizes, "sizes")), "band"), "buckets")
    # a text that others were copied from shares more buckets than they do with each other: it goes first
    shared = cut(shared.join(shared.groupBy("node").agg(F.sum("n").alias("met")), "node"), "buckets")

    texts = shared.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("k"), F.col("first.th").alias("t"))
    chosen = _maybe_broadcast(cut(texts, "candidates"))
    wanted = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["k"]) & rows["th"].eqNullSafe(chosen["t"]))
    sets = cut(wanted.select("node", "text").mapInArrow(_sets, "node binary, blob binary, short binary").dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("blob").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("blob").alias("x")), "a")
        return cut(joined.select("a", "b", "x", "y").mapInArrow(_verify, "a binary, b binary, similarity double"), "verified")

    fits = F.least("weight", "w") >= F.greatest("weight", "w") * least  # else the sizes alone keep them apart
    tested, labels = None, nodes.limit(0).select("node", F.col("node").alias("label"))

    def test(pairs: DataFrame) -> tuple[bool, bool]:
        """Verifies the pairs not tested before; says whether there were links, which renew the components, and pairs that are none."""
        nonlocal tested, labels
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = verified(pairs)
        found = not new.where(F.col("similarity") >= least).isEmpty()
        tested = new if tested is None else tested.unionByName(new)
        if found:
            labels = components(tested.where(F.col("similarity") >= least))
        return found, not new.where(F.col("similarity") < least).isEmpty()

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    heads = shared.groupBy("band").agg(F.max(F.struct("met", "node", "weight")).alias("h"))
    heads = cut(heads.select("band", F.col("h.node").alias("other"), F.col("h.weight").alias("w")), "heads")
    test(shared.join(heads, "band").where((F.col("node") != F.col("other")) & fits))

    # what is still in several components within a bucket: its pairs are weighed in blocks, and the links that join components are
    # verified; if a pair that short hashes named is none, links that it stood for are looked for again by whole ones
    part = F.floor(F.log(F.col("weight").cast("double")) / F.lit(-math.log(least))).cast("int")
    for column, hashes in (("short", np.uint32), ("blob", np.uint64)):
        members = labelled(shared.where("n > 2"))
        mixed = members.groupBy("band").agg((F.min("label") != F.max("label")).alias("mixed"), F.first("n").alias("n")).where("mixed").select("band", "n")
        rest = deal(members, cut(mixed, "mixed")).join(nodes.select("node", "sig"), "node").join(sets.select("node", F.col(column).alias("shingles")), "node")
        dealt = rest.withColumn("cell", F.explode("cells")).select("band", "cell", "node", "weight", "label", "sig", "shingles", F.explode(F.array(part, part + 1)).alias("part"), part.alias("own"))
        if not test(dealt.groupBy("band", "part", "cell").applyInArrow(_links(least, hashes), "node binary, other binary"))[1]:
            break

    groups = nodes.join(labels, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("label"))
    named = groups.groupBy("label").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    by_node = groups.join(named, "label").select("node", "keep", "class_size")
    return prints.select("doc_id", "th", "node").join(by_node, "node").select(
        "doc_id", "th", F.col("keep.doc_id").alias("class_id"), "class_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.th").alias("keep_th")
    )


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, with one document of each class: its smallest doc_id (of rows that repeat it any one)."""
    found = cut(classes(docs, least), "classes")
    out = found.where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("th").eqNullSafe(F.col("keep_th")))).select(F.col("doc_id").alias("k"), F.col("th").alias("t")).distinct()
    out = _maybe_broadcast(cut(out, "dropped"))
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["k"]) & F.xxhash64(docs["text"]).eqNullSafe(out["t"]), "left_anti")
    repeated = cut(found.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("k"), F.col("th").alias("t")), "repeated")
    if repeated.isEmpty():
        return kept
    again = _maybe_broadcast(repeated)
    same = kept["doc_id"].eqNullSafe(again["k"]) & F.xxhash64(kept["text"]).eqNullSafe(again["t"])
    single = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(single)

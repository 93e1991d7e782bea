"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other.  Each is a logistic regression on the presence of words, with an L1
penalty so that only words that carry the category keep a weight, and on the probabilities of the categories before it.
In training those come from out-of-fold predictions: a fold's model gets words and weights from the other folds alone, so
a later model never sees an earlier one's fit to its own rows.
Presence, not frequency, is used: one insult in a very long text counts as much as in a short one.

Training takes a bounded sample of the labelled rows: the SAMPLE labels with the smallest hash of doc_id.  Words are taken
by a test of significance (CHI_SQUARE, in any training subset of the folds), not by rank; their counts are made by Spark
and the driver gets those words and the sample's places of them.  Scoring looks the words of the models up in each text.

Defined cases: a null or empty text has no words; a very long text is read whole; null labels and labels without document
are left out, of repeated labels the largest counts, of repeated documents with a label the text with the smallest hash
trains; a category with no or one kind of label predicts its smoothed share; a probability of exactly one half is toxic;
repeated rows give a row each; an empty table gives no rows; other columns, also of the names used here, stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, cut, fresh_texts, relax, small_batches, text_steps

by_value(__name__)

#: Labelled rows, the chi-square a word needs and rows that must hold it, folds, L1 penalty.
SAMPLE, CHI_SQUARE, LEAST_ROWS, FOLDS, PENALTY = 20_000, 20.0, 3, 4, 2e-5
#: A word, or a run of punctuation, which counts as a word here.
FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]{2,}|\|"
#: Chain of (category, label column, value that marks it).
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


@dataclass
class Link:
    """One model of the chain."""

    name: str
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    earlier: dict[str, float] = field(default_factory=dict)


def features(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of a column, and the pairs of row and token (each once); what is no word or run of marks stands among the tokens too."""
    cut_ = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(fresh_texts(texts)), FEATURE, r" \0 "))
    coded = cut_.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(cut_.offsets.to_numpy()))
    n = max(1, len(coded.dictionary))
    pairs = np.unique(row * n + coded.indices.to_numpy().astype(np.int64))
    return coded.dictionary, pairs // n, pairs % n


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(by: np.ndarray, of: np.ndarray, n: int):
    """A function x -> the sums of x[of] per value of by (0 to n - 1); sorted once, then added run by run."""
    order = np.argsort(by, kind="stable")
    of, begins = of[order], np.searchsorted(by[order], np.arange(n))
    full = np.flatnonzero(np.diff(begins, append=len(by)))

    def run(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(x[of], begins[full])
        return out

    return run


def _fit(row: np.ndarray, col: np.ndarray, m: int, dense: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """L1 logistic regression on presences (row, col) of m words and on dense columns, which like the bias carry no penalty.

    Accelerated proximal gradient steps with restarts, on columns scaled to unit mean square, so rare words move as fast as common ones."""
    n, k = len(y), dense.shape[1]
    scale = np.sqrt(np.maximum(np.bincount(col, minlength=m), 1) / n)
    wide = np.hstack([dense, np.ones((n, 1))])
    spread = np.maximum(np.sqrt((wide**2).mean(0)), 1e-9)
    wide = [wide[:, j] / spread[j] for j in range(k + 1)]
    by_row, by_col = _sums(row, col, n), _sums(col, row, m)

    def product(u: np.ndarray) -> np.ndarray:
        return by_row(u[:m] / scale) + sum(x * w for x, w in zip(wide, u[m:], strict=True))

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([by_col(r) / scale, [(x * r).sum() for x in wide]]) / n

    v = np.ones(m + k + 1)
    for _ in range(20):  # the largest eigenvalue
        v = back(product(v / np.sqrt((v * v).sum())))
    step = 3.9 / max(np.sqrt((v * v).sum()), 1e-9)
    least = np.concatenate([penalty / scale, np.zeros(k + 1)]) * step
    u = np.zeros(m + k + 1)
    u[-1] = _logit((y.sum() + 0.5) / (n + 1)) * spread[-1]
    ahead, t = u, 1.0
    for _ in range(rounds):
        moved = ahead - step * back(_sigmoid(product(ahead)) - y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - least, 0)
        if ((ahead - new) * (new - u)).sum() > 0:
            t = 1.0
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - u)
        done = np.abs(new - u).max() < 1e-4
        u, t = new, after
        if done:
            break
    return u[:m] / scale, u[m : m + k] / spread[:k], float(u[-1] / spread[-1])


def _tells(counts, marked, n, share):
    """Chi-square of a word's marked count against its count; works on columns and on arrays."""
    expected = counts * (share / max(n, 1))
    return (marked - expected) * (marked - expected) / (expected * (1 - share / max(n, 1)) + 1e-9)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> list[Link]:
    """The fitted chain."""
    names = [c for c, _, _ in chain]
    marks = [F.max(F.when(F.col(col).isNotNull(), (F.col(col) == value).cast("int"))).alias(name) for name, col, value in chain]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks).dropna(subset=names)
    sample = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")).drop("h")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            names_, row, col = features(b.column("text"))
            lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1))), names_.take(pa.array(col)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("fold", *names)), lists.cast(pa.list_(pa.string()))], ["fold", *names, "w"])
        relax()

    # at most SAMPLE rows of numbers: a proven bound for the broadcast
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "fold", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(texts.select("fold", *names, "text").mapInArrow(words, ", ".join(["fold int", *(f"{c} int" for c in names), "w array<string>"])), "sample")
    per = [F.sum((F.col("fold") == k).cast("int")).alias(f"n{k}") for k in range(FOLDS)]
    per += [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in names for k in range(FOLDS)]
    sizes = rows.agg(*per).first()
    # training subsets: all folds, and all but each
    subsets = [list(range(FOLDS)), *([j for j in range(FOLDS) if j != k] for k in range(FOLDS))]
    size_of = lambda keep, what: sum(sizes[f"{what}{k}"] or 0 for k in keep)
    total = size_of(subsets[0], "n")
    if not total:
        return [Link(c, float(_logit(0.5 / 2))) for c in names]
    counts = rows.select(F.explode("w").alias("word"), "fold", *names).groupBy("word").agg(F.count("*").alias("n"), *per)
    column_of = lambda keep, what: sum((F.col(f"{what}{k}") for k in keep), F.lit(0))
    telling = [(column_of(keep, "n") >= LEAST_ROWS) & (_tells(column_of(keep, "n"), column_of(keep, c), size_of(keep, "n"), size_of(keep, c)) > CHI_SQUARE) for keep in subsets for c in names]
    any_telling = telling[0]
    for t in telling[1:]:
        any_telling = any_telling | t
    top = counts.where(any_telling).orderBy("word").toPandas()  # words that pass a test of significance in a bounded sample
    vocabulary = top["word"].tolist()
    if not vocabulary:
        return [Link(c, float(_logit((size_of(subsets[0], c) + 0.5) / (total + 1)))) for c in names]
    place = {w: i for i, w in enumerate(vocabulary)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = pa.array(list(place), pa.string())
        for b in batches:
            lists = b.column("w")
            at = pc.index_in(lists.flatten(), value_set=known_words)
            keep = at.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("fold", *names)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), at.drop_null())], ["fold", *names, "w"])

    found = rows.mapInArrow(places, ", ".join(["fold int", *(f"{c} int" for c in names), "w array<int>"])).toArrow().combine_chunks()
    lists = found["w"].chunk(0)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    col, fold = lists.flatten().to_numpy(), found["fold"].to_numpy()

    def model(inside: np.ndarray, keep: list[int], c: str, earlier: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights of all words, fitted to some rows by the words that tell in them."""
        n, marked = (sum(top[f"{what}{k}"].to_numpy(float) for k in keep) for what in ("n", c))
        chosen = (n >= LEAST_ROWS) & (_tells(n, marked, size_of(keep, "n"), size_of(keep, c)) > CHI_SQUARE)
        number = np.cumsum(chosen) - 1
        new_row = np.cumsum(inside) - 1
        use = inside[row] & chosen[col]
        dense = np.stack([p[inside] for p in earlier], 1) if earlier else np.zeros((int(inside.sum()), 0))
        w, v, b = _fit(new_row[row[use]], number[col[use]], int(chosen.sum()), dense, found[c].to_numpy()[inside].astype(float), PENALTY)
        full = np.zeros(len(vocabulary))
        full[chosen] = w
        return full, v, b

    links, probabilities = [], []
    for c in names:
        y = found[c].to_numpy()
        if y.min() == y.max():
            link = Link(c, float(_logit((y.sum() + 0.5) / (len(y) + 1))))
            probabilities.append(np.full(len(y), 1 / (1 + math.exp(-link.bias))))
            links.append(link)
            continue
        out_of_fold = np.zeros(len(y))
        for k, keep in enumerate(subsets[1:]) if c != names[-1] else ():  # nothing follows the last link
            inside = fold != k
            if inside.all():
                continue
            if not inside.any() or y[inside].min() == y[inside].max():
                out_of_fold[~inside] = y[inside].mean() if inside.any() else 0.5
                continue
            w, v, b = model(inside, keep, c, probabilities)
            z = np.bincount(row, w[col], len(y)) + b + sum((x * p for x, p in zip(v, probabilities, strict=True)), np.zeros(len(y)))
            out_of_fold[~inside] = _sigmoid(z)[~inside]
        w, v, b = model(np.ones(len(y), bool), subsets[0], c, probabilities)
        links.append(Link(c, b, {vocabulary[i]: float(w[i]) for i in np.flatnonzero(w)}, {e.name: float(x) for e, x in zip(links, v, strict=True)}))
        probabilities.append(out_of_fold)
    return links


def probabilities(texts: pa.Array, links: list[Link]) -> list[np.ndarray]:
    """Of each text the probability of each category, along the chain."""
    names, row, col = features(texts)
    out: dict[str, np.ndarray] = {}
    for link in links:
        z = np.full(len(texts), link.bias)
        if link.weights and len(names):
            at = pc.index_in(names, value_set=pa.array(list(link.weights), names.type))
            weight = np.append(list(link.weights.values()), 0.0)[pc.fill_null(at, len(link.weights)).to_numpy()]
            z = z + np.bincount(row, weight[col], len(texts))
        for name, w in link.earlier.items():
            z = z + w * out[name]
        out[link.name] = _sigmoid(z)
    return list(out.values())


def score(docs: DataFrame, links: list[Link], least: float = 0.5) -> DataFrame:
    """doc_id, a probability per category (p_<name>) and one decision, <last name>, per row of docs."""
    names = ["doc_id", *(f"p_{link.name}" for link in links), links[-1].name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            p = probabilities(b.column("text"), links)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, p), pa.array(p[-1] >= least)], names)
        relax()

    schema = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"`{n}` double" for n in names[1:-1]), f"`{names[-1]}` boolean"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, ", ".join(schema))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, p_low_quality, p_toxic, toxic."""
    return score(docs, train(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not find toxic."""
    links, text = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, text):
            yield b.filter(pa.array(probabilities(b.column(text), links)[-1] < least))
        relax()

    return docs.mapInArrow(run, docs.schema)

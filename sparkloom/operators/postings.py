"""Positional postings, gap-coded in blocks with skip entries, and phrase search by intersecting them.

The documents of an Arrow batch are a block.  Of each term of a block the places are coded in segments of up to SEGMENT documents: gaps of
document numbers, counts, and gaps of places, as numbers of seven bits a byte.  A segment names the first and last document that it
holds, so a search decodes only segments that can hold a document of the phrase's rarest word.  Each file holds the segments of the documents
of one task, sorted by term, so nothing is shuffled to build them and a reader skips the row groups of other terms in each file.  A term that
is in all documents is as many rows as there are segments, never one list.
"""

from __future__ import annotations

import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

SEGMENT = 128
#: Characters of text that make a block.
BLOCK = 6_000_000
SCHEMA = "term string, block long, first_doc long, last_doc long, n_docs long, n_places long, docs binary, counts binary, places binary"


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (0 or more) of seven bits a byte, lowest first, the eighth bit set where more follow; and the bytes of each."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        size += numbers >= np.uint64(1) << np.uint64(7 * k) if k < 9 else (numbers >> np.uint64(63)) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = ((numbers[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        some = np.flatnonzero(last - first >= k)
        out[some] |= (raw[first[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; runs begin at ``starts`` with the value itself."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The inverse of ``gaps``."""
    total = np.cumsum(values)
    lengths = np.diff(np.append(starts, len(values)))
    return total - np.repeat(total[starts] - values[starts], lengths)


class Block:
    """Documents and their terms, these as numbers: a word takes four bytes, and its text is held once."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)  # of each term, by where it comes first
        self.ids, self.sizes, self.terms, self.size = array("q"), array("q"), array("i"), 0

    def add(self, key: int, words: list[str], size: int = 0) -> None:
        self.ids.append(key)
        self.sizes.append(len(words))
        self.terms.extend(map(self.numbers.__getitem__, words))
        self.size += size


def coded(block: int, ids: list[int], lists: list[list[str]]) -> pa.RecordBatch:
    """The segments of a block: document numbers and their terms in order."""
    held = Block()
    for key, words in zip(ids, lists, strict=True):
        held.add(key, words)
    return segments(block, held)


def segments(block: int, held: Block) -> pa.RecordBatch:
    numbers, term = held.numbers, np.frombuffer(held.terms, np.int32) if held.terms else np.zeros(0, np.int32)
    ids, sizes = np.array(held.ids, np.int64), np.array(held.sizes, np.int64)
    row = np.repeat(np.argsort(np.argsort(ids, kind="stable"), kind="stable").astype(np.int32), sizes)  # the document's place among all
    place = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.lexsort((row, term))  # places are in order already
    term, doc, place = term[order], np.sort(ids)[row[order]], place[order]
    del row, order
    new_doc = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=doc[:1]) != 0))
    heads, owners = doc[new_doc], term[new_doc]  # a row for each (term, document)
    counts = np.diff(np.append(new_doc, len(term)))
    new_term = np.flatnonzero(np.diff(owners, prepend=-1))
    rank = np.arange(len(owners)) - np.repeat(new_term, np.diff(np.append(new_term, len(owners))))
    cuts = np.flatnonzero(rank % SEGMENT == 0)  # a segment begins
    ends = np.append(cuts, len(owners))[1:]
    place_of = np.append(new_doc, len(term))

    def column(values: np.ndarray, first: np.ndarray) -> pa.Array:
        """The packed numbers of each segment, which follow each other."""
        raw, size = pack(values)
        at = np.append(0, np.cumsum(size))[np.append(first, len(values))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(raw)])

    columns = [
        pa.array(list(numbers), pa.string()).take(pa.array(owners[cuts])), pa.array(np.full(len(cuts), block)), pa.array(heads[cuts]), pa.array(heads[ends - 1]) if len(cuts) else pa.array([], pa.int64()),
        pa.array(ends - cuts), pa.array(place_of[ends] - place_of[cuts]),
        column(gaps(heads - heads[np.repeat(cuts, ends - cuts)], cuts), cuts), column(counts, cuts), column(gaps(place, new_doc), place_of[cuts]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "first_doc", "last_doc", "n_docs", "n_places", "docs", "counts", "places"])


def build(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Segments (SCHEMA) of the pattern's matches; ``key`` is a whole number of 0 or more, one row each; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyspark import TaskContext

        cut, block, held = re.compile(pattern), TaskContext.get().partitionId() << 32, Block()
        for b in batches:
            for i, t in zip(b.column(key), b.column(text), strict=True):  # one text at a time: a batch may be of long ones
                t = t.as_py() or ""
                held.add(i.as_py(), cut.findall(t), len(t))
                if held.size >= BLOCK:
                    yield segments(block, held)
                    block, held = block + 1, Block()
        if held.ids:
            yield segments(block, held)

    return texts.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, SCHEMA)


class Segments:
    """The segments of one term in one block; each is decoded when it is first asked for, those that are asked for at once together."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["first_doc"])
        self.first, self.last = (np.array([r[c] for r in self.rows], np.int64) for c in ("first_doc", "last_doc"))
        self.n_docs, self.spots = sum(r["n_docs"] for r in rows), {}

    @property
    def decoded(self) -> int:
        return len(self.spots)

    def at(self, docs: np.ndarray | None) -> np.ndarray:
        """doc * SPAN + place of all places, or of those of segments that can hold one of some sorted documents."""
        wanted = range(len(self.rows)) if docs is None else np.flatnonzero(np.searchsorted(docs, self.first) < np.searchsorted(docs, self.last, "right")).tolist()
        self._decode([i for i in wanted if i not in self.spots])
        return np.concatenate([np.zeros(0, np.int64), *(self.spots[i] for i in wanted)])

    def _decode(self, which: list[int]) -> None:
        if not which:
            return
        rows = [self.rows[i] for i in which]
        counts, docs, places = (unpack(b"".join(r[c] for r in rows)) for c in ("counts", "docs", "places"))
        n = np.array([r["n_docs"] for r in rows])
        numbers = running(docs, np.cumsum(n) - n) + np.repeat(self.first[which], n)
        spots = np.repeat(numbers, counts) * SPAN + running(places, np.cumsum(counts) - counts)
        for i, part in zip(which, np.split(spots, np.cumsum([r["n_places"] for r in rows])[:-1]), strict=True):
            self.spots[i] = part


#: Greater than any place in a document, and small enough that a document number times it is a 63-bit number for 2**32 documents.
SPAN = 1 << 31


def starts(terms: list[Segments], relative: list[int]) -> np.ndarray:
    """doc * SPAN + place at which terms stand at their relative places; rarest first, documents of the others by their segments."""
    order = sorted(range(len(terms)), key=lambda i: terms[i].n_docs)
    found = None
    for i in order:
        spots = terms[i].at(None if found is None else np.unique(found // SPAN))
        spots = spots[spots % SPAN >= relative[i]] - relative[i]
        found = spots if found is None else np.intersect1d(found, spots, assume_unique=True)
        if not len(found):
            break
    return found


#: Phrases that are looked for together in a block.
TOGETHER = 2_000


def phrase_search(stored: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, doc, n): the documents that hold all words of a phrase in a row, and how often; phrases(phrase string, words array<string>).

    Postings meet the words of the phrases by equality, each with all its uses in a part of the phrases, and are intersected by block and
    part: a term of a block is decoded once for a part.  A phrase without words is nowhere."""
    parts = -(-max(phrases.count(), 1) // TOGETHER)
    uses = phrases.distinct().select("phrase", F.size("words").cast("int").alias("n_words"), F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part"), F.posexplode("words").alias("rel", "term"))
    uses = uses.groupBy("term", "part").agg(F.collect_list(F.struct("phrase", "n_words", "rel")).alias("uses"))
    rows = stored.join(uses, "term")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        segments, asked = {}, {}
        for r in table.to_pylist():
            segments.setdefault(r["term"], []).append(r)
        for term, found in segments.items():
            for u in found[0]["uses"]:
                asked.setdefault((u["phrase"], u["n_words"]), {})[u["rel"]] = term
        terms = {term: Segments(found) for term, found in segments.items()}
        names, docs, counts = [], [], []
        for (phrase, n_words), words in asked.items():
            if len(words) == n_words:
                doc, n = np.unique(starts([terms[t] for t in words.values()], list(words)) // SPAN, return_counts=True)
                names += [phrase] * len(doc)
                docs.append(doc)
                counts.append(n)
        together = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
        return pa.table({"phrase": pa.array(names, pa.string()), "doc": together(docs), "n": together(counts)})

    return rows.groupBy("block", "part").applyInArrow(search, "phrase string, doc long, n long")

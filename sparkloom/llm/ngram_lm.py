"""Language-model scores from an Elias-Fano n-gram trie.

Training counts all words, pairs and triples of the training documents (a document ends in an end word).  Words get their
rank in the order of their hashes, in vocabulary shards that split the hash range.  Pairs, with the triples they begin,
go to trie shards by the hash of the pair, so a frequent word or pair weighs on no single shard: what reaches a shard is
already summed per task.  A shard's levels are Elias-Fano sequences: pairs as (rank of the first word, second word), the
monotone pointers from pairs to their triples, and the triples' last words made monotone by their context's place; a
lookup is a search for the successor of the context-relative value, compared for equality.  Beside each level stand
8-bit codes of smoothed probabilities (interpolated absolute discounting).  Levels are files in the shared folder,
memory-mapped by the scoring tasks.

  P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
  P2(w|v) = (c(vw) - D) / c(v) + rest(v) P1(w),   P3(w|uv) = (c(uvw) - D) / c(uv) + rest(uv) P2(w|v)

where the rest is one less the sum of the terms kept: with min_count 1 all pairs and triples, else those seen as often at least.

Defined cases: null is the empty text, which has the end word alone; a null doc_id trains; without training text every
word has P1 = 1; a very long text is counted and scored whole; words of equal counts need no order, ranks go by hash;
repeated rows count and are scored each; an empty table gives no rows; more different words than 32 bits hold are an error;
extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, by_value, fresh_dir, fresh_texts, relax, small_batches, text_steps, worker_cache

by_value(__name__)

DISCOUNT, MIN_COUNT = 0.75, 1
#: Bytes of text handled at once, characters per vocabulary shard, training words per trie shard.
STEP_BYTES, VOCABULARY_CHARS, SHARD_WORDS = 8_000_000, 100_000_000, 2_500_000
#: Bytes of mapped files whose pages a worker keeps from one step to the next.
MAPPED_BYTES = 200_000_000
U = np.uint64
BLOCK = 256  # bits


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _places() -> np.ndarray:
    """int64[256 * 8]: place of the k-th (from 0) set bit of each byte."""
    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        for k, place in enumerate(i for i in range(8) if byte >> i & 1):
            out[byte, k] = place
    return out.reshape(-1)


PLACES = _places()
#: Every byte 1, and masks of bits, pairs, fours and top bits.
EACH, ODD, PAIR, FOUR, TOP = U(0x0101010101010101), U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F), U(0x8080808080808080)


def _nth(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: the bytes' running counts side by side in a word, then a table of bytes."""
    sums = word - ((word >> U(1)) & ODD)
    sums = (sums & PAIR) + ((sums >> U(2)) & PAIR)
    sums = ((sums + (sums >> U(4))) & FOUR) * EACH
    k = k.astype(U)
    at = np.bitwise_count((((k * EACH) | TOP) - sums) & TOP).astype(U) << U(3)  # bytes that hold no more than k set bits, times eight
    byte = (word >> at) & U(255)
    left = k - (((sums << U(8)) >> at) & U(255))
    return at.astype(np.int64) + PLACES[((byte << U(3)) | left).astype(np.int64)]


class EliasFano:
    """A sorted sequence of n values: low bits packed, high bits in unary; of every BLOCK bits the count of set and clear ones before is listed.

    A lookup finds the run of values with the same high bits by two selects and halves it on the low bits, so contexts
    with very many successors, which share few high parts, cost a logarithm."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            bit = np.arange(n, dtype=np.int64) * low_bits
            part, word, off = values & U((1 << low_bits) - 1), bit >> 6, (bit & 63).astype(U)
            np.bitwise_or.at(low, word, part << off)
            over = off + U(low_bits) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - off[over]))
        place = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + 2
        flags = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
        flags[place] = 1
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, BLOCK).sum(1, dtype=np.int64))])
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little").view(U), ones, np.arange(len(ones)) * BLOCK - ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:5])

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th set (flip: clear) bit."""
        before = self.zeros if flip else self.ones
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * (BLOCK // 64)
        bits = self.high[word]
        bits = ~bits if flip else bits
        count = np.bitwise_count(bits).astype(np.int64)
        todo = np.flatnonzero(left >= count)
        while len(todo):
            left[todo] -= count[todo]
            word[todo] += 1
            more = self.high[word[todo]]
            bits[todo] = ~more if flip else more
            count[todo] = np.bitwise_count(bits[todo])
            todo = todo[left[todo] >= count[todo]]
        return (word << 6) + _nth(bits, left)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(U)
        second = np.where(off > 0, self.low[word + 1] << ((U(64) - off) & U(63)), U(0))
        return ((self.low[word] >> off) | second) & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i).astype(U) << U(self.low_bits)) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value of x in the sequence (that of its successor, if equal), else -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        x = x.astype(U)
        high = (x >> U(self.low_bits)).astype(np.int64)
        last = int(self.access(np.array([self.n - 1]))[0])
        ask = np.flatnonzero(x <= U(last))
        high, want = high[ask], x[ask] & U((1 << self.low_bits) - 1)
        begin, end = np.zeros(len(ask), np.int64), self._select(high, True) - high
        later = np.flatnonzero(high > 0)
        begin[later] = self._select(high[later] - 1, True) + 1 - high[later]
        stop = end.copy()
        live = np.flatnonzero(begin < end)
        while len(live):
            middle = (begin[live] + end[live]) >> 1
            less = self._lows(middle) < want[live]
            begin[live] = np.where(less, middle + 1, begin[live])
            end[live] = np.where(less, end[live], middle)
            live = live[begin[live] < end[live]]
        hit = np.flatnonzero(begin < stop)
        hit = hit[self._lows(begin[hit]) == want[hit]]
        out[ask[hit]] = begin[hit]
        return out


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each from a multiple of 8 bytes, after a list of their kinds and sizes."""
    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<8sq", a.dtype.str.encode(), len(a)) for a in arrays)
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def unpack(raw: np.ndarray) -> list[np.ndarray]:
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    kinds = [struct.unpack("<8sq", raw[8 + 16 * i : 24 + 16 * i].tobytes()) for i in range(n)]
    at += 16 * n
    for kind, size in kinds:
        kind = np.dtype(kind.rstrip(b"\0").decode())
        out.append(raw[at : at + size * kind.itemsize].view(kind))
        at += size * kind.itemsize + (-size * kind.itemsize) % 8
    return out


def mapped(store: Store, name: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped once per worker."""
    cache = worker_cache().setdefault("mapped", {})
    if (key := f"{store.uri}/{name}") not in cache:
        if len(cache) > 20_000:
            cache.clear()
        file = np.memmap(store.path(name), np.uint8, "r")
        cache[key] = unpack(file.view(np.ndarray)), file
    return cache[key][0]


def let_go() -> None:
    """Takes the pages of mapped files, if they are many, from this worker: they stay in the machine's cache, and its memory does not grow with the model."""
    import mmap

    files = [file for _, file in worker_cache().get("mapped", {}).values()]
    if sum(map(len, files)) > MAPPED_BYTES:
        for file in files:
            file._mmap.madvise(mmap.MADV_DONTNEED)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: at most 256 values, at equal shares of the distinct ones."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float64)
    distinct = np.unique(values)
    if len(distinct) > 256:
        edges = distinct[np.linspace(0, len(distinct), 257).astype(int)[1:-1]]
        codes = np.searchsorted(edges, values, "right").astype(np.uint8)
        sums, n = np.bincount(codes, values, 256), np.bincount(codes, minlength=256)
        return codes, sums / np.maximum(n, 1)
    return np.searchsorted(distinct, values).astype(np.uint8), distinct


def text_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each word's place among them (documents one after the other, each with its end), offsets."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(fresh_texts(texts)))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy().astype(np.int64)
    real = index != names.index("") if "" in names else np.ones(len(index), bool)
    offsets = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    hashes = np.array([*map(xxhash.xxh3_64_intdigest, names), xxhash.xxh3_64_intdigest("end of text")], U)
    return hashes, np.insert(index[real], offsets[1:], len(names)), offsets + np.arange(len(offsets))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _zip(*arrays: np.ndarray) -> bytes:
    """Packed arrays: sorted 8-byte ones as differences, wide numbers by byte planes, then zstandard."""
    import zstandard

    flat = []
    for a in arrays:
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T if len(a) else np.zeros((8, 0), np.uint8)
        flat.append(struct.pack("<q", len(a)) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(flat))


def _unzip(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<q", raw, at)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n).T).view(U).reshape(-1))
        at += 8 + 8 * n
    return out


def _differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a[:0].sum(dtype=a.dtype))


class Vocabulary:
    """Words by hash: rank, count and the share of P1 that stays for a word as context."""

    def __init__(self, path: str, sizes: list[int]):
        self.store, self.sizes, self.begins = Store(path), sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> U(32)) * U(len(self.sizes))) >> U(32)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks (-1: not a training word)."""
        out, shard = np.full(len(hashes), -1, np.int64), self.shard(hashes)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            if self.sizes[s]:
                found = EliasFano.of(mapped(self.store, f"vocabulary-{s:06d}")).find(hashes[at])
                out[at] = np.where(found >= 0, found + self.begins[s], -1)
        return out

    def gather(self, ids: np.ndarray, level: str, none: float) -> np.ndarray:
        """Of each rank its count, or its rest (as context)."""
        out = np.full(len(ids), none, np.float64)
        shard = np.searchsorted(self.begins, ids, "right") - 1
        for s in np.unique(shard[ids >= 0]):
            at = np.flatnonzero((shard == s) & (ids >= 0))
            arrays = mapped(self.store, f"{level}-{s:06d}")
            i = ids[at] - self.begins[s]
            out[at] = arrays[5][i] if level == "vocabulary" else arrays[1][arrays[0][i]]
        return out


class Model:
    def __init__(self, path: str, sizes: list[int], tokens: int, shards: int):
        self.path, self.sizes, self.tokens, self.shards = path, sizes, tokens, shards

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.path, self.sizes)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (sum(self.sizes) + 1))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def train(docs: DataFrame, min_count: int = MIN_COUNT) -> Model:
    """Counts docs and writes the model's files."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "ngram-model")
    texts = small_batches(docs).select("text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_vocabulary = max(4, -(-chars // VOCABULARY_CHARS))

    def count_words(batches):
        for b in text_steps(batches, size=STEP_BYTES):
            hashes, index, _ = text_tokens(b.column("text"))
            keys, counts = summed(hashes, np.bincount(index, minlength=len(hashes)))
            keys, counts = keys[counts > 0], counts[counts > 0]
            shard = Vocabulary("/", [0] * n_vocabulary).shard(keys)
            edges = np.searchsorted(shard, np.arange(n_vocabulary + 1))
            got = [(s, _zip(_differences(keys[a:z]), counts[a:z])) for s, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["shard", "blob"])

    def write_words(group: pa.Table) -> pa.Table:
        s = group["shard"][0].as_py()
        parts = [_unzip(x.as_py()) for x in group["blob"]]
        keys, counts = summed(np.concatenate([np.cumsum(p[0], dtype=U) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        Store(path).write(f"vocabulary-{s:06d}", pack([*EliasFano.build(keys).arrays(), counts]))
        return pa.table([pa.array([x], pa.int64()) for x in (s, len(keys), int(counts.sum()))], ["shard", "words", "tokens"])

    made = texts.mapInArrow(count_words, "shard long, blob binary").groupBy("shard").applyInArrow(write_words, "shard long, words long, tokens long").collect()  # a row per shard
    sizes = [0] * n_vocabulary
    for r in made:
        sizes[r["shard"]] = r["words"]
    tokens = sum(r["tokens"] for r in made)
    if sum(sizes) + 1 >= 2**32:
        raise ValueError("more than 4,294,967,295 different words: ranks are packed in pairs of 32 bits")
    shards = max(4, -(-tokens // SHARD_WORDS))
    model = Model(path, sizes, tokens, shards)

    def count_grams(batches):
        vocabulary = model.vocabulary()
        for b in text_steps(batches, size=STEP_BYTES):
            hashes, index, offsets = text_tokens(b.column("text"))
            ids = vocabulary.ids(hashes)[index].astype(U)
            last = np.zeros(len(ids), bool)
            last[offsets[1:] - 1] = True
            at = np.flatnonzero(~last)  # words that another follows in the document
            pairs = (ids[at] << U(32)) | ids[at + 1]
            u2, back, c2 = np.unique(pairs, return_inverse=True, return_counts=True)
            tri = ~last[at + 1]
            u3, c3 = np.unique((back[tri].astype(U) << U(32)) | ids[at[tri] + 2], return_counts=True)
            of = (u3 >> U(32)).astype(np.int64)
            shard2 = (_mix(u2) % U(shards)).astype(np.int64)
            o2 = np.argsort(shard2, kind="stable")
            e2 = np.searchsorted(shard2[o2], np.arange(shards + 1))
            o3 = np.argsort(shard2[of], kind="stable")
            e3 = np.searchsorted(shard2[of][o3], np.arange(shards + 1))
            got = []
            for s in range(shards):
                i2, i3 = o2[e2[s] : e2[s + 1]], o3[e3[s] : e3[s + 1]]
                if len(i2):
                    got.append((s, _zip(_differences(u2[i2]), c2[i2], _differences(np.searchsorted(i2, of[i3]).astype(np.int64)), u3[i3] & U(0xFFFFFFFF), c3[i3])))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["shard", "blob"])

    def write_grams(group: pa.Table) -> pa.Table:
        """Writes a trie shard; hands on, by vocabulary shard, the sums of first words' pair terms."""
        s, vocabulary = group["shard"][0].as_py(), model.vocabulary()
        parts = [_unzip(x.as_py()) for x in group["blob"]]
        pairs = [np.cumsum(p[0], dtype=U) for p in parts]
        u2, c2 = summed(np.concatenate(pairs), np.concatenate([p[1] for p in parts]).astype(np.int64))
        place = np.concatenate([np.searchsorted(u2, q)[np.cumsum(p[2].view(np.int64))] for q, p in zip(pairs, parts, strict=True)])
        u3, c3 = summed((place.astype(U) << U(32)) | np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]).astype(np.int64))
        del parts, pairs, place
        keep2, keep3 = c2 >= min_count, c3 >= min_count
        of = (np.cumsum(keep2) - 1)[(u3[keep3] >> U(32)).astype(np.int64)]
        u2, c2, last, c3 = u2[keep2], c2[keep2], u3[keep3] & U(0xFFFFFFFF), c3[keep3]
        first = (u2 >> U(32)).astype(np.int64)
        heads, head = np.unique(first, return_inverse=True)
        total = U(sum(sizes) + 1)
        term2 = (c2 - DISCOUNT) / np.maximum(vocabulary.gather(first, "vocabulary", 1), 1)
        term3 = (c3 - DISCOUNT) / c2[of]
        code2, book2 = quantised(term2)
        code3, book3 = quantised(term3)
        rest2 = np.clip(1 - np.bincount(of, book3[code3], len(u2)), 1e-6, 1)  # of the terms as they are stored
        code_rest, book_rest = quantised(rest2)
        levels = [
            EliasFano.build(heads), EliasFano.build(head.astype(U) * total + (u2 & U(0xFFFFFFFF))), EliasFano.build(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(u2)))])),
            EliasFano.build(of.astype(U) * total + last),
        ]
        Store(path).write(f"grams-{s:06d}", pack([a for e in levels for a in e.arrays()] + [code2, book2, code_rest, book_rest, code3, book3, np.packbits(np.bincount(of, minlength=len(u2)) > 0, bitorder="little")]))
        sums = np.bincount(head, book2[code2], len(heads)) if len(heads) else np.zeros(0)
        shard = np.searchsorted(vocabulary.begins, heads, "right") - 1
        rows = [(int(v), _zip(heads[shard == v].astype(U), sums[shard == v].view(U))) for v in np.unique(shard)]
        return pa.table([pa.array([v for v, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["shard", "blob"])

    def write_rests(group: pa.Table) -> pa.Table:
        s = group["shard"][0].as_py()
        rest = np.ones(sizes[s])
        for x in group["blob"]:
            if x.as_py():
                ids, sums = _unzip(x.as_py())
                rest[ids.astype(np.int64) - int(np.sum(sizes[:s]))] -= sums.view(np.float64)
        Store(path).write(f"rest-{s:06d}", pack(list(quantised(np.clip(rest, 1e-6, 1)))))
        return pa.table([pa.array([s], pa.int64())], ["shard"])

    grams = texts.mapInArrow(count_grams, "shard long, blob binary").groupBy("shard").applyInArrow(write_grams, "shard long, blob binary")
    every = spark.range(n_vocabulary).select(F.col("id").alias("shard"), F.lit(None).cast("binary").alias("blob"))
    grams.unionByName(every).groupBy("shard").applyInArrow(write_rests, "shard long").collect()  # a row per shard
    return model


class Trie:
    """One shard of pairs and triples."""

    def __init__(self, arrays: list[np.ndarray]):
        self.heads, self.pairs, self.pointers, self.triples = (EliasFano.of(arrays[5 * i : 5 * i + 5]) for i in range(4))
        self.code2, self.book2, self.code_rest, self.book_rest, self.code3, self.book3, self.bears = arrays[20:]

    def pair(self, first: np.ndarray, second: np.ndarray, total: int) -> np.ndarray:
        """Place of each pair (-1: none); pairs in order, so each first word is looked up once."""
        new = np.concatenate([[True], first[1:] != first[:-1]])
        head = self.heads.find(first[new])[np.cumsum(new) - 1]
        place, at = np.full(len(first), -1, np.int64), np.flatnonzero(head >= 0)
        place[at] = self.pairs.find(head[at].astype(U) * U(total) + second[at].astype(U))
        return place

    def fertile(self, pair: np.ndarray) -> np.ndarray:
        """Whether a pair has successors, that is, its pointers differ: a bit of each pair says so."""
        return (self.bears[pair >> 3] >> (pair & 7).astype(np.uint8) & 1).astype(bool)

    def triple(self, pair: np.ndarray, last: np.ndarray, total: int) -> np.ndarray:
        return self.triples.find(pair.astype(U) * U(total) + last.astype(U))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        vocabulary, store, total = model.vocabulary(), Store(model.path), sum(model.sizes) + 1
        for b in text_steps(batches, size=STEP_BYTES):
            hashes, index, offsets = text_tokens(b.column("text"))
            own = vocabulary.ids(hashes)
            count = vocabulary.gather(own, "vocabulary", 0)
            rest = vocabulary.gather(own, "rest", 1)
            ids, p = own[index], model.unigram(count)[index]
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            base = np.bincount(owner, np.log10(p), b.num_rows)
            known = np.bincount(owner, count[index] > 0, b.num_rows).astype(np.int64)
            last = np.zeros(len(ids), bool)
            last[offsets[1:] - 1] = True
            at = np.flatnonzero(~last)
            p2 = p[at + 1] * rest[index[at]]
            both = np.flatnonzero((ids[at] >= 0) & (ids[at + 1] >= 0))
            u2, back = np.unique((ids[at[both]].astype(U) << U(32)) | ids[at[both] + 1].astype(U), return_inverse=True)
            shard = (_mix(u2) % U(model.shards)).astype(np.int64)
            place, term2, rest2 = np.full(len(u2), -1, np.int64), np.zeros(len(u2)), np.ones(len(u2))
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(model.shards + 1))
            fertile = np.zeros(len(u2), bool)
            for s in np.flatnonzero(np.diff(edges)):
                o, trie = order[edges[s] : edges[s + 1]], Trie(mapped(store, f"grams-{s:06d}"))
                place[o] = trie.pair((u2[o] >> U(32)).astype(np.int64), (u2[o] & U(0xFFFFFFFF)).astype(np.int64), total)
                o = o[place[o] >= 0]
                term2[o] = trie.book2[trie.code2[place[o]]]
                rest2[o] = trie.book_rest[trie.code_rest[place[o]]]
                fertile[o] = trie.fertile(place[o])
            p2[both] += term2[back]
            # the triple that ends where the next pair ends
            tri = np.flatnonzero(fertile[back] & ~last[at[both] + 1])
            tri = tri[ids[at[both[tri]] + 2] >= 0]
            u3, back3 = np.unique((back[tri].astype(U) << U(32)) | ids[at[both[tri]] + 2].astype(U), return_inverse=True)
            term3, of = np.zeros(len(u3)), (u3 >> U(32)).astype(np.int64)
            order = np.argsort(shard[of], kind="stable")
            edges = np.searchsorted(shard[of][order], np.arange(model.shards + 1))
            for s in np.flatnonzero(np.diff(edges)):
                o, trie = order[edges[s] : edges[s + 1]], Trie(mapped(store, f"grams-{s:06d}"))
                found = trie.triple(place[of[o]], (u3[o] & U(0xFFFFFFFF)).astype(np.int64), total)
                o, found = o[found >= 0], found[found >= 0]
                term3[o] = trie.book3[trie.code3[found]]
            q = p.copy()
            q[at + 1] = p2
            after = both[~last[at[both] + 1]]
            q[at[after] + 2] *= rest2[back[~last[at[both] + 1]]]
            q[at[both[tri]] + 2] += term3[back3]
            full = np.bincount(owner, np.log10(np.minimum(q, 1.0)), b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(known), pa.array(np.full(b.num_rows, model.tokens, np.int64)), pa.array(base), pa.array(full)], names
            )
            let_go()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return score(docs, train(docs.where(~held_out()), min_count))

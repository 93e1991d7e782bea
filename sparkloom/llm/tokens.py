"""Token-id files: documents encoded, compressed one by one with a shared zstandard dictionary, indexed for single reads.

A file holds ``MAGIC``, one zstandard frame per document (its ids, little-endian, 2 bytes each when every id fits, else 4),
then an Arrow IPC index (doc_id, offset, bytes, n_tokens), then a JSON footer (dictionary hash, width, totals, place of
the index), the footer's length and ``MAGIC`` again.  The dictionary is trained on serialized id arrays: those of SAMPLE
blocks of ids, taken by hash from anywhere in documents taken by hash (a bounded sample, for compression only); it lies
beside the files as dictionary-<sha256>, and a file whose hash has no dictionary beside it can't be read by mistake.

Documents are encoded and compressed where they lie; only frames are dealt out in the order of the files.  A text of
characters that the worker has found to be lower-cased and classed alike by Arrow and the tokenizer is cut by the
tokenizer's own pattern in Arrow, and each distinct piece of a batch is encoded once; all other texts go through the
tokenizer by distinct words (it drops white space and never joins across it).

Defined cases: null is the empty text, which has the end id alone; order is doc_id (null first), then a hash of the text;
repeated rows are separate documents; a very long text is encoded whole, as one document; an empty table gives no rows;
extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, by_value, cut, fresh_dir, fresh_texts, relax, small_batches, text_steps, worker_cache

by_value(__name__)

MAGIC = b"LOOMTOK1"
END = 1
#: Blocks of ids that the dictionary is trained on, ids in a block, bytes of the dictionary.
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 800, 2_048, 32_768
#: Pieces, and words of other texts, kept encoded per worker.
CACHE = 300_000
#: Bytes of a file read at once.
STEP_BYTES = 8_000_000
#: Fixed value: the cutting pattern that the tokenizer file states (its white space written out).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0D\x20\p{L}\p{N}]+"
#: Characters beyond ASCII that may be plain, if the tokenizer treats each like Arrow; none of them composes with others.
WIDE = ((0xA1, 0x24F), (0x370, 0x3FF), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """The last used entries: two generations of at most CACHE / 2; what is asked for in the old one moves to the young one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        for i in [i for i, v in enumerate(found) if v is None] if None in found else ():
            if (v := self.old.get(keys[i])) is not None:
                found[i] = self.young[keys[i]] = v
        return found

    def turn(self) -> None:
        """To be called between batches."""
        if len(self.young) > CACHE // 2:
            self.young, self.old = {}, self.young


class Encoder:
    """Encodes columns of texts; one per worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces, self.seen = Recent(), Recent()
        self.odd = self._odd()

    @classmethod
    def get(cls, path: str) -> Encoder:
        cache = worker_cache()
        if ("encoder", path) not in cache:
            cache["encoder", path] = cls(path)
        return cache["encoder", path]

    def _odd(self) -> str:
        """A pattern that finds what a plain text may not hold: characters treated otherwise, controls, starts of special tokens."""
        wide = [chr(c) for a, b in WIDE for c in range(a, b + 1)]
        low = pc.utf8_lower(pa.array(wide)).to_pylist()
        same = [self.tokenizer.normalizer.normalize_str(x) == y and len(y) == 1 and self.tokenizer.normalizer.normalize_str(y) == y for x, y in zip(wide, low, strict=True)]
        # between two letters a letter makes one piece of three, any other character pieces of its own
        here = pc.replace_substring_regex(pa.array([f"a{y}a" for y in low]), PIECE, r" \0").to_pylist()
        there = [[f"a{y}a"[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{y}a")] for y in low]
        plain = sorted({ord(x) for x, ok, h, t in zip(wide, same, here, there, strict=True) if ok and h.split(" ")[1:] == t})
        ranges = [[plain[0], plain[0]]]
        for c in plain[1:]:
            if c == ranges[-1][1] + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return r"<\||[^\x{9}-\x{D}\x{20}-\x{7E}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not known, many at a time; the ends of words in the ids tell them apart."""
        to = self.pieces.young
        groups = [pieces[i : i + 200] for i in range(0, len(pieces), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1 if len(ids) else []
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for p, end in zip(group, ends.tolist(), strict=True):
                    to[p] = raw[at * 4 : end * 4]
                    at = end
            else:
                for p in group:
                    to[p] = self.whole(p)

    def _plain(self, texts: pa.Array) -> pa.ListArray:
        """Ids of plain texts, each with its end."""
        cut = pc.ascii_split_whitespace(pc.binary_join_element_wise(pc.replace_substring_regex(pc.utf8_lower(texts), PIECE, r" \0"), pa.scalar("\0", pa.large_string()), pa.scalar(" ", pa.large_string())))
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.pieces.turn()
        known = self.pieces.get(names)
        for p, ids in (("", b""), ("\0", np.array([END], "<u4").tobytes())):
            if p in names:
                known[names.index(p)] = ids
        if missing := [i for i, b in enumerate(known) if b is None] if None in known else []:
            self._learn([names[i] for i in missing])
            for i in missing:
                known[i] = self.pieces.young[names[i]]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)])
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(known), "<u4"))).take(coded.indices)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        return pa.LargeListArray.from_arrays(pa.array(ids.offsets.to_numpy()[offsets - offsets[0]] - ids.offsets[0].as_py()), ids.flatten())

    def _odd_one(self, text: str) -> np.ndarray:
        self.seen.turn()
        words = re.split("[\t-\r ]+", text)
        ids = self.seen.get(words)
        for i in [i for i, b in enumerate(ids) if b is None]:
            if (b := self.seen.young.get(words[i])) is None:
                b = self.seen.young[words[i]] = self.whole(words[i])
            ids[i] = b
        return np.frombuffer(b"".join([*ids, np.array([END], "<u4").tobytes()]), "<u4")

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and the documents' offsets in them."""
        texts = fresh_texts(texts)
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = self._plain(texts.filter(pa.array(~odd)))
        ids, offsets = plain.values.to_numpy(), plain.offsets.to_numpy()
        if not odd.any():
            return ids, offsets
        of_plain, parts = iter(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), []
        for i, o in enumerate(odd.tolist()):
            if o:
                parts.append(self._odd_one(texts[i].as_py()))
            else:
                a, b = next(of_plain)
                parts.append(ids[a:b])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def train_dictionary(samples: list[bytes]):
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3)
    except (zstandard.ZstdError, ValueError):  # too few to train on
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].ljust(16, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """One file."""

    def __init__(self, store: Store, name: str, dictionary_hash: str, width: int):
        self.store, self.name, self.width, self.hash = store, name, width, dictionary_hash
        self.part = f"{store.root}/.{name}.{hashlib.sha256(np.random.bytes(16)).hexdigest()[:16]}"
        store.fs.create_dir(store.root, recursive=True)
        self.out, self.at, self.index = store.fs.open_output_stream(self.part, compression=None), len(MAGIC), []
        self.out.write(MAGIC)
        self.tokens = 0

    def add(self, doc_ids: pa.Array, frames: pa.Array, n_tokens: pa.Array) -> None:
        size = pc.binary_length(frames).to_numpy().astype(np.int64)
        for frame in frames:
            self.out.write(frame.as_buffer())
        ends = self.at + np.cumsum(size)
        self.index.append(pa.record_batch([doc_ids, pa.array(ends - size), pa.array(size), n_tokens], ["doc_id", "offset", "bytes", "n_tokens"]))
        self.at = int(ends[-1])
        self.tokens += pc.sum(n_tokens).as_py()

    def close(self) -> tuple[int, int]:
        table = pa.Table.from_batches(self.index)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        index = sink.getvalue().to_pybytes()
        footer = json.dumps({"dictionary": self.hash, "width": self.width, "docs": len(table), "tokens": self.tokens, "index": self.at, "index_bytes": len(index)}).encode()
        self.out.write(index + footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.store.fs.move(self.part, f"{self.store.root}/{self.name}")
        return len(table), self.tokens


class Reader:
    """Random access to one file: ``ids(i)`` reads and opens the frame of document i alone."""

    def __init__(self, store: Store, name: str):
        import zstandard

        self.f = store.fs.open_input_file(f"{store.root}/{name}")
        size = self.f.size()
        tail = self.f.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC:
            raise ValueError(f"{name}: not a token file")
        n = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.f.read_at(n, size - 4 - len(MAGIC) - n))
        dictionary = store.read(f"dictionary-{self.footer['dictionary']}")
        if hashlib.sha256(dictionary).hexdigest() != self.footer["dictionary"]:
            raise ValueError(f"{name}: wrong dictionary")
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.index = pa.ipc.open_stream(self.f.read_at(self.footer["index_bytes"], self.footer["index"])).read_all()
        self.offset, self.bytes = (self.index[c].to_numpy() for c in ("offset", "bytes"))

    def ids(self, i: int) -> np.ndarray:
        return self._open(self.f.read_at(int(self.bytes[i]), int(self.offset[i])))

    def _open(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(frame), f"<u{self.footer['width']}").astype("<u4")

    def every(self) -> Iterator[np.ndarray]:
        """The ids of each document in order; frames are read many at once."""
        ends = self.offset + self.bytes
        i, n = 0, len(ends)
        while i < n:
            begin = int(self.offset[i])
            j = max(i + 1, int(np.searchsorted(ends, begin + STEP_BYTES, "right")))
            block = self.f.read_at(int(ends[j - 1]) - begin, begin)
            for k in range(i, j):
                yield self._open(block[int(self.offset[k]) - begin : int(ends[k]) - begin])
            i = j


def dictionary_for(rows: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary trained on SAMPLE blocks of ids: those with the smallest hashes in the SAMPLE documents with the smallest hashes."""
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    most = rows.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if most is None:
        return train_dictionary([]).as_bytes()

    def cut_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            ids, offsets = Encoder.get(tokenizer).column(b.column("text"))
            raw = ids.astype(f"<u{width}")
            blocks = [raw[i : min(i + SAMPLE_IDS, z)].tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for i in range(a, z, SAMPLE_IDS)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).digest() for x in blocks], pa.binary()), pa.array(blocks, pa.binary())], ["h", "block"])

    # SAMPLE documents, or as many blocks of longer ones: at most SAMPLE rows of 2 * SAMPLE_IDS or 4 * SAMPLE_IDS bytes reach the driver
    blocks = rows.where(h <= F.lit(most)).select("text").distinct().mapInArrow(cut_ids, "h binary, block binary").distinct().orderBy("h").limit(SAMPLE)
    return train_dictionary([bytes(r["block"]) for r in blocks.select("block").collect()]).as_bytes()


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> list[tuple[int, int, int]]:
    """Writes the files in order of doc_id; returns (file number, documents, tokens), a row per file."""
    tokenizer = tokenizer or tokenizer_path()
    width = 2 if Encoder.get(tokenizer).size <= 65_536 else 4
    rows = small_batches(docs).select("doc_id", "text")
    dictionary = dictionary_for(rows, tokenizer, width)
    name = hashlib.sha256(dictionary).hexdigest()
    Store(path).write(f"dictionary-{name}", dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=1)
        compress = zstandard.ZstdCompressor(level=1, dict_data=shared, write_content_size=True).compress
        for b in text_steps(batches):
            ids, offsets = Encoder.get(tokenizer).column(b.column("text"))
            raw = memoryview(ids.astype(f"<u{width}")).cast("B")
            at = (offsets * width).tolist()
            frames = [compress(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.diff(offsets)), pa.array(frames, pa.binary())], ["doc_id", "th", "n_tokens", "frame"])
        relax()

    kind = docs.schema["doc_id"].dataType.simpleString()
    # written once: finding the ranges and dealing the frames both read it
    frames = cut(rows.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(encode, f"doc_id {kind}, th long, n_tokens long, frame binary"), "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer = TaskContext.get().partitionId(), None
        for b in batches:
            if b.num_rows:
                writer = writer or Writer(Store(path), f"part-{number:06d}", name, width)
                writer.add(b.column("doc_id"), b.column("frame"), b.column("n_tokens"))
        if writer:
            docs, tokens = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, docs, tokens)], ["file", "docs", "tokens"])

    # equal rows are told apart by their place, so even one id that a third of all rows hold is cut to many files
    order = [F.col("doc_id").asc_nulls_first(), F.col("th").asc(), F.col("place").asc()]
    placed = frames.withColumn("place", F.monotonically_increasing_id())
    made = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "file long, docs long, tokens long")
    return sorted(tuple(r) for r in made.collect())  # a row per file


def read(spark: SparkSession, path: str, files: list[tuple[int, int, int]], id_type: str = "bigint") -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, ids_crc32."""
    starts, at = [], 0
    for number, _, tokens in files:
        starts.append((number, at))
        at += tokens
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                number, start = starts[i]
                reader = Reader(Store(path), f"part-{number:06d}")
                n = reader.index["n_tokens"].to_numpy()
                crc = [zlib.crc32(x.tobytes()) for x in reader.every()]
                table = pa.table([reader.index["doc_id"], pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names)
                yield from table.to_batches(max_chunksize=10_000)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the files (into the shared folder unless told otherwise) and reads them back."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "token-files")
    return read(spark, path, write(docs, path, tokenizer), docs.schema["doc_id"].dataType.simpleString())

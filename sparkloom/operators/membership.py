"""Membership filters: a byte and a quarter for each key, no key lost, one strange key in 256 let through.

A filter of a set of 64-bit hashes has three blocks of one-byte cells.  A key has a cell in each block and a one-byte mark, and the
three cells' exclusive or is the mark.  Cells are found by peeling: a key that is alone in a cell can be settled after all others,
so such keys are taken out, round after round, until none is left, and cells are set in the opposite order.  Where that gets stuck,
the set is tried again with another seed.  All sets of an Arrow batch are peeled together, a round at a time.

Layout of a filter: seed and cells of a block as two little-endian 32-bit numbers, then the cells.  An empty set has an empty filter.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hierarchy import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Odd multipliers that mix a hash and pick its cells (any odd numbers with well spread bits).
MIX, CELLS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Cells for n keys: 1.23 n and some more, below which peeling gets stuck too often.
ROOM, LEAST = 1.23, 32


def hashed(ref: Column) -> Column:
    return F.xxhash64(ref)


def places(keys: np.ndarray, seeds: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (n x 3, within the filter) and marks of hashes, under the seeds and block lengths of their filters."""
    x = (keys ^ (seeds * np.uint64(MIX))) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    cells = [(((x * np.uint64(m)) >> np.uint64(32)) * blocks >> np.uint64(32)) + np.uint64(i) * blocks for i, m in enumerate(CELLS)]
    return np.stack(cells, axis=1).astype(np.int64), ((x * np.uint64(MIX)) >> np.uint64(56)).astype(np.uint8)


def peel(cells: np.ndarray, size: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rounds of (key, cell that it is alone in), and the keys that no round takes."""
    count = np.bincount(cells.ravel(), minlength=size)
    total = np.zeros(size, np.int64)  # of the numbers of the keys in a cell
    np.add.at(total, cells.ravel(), np.repeat(np.arange(len(cells)), 3))
    rounds, left = [], np.ones(len(cells), bool)
    alone = np.flatnonzero(count == 1)
    while len(alone):
        keys, first = np.unique(total[alone], return_index=True)
        rounds.append((keys, alone[first]))
        left[keys] = False
        touched = cells[keys].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.repeat(keys, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return rounds, np.flatnonzero(left)


def build(sets: list[np.ndarray]) -> list[bytes]:
    """The filters of sets of different 64-bit hashes."""
    out = [b""] * len(sets)
    todo, seed = [i for i, s in enumerate(sets) if len(s)], 0
    while todo:
        n = np.array([len(sets[i]) for i in todo])
        blocks = np.ceil((n * ROOM + LEAST) / 3).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(3 * blocks)])
        owner = np.repeat(np.arange(len(todo)), n)
        cells, marks = places(np.concatenate([sets[i] for i in todo]).astype(np.uint64), np.full(len(owner), seed, np.uint64), blocks[owner].astype(np.uint64))
        cells += base[owner][:, None]
        rounds, stuck = peel(cells, int(base[-1]))
        table = np.zeros(base[-1], np.uint8)
        for keys, cell in reversed(rounds):
            table[cell] = marks[keys] ^ np.bitwise_xor.reduce(table[cells[keys]], axis=1)
        again = set(owner[stuck].tolist())
        for k, i in enumerate(todo):
            if k not in again:
                out[i] = struct.pack("<II", seed, blocks[k]) + table[base[k] : base[k + 1]].tobytes()
        todo, seed = [todo[k] for k in sorted(again)], seed + 1
    return out


def held(filters: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Whether each filter may hold any of the hashes."""
    found = np.zeros(len(filters), bool)
    some = np.array([i for i, f in enumerate(filters) if f], np.int64)
    if not len(some) or not len(keys):
        return found
    heads = np.array([struct.unpack_from("<II", filters[i]) for i in some], np.uint64)
    data = np.frombuffer(b"".join(filters[i] for i in some), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(filters[i]) for i in some])])[:-1] + 8
    for key in keys.astype(np.uint64):
        cells, marks = places(np.full(len(some), key), heads[:, 0], heads[:, 1])
        found[some] |= np.bitwise_xor.reduce(data[cells + base[:, None]], axis=1) == marks
    return found


def filters(sets: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, n_keys, filter) of rows with an array of different hashes (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # sets that are peeled together
                part = b.slice(at, 500)
                lists = [np.asarray(v.values, np.int64) if v.is_valid else np.zeros(0, np.int64) for v in part.column(hashes)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(v) for v in lists], pa.int64()), pa.array(build(lists), pa.binary())], [key, "n_keys", "filter"])

    return sets.select(key, hashes).mapInArrow(run, T.StructType([sets.schema[key], T.StructField("n_keys", T.LongType()), T.StructField("filter", T.BinaryType())]))


def may_hold(stored: DataFrame, key: str, refs: list[str]) -> DataFrame:
    """(key) of the filters that may hold one of the names: all that do, and one in 256 of the others for each name."""
    spark = stored.sparkSession
    keys = np.array([r[0] for r in spark.createDataFrame([(r,) for r in dict.fromkeys(refs)], "r string").select(hashed(F.col("r"))).collect()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key).filter(pa.array(held(b.column("filter").to_pylist(), keys)))], [key])

    return stored.select(key, "filter").mapInArrow(run, T.StructType([stored.schema[key]]))


#: Keys that are broadcast to find their documents; beyond, both sides are shuffled by key.
BROADCAST_KEYS = 100_000


def only(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of a table with one of the wanted keys, which are written before they are counted."""
    path = f"{shared_folder(table.sparkSession)}/wanted-{uuid.uuid4().hex}"
    wanted.write.parquet(path)
    wanted = table.sparkSession.read.schema(wanted.schema).parquet(path)
    return table.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, key, "left_semi")

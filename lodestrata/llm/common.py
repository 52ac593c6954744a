"""Helpers shared by the corpus operators: shared storage, word hashing, counting sketches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python at most, so that long texts and arrays don't add up.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
WORD = "[^\\x20\\x09-\\x0D]+"
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and Spark is local, as in
    tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs no recomputation of what lies before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def text_key(col: str = "text"):
    """Tells rows with equal doc_id and different texts apart."""
    return F.xxhash64(F.col(col))


def split_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8 (bytes.split() splits at just these characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values, so that their order is as good as random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of all windows of an array of 64-bit values, by prefix sums modulo 2**64."""

    def __init__(self, multiplier: int):
        self.up, self.down = multiplier | 1, pow(multiplier | 1, -1, 1 << 64)
        self.powers = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 4096)
            for name, base in (("powers", self.up), ("inverse", self.down)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.inverse[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.powers[start])

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        n = len(values) - length + 1
        if n <= 0:
            return np.empty(0, _U)
        p = self.prefix(values)
        return mix((p[length:] - p[:n]) * self.powers[:n])


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each window of the given length, by doubling."""
    have = 1
    while 2 * have <= length:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (length - have)], x[length - have :]) if have < length else x


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column, one list for each array."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


# Counting sketch. Each partition counts keys in `depth` rows of `width` counters and emits the touched counters by
# block; the merge adds them up (saturating), so that a merged counter is never below any of its keys' counts.
BLOCK_BITS = 19
WIDEST = 28  # log2 of the counters in a row at most: 64 MB that every task gets
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SKETCH_SCHEMA = "row int, block int, pos binary, n binary"


def sketch_bits(n_keys: int, load: float, at_least: int = BLOCK_BITS + 1, at_most: int = WIDEST) -> int:
    """log2 of the width for n_keys keys at the given load. at_most bounds what is broadcast: 2**28 counters of 2 bits, 64 MB
    a row. A fuller sketch only overestimates more; it never loses a key."""
    return int(min(at_most, max(at_least, np.ceil(np.log2(max(n_keys, 1) / load)))))


def slots(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * _U(_SEEDS[row])) >> _U(64 - bits)).astype(np.int64)


class PartialSketch:
    """One partition's counts. flush() hands out what has gathered, so memory stays bounded for any partition."""

    def __init__(self, bits: int, depth: int, limit: int = 3_000_000):
        self.bits, self.depth, self.limit, self.keys, self.held = bits, depth, limit, [], 0

    def add(self, keys: np.ndarray) -> bool:
        self.keys.append(keys)
        self.held += len(keys)
        return self.held >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, self.keys, self.held = np.concatenate(self.keys), [], 0
        for row in range(self.depth):
            at, n = np.unique(slots(keys, row, self.bits), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            block = at >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
            low = (at & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts) - 1, row, np.int32)), pa.array(block[cuts[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["row", "block", "pos", "n"],
            )


_MERGED = "row int, block int, levels binary, total long, at array<int>, n array<long>"


def _packed(counts: np.ndarray, steps: tuple[int, ...]) -> bytes:
    level = sum((counts >= s).astype(np.uint8) for s in steps).reshape(-1, 4)
    return (level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6).astype(np.uint8).tobytes()


def _merged(partial: DataFrame, bits: int, depth: int, steps: tuple[int, ...], wide: int | None = None, least: int = 0) -> DataFrame:
    """The merged blocks of partial sketches: packed levels, and for those of wide counters (row -1) their sum and the counters that
    reach `least`. A task holds one block at a time."""
    width = 1 << min(wide or 0, BLOCK_BITS)

    def done(row: int, block: int, own: np.ndarray) -> pa.RecordBatch:
        if row < 0:
            top = np.flatnonzero(own >= least)
            columns = [pa.array([None], pa.binary()), pa.array([int(own.sum())], pa.int64()), lists([top.astype(np.int32)], pa.int32()), lists([own[top].astype(np.int64)], pa.int64())]
        else:
            columns = [pa.array([_packed(own, steps)], pa.binary()), pa.array([0], pa.int64()), lists([np.empty(0, np.int32)], pa.int32()), lists([np.empty(0, np.int64)], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), *columns], names=[x.split()[0] for x in _MERGED.split(", ")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current = None, None
        for b in batches:
            for row, block, pos, n in zip(*(b.column(k) for k in range(4))):
                key = row.as_py(), block.as_py()
                if key != current:
                    if own is not None:
                        yield done(*current, own)
                    current, own = key, np.zeros(width, np.uint64) if key[0] < 0 else np.zeros(1 << BLOCK_BITS, np.uint8)
                if key[0] < 0:
                    own += np.frombuffer(pa.decompress(pos.as_py(), 4 * width, "zstd", asbytes=True), np.uint32)
                else:
                    at, add = np.frombuffer(pos.as_py(), np.uint32), np.frombuffer(n.as_py(), np.uint8)
                    own[at] = np.minimum(own[at].astype(np.uint16) + add, 255)
        if own is not None:
            yield done(*current, own)

    blocks = (depth << (bits - BLOCK_BITS)) + ((1 << wide) // width if wide else 0)
    dealt = partial.repartition(min(blocks, max(8, int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "row", "block")
    return dealt.sortWithinPartitions("row", "block").mapInArrow(merge, _MERGED)


def _levels_of(rows, bits: int, depth: int) -> list[np.ndarray]:
    out = [np.zeros(1 << (bits - 2), np.uint8) for _ in range(depth)]
    size = 1 << (BLOCK_BITS - 2)
    for r in rows:
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    return out


def merged_levels(partial: DataFrame, bits: int, depth: int, steps: tuple[int, ...]) -> list[np.ndarray]:
    """Merges partial sketches and returns, for each row, the packed level of every counter: how many of `steps` (at most
    three, up to 255) it reaches, in 2 bits. The driver gets depth * 2**bits / 4 bytes, which sketch_bits bounds."""
    return _levels_of(_merged(partial, bits, depth, steps).select("row", "block", "levels").toLocalIterator(), bits, depth)


def level_blocks(partial: DataFrame, step: int) -> DataFrame:
    """block, flags: one bit for each counter of a sketch of one row, whether it reaches `step`. Stays a table, for sketches that
    no task could hold."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current = None, None

        def done() -> pa.RecordBatch:
            flags = np.packbits(own >= step, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([flags], pa.binary())], names=["block", "flags"])

        for b in batches:
            for block, pos, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                if block != current:
                    if own is not None:
                        yield done()
                    own, current = np.zeros(1 << BLOCK_BITS, np.uint8), block
                at, add = np.frombuffer(pos, np.uint32), np.frombuffer(n, np.uint8)
                own[at] = np.minimum(own[at].astype(np.uint16) + add, 255)
        if own is not None:
            yield done()

    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, flags binary")


def level_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The least level over the rows: an overestimate of each key's count, as a level."""
    bits = int(len(levels[0]) * 4).bit_length() - 1
    out = None
    for row, packed in enumerate(levels):
        at = slots(keys, row, bits)
        own = (packed[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3
        out = own if out is None else np.minimum(out, own)
    return out


# Heavy keys. A sketch with counters of 32 bits over all keys, however many there are: a key whose counter is far above what
# falls on each counter by chance has very many occurrences. Nothing but one bit a counter is broadcast.
HEAVY_BITS = 22  # log2 of the counters at most: 16 MB in a task, 512 KB broadcast
HEAVY_FACTOR = 8  # times the mean of all counters


class WideCounts:
    """One partition's counters. drain() hands out the blocks that have been touched, compressed."""

    def __init__(self, bits: int):
        self.bits, self.n, self.gathered, self.held = bits, np.zeros(1 << bits, np.uint32), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.gathered.append((keys >> _U(64 - self.bits)).astype(np.uint32))
        self.held += len(keys)
        if self.held >= 1_000_000:
            self._count()

    def _count(self) -> None:
        if self.held:
            at, n = np.unique(np.concatenate(self.gathered), return_counts=True)
            self.n[at] += np.minimum(n, np.uint32(0xFFFFFFFF) - self.n[at]).astype(np.uint32)
            self.gathered, self.held = [], 0

    def drain(self) -> Iterator[pa.RecordBatch]:
        self._count()
        width = 1 << min(self.bits, BLOCK_BITS)
        for block in range(len(self.n) // width):
            own = self.n[block * width : (block + 1) * width]
            if own.any():
                packed = pa.compress(own.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block], pa.int32()), pa.array([packed], pa.binary()), pa.array([b""], pa.binary())], names=["row", "block", "pos", "n"])


def heavy_bits(n_keys: int) -> int:
    return int(min(HEAVY_BITS, max(16, np.ceil(np.log2(max(n_keys, 1))))))


def merged_with_heavy(partial: DataFrame, bits: int, steps: tuple[int, ...], wide: int, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """merged_levels() of a sketch of one row, and one bit for each wide counter, packed: whether it reaches `least` and
    HEAVY_FACTOR times the mean of all counters. No more than 1 / HEAVY_FACTOR of the counters can be so far above the mean."""
    table = materialize(_merged(partial, bits, 1, steps, wide, least), "merged")
    levels = _levels_of(table.where("row >= 0").select("row", "block", "levels").toLocalIterator(), bits, 1)
    counters = table.where("row = -1")
    total = counters.agg(F.sum("total")).first()[0] or 0
    limit = max(least, HEAVY_FACTOR * total >> wide)
    flags, width = np.zeros(1 << wide, bool), 1 << min(wide, BLOCK_BITS)
    far = F.filter(F.arrays_zip("at", "n"), lambda x: x["n"] >= limit)
    for r in counters.select("block", F.transform(far, lambda x: x["at"]).alias("at")).toLocalIterator():
        flags[r["block"] * width + np.array(r["at"], np.int64)] = True
    return levels, np.packbits(flags, bitorder="little")


def is_heavy(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    at = (keys >> _U(64 - (len(flags) * 8).bit_length() + 1)).astype(np.int64)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0

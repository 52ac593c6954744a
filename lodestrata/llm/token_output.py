"""Token ids as binary shards: ranks by frequency, in a byte-aligned variable-length coding.

The format. A table of shards, written and committed by Spark, so that it can be in any store and a lost task leaves nothing
behind. Ids are replaced by their ranks in the corpus, the most frequent id first (the rank table is the file `ranks`).
A rank takes 1 to 4 bytes, little-endian. Control bytes are kept apart: 2 bits for each rank, four to a byte, the first in
the lowest bits, hold its number of bytes less 1. A shard holds consecutive documents in ascending order of doc_id:
  part, shard   long    the order of shards
  before        long    ids of the part's earlier shards
  doc_ids, n    array   the documents and their numbers of ids
  control, data binary  the streams
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .tokens import ids_of

SHARD_IDS = 1 << 20
SHARD_SCHEMA = "part long, shard long, before long, doc_ids array<long>, n array<int>, control binary, data binary"
_LENGTHS = np.array([[(b >> 2 * k & 3) + 1 for k in range(4)] for b in range(256)], np.uint8)  # of the four ranks of a control byte


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks. Lengths come from a table by control byte; each byte is then taken for all ranks at once."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_table(encoded: DataFrame) -> np.ndarray:
    """Ids by descending count over all documents (ties: the lesser id first). The vocabulary bounds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for narrow in (True, False):
                own = np.bincount(_raw(b"".join(b.column(0).filter(b.column(1) if narrow else pc.invert(b.column(1))).to_pylist()), narrow))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = encoded.select("ids", "narrow").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def _raw(ids: bytes, narrow: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if narrow else "<u4")


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, key (of the text), ids (in two bytes each where narrow, else four)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, at in ids_of(batches, "text", tokenizer, end_id):
            top = np.maximum.reduceat(ids, at[:-1])  # no text is without an id
            wide = top >= 1 << 16
            size = np.where(wide, 4, 2) * np.diff(at)
            if wide.any():
                raw = b"".join(ids[s:e].astype("<u4" if w else "<u2").tobytes() for s, e, w in zip(at[:-1].tolist(), at[1:].tolist(), wide.tolist()))
            else:
                raw = ids.astype("<u2").tobytes()
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], binary, pa.array(~wide)], names=["doc_id", "key", "ids", "narrow"])

    return docs.select("doc_id", c.text_key().alias("key"), "text").mapInArrow(encode, "doc_id long, key long, ids binary, narrow boolean")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, out: str) -> None:
    """Writes the ids of every text, end_id after each, to `out`. Null texts are empty, null doc_ids come first; rows with
    one doc_id are in the order of their texts' hashes. Further columns are ignored. An empty table gives no shards.

    Texts are encoded once where they lie, into a table of ids in the shared folder. Counts are taken from it, and only ids
    (about half a text's bytes) are shuffled and sorted, while no tokenizer takes memory beside them."""
    spark = docs.sparkSession
    encoded = c.materialize(_encoded(docs, tokenizer, end_id), "ids")
    ranks = rank_table(encoded)
    spark.createDataFrame([(bytearray(ranks.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{out}/ranks")
    to_rank = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
    to_rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before, doc_ids, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = pack(shared.value[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([before]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "shard", "before", "doc_ids", "n", "control", "data"])

        for b in batches:
            for doc_id, own, narrow in zip(*(b.column(k) for k in range(3))):
                doc_ids.append(doc_id.as_py())
                ids.append(_raw(own.as_py(), narrow.as_py()))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield flush()
                    shard, before, doc_ids, ids, held = shard + 1, before + held, [], [], 0
        if ids:
            yield flush()

    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("doc_id").asc_nulls_first(), F.col("key"))
    ordered = encoded.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids", "narrow").mapInArrow(shards, SHARD_SCHEMA).write.parquet(f"{out}/shards")


def read_ids(spark, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids, decoded from what write_ids wrote. With digests,
    ids_crc32 (of the ids as little-endian 32-bit integers) instead of ids."""
    ranks = np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first()[0]), "<u4")
    shared = spark.sparkContext.broadcast(ranks)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # one total for each part, that is for each partition of the writing job
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = shards.groupBy("part").agg(F.max(F.col("before") + total).alias("total")).orderBy("part").collect()
    parts = np.array([r["part"] for r in totals], np.int64)
    starts = spark.sparkContext.broadcast((parts, np.concatenate([[0], np.cumsum([r["total"] for r in totals])]).astype(np.int64)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, before, doc_ids, n, control, data in zip(*b.columns):
                n = n.values.to_numpy().astype(np.int64)
                ids = shared.value[unpack(control.as_py(), data.as_py(), int(n.sum()))]
                end = np.cumsum(n)
                first = starts.value[1][np.searchsorted(starts.value[0], part.as_py())] + before.as_py()
                if digests:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[s:e]) for s, e in zip((4 * (end - n)).tolist(), (4 * end).tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first + end - n), pa.array(n), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return shards.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids array<int>'}")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{c.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1, out)
    return read_ids(spark, out, digests=True)

"""Packing: bounded-space online best fit of token runs into sequences.

Each task keeps a fixed number of open windows. A document's ids go into the fullest window that they fit into; if none
has room, the fullest one is filled up with their beginning and emitted. What is open at a partition's end is merged with
that of other partitions. So every sequence is full, but for the last of each merge, which is cut at powers of two."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ids_of

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LEFT = PIECE_SCHEMA + ", ids array<int>"
MERGED = 256  # partitions whose leftovers are merged together


class Windows:
    """Open windows of `size` ids, `most` at a time. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.used = size, most, [], []

    def put(self, doc_id, start: int, total: int, ids: np.ndarray) -> Iterator[list]:
        """Places the ids; yields the windows that became full."""
        while len(ids):
            room = [(u, k) for k, u in enumerate(self.used) if u + len(ids) <= self.size]
            if not room and len(ids) < self.size and len(self.open) < self.most:
                self.open.append([])
                self.used.append(0)
                room = [(0, len(self.open) - 1)]
            if room:
                k = max(room)[1]
                take = len(ids)
            elif len(ids) >= self.size:
                yield [(doc_id, start, total, ids[: self.size])]
                start, ids = start + self.size, ids[self.size :]
                continue
            else:
                k = max((u, k) for k, u in enumerate(self.used))[1]
                take = self.size - self.used[k]
            self.open[k].append((doc_id, start, total, ids[:take]))
            self.used[k] += take
            start, ids = start + take, ids[take:]
            if self.used[k] == self.size:
                self.used.pop(k)
                yield self.open.pop(k)

    def merge(self) -> Iterator[list]:
        """Moves the emptiest windows' pieces into the fullest ones till one is left open at most."""
        while len(self.open) > 1:
            k = min((u, k) for k, u in enumerate(self.used))[1]
            pieces = self.open.pop(k)
            self.used.pop(k)
            most, self.most = self.most, len(self.open)
            for piece in pieces:
                yield from self.put(*piece)
                self.most = max(1, len(self.open)) if not self.open else self.most
            self.most = most


def _rows(windows: Iterator[list], first_id: int, with_ids: bool) -> pa.RecordBatch | None:
    out: list[tuple] = []
    ids = []
    for seq, window in enumerate(windows):
        at = 0
        for doc_id, start, total, own in window:
            out.append((doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), total, first_id + seq, at))
            at += len(own)
            ids.append(own.astype(np.int32) if with_ids else own[:0].astype(np.int32))
    if not out:
        return None
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    cols = [pa.array(x, pa.int64()) for x in zip(*out)]
    names = [x.split()[0] for x in _LEFT.split(", ")]
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=names)


def _powers(window: list) -> Iterator[list]:
    """A window cut into sequences whose lengths are powers of two, the longest first, so that none needs padding."""
    left = [list(x) for x in window]
    n = sum(len(x[3]) for x in left)
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            need, out = 1 << bit, []
            while need:
                doc_id, start, total, ids = left[0]
                take = min(need, len(ids))
                out.append((doc_id, start, total, ids[:take]))
                need -= take
                left[0] = [doc_id, start + take, total, ids[take:]]
                if not len(left[0][3]):
                    left.pop(0)
            yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, open_windows: int = 16) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every text, and end_id after each, is in exactly one piece. Null texts are empty (a piece of one id).
    Repeated rows are packed each; null doc_ids stay null; further columns are ignored; an empty table gives no piece. The
    only shuffle moves what is open at the end of each partition: `size` ids at most from each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows, seq = Windows(size, open_windows), TaskContext.get().partitionId() << 32
        for b, ids, at in ids_of(batches, "text", tokenizer, end_id):
            ends = at.tolist()
            done = [w for doc_id, s, e in zip(b.column("doc_id").to_pylist(), ends, ends[1:]) for w in windows.put(doc_id, 0, e - s, ids[s:e])]
            if rows := _rows(done, seq, False):
                yield rows
            seq += len(done)
        done = list(windows.merge())
        if rows := _rows(done, seq, False):
            yield rows
        seq += len(done)
        if windows.open and (rows := _rows(windows.open, -1 - TaskContext.get().partitionId(), True)):
            yield rows

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, group, seq = Windows(size, open_windows), None, 0

        def end():
            done = [*windows.merge(), *(p for w in windows.open for p in _powers(w))]
            windows.open, windows.used = [], []
            return done

        for b in batches:
            done = []
            for r in b.to_pylist():
                if group != r["merge_group"]:
                    if done := done + (end() if group is not None else []):
                        yield _rows(done, seq, False).drop_columns(["ids"])
                    group, seq, done = r["merge_group"], (1 << 62) + (r["merge_group"] << 32), []
                done += windows.put(r["doc_id"], r["start"], r["doc_tokens"], np.array(r["ids"], np.uint32))
            if done:
                yield _rows(done, seq, False).drop_columns(["ids"])
                seq += len(done)
        if group is not None and (done := end()):
            yield _rows(done, seq, False).drop_columns(["ids"])

    from .common import materialize

    placed = materialize(docs.select("doc_id", "text").mapInArrow(place, _LEFT), "packed")
    left = placed.where("sequence_id < 0").withColumn("merge_group", F.expr(f"(-1 - sequence_id) div {MERGED}"))
    left = left.repartition("merge_group").sortWithinPartitions("merge_group", F.desc("sequence_id"), "offset")
    return placed.where("sequence_id >= 0").drop("ids").unionByName(left.mapInArrow(merge, PIECE_SCHEMA))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)

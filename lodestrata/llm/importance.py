"""Importance resampling towards a target: documents drawn by how much their words and word pairs look like the target's.

Features fall into buckets by a checksum. A bucket's gain is the log ratio of its shares in the target and in all
documents; the gains are one array that every task gets (8 bytes a bucket), and a document's weight is the mean over its
features. With Gumbel noise added, the documents of the highest scores are a sample without replacement. Which key is the
k-th is found by radix selection: each pass counts one digit of the composite key, so nothing is sorted but what is drawn."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.numbering import numbered

from .common import materialize

_OTHER = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
PIECE = 1 << 20  # bytes of a text that are split into words at a time
_SHORT = 24  # words of more bytes are appended to a checksum one by one
_HELD = 500_000  # words whose checksums a task remembers


def _appending() -> np.ndarray:
    """[n, k, v]: what byte k of a checksum, if it is v, becomes when n bytes follow; checksums are linear, so these are xored."""
    out = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    for n in range(_SHORT + 1):
        zeros, none = bytes(n), zlib.crc32(bytes(n), 0)
        out[n] = [[zlib.crc32(zeros, v << 8 * k) ^ none for v in range(256)] for k in range(4)]
    return out


class Features:
    """Buckets of all runs of one or two consecutive words of a text."""

    def __init__(self, buckets: int):
        self.buckets, self.table = buckets, _appending()
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.known = 0
        self.seen = np.zeros((3, 4096), np.uint32)  # checksum, checksum with a space behind, bytes; grows by doubling

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        if len(index) > self.known:
            new = list(islice(reversed(index), len(index) - self.known))[::-1]
            sums = [zlib.crc32(w) for w in new]
            if len(index) > self.seen.shape[1]:
                grown = np.zeros((3, 2 * len(index)), np.uint32)
                grown[:, : self.known] = self.seen[:, : self.known]
                self.seen = grown
            self.seen[:, self.known : len(index)] = sums, [zlib.crc32(b" ", s) for s in sums], [min(len(w), _SHORT + 1) for w in new]
            self.known = len(index)
        return ids

    def of(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece of the text, the number of its words and the buckets of the features that end in it."""
        at, last, size = 0, None, len(text or b"")
        while at < size:
            end = at + PIECE
            low = text[at:end].translate(_OTHER)
            while end < size and not low.endswith(b" "):  # up to the end of a word
                more = text[end : end + 4096].translate(_OTHER)
                cut = more.find(b" ") + 1 or len(more)
                low, end = low + more[:cut], end + cut
            at, words = end, low.split()
            if not words:
                continue
            ids = self._numbers(words if last is None else [last, *words])
            whole, spaced, length = (row[ids] for row in self.seen)
            n = np.minimum(length[1:], _SHORT)
            pairs = whole[1:].copy()
            for k in range(4):
                pairs ^= self.table[n, k, (spaced[:-1] >> np.uint32(8 * k)) & np.uint32(255)]
            before = words if last is not None else words[1:]
            for k in np.flatnonzero(length[1:] > _SHORT):
                pairs[k] = zlib.crc32(before[k], int(spaced[k]))
            single = whole if last is None else whole[1:]
            last = words[-1]
            yield len(words), np.concatenate([single, pairs]) % np.uint32(self.buckets)
            if len(self.index) > _HELD:
                self.forget()


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task hands out one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, own in features.of(text.as_py()):
                    total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    partial = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the source, for each bucket."""
    s, t = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _noise(key: bytes) -> int:
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and digest, 64 bits of its text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gains))
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = n = total = 0
                for w, own in features.of(text.as_py()):
                    words, n, total = words + w, n + len(own), total + int(gains[own].sum())
                weight = total // n if n else 0
                rows.append((words, n, weight, weight + _noise(f"{seed}:{'' if doc_id is None else doc_id}".encode())))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(2)], names=["doc_id", "n_words", "n_features", "weight", "score", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long, digest long")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th least composite key (k from 1) of long columns without nulls, by radix selection.

    Each pass counts one digit of 16 bits among the rows that agree with the digits found so far; the driver gets 65,536
    counts at most. Digits that all of these rows share take no pass."""
    found = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        for shift in (48, 32, 16, 0):
            if low >> shift != high >> shift:
                counts = rows.groupBy(F.shiftright(key, shift).alias("digit")).count().collect()
                for digit, n in sorted((r["digit"], r["count"]) for r in counts):
                    if k <= n:
                        break
                    k -= n
                rows = rows.where(F.shiftright(key, shift) == digit)
                low, high = max(low, digit << shift), min(high, (digit + 1 << shift) - 1)
        found.append(low)
        rows = rows.where(F.col(key) == low)
    return found


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of docs; rank is 1, 2, 3... for those drawn, else null.

    Of the N rows with least_words words or more, the floor(percent * N / 100) highest scores are drawn, ties to the smaller
    doc_id. Rows that share a doc_id, or have none, have the same noise; rows without one come last among ties, then 64 bits
    of the text decide. Null and empty texts have no feature and weight 0; repeated rows are rows of their own; long texts
    are read in pieces; further columns are ignored; an empty table gives no row, an empty target gains from smoothing only."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    table = materialize(scored(docs, gains, seed), "scored").withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    fit = table.where(F.col("n_words") >= least_words)
    out, keys = ["doc_id", "n_features", "weight", "score"], ["down", "no_id", "id", "digest"]
    k = percent * fit.count() // 100
    if not k:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(fit, keys, k)
    # Rows that equal the last key in all parts are the same in all that is returned; which of them are drawn makes no difference.
    within = F.struct(*keys) <= F.struct(*(F.lit(v).cast("long") for v in last))
    drawn = numbered(fit.where(within), *keys, position="rank", first=1)
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    return drawn.select(*out, rank.alias("rank")).unionByName(table.where(~(within & (F.col("n_words") >= least_words))).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
known AS (SELECT DISTINCT f, hex(f) AS h FROM features),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM known, crc),
own AS (SELECT side, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
counts AS (SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM own GROUP BY bucket),
totals AS (SELECT sum(s) AS s, coalesce(sum(t), 0) AS t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(c.t, 0) + 1)::DOUBLE * (x.s + 10000)::DOUBLE) / ((coalesce(c.s, 0) + 1)::DOUBLE * (x.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts c, totals x),
sums AS (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM own JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
weighed AS (SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight, len(w) AS n_words FROM words LEFT JOIN sums USING (id) WHERE side = 's'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""

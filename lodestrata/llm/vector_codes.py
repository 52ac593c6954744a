"""Product codes of vectors: integer k-means over each part of the vectors, by a reduction tree.

Vectors become blocks: one binary matrix of integers, dimension by dimension, for some thousand rows. Each round folds the
blocks of a partition into sums and counts for every entry (int64), and treeAggregate adds these up in a tree, so the
driver gets a few of them whatever the number of partitions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROWS = 2048  # of a block at most
_BLOCK = "n int, wide boolean, data binary, vec_id array<long>, label binary"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows whose vector isn't null or empty and has only finite components."""
    return rows.where("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), as int64 where that is exact and sums are safe, else as Python integers."""
    values = values.astype(np.float64)
    if np.abs(values).max(initial=0) < 2**16 - 1:
        return np.floor(1024 * values).astype(np.int64)
    return np.array([math.floor(1024 * Fraction(v)) for v in values.ravel().tolist()], object).reshape(values.shape)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry for each column of part (dimension x row), the lowest index on ties.

    Distances accumulate dimension by dimension, in the narrowest type that holds them exactly."""
    reach = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    most = len(part) * (2 * reach) ** 2
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    part, book = part.astype(kind), book.astype(kind)
    total = np.zeros((part.shape[1], len(book)), kind)
    for d in range(len(part)):
        apart = part[d][:, None] - book[:, d][None, :]
        apart *= apart
        total += apart
    at = total.argmin(axis=1)
    return at, total[np.arange(len(at)), at]


def _cuts(width: int, parts: int) -> list[slice]:
    """Consecutive slices of equal size; where it doesn't divide, the first ones are longer by one."""
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(width), parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _matrix(wide: bool, data: bytes, n: int) -> np.ndarray:
    """A block's integers, dimension x row."""
    flat = np.array([int(x) for x in data.split(b",")], object) if wide else np.frombuffer(data, np.int32)
    return flat.reshape(-1, n)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Vectors of the given width as columnar blocks with their ids and labels."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = b.slice(at, ROWS)
                ints = integers(own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).T
                wide = ints.dtype == object
                data = ",".join(map(str, ints.ravel().tolist())).encode() if wide else np.ascontiguousarray(ints, np.int32).tobytes()
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, pa.schema([pa.field("label", own.column(2).type)])) as writer:
                        writer.write_batch(pa.RecordBatch.from_arrays([own.column(2)], names=["label"]))
                    label = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_pylist([{"n": own.num_rows, "wide": wide, "data": data, "vec_id": own.column(0).to_pylist(), "label": label}], pa.schema([("n", pa.int32()), ("wide", pa.bool_()), ("data", pa.binary()), ("vec_id", pa.list_(pa.int64())), ("label", pa.binary())]))

    return rows.where(F.size("embedding") == width).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").mapInArrow(pack, _BLOCK)


def refined(table: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds of assignment and floored means; unused entries stay."""
    sc = table.sparkSession.sparkContext
    data = table.select("wide", "data", "n").rdd
    cuts = _cuts(sum(b.shape[1] for b in books), len(books))
    depth = 2 if data.getNumPartitions() < 1000 else 3
    for _ in range(rounds):
        sent = sc.broadcast(books)

        def fold(gathered, block):
            whole, books = _matrix(*block), sent.value
            if gathered is None:
                gathered = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
            for k, (cut, book) in enumerate(zip(cuts, books)):
                part = whole[cut]
                at, _ = nearest(part, book)
                sums, counts = gathered[k]
                if part.dtype == object and sums.dtype != object:
                    sums = sums.astype(object)
                np.add.at(sums, at, part.T.astype(sums.dtype))
                np.add.at(counts, at, 1)
                gathered[k] = (sums, counts)
            return gathered

        def merge(a, b):
            return b if a is None else a if b is None else [(s + t, m + n) for (s, m), (t, n) in zip(a, b)]

        total = data.treeAggregate(None, fold, merge, depth)
        sent.unpersist()
        books = [np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book) for (sums, counts), book in zip(total, books)]
    return books


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row whose vector is whole.

    Rows with a null or empty vector, or one with null or non-finite components, are left out, and so are those whose vector
    isn't as long as that of the least vec_id. Codebooks begin with the vectors of the least vec_ids (`entries` at most, nulls
    never unless no row has an id; equal ids in the order of their vectors). Repeated rows count each. Lengths that don't
    divide have longer first parts; further columns are ignored; an empty table gives no row. Blocks with components beyond 65,534
    are computed with Python's integers; an error beyond 64 bits is given as the greatest long."""
    rows = whole_vectors(rows.select("vec_id", "embedding", "label"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    head = rows.orderBy(*order).limit(1).select("embedding").collect()
    width = len(head[0][0]) if head else 0
    first = rows.where(F.size("embedding") == width).orderBy(*order).limit(entries).select("embedding").collect()
    out = "vec_id long, label string, code string, error long"
    label = dict(rows.dtypes)["label"]
    if not first:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    start = integers(np.array([r[0] for r in first], np.float64))
    cuts = _cuts(width, parts)
    table = materialize(blocks(rows, width), "blocks")
    books = refined(table, [start[:, c] for c in cuts], rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(books)
    most = 2**63 - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                whole = _matrix(r["wide"], r["data"], r["n"])
                found = [nearest(whole[c], book) for c, book in zip(cuts, sent.value)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                error = sum(far.astype(object) if far.dtype == object else far.astype(np.int64) for _, far in found)
                labels = pa.ipc.open_stream(r["label"]).read_all().column("label").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(r["vec_id"], pa.int64()), labels, pa.array([bytes(x).hex() for x in codes]), pa.array([min(e, most) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = materialize(table.mapInArrow(encode, out.replace("label string", f"label {label}")), "coded")
    total = F.coalesce(F.try_sum("error"), F.lit(most))
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _statement(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """compress() in SQL, a few tables for each round."""
    far = "list_sum(list_transform(range(1, len(v) + 1), lambda d: (v[d] - e[d]) * (v[d] - e[d])))"
    tables = [
        """whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM whole, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS e FROM parts QUALIFY k < {entries})",
    ]
    for r in range(rounds + 1):
        tables.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min({{'far': {far}, 'k': k}}) AS best FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            tables.append(f"m{r} AS (SELECT p, best.k AS k, d, sum(v[d]) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS d) GROUP BY ALL)")
            means = f"SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS mean FROM m{r} GROUP BY p, k"
            tables.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(mean, e) AS e FROM b{r} LEFT JOIN ({means}) USING (p, k))")
    tables.append(f"book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS digest FROM b{rounds})")
    tables.append(f"coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.k)), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(tables) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded JOIN whole USING (vec_id), book"


OP12_SQL = _statement()

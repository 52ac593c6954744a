"""Substring dedup: removes passages that repeat an earlier document's words.

A window is `window` consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller doc_id.

1. Every window is represented by the least hash among its half-length word runs (equal windows have equal
   representatives). Each partition counts its documents' representatives in a count-min sketch; the merged sketch
   overestimates in how many documents a window occurs. A sketch of 128 MB at most is given to every task. A larger one is
   dealt over the tasks by blocks of counters, and representatives meet their block there, so that the texts are passed over
   twice at any size.
2. Only windows estimated in two documents or more are grouped exactly. Neighbouring windows with one representative form a
   run. Equal runs are grouped first, then single windows among the different runs of one representative, by 128 bits of
   hash. Either grouping is a partial aggregate to the least doc_id, so a passage in a third of all documents is one row
   from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_SHORT, _LONG, _RUN = c.Rolling(0xD6E8FEB86659FD93), c.Rolling(0xA0761D6478BD642F), c.Rolling(0xE7037ED1A0B428DB)
LOAD = 0.5  # representatives for each counter of a sketch, at most
SLICE = int(LOAD * (1 << c.WIDEST))  # representatives that a sketch for every task counts
BLOCK_PARTS = 8  # parts of a block of a larger sketch
MAX_RUN = 32  # windows in a run; longer runs are cut at multiples of it, counted from their start


def representatives(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its representative and its own hash."""
    h = c.hash_words(words)
    short = max(1, window // 2)
    return c.sliding_min(_SHORT.windows(h, short), window - short + 1), _LONG.windows(h, window)


def runs(rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of windows with one representative."""
    cuts = np.flatnonzero(np.diff(rep) != 0) + 1
    start = np.concatenate([[0], cuts])
    end = np.concatenate([cuts, [len(rep)]])
    if (end - start).max() > MAX_RUN:
        start = np.concatenate([np.arange(a, b, MAX_RUN) for a, b in zip(start, end)])
        end = np.concatenate([start[1:], [len(rep)]])
    return start, end


def _reps_of(text: pa.Scalar, window: int) -> np.ndarray:
    words = c.split_words(text.as_py())
    return np.unique(representatives(words, window)[0]) if len(words) >= window else np.empty(0, np.uint64)


def _counted(docs: DataFrame, window: int, bits: int, depth: int) -> DataFrame:
    """Partial sketches of the representatives of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = c.PartialSketch(bits, depth)
        for b in batches:
            for text in b.column(0):
                if len(reps := _reps_of(text, window)) and sketch.add(reps):
                    yield from sketch.flush()
        yield from sketch.flush()

    return docs.select("text").mapInArrow(count, c.SKETCH_SCHEMA)


_RUNS = "doc_id long, key long, rep long, run long, start int, n int"


def _runs_of(doc_id, key, words: list[bytes], window: int, wanted) -> tuple | None:
    """The runs of a document whose representatives are wanted: their columns, and the hashes of their windows."""
    if len(words) < window:
        return None
    rep, own = representatives(words, window)
    start, end = runs(rep)
    keep = wanted(rep[start])
    if not keep.any():
        return None
    prefix = _RUN.prefix(own)
    start, end = start[keep], end[keep]
    n = end - start
    columns = (np.full(len(start), doc_id), np.full(len(start), key), rep[start].view(np.int64), (_RUN.between(prefix, start, end) + n.astype(np.uint64)).view(np.int64), start.astype(np.int32), n.astype(np.int32))
    return columns, [own[s:e].view(np.int64) for s, e in zip(start, end)]


def _run_batches(batches: Iterator[pa.RecordBatch], window: int, wanted, with_wins: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [x for doc_id, text, key in zip(*(b.column(k) for k in ("doc_id", "text", "key"))) if (x := _runs_of(doc_id.as_py(), key.as_py(), c.split_words(text.as_py()), window, wanted))]
        if found:
            columns = [pa.array(np.concatenate(x)) for x in zip(*(f[0] for f in found))]
            wins = [c.lists([w for f in found for w in f[1]], pa.int64())] if with_wins else []
            yield pa.RecordBatch.from_arrays([*columns, *wins], names=[*(x.split()[0] for x in _RUNS.split(", ")), *(["wins"] if with_wins else [])])


def _repeated_runs(docs: DataFrame, window: int, n_reps: int) -> DataFrame:
    """The runs of windows whose representatives are estimated in two documents or more, by one sketch that every task gets."""
    levels = c.merged_levels(_counted(docs, window, c.sketch_bits(n_reps, 0.25), 2), c.sketch_bits(n_reps, 0.25), 2, (2,))
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    wanted = lambda rep: c.level_of(rep, shared.value) > 0
    return c.materialize(docs.mapInArrow(lambda batches: _run_batches(batches, window, wanted, True), f"{_RUNS}, wins array<long>"), "windows")


def _repeated_runs_by_blocks(docs: DataFrame, window: int, n_reps: int) -> DataFrame:
    """The same, without the windows' hashes, by a sketch whose blocks meet the runs in a shuffle."""
    bits = int(min(50, max(c.BLOCK_BITS + 1, np.ceil(np.log2(n_reps / LOAD)))))
    flags = c.level_blocks(_counted(docs, window, bits, 1), 2)
    all_runs = docs.mapInArrow(lambda batches: _run_batches(batches, window, lambda rep: np.ones(len(rep), bool), False), _RUNS)
    names = [x.split()[0] for x in _RUNS.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = c.slots(b.column(2).to_numpy().view(np.uint64), 0, bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> c.BLOCK_BITS).astype(np.int32)), pa.array((at & ((1 << c.BLOCK_BITS) - 1)).astype(np.int32)), *b.columns], names=["block", "at", *names])

    # a representative of very many documents is one block's; blocks are dealt in parts, each with a copy of the flags
    placed = all_runs.mapInArrow(place, f"block int, at int, {_RUNS}").withColumn("part", F.pmod(F.hash("doc_id"), F.lit(BLOCK_PARTS)))
    flags = flags.select("block", F.lit(-1).alias("at"), *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _RUNS.split(", ")), F.explode(F.sequence(F.lit(0), F.lit(BLOCK_PARTS - 1))).alias("part"), "flags")
    both = placed.withColumn("flags", F.lit(None).cast("binary")).unionByName(flags)

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bits_of = None, None
        for b in batches:
            at, blocks, parts = (b.column(k).to_numpy() for k in ("at", "block", "part"))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if at[s] < 0:  # the flags come first in their block
                    current, bits_of = (blocks[s], parts[s]), np.frombuffer(b.column("flags")[s].as_py(), np.uint8)
                    s += 1
                if s < e and current == (blocks[s], parts[s]):
                    own = at[s:e]
                    hit = (bits_of[own >> 3] >> (own & 7).astype(np.uint8)) & 1
                    yield b.slice(s, e - s).select(names).filter(pa.array(hit.astype(bool)))

    dealt = both.repartition("block", "part").sortWithinPartitions("block", "part", "at")
    return c.materialize(dealt.mapInArrow(estimated, _RUNS), "windows")


def _with_wins(docs: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """doc_id, key, rep, start, wins: the hashes of the windows of the given runs, from the texts that have some."""
    own = rows.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "rep")).alias("runs")).withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    joined = docs.join(own, (F.col("doc_id") == F.col("of")) & (F.col("key") == F.col("of_key"))).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, wins = [], []
            for doc_id, key, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                own = representatives(c.split_words(text.as_py()), window)[1].view(np.int64)
                rows += [(doc_id, key, r["rep"], r["start"]) for r in found]
                wins += [own[r["start"] : r["start"] + r["n"]] for r in found]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, c.lists(wins, pa.int64())], names=["doc_id", "key", "rep", "start", "wins"])

    return joined.mapInArrow(cut, "doc_id long, key long, rep long, start int, wins array<long>")


def covered_ranges(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, key, ranges: the starts and numbers of the windows that also start in a document with a smaller doc_id.

    docs needs doc_id and text; rows without a doc_id or a text neither give nor get ranges."""
    docs = docs.select("doc_id", "text", c.text_key().alias("key")).where("doc_id is not null and text is not null")
    n_reps = c.text_bytes(docs) // 6 * 4 // max(window, 4) + 1
    anchors = _repeated_runs(docs, window, n_reps) if n_reps <= SLICE else _repeated_runs_by_blocks(docs, window, n_reps)
    firsts = anchors.groupBy("rep", "run").agg(F.min("doc_id").alias("first_id"))
    several = firsts.groupBy("rep").agg((F.count("*") > 1).alias("several"))
    firsts = c.materialize(firsts.join(several, "rep"), "runs")
    whole = anchors.select("doc_id", "key", "rep", "run", "start", "n").join(firsts.select("rep", "run", "first_id"), ["rep", "run"]).where("doc_id > first_id").select("doc_id", "key", "start", "n")
    mixed = anchors.join(firsts.where("several"), ["rep", "run"]).where("doc_id = first_id")
    mixed = mixed if "wins" in anchors.columns else _with_wins(docs, mixed, window)
    single = mixed.select("doc_id", "key", "rep", "start", F.posexplode("wins").alias("at", "win"))
    least = single.groupBy("rep", "win").agg(F.min("doc_id").alias("win_id"))
    part = single.join(least, ["rep", "win"]).where("doc_id > win_id").select("doc_id", "key", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(part).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_text: the words that stay, joined by one space.

    Null texts have no words; null doc_ids and further columns of docs are allowed (rows without a doc_id stay whole).
    Documents with fewer than `window` words stay whole. Rows with one doc_id are one document: none is removed for the
    other's sake. Repeated rows give repeated results; an empty table gives an empty one."""
    ranges = covered_ranges(docs, window).withColumnsRenamed({"doc_id": "r_id", "key": "r_key"})
    docs = docs.select("doc_id", "text").withColumn("key", c.text_key())
    joined = docs.join(ranges, (F.col("doc_id") == F.col("r_id")) & (F.col("key") == F.col("r_key")), "left").select("doc_id", "text", "ranges.start", "ranges.n")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, start, n in zip(b.column(1), b.column(2), b.column(3)):
                words = c.split_words(text.as_py())
                n_words.append(len(words))
                gone = 0
                if (start := start.as_py()) is not None:
                    at, n = np.array(start), np.array(n.as_py())
                    steps = np.zeros(len(words) + 1, np.int32)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + n + window - 1, -1)
                    stays = np.cumsum(steps[:-1]) == 0
                    gone = int(len(words) - stays.sum())
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM docs, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM windows JOIN firsts USING (h), range(0, 50) AS r(k) WHERE first_id < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""

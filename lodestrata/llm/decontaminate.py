"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, windows of its number of shingles slide over each document. Words are runs of letters, digits and
underscores in lower case. A window's 128-bit SimHash is a difference of two prefix sums over its shingles. A multi-index of
Hamming blocks finds all fingerprints within the radius: with a radius of 32 and 11 blocks, one block at least differs in two
bits at most, so each item is listed under all such values of each of its blocks, and a window looks at one list for each
block. Candidates are then verified by exact weighted Jaccard similarity of their shingles (weights: occurrences). Windows
that hold too few of the items' shingles to reach the similarity are not fingerprinted, which loses nothing.

The items' shingles and lists go to every task, with a bound on their number that is checked: items beyond it are taken in
further passes over the documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_WORD = re.compile(r"\w+")
_GRAM = c.Rolling(0x9FB21C651E98DF25)
_BITS = np.arange(64, dtype=np.uint64)
ITEMS_AT_ONCE, WORDS_AT_ONCE = 10_000, 1_000_000  # about 40 MB of lists and shingles in each task
BLOCKS = 11
CHUNK = 4096  # windows that are fingerprinted together
TEXTS = 64  # documents whose words are hashed together, or a long one alone


def split_words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())] if text else []


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of the whole sequence if it is shorter."""
    words = split_words(text)
    return _GRAM.windows(c.hash_words(words), min(k, len(words))) if words else np.empty(0, np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    """128 signs for each hash."""
    both = np.stack([h, c.mix(h + np.uint64(0x2545F4914F6CDD1D))], axis=1)
    return ((both[:, :, None] >> _BITS) & np.uint64(1)).astype(np.int32).reshape(len(h), 128) * 2 - 1


class Index:
    """Items by length (in shingles) and by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int):
        self.radius, self.near_bits = radius, radius // BLOCKS
        edges = np.linspace(0, 128, BLOCKS + 1).astype(int)
        self.blocks = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]
        by_length = defaultdict(list)
        for item_id, h in items:
            if len(h):
                by_length[len(h)].append((item_id, h))
        self.known = np.unique(np.concatenate([h for _, h in items] or [np.empty(0, np.uint64)]))
        self.by_length = {n: (own, *self._lists(own)) for n, own in sorted(by_length.items())}

    def _lists(self, own: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list]:
        bits = np.array([signs(h).sum(axis=0) > 0 for _, h in own])
        tables = []
        for a, b in self.blocks:
            value = bits[:, a:b] @ (1 << np.arange(b - a))
            flips = np.array([sum(1 << x for x in some) for k in range(self.near_bits + 1) for some in combinations(range(b - a), k)])
            listed = (value[:, None] ^ flips).reshape(-1)
            order = np.argsort(listed, kind="stable")
            tables.append((np.searchsorted(listed[order], np.arange((1 << (b - a)) + 1)), (order // len(flips)).astype(np.int32)))
        return np.packbits(bits, axis=1), tables

    def near(self, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of n shingles whose fingerprints are within the radius."""
        _, prints, tables = self.by_length[n]
        pairs = []
        for (a, b), (begin, listed) in zip(self.blocks, tables):
            value = bits[:, a:b] @ (1 << np.arange(b - a))
            size = begin[value + 1] - begin[value]
            ends = np.cumsum(size)
            at = np.repeat(begin[value] - (ends - size), size) + np.arange(ends[-1])
            pairs.append(np.repeat(np.arange(len(bits)), size) * len(prints) + listed[at])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(prints))
        far = np.bitwise_count(np.packbits(bits, axis=1)[window] ^ prints[item]).sum(axis=1)
        return window[far <= self.radius], item[far <= self.radius]

    def search(self, h: np.ndarray, percent: int) -> dict[int, tuple[int, float]]:
        """For each item that a window of the document matches: the best window's start and similarity."""
        best: dict[int, tuple[int, float]] = {}
        if not len(h) or not len(self.known):
            return best
        known = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        if not known.any():
            return best
        counts = np.concatenate([[0], np.cumsum(known)])
        for n, (items, *_) in self.by_length.items():
            size = min(n, len(h))
            # as many shingles as a similar window shares with its item at least
            starts = np.flatnonzero((counts[size:] - counts[:-size]) * (100 + percent) >= percent * (n + size))
            for part in np.split(starts, np.flatnonzero((np.diff(starts) > size)) + 1) if len(starts) else ():
                for k in range(0, len(part), CHUNK):
                    self._compare(h, part[k : k + CHUNK], size, n, items, percent, best)
        return best

    def _compare(self, h, starts, size, n, items, percent, best) -> None:
        first = starts[0]
        sums = np.zeros((int(starts[-1] - first) + size + 1, 128), np.int32)
        np.cumsum(signs(h[first : starts[-1] + size]), axis=0, out=sums[1:])
        at = starts - first
        for w, k in zip(*(x.tolist() for x in self.near(n, sums[at + size] - sums[at] > 0))):
            s = int(starts[w])
            item_id, own = items[k]
            both = sum((Counter(own.tolist()) & Counter(h[s : s + size].tolist())).values())
            if 100 * both >= percent * (n + size - both):
                sim = both / (n + size - both)
                if sim > best.get(item_id, (0, -1.0))[1]:
                    best[item_id] = (s, sim)


def _passes(items: DataFrame) -> Iterator[list]:
    """Items in blocks that may go to every task."""
    block, words = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        words += len(r[1]) // 4
        if len(block) >= ITEMS_AT_ONCE or words >= WORDS_AT_ONCE:
            yield block
            block, words = [], 0
    if block:
        yield block


def _searched(index: Index, short: list[int], k: int, percent: int, ids: list, texts: list[str]) -> list[tuple]:
    """Rows of the items found. The words of all the texts are hashed at once."""
    split = [split_words(t) for t in texts]
    hashes = c.hash_words(list(chain.from_iterable(split)))
    rows, at = [], 0
    for doc_id, words in zip(ids, split):
        own = hashes[at : at + len(words)]
        at += len(words)
        if not len(own):
            continue
        found = index.search(_GRAM.windows(own, min(k, len(own))), percent)
        for n in short:  # items below the shingle's length
            for item, hit in index.search(_GRAM.windows(own, min(n, len(own))), percent).items():
                if hit[1] > found.get(item, (0, -1.0))[1]:
                    found[item] = hit
        rows += [(doc_id, item, start, sim) for item, (start, sim) in found.items()]
    return rows


def matches(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, radius: int = 32) -> DataFrame:
    """doc_id, item_id, start (in words), similarity: each item that a document holds, by the best window.

    Null texts and ids match nothing; an item of fewer words than a shingle is one shingle; rows with equal doc_id give one
    row for an item; further columns are ignored; empty tables give an empty result."""
    schema = "doc_id long, item_id long, start long, similarity double"
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = []
    for block in _passes(items):
        index = Index([(i, shingles(t, k)) for i, t in block], radius)
        short = sorted({len(_WORD.findall(t)) for _, t in block if 0 < len(_WORD.findall(t)) < k})
        shared = docs.sparkSession.sparkContext.broadcast((index, short))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, short = shared.value
            for b in batches:
                rows, held, size = [], [], 0
                for k_text, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
                    held.append(k_text)
                    size += n
                    if len(held) == TEXTS or size > 1 << 20 or k_text + 1 == len(b):
                        part = b.slice(held[0], len(held))
                        rows += _searched(index, short, k, percent, part.column(0).to_pylist(), part.column(1).to_pylist())
                        held, size = [], 0
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "start", "similarity"])

        out.append(texts.mapInArrow(search, schema))
    found = reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m")).select("doc_id", "item_id", (-F.col("m.s")).alias("start"), F.col("m.similarity").alias("similarity"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

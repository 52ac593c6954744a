"""N-gram Jaccard join: connected groups of documents whose sets of word n-grams are similar.

Exact size-aware heavy-light join. Documents with equal sets are one class, of which only the least document goes on.

Light sets, those up to a boundary size, enumerate their subsets of the sizes that a link needs: two light sets link exactly
when they have such a subset in common, so each group of equal subsets is linked by a star, without any comparison. Heavy
sets go into inverted lists of their prefixes: in one global order of n-grams, rare ones first, linked sets share one of
their first n - ceil(t * n) + 1. A counting sketch over the corpus gives that order; n-grams that it has seen once only are
in no list, and those that very many documents have (a notice, a license) come last, at any size of the corpus. The boundary is the size at which the sum of both costs is least, from the measured number of sets and the
measured lengths of the lists that sets of each size are in.

Lists are scanned in three passes, none of which makes all pairs of a group of copies. First every document is compared
with the best of the leaders of its rarest lists, and linked ones are joined into components. Then pairs from different
components that meet in a list are compared, first with some members of each list, and after joining components again
with all. Parities of each set's bits bound every overlap before any text is read. No list is cut, and every candidate is
verified on the whole sets. Leaders, subsets and verified pairs are dealt by their key and a part of it, so that one key of a
third of all rows is spread over many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected

_GRAM = {n: c.Rolling(0x8CB92BA72F3D8DD7 + 2 * n) for n in range(1, 9)}
LIGHT_SIZES = 64  # sizes that the boundary is sought among; subsets of larger sets always cost more
COUNTED = 0.3125  # share of the n-grams' hash space that the sketch counts
SKETCH_LOAD = 0.6  # n-grams for each counter of the sketch
HEAVY = 255  # documents' n-grams that may fall on a counter before its n-grams are heavy, whatever the mean
PAIR = 0.25  # cost of an entry of a list that is scanned, in rows that are shuffled
LEADERS = 4
SOME = 32  # members of each list in the round before the last
PARTS = 32  # parts of a key that may have very many rows
BITS = [f"b{i}" for i in range(16)]


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text (A-Z in lower case); with fewer words, of the whole sequence."""
    words = c.split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = c.hash_words([w.lower() for w in words])
    return np.unique(_GRAM[n].windows(h, min(n, len(h))))


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a set that subsets can be derived from by subtraction."""
    return x, c.mix(x + np.uint64(0x632BE59BD9B4E019))


def _fp(x: np.ndarray) -> tuple[int, int]:
    a, b = fingerprint(x)
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def parities(x: np.ndarray) -> np.ndarray:
    """1024 bits of a set: how many elements fall on each, modulo 2. Two sets differ by at least the bits that differ."""
    odd = np.bincount((c.mix(x) >> np.uint64(54)).astype(np.int64), minlength=1024).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def least_overlap(size: int, percent: int) -> int:
    """What a set of this size has in common with any set that it links with."""
    return -(-percent * size // 100)


def _equal_links(sets: DataFrame) -> DataFrame:
    """a, b, fp1: documents b whose set is that of a smaller document, by way of the least one of their part of the class."""
    key = ["fp1", "fp2", "n_shingles"]
    own = sets.select("doc_id", *key, F.pmod(F.hash("doc_id"), F.lit(PARTS)).alias("part"))
    lead = own.groupBy(*key, "part").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"))
    top = lead.groupBy(*key).agg(F.min("lead").alias("a"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    within = own.join(lead.where("n > 1").drop("n"), [*key, "part"]).select(F.col("lead").alias("a"), F.col("doc_id").alias("b"), "fp1")
    across = lead.join(top, key).select("a", F.col("lead").alias("b"), "fp1")
    return within.unionByName(across).where("a <> b").distinct()


def _profile(docs: DataFrame, n: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, fps, bits = [], [], []
            for t in b.column(1):
                x = gram_set(t.as_py(), n)
                size.append(len(x))
                fps.append(_fp(x))
                bits.append(parities(x))
            bits = np.array(bits).reshape(-1, len(BITS)).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array([x[0] for x in fps], pa.int64()), pa.array([x[1] for x in fps], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in bits)], names=["doc_id", "n_shingles", "fp1", "fp2", *BITS])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n_shingles long, fp1 long, fp2 long, " + ", ".join(f"{x} long" for x in BITS))


def _sketch(docs: DataFrame, n: int) -> tuple[list[np.ndarray], np.uint64, np.ndarray]:
    """Levels of the counted n-grams, the hash below which n-grams are counted, and flags of the heavy ones among all.

    Beyond what a sketch of the largest width holds, a smaller share is counted, so that the counts stay right at any size. The
    frequency of the others is unknown but for those that very many documents have: all are counted in wide counters too."""
    n_grams = c.text_bytes(docs) // 18 * (16 / 5)
    share = min(COUNTED, (1 << c.WIDEST) * SKETCH_LOAD / max(n_grams, 1))
    bits, counted = c.sketch_bits(int(n_grams * share), SKETCH_LOAD), np.uint64(int(share * 2**64))
    wide = c.heavy_bits(int(n_grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, counts = c.PartialSketch(bits, 1, limit=1_000_000), c.WideCounts(wide)
        for b in batches:
            for t in b.column(0):
                x = gram_set(t.as_py(), n)
                counts.add(x)
                if sketch.add(x[: np.searchsorted(x, counted)]):
                    yield from sketch.flush()
        yield from sketch.flush()
        yield from counts.drain()

    levels, heavy = c.merged_with_heavy(docs.select("text").mapInArrow(count, c.SKETCH_SCHEMA), bits, (2, 17, 255), wide, HEAVY)
    return levels, counted, heavy


def _postings(docs: DataFrame, n: int, percent: int, levels, counted: np.uint64, heavy: np.ndarray) -> DataFrame:
    """token, doc_id, fp1, size, pos (in the global order), ord (among the document's listed n-grams), single (how many in a
    thousand of its n-grams occur once)."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, heavy))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = gram_set(t.as_py(), n)
                if not len(x):
                    continue
                p = len(x) - least_overlap(len(x), percent) + 1
                inside = int(np.searchsorted(x, counted))
                rank = np.full(len(x), 3, np.uint8)  # not counted: after all that are known not to be frequent
                level = c.level_of(x[:inside], shared.value[0])
                rank[:inside] = np.where(level == 3, 4, level)
                rank[c.is_heavy(x, shared.value[1])] = 4
                first = np.argsort(rank, kind="stable")[:p]
                pos = np.flatnonzero(rank[first] > 0).astype(np.int32)
                if len(pos):
                    single = int(1000 * (level == 0).mean()) if inside else 0
                    out.append((x[first[pos]].view(np.int64), np.full(len(pos), doc_id), np.full(len(pos), _fp(x)[0]), np.full(len(pos), len(x), np.int32), pos, np.arange(len(pos), dtype=np.int32), np.full(len(pos), single, np.int32)))
                    held += len(pos)
                if held > 200_000:
                    yield _listed(out)
                    out, held = [], 0
            if out:
                yield _listed(out)

    return docs.select("doc_id", "text").mapInArrow(prefixes, "token long, doc_id long, fp1 long, size int, pos int, ord int, single int")


def _listed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], names=["token", "doc_id", "fp1", "size", "pos", "ord", "single"])


def subsets(size: int, percent: int) -> int:
    """How many subsets a light set enumerates; none where only equal sets link."""
    if 100 * size < percent * (size + 1):
        return 0
    return sum(comb(size, k) for k in range(size - least_overlap(size, percent) + 1))


def light_boundary(sets: dict[int, int], rows: dict[int, int], scanned: dict[int, int], percent: int) -> int:
    """The size up to which sets enumerate subsets, so that the sum of costs is least.

    A light set costs a row for each subset. A set in the lists costs its rows there, and PAIR for each entry of the lists
    they are in. sets: number of sets by size; rows and scanned: rows in lists by size, and the lengths of their lists added
    up. Sets below the boundary stay in the lists if a set above it can link with them."""
    heavy = {n: rows.get(n, 0) + PAIR * scanned.get(n, 0) for n in range(1, LIGHT_SIZES + 1)}
    light, best = 0.0, (sum(heavy.values()), 0)
    for b in range(1, LIGHT_SIZES + 1):
        light += sets.get(b, 0) * subsets(b, percent)
        best = min(best, (light + sum(v for n, v in heavy.items() if 100 * n > percent * b), b))
    return best[1]


def _costs(posts: DataFrame) -> tuple[dict, dict]:
    """Rows in lists and lengths of these lists added up, by size of the set. Lists are counted by size first, in the tasks."""
    small = posts.groupBy("token", F.least("size", F.lit(LIGHT_SIZES + 1)).alias("size")).agg(F.count("*").alias("n"))
    lists = small.groupBy("token").agg(F.sum("n").alias("length"), F.collect_list(F.struct("size", "n")).alias("own"))
    by_size = lists.select("length", F.inline("own")).where(f"size <= {LIGHT_SIZES}").groupBy("size").agg(F.sum("n"), F.sum(F.col("n") * F.col("length"))).collect()
    return {r[0]: r[1] for r in by_size}, {r[0]: r[2] for r in by_size}


@cache
def _left_out(size: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(size), k)), np.int64).reshape(comb(size, k), k)


def _light_links(docs: DataFrame, copies: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """Links among sets of up to `most` elements, by common subsets of the size that the link needs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, found = [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                # so many different words at its beginning (the last of them perhaps cut) make more n-grams than a light set has
                if len(set(t[:4000].encode("utf-8", "surrogatepass").lower().split())) > most + n:
                    continue
                x = gram_set(t, n)
                if 0 < len(x) <= most:
                    ids.append(doc_id)
                    fps.append(_fp(x)[0])
                    found.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), c.lists(found, pa.int64())], names=["doc_id", "fp1", "x"])

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = x.values.to_numpy().view(np.uint64)
                size = len(x)
                if not subsets(size, percent):
                    continue
                a, z = fingerprint(x)
                sa, sz = a.sum(dtype=np.uint64), z.sum(dtype=np.uint64)
                for k in range(size - least_overlap(size, percent) + 1):
                    gone = _left_out(size, k)
                    many = len(gone)
                    keys = ((s - v[gone].sum(axis=1, dtype=np.uint64)).view(np.int64) for s, v in ((sa, a), (sz, z)))
                    out.append((np.full(many, doc_id), np.full(many, size, np.int32), np.full(many, size - k, np.int32), *keys))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], names=["doc_id", "size", "k", "k1", "k2"])

    light = docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, fp1 long, x array<long>").join(copies, ["doc_id", "fp1"], "left_anti")
    keys = light.select("doc_id", "x").mapInArrow(enumerate_subsets, "doc_id long, size int, k int, k1 long, k2 long")
    keys = c.materialize(keys.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS))), "subsets")
    # the smallest set of a group links with all others that any of them links with by this subset
    first = keys.groupBy("k", "k1", "k2", "part").agg(F.min(F.struct("size", "doc_id")).alias("lead"), F.count("*").alias("n"))
    first = c.materialize(first, "subset_leads")
    top = first.groupBy("k", "k1", "k2").agg(F.min("lead").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    enough = f"(100 + {percent}) * k >= {percent} * (size + other.size)"
    within = keys.join(first.where("n > 1").select("k", "k1", "k2", "part", F.col("lead").alias("other")), ["k", "k1", "k2", "part"])
    across = first.select("k", "k1", "k2", "lead.*").join(top.select("k", "k1", "k2", F.col("top").alias("other")), ["k", "k1", "k2"])
    both = within.select("doc_id", "size", "k", "other").unionByName(across.select("doc_id", "size", "k", "other"))
    return both.where(f"doc_id <> other.doc_id and {enough}").select(F.col("other.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. b's text goes once to each of its pairs, a's once to each part of
    a's pairs. Texts of documents in no pair are left out before the shuffle by a bitmap of hashed ids; what it lets through
    too much, the join drops."""
    spark = pairs.sparkSession
    pairs = pairs.select("a", "b", F.pmod(F.hash("b"), F.lit(PARTS)).alias("part"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bits = c.sketch_bits(2 * pairs.count(), 0.1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = c.PartialSketch(bits, 1)
        for b in batches:
            sketch.add(c.mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield from sketch.flush()

    shared = spark.sparkContext.broadcast(c.merged_levels(ids.mapInArrow(mark, c.SKETCH_SCHEMA), bits, 1, (1,)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = c.mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield b.filter(pa.array(c.level_of(keys, shared.value) > 0))

    texts = docs.select("doc_id", "text").mapInArrow(needed, "doc_id long, text string")
    heads = pairs.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    both = heads.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            hit: list[tuple[int, int]] = []
            for a, part, b, t in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                x = gram_set(t.as_py(), n)
                if b is None:
                    if last != (a, part):
                        last, own = (a, part), []
                    own.append(x)
                    continue
                for y in own:
                    both_have = len(np.intersect1d(x, y, assume_unique=True))
                    if both_have and 100 * both_have >= percent * (len(x) + len(y) - both_have):
                        hit.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hit], pa.int64()) for k in range(2)], names=["a", "b"])

    return both.mapInArrow(similar, "a long, b long")


def _possible(percent: int) -> str:
    """Whether two sets can be similar enough, by sizes and parities."""
    need = f"(({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent})"
    return f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) and {_differ()} <= size_a + size_b - 2 * {need}"


def _differ() -> str:
    return "(" + " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in BITS) + ")"


def _leader_pairs(posts: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """For every document at most one pair with a leader of one of its rarest lists: the one that differs least by parities.
    A list's leader has the fewest n-grams of its own; parts of a list have leaders too, which meet the list's."""
    own = posts.where(f"ord < {LEADERS}").select("token", "doc_id", "size", "single", F.pmod(F.hash("doc_id"), F.lit(PARTS)).alias("part"))
    lead = c.materialize(own.groupBy("token", "part").agg(F.min(F.struct("single", "size", "doc_id")).alias("lead"), F.count("*").alias("n")), "leads")
    top = lead.groupBy("token").agg(F.min("lead").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    within = own.join(lead.where("n > 1").select("token", "part", "lead"), ["token", "part"]).select("doc_id", F.col("lead.doc_id").alias("other"))
    across = lead.join(top, "token").select("lead.doc_id", F.col("top.doc_id").alias("other"))
    pairs = within.unionByName(across).where("doc_id <> other").distinct()
    a, b = (bits.select(*(F.col(x).alias(f"{x}_{s}") for x in bits.columns)) for s in "ab")
    # hot leaders are met once for each part: the part's documents carry no more than their parities
    parts = pairs.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
    heads = parts.select("other", "part").distinct().join(a, F.col("other") == F.col("doc_id_a")).drop("other").withColumnRenamed("part", "part_a")
    rated = parts.join(b, F.col("doc_id") == F.col("doc_id_b")).join(heads, (F.col("other") == F.col("doc_id_a")) & (F.col("part") == F.col("part_a")))
    rated = rated.where(_possible(percent)).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), (F.expr(_differ()) / (F.col("size_a") + F.col("size_b"))).alias("far"))
    return rated.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("best.a", "b")


def _labelled(posts: DataFrame, label: DataFrame) -> DataFrame:
    own = posts.select("token", "doc_id", "size", "pos").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    return c.materialize(own, "labelled")


def _mixed_pairs(own: DataFrame, bits: DataFrame, percent: int, some: int | None) -> DataFrame:
    """Pairs from different components that meet in a list and may be similar; with `some`, only those of longer lists in which
    one is among so many members. Of each list, those outside its largest component are compared with all of it, so that the
    members of one component, however many, are not compared among themselves."""
    lists = own.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", "n").alias("largest"), F.sum("n").alias("length"), F.count("*").alias("labels"))
    lists = lists.where(f"labels > 1 and length > {some or 0}").select("token", "largest")
    own = own.join(lists, "token")
    own = c.materialize(own.join(bits.drop("size"), "doc_id"), "mixed")
    if some:
        first = own.groupBy("token", F.pmod(F.xxhash64("doc_id"), F.lit(some)).alias("at")).agg(F.min("doc_id").alias("doc_id")).drop("at")
        a = own.join(first, ["token", "doc_id"], "left_semi")
    else:
        a = own.where("label <> largest")
    a, b = (x.drop("largest").select(*(F.col(k).alias(k if k == "token" else f"{k}_{s}") for k in x.columns if k != "largest")) for x, s in ((a, "a"), (own, "b")))
    need = f"(({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent})"
    found = a.join(b, "token").where(f"label_a <> label_b and least(size_a - pos_a, size_b - pos_b) >= {need} and {_possible(percent)}")
    return found.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Returns doc_id, n_shingles, component_id (the least doc_id reachable by links) for every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union|. Documents without words have an empty set and link
    with nothing. Rows with one doc_id are one document. Rows without a doc_id keep a null component_id and link with
    nothing. Further columns are ignored; an empty table gives an empty result. percent must be 50 at least."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    profile = c.materialize(_profile(docs, n), "sets")
    sets = profile.where("doc_id is not null and n_shingles > 0")
    equal = c.materialize(_equal_links(sets), "equal")
    copies = equal.select(F.col("b").alias("doc_id"), "fp1")  # they are linked to their class's document already
    bits = sets.join(copies, ["doc_id", "fp1"], "left_anti").select("doc_id", F.col("n_shingles").alias("size"), *BITS).distinct()
    posts = c.materialize(_postings(known, n, percent, *_sketch(known, n)).join(copies, ["doc_id", "fp1"], "left_anti").drop("fp1"), "lists")

    number = {r[0]: r[1] for r in bits.where(f"size <= {LIGHT_SIZES}").groupBy("size").count().collect()}
    light = light_boundary(number, *_costs(posts), percent)
    links = equal.select("a", "b")
    if light:
        links = c.materialize(links.unionByName(_light_links(known, copies, n, percent, light)), "links")
        posts = posts.where(f"100 * size > {percent * light}")

    pairs = c.materialize(_leader_pairs(posts, bits, percent), "pairs")
    links = c.materialize(links.unionByName(_verified(pairs, known, n, percent)), "links")
    label = _labels(links)
    own = _labelled(posts, label)
    for some in (SOME, None):
        rest = c.materialize(_mixed_pairs(own, bits, percent, some), "rest")
        if rest.isEmpty():
            continue
        more = c.materialize(_verified(rest, known, n, percent), "more")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        label = _labels(links)
        if some:
            own = _labelled(posts, label)
    return profile.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _labels(links: DataFrame) -> DataFrame:
    return c.materialize(connected(links, "a", "b").withColumnRenamed("node", "doc_id"), "labels")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(words, i, i + 3), ' ')) AS g FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * n_both >= 85 * (s.n + t.n - n_both)),
ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

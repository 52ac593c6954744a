"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one, where cosine >= c means a distance of at most r = sqrt(2 - 2c). Pivots, taken from a bounded
sample and at least r apart, partition the vectors: each belongs to its nearest pivot, in one of two cells, the core (within
r / 2 of the pivot) or the shell. By the triangle inequality a vector v can only be near one of a cell whose distances to its
pivot q lie in [low, high] if d(v, q) lies in [low - r, high + r]; and since that one is nearer to q than to v's pivot p,
also d(v, q)^2 - d(v, p)^2 <= 2 r d(p, q). Only then v is replicated into the cell. All vectors of a core are near each
other by the same inequality, so they are counted without being compared, however many they are.

Equal vectors are one class that carries its number of rows; they are told apart by 128 bits, and vectors that share these are
compared. Classes are written once, in blocks of one cell. Cells join independently, in units of one block of a cell's own
vectors and one block of others, in one of two ways with the same results. Where few vectors have to go to other cells, copies
of them do, and units of like size share tasks. Where most vectors have to go to most cells, these copies would fill any disk;
then tasks read the stored blocks, each two parts of the table that hold blocks of cells that may be near, and nothing is
copied or shuffled. A unit hands out numbers of links by vector and the edges of a spanning forest, never all pairs.

Where vectors fill many dimensions evenly (random ones, of 64), all distances are alike, no bound excludes anything, and the
join compares all blocks with each other; no exact metric method does better there."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import connected
from .vector_codes import whole_vectors

SLACK = 1e-6  # by which bounds on distances are widened, far more than rounding makes them wrong
UNSURE = 1e-4  # products in single precision this near the threshold or above it are taken again in double precision
SAMPLE = 4096  # vectors from which pivots are taken
_DEALT = "part int, slot int, k1 long, k2 long, size long, vec_id long, x binary"
_BLOCK = "first long, cell int, core boolean, k1 array<long>, k2 array<long>, size array<long>, vec_id array<long>, x binary, goes array<int>, going array<int>"
_LAST = np.iinfo(np.int64).max
MOST_BYTES = 4 << 20


def units_of_length(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(sample: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Vectors of the sample that are at least so far apart, those in the densest places first."""
    crowd = np.concatenate([(_far(sample[k : k + 512], sample) <= apart / 2).sum(axis=1) for k in range(0, len(sample), 512)])
    taken: list[np.ndarray] = []
    for v in sample[np.argsort(-crowd, kind="stable")]:
        if not taken or (np.sum((np.stack(taken) - v) ** 2, axis=1) >= apart * apart).all():
            taken.append(v)
            if len(taken) == most:
                break
    return np.stack(taken)


def _far(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))


def _batches(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix) for each length of vector in the batch's last column."""
    column = b.column(b.num_columns - 1)
    ends = np.asarray(column.offsets)
    values, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        yield width, rows, values[ends[rows][:, None] + np.arange(width)[None, :]]


class Forest:
    """Components of what one unit has seen; union() says whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


class Cells:
    """What the driver knows of the partition: pivots by width, and each cell's classes (about) and range of distances. Cells are (width, pivot, core),
    and where two meet, the lesser one's vectors are its own and those of the other are replicated."""

    def __init__(self, pivots: dict[int, np.ndarray], r: float):
        self.pivots, self.r, self.own, self.keys, self.number = pivots, r, {}, [], {}
        self.between = {w: _far(p, p) for w, p in pivots.items()}

    def of_width(self, width: int) -> np.ndarray:
        """The pivots of a width; the first axis is the only one where the sample has none of it."""
        return self.pivots[width] if width in self.pivots else np.eye(1, width)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors' pivots, whether they are in the core, and their distances."""
        far = _far(x, self.of_width(x.shape[1]))
        pivot = far.argmin(axis=1)
        own = far[np.arange(len(x)), pivot]
        return pivot, own <= self.r / 2 - SLACK, own

    def reach(self, cell: tuple, far: np.ndarray, pivot: int, nearest: np.ndarray) -> np.ndarray:
        """The vectors that may be near some of a cell, by their distances to its pivot and to their own."""
        (width, q, _), r = cell, self.r + SLACK
        _, low, high = self.own[cell]
        between = self.between[width][pivot, q] if width in self.between else 0.0
        return np.flatnonzero((far >= low - r) & (far <= high + r) & (far**2 - nearest**2 <= 2 * r * between + SLACK))

    def others(self, home: tuple, x: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        """(cell, rows): the vectors of one cell that may be near some of a lesser one."""
        far = _far(x, self.of_width(home[0]))
        for cell in self.own:
            if cell[0] == home[0] and cell < home:
                rows = self.reach(cell, far[:, cell[1]], home[1], far[:, home[1]])
                if len(rows):
                    yield cell, rows


class Slots:
    """Where classes are written: a slot is a cell's share of about a block, of some MOST_BYTES of numbers in single precision at
    most, and parts of the table hold a few slots in the order of cells."""

    def __init__(self, own: dict[tuple, int], block: int, blocks_of_part: int = 4):
        self.first, self.shares, self.cells, parts, before = {}, {}, [], [], 0.0
        for k, cell in enumerate(sorted(own)):
            blocks = max(own[cell], 1) / min(block, max(MOST_BYTES // (4 * cell[0]), 1))
            n = math.ceil(blocks)
            self.first[cell], self.shares[cell] = len(parts), n
            parts += [int((before + blocks * t / n) // blocks_of_part) for t in range(n)]
            self.cells += [k] * n
            before += blocks
        self.part = np.array(parts or [0], np.int32)
        self.parts = int(self.part[-1]) + 1


def one_for_each(k1: np.ndarray, k2: np.ndarray, size: np.ndarray, vec_id: pa.Array, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of rows in the order of their keys: the first row of each key, the key's number of rows and its least vec_id."""
    same = np.zeros(len(k1), bool)
    same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    at = np.flatnonzero(same)
    if not (raw[at] == raw[at - 1]).all():
        raise RuntimeError("different vectors have equal keys of 128 bits")
    starts = np.flatnonzero(~same)
    known = np.logical_or.reduceat(np.asarray(vec_id.is_valid()), starts)
    return starts, np.add.reduceat(size, starts), pa.array(np.minimum.reduceat(np.asarray(vec_id.fill_null(_LAST)), starts), mask=~known)


def near_rows(rows: DataFrame, least: float = 0.9, block: int = 4096, most_pivots: int = 1024, fewest_pivots: int = 16, cell: int = 8192, copies: float = 1.5) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row.

    Vectors that are null, empty or zero, or have null or non-finite components, link with nothing; neither do vectors of
    different lengths with each other. Rows with equal vectors link, also if they share a vec_id or have none; a row without
    one counts as a link, and component_id is the least vec_id that there is among those reachable (null if none has one).
    kept says that vec_id equals component_id (false for null). Further columns are ignored; an empty table gives no row.
    Units get copies of vectors if these are at most `copies` for each vector, else they read the stored blocks."""
    spark = rows.sparkSession
    r = math.sqrt(2 - 2 * least)
    kind = "float" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull) else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fit = whole_vectors(rows).where("exists(embedding, x -> x <> 0)").select("vec_id", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), "embedding")
    n, classes = fit.agg(F.count("*"), F.approx_count_distinct("k1")).first()
    sample = fit.where(F.pmod(F.xxhash64("vec_id", "k1"), F.lit(max(n, 1))) < SAMPLE).limit(SAMPLE).select("embedding").collect()
    by_width: dict[int, list] = {}
    for (v,) in sample:
        by_width.setdefault(len(v), []).append(v)
    wanted = int(min(most_pivots, max(fewest_pivots, classes // cell)))
    found = Cells({w: pick_pivots(units_of_length(np.array(v, np.float64)), r, wanted) for w, v in by_width.items()}, r)
    sent = spark.sparkContext.broadcast(found)
    table = fit.select("k1", "embedding").mapInArrow(lambda batches: measure(batches, sent.value), "k1 long, width int, pivot int, core int, far double")
    table = table.groupBy("width", "pivot", "core").agg(F.approx_count_distinct("k1").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # two rows for each pivot at most
    found.own = {(x["width"], x["pivot"], x["core"]): (x["n"], x["low"], x["high"]) for x in sorted(table)}
    found.keys = list(found.own)
    found.number = {k: at for at, k in enumerate(found.keys)}
    slots = Slots({k: v[0] for k, v in found.own.items()}, block)
    sent = spark.sparkContext.broadcast((found, slots, kind))

    dealt = fit.mapInArrow(lambda batches: deal_out(batches, *sent.value), _DEALT)
    ordered = dealt.repartitionById(slots.parts, F.col("part")).sortWithinPartitions("slot", "k1", "k2")
    blocks = materialize(ordered.mapInArrow(lambda batches: pack(batches, *sent.value), _BLOCK), "blocks")
    by_cell = blocks.groupBy("cell").agg(F.sum(F.size("k1")).alias("n"), F.sum(F.expr("aggregate(size, 0L, (s, x) -> s + x)")).alias("all_rows"), F.min("first").alias("least"))
    own = {found.keys[x["cell"]]: x["n"] for x in by_cell.collect()}
    more = blocks.select(F.explode(F.arrays_zip("goes", "going")).alias("x")).groupBy("x.goes").agg(F.sum("x.going").alias("n")).collect()
    plan, tasks = deal(own, {found.keys[x["goes"]]: x["n"] for x in more}, block)
    if sum(d.sent for d in plan.values()) <= copies * sum(own.values()):
        sent_plan = spark.sparkContext.broadcast((found, plan, tasks, kind))
        links = blocks.select("first", "cell", "size", "x").mapInArrow(lambda batches: replicate(batches, *sent_plan.value), f"{_SENT}, embedding array<{kind}>")
        at = [F.col(c) for c in ("task", "unit", "side")]
        joined = links.repartition(tasks, "task").sortWithinPartitions(*at).mapInArrow(lambda batches: join_units(batches, least), _LINKS)
    else:
        joined = meeting(blocks).mapInArrow(lambda batches: join_blocks(batches, least, sent.value[0], sent.value[2]), _LINKS)
    within = blocks.where("core").join(F.broadcast(by_cell.select("cell", "all_rows", "least")), "cell").select("first", "all_rows", "least", F.posexplode("size").alias("k", "size"))
    cored = within.select((F.col("first") + F.col("k")).alias("u"), F.col("least").alias("v"), (F.col("all_rows") - F.col("size")).alias("n"))
    edges = materialize(joined.unionByName(cored), "links")
    counts = edges.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    labels = connected(edges.where("v is not null and u <> v"), "u", "v")
    classes = blocks.select("first", F.posexplode(F.arrays_zip("k1", "k2", "vec_id", "size")).alias("k", "x")).select((F.col("first") + F.col("k")).alias("node"), "x.*")
    linked = counts.join(labels, "node", "left")
    # of a class that has one row and no links, the row itself says all
    members = classes.join(linked, "node", "left").where("size > 1 or n > 0").withColumn("label", F.coalesce("label", "node"))
    members = materialize(members.select("label", "k1", "k2", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "members")
    least_id = members.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    known = materialize(members.join(least_id, "label").select("k1", "k2", "component_id", "n_links"), "known")
    linked = fit.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    unfit = rows.where("not coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)")
    alone = unfit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


_SENT = "task int, unit long, side int, node long, size long"
_LINKS = "u long, v long, n long"


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _bytes(x: np.ndarray) -> pa.Array:
    """A binary column, one value for each row."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def measure(batches: Iterator[pa.RecordBatch], found: Cells) -> Iterator[pa.RecordBatch]:
    """Each row's cell and its distance to the pivot."""
    for b in batches:
        for width, at, raw in _batches(b):
            pivot, core, own = found.place(units_of_length(raw))
            columns = [b.column(0).take(pa.array(at)), pa.array(np.full(len(at), width, np.int32)), pa.array(pivot.astype(np.int32)), pa.array(core.astype(np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "width", "pivot", "core", "far"])


def deal_out(batches: Iterator[pa.RecordBatch], found: Cells, slots: Slots, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows with their slots; of equal vectors in a batch one is left."""
    for b in batches:
        for _, at, raw in _batches(b):
            k1, k2 = (np.asarray(b.column(k))[at] for k in (1, 2))
            order = np.lexsort((k2, k1))
            at, raw, k1, k2 = at[order], raw[order], k1[order], k2[order]
            starts, size, vec_id = one_for_each(k1, k2, np.ones(len(at), np.int64), b.column(0).take(pa.array(at)), raw)
            raw, k1, k2 = raw[starts], k1[starts], k2[starts]
            pivot, core, _ = found.place(units_of_length(raw))
            home, slot = 2 * pivot + core, np.zeros(len(raw), np.int64)
            for h in np.unique(home).tolist():
                key, rows = (raw.shape[1], h // 2, h % 2), np.flatnonzero(home == h)
                slot[rows] = slots.first[key] + (k2[rows].view(np.uint64) % np.uint64(slots.shares[key])).astype(np.int64)
            columns = [pa.array(slots.part[slot]), pa.array(slot.astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(size), vec_id, _bytes(raw.astype(f"<{'f4' if kind == 'float' else 'f8'}"))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DEALT.split(", ")])


def unpack(x: list | pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x), f"<{'f4' if kind == 'float' else 'f8'}").reshape(-1, width)


def pack(batches: Iterator[pa.RecordBatch], found: Cells, slots: Slots, kind: str) -> Iterator[pa.RecordBatch]:
    """One row for each slot, whose classes are numbered from `first` on; `goes` and `going` are the lesser cells that some of them may
    be near, and how many."""
    at = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []

    def end() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        number = slots.cells[t["slot"][0].as_py()]
        home = found.keys[number]
        k1, k2, size = (t[c].to_numpy() for c in ("k1", "k2", "size"))
        raw = unpack(t["x"].to_pylist(), home[0], kind)
        starts, size, vec_id = one_for_each(k1, k2, size, t["vec_id"].combine_chunks(), raw)
        goes = [(found.number[c], len(rows)) for c, rows in found.others(home, units_of_length(raw[starts]))]
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = [pa.array([at]), pa.array([number], pa.int32()), pa.array([home[2] == 1]), *(whole(x, pa.int64()) for x in (k1[starts], k2[starts], size, vec_id))]
        columns += [pa.array([raw[starts].tobytes()]), *(whole([g[k] for g in goes], pa.int32()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

    for b in batches:
        slot = np.asarray(b.column(1))
        cuts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist() + [len(slot)]
        for s, e in zip(cuts, cuts[1:]):
            if held and held[0].column(1)[0].as_py() != slot[s]:
                done = end()
                yield done
                at, held = at + len(done.column(3).values), []
            held.append(b.slice(s, e - s))
    if held:
        yield end()


def meeting(blocks: DataFrame) -> DataFrame:
    """Each two blocks that have to be compared, a block with itself too. This is a Cartesian product of the stored table with itself, whose
    tasks read two parts of it; which of two blocks comes first is drawn, so that tasks have like shares of them."""
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("first", "cell", "core", "size", "x", "goes"))) for side in "ab")
    drawn = "(a_first = b_first or (a_first < b_first) = (xxhash64(least(a_first, b_first), greatest(a_first, b_first)) % 2 = 0))"
    near = "(a_cell = b_cell and not a_core or a_cell < b_cell and array_contains(b_goes, a_cell) or b_cell < a_cell and array_contains(a_goes, b_cell))"
    return a.join(b.hint("shuffle_replicate_nl"), F.expr(f"{drawn} and {near}")).select(*(f"{side}_{c}" for side in "ab" for c in ("first", "cell", "size", "x")))


class Deal:
    """How one cell's blocks meet: `a` blocks of its own vectors and `b` of others. Pairs of blocks are numbered, so that no task
    and no driver holds a list of them: first those of own blocks i <= j, row by row, then own block i with each other one."""

    def __init__(self, own: int, others: int, core: bool, block: int):
        self.a, self.b, self.core = -(-own // block), -(-others // block), core
        inner = 0 if core else self.a * (self.a + 1) // 2
        self.inner, self.pairs = inner, inner + self.a * self.b
        self.rows = inner * 2 * own / self.a + self.a * self.b * (own / self.a + others / max(self.b, 1))
        self.sent = self.rows - (0 if core else own)  # rows that are copied; a block with itself is one
        self.first = self.task = 0
        self.each = 1  # pairs of one task

    def number(self, i: int, j: int) -> int:
        """Of own block i and block j, which is one of the others from a on."""
        return i * self.a - i * (i - 1) // 2 + j - i if j < self.a else self.inner + i * self.b + j - self.a

    def of_own(self, i: int) -> Iterator[tuple[int, int]]:
        """(pair, side) that own block i takes part in; side -1 stands for the pair with itself."""
        if not self.core:
            yield from ((self.number(i, j), 0 if j > i else -1) for j in range(i, self.a))
            yield from ((self.number(j, i), 1) for j in range(i))
        yield from ((self.number(i, self.a + j), 0) for j in range(self.b))

    def of_other(self, j: int) -> Iterator[tuple[int, int]]:
        return ((self.number(i, self.a + j), 1) for i in range(self.a))


MOST_TASKS = 50_000


def deal(own: dict[tuple, int], others: dict[tuple, int], block: int) -> tuple[dict[tuple, Deal], int]:
    """The cells' deals and the number of tasks. A task gets pairs of about two blocks of rows: one large pair, or those of several
    small cells."""
    plan, unit, held = {}, 0, 0.0
    for key in sorted(own):
        d = plan[key] = Deal(own[key], others.get(key, 0), bool(key[2]), block)
        d.first, d.task = unit, int(held // (2 * block))
        d.each = max(1, int(2 * block * d.pairs // max(d.rows, 1))) if d.pairs else 1
        unit, held = unit + d.pairs, max(held + d.rows, (d.task + -(-d.pairs // d.each)) * 2 * block if d.pairs > d.each else 0)
    return plan, min(MOST_TASKS, int(held // (2 * block)) + 1)


def replicate(batches: Iterator[pa.RecordBatch], found: Cells, plan: dict[tuple, Deal], tasks: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector for every unit that it takes part in: side 0 is the block of own vectors (-1 where it meets itself), 1 the block beside it."""

    def sent(d: Deal, pair: int, side: int, rows: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        task = (d.task + pair // d.each) % tasks
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, d.first + pair, np.int64)), pa.array(np.full(n, side, np.int32)), pa.array(node[rows]), pa.array(size[rows]), _vectors(raw[rows])], names=[*(c.split()[0] for c in _SENT.split(", ")), "embedding"])

    for b in batches:
        for k in range(b.num_rows):
            home, size = found.keys[b.column(1)[k].as_py()], np.asarray(b.column(2)[k].values)
            raw, node = unpack([b.column(3)[k].as_py()], home[0], kind), b.column(0)[k].as_py() + np.arange(len(size))
            d = plan[home]
            part = node % d.a
            for i in np.unique(part).tolist():
                for pair, side in d.of_own(i):
                    yield sent(d, pair, side, np.flatnonzero(part == i))
            for key, rows in found.others(home, units_of_length(raw)):
                d = plan[key]
                part = node[rows] % d.b
                for j in np.unique(part).tolist():
                    for pair, side in d.of_other(j):
                        yield sent(d, pair, side, rows[part == j])


class Unit:
    """One block of own vectors; others pass by in batches."""

    def __init__(self, least: float, forest: Forest | None = None):
        self.least, self.parts, self.forest, self.edges = least, [], forest or Forest(), []

    def take(self, node: np.ndarray, size: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((node, size, x))

    def close(self) -> None:
        """The own block is whole."""
        if self.parts and not hasattr(self, "x"):
            self.node, self.size, self.x = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
            self.single, self.n = self.x.astype(np.float32), np.zeros(len(self.node), np.int64)

    def compare(self, node: np.ndarray, size: np.ndarray, x: np.ndarray, from_row: int | None = None) -> np.ndarray:
        """Links of the batch with the own block; from_row: the batch is that part of the own block, and later rows count."""
        n, beside = np.zeros(len(node), np.int64), x.astype(np.float32).T
        for start in range(0, len(self.node), 256):  # few pairs at a time, for dense blocks
            i, j = np.divmod(np.flatnonzero(self.single[start : start + 256] @ beside >= self.least - UNSURE), len(node))
            i += start
            if from_row is not None:
                i, j = i[i < j + from_row], j[i < j + from_row]
            for cut in range(0, len(i), 65536):
                a, b = i[cut : cut + 65536], j[cut : cut + 65536]
                sure = np.einsum("ij,ij->i", self.x[a], x[b]) >= self.least
                a, b = a[sure], b[sure]
                np.add.at(self.n, a, size[b])
                np.add.at(n, b, self.size[a])
                self.connect(self.node[a], node[b])
        return n

    def compare_alone(self) -> None:
        """Links within the own block."""
        for start in range(0, len(self.node), 1024):
            self.n[start : start + 1024] += self.compare(self.node[start : start + 1024], self.size[start : start + 1024], self.x[start : start + 1024], start)

    def connect(self, u: np.ndarray, v: np.ndarray) -> None:
        """Adds the edges that join components: first one for each v, then one for each u, then what is left."""
        for first in (1, 0, None):
            roots = []
            for side in (u, v):
                own, at = np.unique(side, return_inverse=True)
                roots.append(np.array([self.forest.root(x) for x in own.tolist()], np.int64)[at])
            apart = roots[0] != roots[1]
            u, v = u[apart], v[apart]
            if not len(u):
                return
            pick = slice(None) if first is None else np.unique((u, v)[first], return_index=True)[1]
            self.edges += [(x, y) for x, y in zip(u[pick].tolist(), v[pick].tolist()) if self.forest.union(x, y)]


def _found(node: np.ndarray, n: np.ndarray, edges: list) -> pa.RecordBatch:
    """(u, null, n): n links of u; (u, v, 0): edges of a spanning forest."""
    at = np.flatnonzero(n)
    u = np.concatenate([node[at], np.array([e[0] for e in edges], np.int64)])
    v = [None] * len(at) + [e[1] for e in edges]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.concatenate([n[at], np.zeros(len(edges), np.int64)]), pa.int64())], names=["u", "v", "n"])


class Block:
    """A stored block as a task reads it."""

    def __init__(self, found: Cells, first: int, number: int, size: np.ndarray, x: bytes, kind: str):
        self.key, self.size, self.node = found.keys[number], size, first + np.arange(len(size))
        self.x, self.unit = units_of_length(unpack([x], self.key[0], kind)), None

    def own(self, least: float, forest: Forest) -> Unit:
        if self.unit is None or self.unit.forest is not forest:
            self.unit = Unit(least, forest)
            self.unit.take(self.node, self.size, self.x)
            self.unit.close()
        return self.unit


def join_blocks(batches: Iterator[pa.RecordBatch], least: float, found: Cells, kind: str, most_nodes: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Links of a task's units. Numbers of links are added up over all of them, and so is the forest, unless it has very many vectors."""
    totals: dict[int, np.ndarray] = {}
    forest, left = Forest(), None
    for b in batches:
        edges = []
        for k in range(b.num_rows):
            part = lambda c: Block(found, b.column(c)[k].as_py(), b.column(c + 1)[k].as_py(), np.asarray(b.column(c + 2)[k].values), b.column(c + 3)[k].as_py(), kind)  # noqa: B023, E731
            if left is None or left.node[0] != b.column(0)[k].as_py():
                left = part(0)
            right = left if left.node[0] == b.column(4)[k].as_py() else part(4)
            own, other = (left, right) if left.key <= right.key else (right, left)
            unit = own.own(least, forest)
            if own is other:
                unit.compare_alone()
            else:
                rows = slice(None)
                if own.key != other.key:
                    far = _far(other.x, found.of_width(own.key[0])[[own.key[1], other.key[1]]])
                    rows = found.reach(own.key, far[:, 0], other.key[1], far[:, 1])
                node, size, x = other.node[rows], other.size[rows], other.x[rows]
                got = [unit.compare(node[s : s + 1024], size[s : s + 1024], x[s : s + 1024]) for s in range(0, len(node), 1024)]
                if got:
                    totals.setdefault(int(other.node[0]), np.zeros(len(other.node), np.int64))[rows] += np.concatenate(got)
            edges += unit.edges
            totals.setdefault(int(own.node[0]), np.zeros(len(own.node), np.int64))[:] += unit.n
            unit.n[:], unit.edges = 0, []
        if edges:
            yield _found(np.empty(0, np.int64), np.empty(0, np.int64), edges)
        if len(forest.up) > most_nodes:
            forest = Forest()
    for first, n in totals.items():
        if n.any():
            yield _found(first + np.arange(len(n)), n, [])


def join_units(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of units that got copies of their vectors."""

    def end(unit: Unit) -> Iterator[pa.RecordBatch]:
        unit.close()
        if not unit.parts:
            return
        if unit.alone:  # a block with itself
            unit.compare_alone()
        yield _found(unit.node, unit.n, unit.edges)

    unit, current = None, None
    for b in batches:
        ids, side, node, size = (np.asarray(b.column(k)) for k in (1, 2, 3, 4))
        cuts = np.flatnonzero(np.diff(ids * 4 + side, prepend=-9)).tolist() + [len(ids)]
        for s, e in zip(cuts, cuts[1:]):
            if ids[s] != current:
                if unit:
                    yield from end(unit)
                unit, current = Unit(least), ids[s]
                unit.alone = side[s] < 0
            x = units_of_length(next(_batches(b.slice(s, e - s)))[2])
            if side[s] <= 0:
                unit.take(node[s:e], size[s:e], x)
            elif unit.parts:
                unit.close()
                for k in range(s, e, 1024):
                    own = slice(k, min(k + 1024, e))
                    got = unit.compare(node[own], size[own], x[k - s : own.stop - s])
                    yield _found(node[own], got, [])
    if unit:
        yield from end(unit)


def op13_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH RECURSIVE fit AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(id, other) AS (SELECT vec_id, vec_id FROM fit UNION SELECT id, b FROM reach JOIN links ON other = a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

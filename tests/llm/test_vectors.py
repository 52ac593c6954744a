"""Vector codes, the metric range join and importance resampling against plain versions, with the cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm import embedding_join, importance, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, size int, node string, code string"


def vectors(n, width=8, seed=1, groups=0):
    """Random vectors; so many groups of near copies, one of a third of all."""
    chance = np.random.default_rng(seed)
    x = chance.normal(size=(n, width))
    for g in range(groups):
        first, last = (0, n // 3) if g == 0 else (n // 3 + 20 * g, n // 3 + 20 * g + 12)
        x[first:last] = x[first] + chance.normal(size=(last - first, width)) * (0.05 if g % 2 else 0.2)
    return x.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k, 1, "n", "c") for i, v, k in rows], SCHEMA).repartition(3)


def odd_rows(width):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [0.5] * (width - 1) + [nan], 1), (902, [inf] + [0.1] * (width - 1), 2), (903, [None] + [0.1] * (width - 1), 2), (904, [], 1), (905, [0.0] * width, None)]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Integer k-means by plain loops."""
    good = [(i, v, k) for i, v, k in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(c)) for c in r[1]]))
    width = len(good[0][1])
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], k) for i, v, k in good if len(v) == width]
    cuts = [c.tolist() for c in np.array_split(np.arange(width), parts)]
    cut = lambda v, p: [v[d] for d in cuts[p]]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, book: min((far(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in good:
                held.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, k, [best(cut(v, p), books[p]) for p in range(parts)]) for i, v, k in good]
    by_label = Counter()
    for _, k, f in found:
        by_label[k] += sum(e for e, _ in f)
    return sorted(((i, "".join(f"{at:02x}" for _, at in f), sum(e for e, _ in f), by_label[k], digest) for i, k, f in found), key=str)


@pytest.mark.parametrize("scale", [1, 3e4, 1e18])
def test_vector_codes(spark, scale):
    """Equal vectors and ids, null labels and ids, ties between entries; great components take Python's integers."""
    x = vectors(400, 8, 3) * np.float32(scale)
    rows = [(k, v.tolist(), [None, 1, 2, 2][k % 4]) for k, v in enumerate(x)]
    rows += [(5, x[5].tolist(), 2), (5, x[6].tolist(), 2), (None, x[7].tolist(), 1), (906, x[0].tolist()[:5], 1), *odd_rows(8)]
    got = sorted((tuple(r) for r in vector_codes.compress(frame(spark, rows)).drop("label").collect()), key=str)
    most = 2**63 - 1
    want = sorted(((i, c, min(e, most), min(b, most), d) for i, c, e, b, d in plain_codes(rows)), key=str)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert all(g[3] == w[3] for g, w in zip(got, want))


def test_vector_codes_of_few_or_no_rows(spark):
    assert vector_codes.compress(frame(spark, [])).count() == 0 and vector_codes.compress(frame(spark, odd_rows(8)[:5])).count() == 0
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], 1), (2, [0.1] * 7, None)]
    got = sorted(tuple(r) for r in vector_codes.compress(frame(spark, rows)).drop("label").collect())
    assert got == plain_codes(rows) and [g[2] for g in got] == [0, 0]


def plain_links(rows, least=0.9):
    """vec_id, n_links, component_id, kept by comparing all rows with all."""
    unit = []
    for _, v, _ in rows:
        fit = bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float32).astype(float) if fit else None
        unit.append(x / math.sqrt(sum(c * c for c in x)) if fit else None)
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    least_id = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least_id[root(k)] = min(least_id.get(root(k), i), i)
    return sorted(((i, n[k], least_id.get(root(k)), i is not None and least_id.get(root(k)) == i) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "block", "cell", "most"), [(3, 40, 30, 64), (8, 64, 8192, 4), (16, 4096, 50, 1024), (3, 25, 8192, 1)])
def test_metric_range_join(spark, width, block, cell, most):
    """Low dimensions, where cells exclude each other, and higher ones; groups of near copies, one of a third of all rows."""
    x = vectors(500, width, width, groups=6)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(600 + k, (x[2] * (1 + k % 3)).tolist(), 2) for k in range(30)] + [(3, x[3].tolist(), 0), (4, x[200].tolist(), 0), (None, x[450].tolist(), 0), (None, [-9.0] * width, 1)]
    rows += [(700, [1.0] * (width + 1), 0), (701, [2.0] * (width + 1), 0), (702, [1e-30] * width, 0), *odd_rows(width)]
    got = embedding_join.near_rows(frame(spark, rows), block=block, cell=cell, most_pivots=most, fewest_pivots=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows)


@pytest.mark.parametrize("copies", [0, 1e9])
def test_units_by_copies_or_by_stored_blocks(spark, copies):
    """Both ways have the same results, also for copies of a vector, several lengths, and vectors that the sample of pivots has not."""
    x = vectors(700, 6, 11, groups=6)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(800 + k, x[k % 5].tolist(), 2) for k in range(60)] + [(None, x[9].tolist(), 0), (None, x[650].tolist(), 0)]
    rows += [(1000 + k, v.tolist(), 0) for k, v in enumerate(vectors(90, 5, 12, groups=2))] + odd_rows(6)
    for block in (30, 4096):
        got = embedding_join.near_rows(frame(spark, rows), block=block, cell=50, fewest_pivots=2, copies=copies)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows)


def test_disk_of_vectors_that_all_cells_need(spark, tmp_path):
    """Of vectors that fill 64 dimensions no cell excludes any: files and shuffles stay below four times the table, in however many blocks."""
    x = np.random.default_rng(6).normal(size=(4000, 64)).astype(np.float32)
    frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)]).select("vec_id", "embedding").write.parquet(f"{tmp_path}/v")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:"))
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    stored = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*.parquet"))
    before = shuffled() + stored(shared)
    assert embedding_join.near_rows(spark.read.parquet(f"{tmp_path}/v"), block=100).where("kept and n_links = 0").count() == 4000
    assert 0 < shuffled() + stored(shared) - before < 4 * stored(f"{tmp_path}/v")


def test_slots_and_parts_are_small():
    """A share is about a block, less of wide vectors; a part has few of them, in the order of cells."""
    own = {(64, 0, 0): 5000, (64, 0, 1): 3, (64, 1, 0): 100_000, (8192, 0, 0): 1000}
    slots = embedding_join.Slots(own, 4096)
    assert slots.shares == {(64, 0, 0): 2, (64, 0, 1): 1, (64, 1, 0): 25, (8192, 0, 0): 8}
    assert (np.diff(slots.part) >= 0).all() and max(Counter(slots.part.tolist()).values()) <= 6 and slots.parts == 9
    assert [slots.cells[slots.first[k]] for k in sorted(own)] == [0, 1, 2, 3] and embedding_join.Slots({}, 4096).parts == 1


def test_equal_keys_of_different_vectors_are_not_passed_over():
    import pyarrow as pa

    key, size, ids = np.array([5, 5]), np.array([1, 2]), pa.array([None, 3], pa.int64())
    starts, n, least = embedding_join.one_for_each(key, key, size, ids, np.array([[0.0, 1], [-0.0, 1]]))
    assert (starts.tolist(), n.tolist(), least.to_pylist()) == ([0], [3], [3])
    with pytest.raises(RuntimeError, match="equal keys"):
        embedding_join.one_for_each(key, key, size, ids, np.array([[0.5, 1], [0.0, 1]]))


def test_deals():
    """Each two blocks of a cell meet once, and tasks get about two blocks of rows."""
    for own, others, core in ((100, 0, False), (100, 250, False), (95, 31, True), (1, 0, False), (7, 3, True), (10, 0, True)):
        d = embedding_join.Deal(own, others, core, 10)
        met = Counter((pair, side) for i in range(d.a) for pair, side in d.of_own(i))
        met += Counter((pair, side) for j in range(d.b) for pair, side in d.of_other(j))
        assert set(met.values()) <= {1} and {p for p, _ in met} == set(range(d.pairs))
        alone = d.a if not core else 0
        assert sum(side == -1 for _, side in met) == alone and sum(side == 1 for _, side in met) == d.pairs - alone
    plan, tasks = embedding_join.deal({(8, k, 0): 10 * k + 5 for k in range(30)}, {(8, 0, 0): 1000}, 20)
    rows = Counter()
    for d in plan.values():
        for pair in range(d.pairs):
            rows[d.task + pair // d.each] += d.rows / d.pairs
    assert max(rows) < tasks and max(rows.values()) <= 4 * 20


def test_metric_range_join_of_no_rows(spark):
    assert embedding_join.near_rows(frame(spark, [])).count() == 0
    got = embedding_join.near_rows(frame(spark, odd_rows(4))).collect()
    assert len(got) == 6 and all(r.n_links == 0 and r.kept for r in got)


def test_a_core_is_counted_without_being_compared(spark):
    """All of a third of the rows lie in one core: units take far fewer pairs than there are."""
    chance = np.random.default_rng(5)
    dense = chance.normal(size=16) + chance.normal(size=(3000, 16)) * 0.01
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([dense, chance.normal(size=(100, 16))]).astype(np.float32))]
    seen = []
    deal = embedding_join.deal
    embedding_join.deal = lambda own, others, block: seen.append((own, others)) or deal(own, others, block)
    try:
        got = {r.vec_id: r.n_links for r in embedding_join.near_rows(frame(spark, rows)).collect()}
    finally:
        embedding_join.deal = deal
    assert all(got[k] == 2999 for k in range(3000))
    own, _ = seen[0]
    assert max(own.values()) == 3000 and next(k for k, v in own.items() if v == 3000)[2] == 1


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_resample(rows, target, percent=25, least_words=20, buckets=10_000):
    def features(text):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(x.encode()) % buckets for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    found = [(i, *features(t), t) for i, t in rows]
    s, t = Counter(b for _, _, f, _ in found for b in f), Counter(b for x in target for b in features(x)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets))))
    out = []
    for i, n, f, text in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, fit[: percent * len(fit) // 100]


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(3)
    names = [f"{chance.choice(['Alpha', 'beta', 'Ünïcode', 'x' * 40, 'İstanbul', '7', 'don'])}{k % 60}" for k in range(500)]
    rows = [(k, chance.choice([" ", "-", "\n", "  "]).join(chance.choice(names) for _ in range(chance.randrange(60)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "..."), (403, " ".join(chance.choice(names) for _ in range(40_000))), (404, "long" * 500_000), (5, rows[5][1]), (None, rows[6][1] + " more" * 30), (None, None)]
    return rows, [" ".join(chance.choice(names[:50]) for _ in range(30)) for _ in range(8)]


def test_resampling(spark, texts, monkeypatch):
    rows, target = texts
    monkeypatch.setattr(importance, "PIECE", 1000)  # texts in many pieces
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, rank int, score double").repartition(4)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in importance.resample(docs, aims).collect()]
    out, drawn = plain_resample(rows, target)
    assert Counter(g[:4] for g in got) == Counter(x[:4] for x in out)
    ranked = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
    assert [g[4] for g in ranked] == list(range(1, len(drawn) + 1)) and [g[:4] for g in ranked] == [x[:4] for x in drawn]
    assert importance.resample(docs.where("false"), aims).count() == 0
    few = importance.resample(docs, aims.where("false"), percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in few) == list(range(1, len(rows) + 1))


def test_features_in_pieces(monkeypatch):
    """A text's features don't depend on where it is cut."""
    chance = random.Random(4)
    text = " ".join(chance.choice(["A", "bc", "é" * 20, "word" * 9, "..", "x1"]) for _ in range(3000)).encode()
    whole = np.sort(np.concatenate([f for _, f in importance.Features(977).of(text)]))
    for piece in (1, 7, 100, 4096):
        monkeypatch.setattr(importance, "PIECE", piece)
        assert np.array_equal(np.sort(np.concatenate([f for _, f in importance.Features(977).of(text)])), whole)
    assert list(importance.Features(977).of(None)) == []


@pytest.mark.parametrize("spread", [3, 100_000, 2**62])
def test_kth_key(spark, spread):
    chance = random.Random(spread)
    keys = [(chance.randrange(-spread, spread), chance.choice([-(2**63), 2**63 - 1, 0, chance.randrange(9)])) for _ in range(500)]
    df = spark.createDataFrame(keys, "a long, b long")
    for k in (1, 2, 77, 250, 499, 500):
        assert tuple(importance.kth_key(df, ["a", "b"], k)) == sorted(keys)[k - 1]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_codes", "op13_embedding_near_dedup"])
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_statements(spark, name, folder):
    """On the whole tables; and for vectors, on some that are near each other, or no vectors."""
    import duckdb

    from lodestrata.llm import queries

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '/root/testdata/{folder}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, f"/root/testdata/{folder}")
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_statements_of_near_vectors(spark, tmp_path):
    import duckdb

    from lodestrata.llm import queries

    rows = [(k, v.tolist(), k % 3 if k % 7 else None) for k, v in enumerate(vectors(300, 8, 9, groups=6))] + odd_rows(8)
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op12_vector_codes", "op13_embedding_near_dedup"):
        want = con.sql(queries.ORACLES[name])
        got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert Counter(map(tuple, got)) == Counter(want.fetchall())
    assert sum(r.n_links > 0 for r in got) > 100

"""Positions, predecessors and carried values over ranges, against plain loops; one group holds most rows."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import inventory
from lodestrata.operators.numbering import carried, numbered, previous

SCHEMA = "g string, h int, at int, id int, v string, `a.b` string, part long, row string"


def rows(n=3000, seed=1):
    chance = random.Random(seed)
    out = []
    for k in range(n):
        g = chance.choice(["hot"] * 6 + ["a", "b", None])
        out.append((g, chance.choice([1, None]) if g == "a" else 1, chance.randrange(n // 3), k, chance.choice([None, None, f"v{k}"]), "x", k, "r"))
    chance.shuffle(out)
    return out


def groups(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[2], r[3])):
        out.setdefault(r[:2], []).append(r)
    return out


def test_numbers(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = numbered(df, "g", "-at", "id", position="n", first=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or "", -r[2], r[3]))
    assert [tuple(r)[:-1] for r in got.orderBy("n").collect()] == want and [r.n for r in got.orderBy("n").collect()] == list(range(1, len(data) + 1))
    again = numbered(got, "id", position="n").orderBy("n").collect()  # a column of that name is replaced
    assert [r.n for r in again] == [r.id for r in again] and again[0].__fields__[-1] == "n"
    assert numbered(df.where("false"), "id").count() == 0


def test_predecessors_and_carried_values(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    before = {r.id: r.before for r in previous(df, ["g", "h"], ["at", "id"], "v", "before").collect()}
    last = {r.id: r.last for r in carried(df, ["g", "h"], ["at", "id"], F.col("v"), "last").collect()}
    for own in groups(data).values():
        held = None
        for k, r in enumerate(own):
            held = r[4] if r[4] is not None else held
            assert before[r[3]] == (own[k - 1][4] if k else None) and last[r[3]] == held
    assert len(before) == len(last) == len(data)
    assert previous(df.where("false"), ["g"], ["at"], "v", "b").count() == carried(df.where("false"), ["g"], ["at"], F.col("v"), "b").count() == 0
    assert previous(df, ["g"], ["at"], "v", "b").columns == [*df.columns, "b"] == carried(df, ["g"], ["at"], F.col("v"), "b").columns


def test_one_chain_over_many_tasks(spark):
    """A chain of all rows is split; a change is found beside the edges of ranges too."""
    import hashlib

    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(4000)]
    entries = [("o", k, hashes[k], hashes[k - 1] if k else None) for k in range(4000) if k != 2500]
    df = spark.createDataFrame(entries, "organization_id string, id long, entry_hash string, prev_hash string").repartition(5)
    assert [tuple(r) for r in inventory.verify_chain(df, recompute=False).collect()] == [("o", False, 3999, 2501, 1)]
    fine = inventory.verify_chain(df.where("id < 2500"), recompute=False).first()
    assert (fine.ok, fine.checked) == (True, 2500)


def test_decisions_as_of_a_scan(spark):
    chance = random.Random(3)
    found = [(k, chance.choice(["hot", "hot", "g", None]), chance.choice([chance.randrange(300), chance.randrange(300), None])) for k in range(2000)]
    made = [(chance.choice(["hot", "g", "none", None]), chance.randrange(300), k, f"s{k}") for k in range(400)]
    got = inventory.triage_as_of(spark.createDataFrame(found, "id int, fingerprint string, started_at int").repartition(6), spark.createDataFrame(made, "fingerprint string, updated_at int, triage_id int, status string").repartition(3))
    best = {}
    for k, f, at in found:
        fits = [m for m in made if f is not None and at is not None and m[0] == f and m[1] <= at]
        best[k] = max(((m[1], m[2], m[3]) for m in fits), default=(None, None, None))
    rows = got.collect()
    assert len(rows) == len(found) and all((r.triage_status, r.triaged_at) == (best[r.id][2], best[r.id][0]) for r in rows)

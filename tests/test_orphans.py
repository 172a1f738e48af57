import random

from pyspark.sql import functions as F

from galewright.operators.orphans import apply_deltas, change_deltas, current_orphans, orphan_keys, orphan_references, report_per_month
from galewright.operators.orphans import Reference

REFS = [Reference("child", "parent_id", "parent"), Reference("leaf", "place", "spot", columns=("parent_id", "place"), target_columns=("parent_id", "spot"), target_end=None)]


def stamp(df, *names):
    return df.withColumns({n: F.timestamp_seconds(F.col(n)).cast("timestamp_ntz") for n in names})


def tables(spark, parents, children, spots=(), leaves=()):
    return {
        "parent": stamp(spark.createDataFrame(list(parents), "id int, inserted_at long, deleted_at long, key string"), "inserted_at", "deleted_at"),
        "child": stamp(spark.createDataFrame(list(children), "id int, parent_id int, inserted_at long, exists int"), "inserted_at"),
        "spot": stamp(spark.createDataFrame(list(spots), "parent_id int, spot int, inserted_at long"), "inserted_at"),
        "leaf": stamp(spark.createDataFrame(list(leaves), "id int, parent_id int, place int, inserted_at long"), "inserted_at"),
    }


def test_random_histories_equal_brute_force(spark):
    rng = random.Random(4)
    parents = [(rng.randrange(6), a := rng.randrange(400_000), rng.choice([None, a, a + rng.randrange(200_000)]), "k") for _ in range(25)]
    children = [(k, rng.choice([None, *range(8)]), rng.randrange(500_000), 1) for k in range(120)] + [(7, 0, 5, 1)] * 2
    got = {r["row_id"] for r in orphan_references(tables(spark, parents, children), REFS[:1]).collect()}
    want = set()
    for i, p, t, _ in children:
        if p is not None:
            mine = [(a, d) for q, a, d, _ in parents if q == p]
            if not any(a <= t and (d is None or d > t) for a, d in mine) or not any(d is None for _, d in mine):
                want.add(i)
    assert got == want


def test_composite_keys_reasons_and_reports(spark):
    t = tables(spark, [(1, 10, None, ""), (2, 50, None, ""), (3, 0, 20, "")], [(1, 1, 10, 0), (2, 2, 40, 0), (3, 3, 10, 0), (4, 9, 10, 0)], [(1, 5, 100)], [(1, 1, 5, 100), (2, 1, 5, 99), (3, 1, 6, 100), (4, None, 5, 100), (5, 1, None, 100)])
    got = {(r["table_name"], r["row_id"]): r["reason"] for r in orphan_references(t, REFS).collect()}
    assert got == {("child", 2): "missing then", ("child", 3): "missing now", ("child", 4): "missing now", ("leaf", 2): "missing then", ("leaf", 3): "missing now"}
    assert {(r["kind"], r["key"], r["refs"]) for r in orphan_keys(t, REFS).collect()} == {("parent(id)", "3", 1), ("parent(id)", "9", 1), ("spot(parent_id,spot)", "1:6", 1)}
    assert {(r["table_name"], r["month"], r["n_rows"]) for r in report_per_month(orphan_references(t, REFS)).collect()} == {("child", "1970-01", 3), ("leaf", "1970-01", 2)}


def test_increments_equal_one_rebuild(spark):
    """Deltas in two and in many parts, in any order, give the state of all rows; deletions of referring rows take their references back."""
    rng = random.Random(9)
    parents = [(rng.randrange(9), a := rng.randrange(400_000), rng.choice([None, a + rng.randrange(1, 90_000)]), "k") for _ in range(40)]
    t = tables(spark, parents, [])
    children = [(k, rng.randrange(12), a := rng.randrange(500_000), rng.choice([None, None, a + rng.randrange(1, 50_000)])) for k in range(150)]
    t["child"] = stamp(spark.createDataFrame(children, "id int, parent_id int, inserted_at long, deleted_at long"), "inserted_at", "deleted_at")
    deltas = change_deltas(t, REFS[:1])
    rows = lambda state: {(r["kind"], r["key"], r["exists"], r["refs"]) for r in state.collect()}
    whole = apply_deltas(None, deltas)
    parts = None
    for k in (2, 0, 1):
        parts = apply_deltas(parts, deltas.where(f"pmod(hash(at), 3) = {k}"))
    assert rows(parts) == rows(whole)
    want = {}
    for _, p, _, gone in children:
        want[p] = want.get(p, 0) + (gone is None)
    alive = {p for p, _, gone, _ in parents if gone is None}
    assert {(int(r["key"]), r["refs"]) for r in current_orphans(whole, REFS[:1]).collect()} == {(p, n) for p, n in want.items() if n and p not in alive}


def test_a_bulk_load_of_one_key_at_one_instant(spark):
    """A third of all rows refer to one key at one time: the instant has one verdict, and rows come out by salt."""
    parents = [(1, 0, 100, ""), (2, 0, None, "")]
    children = [(k, 1 if k % 3 == 0 else 2, 50 if k % 2 else 200, 0) for k in range(3_000)]
    got = {r["row_id"]: r["reason"] for r in orphan_references(tables(spark, parents, children), REFS[:1]).collect()}
    assert got == {k: "missing now" for k in range(0, 3_000, 3)}


def test_empty_tables(spark):
    assert orphan_references(tables(spark, [], []), REFS).collect() == []
    assert {r["row_id"] for r in orphan_references(tables(spark, [], [(1, 1, 5, 0)]), REFS).collect()} == {1}

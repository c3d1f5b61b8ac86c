"""The store of tasks that is updated in place."""

import random
from pathlib import Path

import pytest

from campaign.operators import tables
from campaign.sources.store import TaskStore

SCHEMA = "id long, version long, state string, tags map<string,string>"


def files(path: Path) -> dict[str, tuple]:
    return {f"{p.parent.name}/{p.name}": (p.stat().st_mtime_ns, p.stat().st_size) for p in path.glob("bucket=*/part-*")}


def test_writes_replace_only_the_buckets_they_touch(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "s"), SCHEMA, "id", "version", 8)
    assert store.read().collect() == []
    assert len(store.upsert(spark.createDataFrame([(k, 1, "new", {"a": str(k)}) for k in range(200)], SCHEMA))) == 8
    before = files(tmp_path / "s")
    touched = store.upsert(spark.createDataFrame([(5, 2, "changed", None), (5, 1, "old", None), (None, 9, "no id", None)], SCHEMA))
    after = files(tmp_path / "s")
    assert len(touched) == 1 and {k: v for k, v in before.items() if not k.startswith(f"bucket={touched[0]}/")} == {k: v for k, v in after.items() if not k.startswith(f"bucket={touched[0]}/")}
    rows = {r["id"]: (r["version"], r["state"], r["tags"]) for r in store.read().collect()}
    assert len(rows) == 200 and rows[5] == (2, "changed", None) and rows[6] == (1, "new", {"a": "6"})
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == [] and files(tmp_path / "s") == after


def test_deleted_ids_come_back_with_newer_writes_only(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    store = TaskStore(spark, str(tmp_path / "d"), SCHEMA, "id", "version", 4)
    store.upsert(frame((1, 5, "a"), (2, 5, "b"), (3, 5, "c")))
    store.delete(frame((1, 0, ""), (2, 0, ""), (99, 0, "")).select("id"))
    assert [r["id"] for r in store.read().collect()] == [3]
    store.upsert(frame((1, 4, "late"), (2, 5, "same version, later call")))
    assert sorted((r["id"], r["state"]) for r in store.read().collect()) == [(2, "same version, later call"), (3, "c")]
    store.delete(store.read().select("id"))  # nothing is left, not even where a bucket has no row
    assert store.read().collect() == []


@pytest.mark.parametrize("buckets", [1, 7])
def test_rows_after_many_calls_are_the_newest(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    store, known = TaskStore(spark, str(tmp_path / "m"), SCHEMA, "id", "version", buckets), {}
    for call in range(4):
        batch = [(rng.randrange(40), rng.randrange(3), rng.choice("abc")) for _ in range(30)]
        store.upsert(spark.createDataFrame([(*r, None) for r in batch], SCHEMA))
        for i, version, state in batch:
            known[i] = max(known.get(i, (-1, -1, "")), (version, call, state))
    assert {r["id"]: (r["version"], r["state"]) for r in store.read().collect()} == {k: (v, s) for k, (v, _, s) in known.items()}


def test_ties_of_upserts(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "id long, version long, state string")
    got = tables.upsert_tasks(frame((1, 1, "z"), (2, 2, "z"), (3, 1, "s")), frame((1, 1, "a"), (1, 1, "b"), (2, 1, "y")), "id", "version")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "b"), (2, 2, "z"), (3, 1, "s")]

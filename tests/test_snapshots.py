"""The state table: snapshots and batches."""

import json
from datetime import datetime

import pytest

from tracewise.streaming import snapshots
from tracewise.streaming.state import STATE


def rows(spark, *results):
    """(key, second, payload or None)."""
    return spark.createDataFrame([(k, "error" if p is None else "ok", p, None, "{}" if p is None else None, datetime(2024, 1, 1, 0, 0, s)) for k, s, p in results], STATE)


def held(df):
    return {r["pair_id"]: r["pair_json"] for r in df.collect()}


def test_batches_become_snapshots(spark, tmp_path):
    table = snapshots.StateTable(spark, f"file://{tmp_path}/state", keep=3, buckets=4)
    assert table.read().count() == 0 and table.batches() == {}
    table.append(rows(spark, ("a", 1, "a1"), ("a", 3, "a3"), ("b", 1, None)), "s", 0)
    table.append(rows(spark, ("a", 2, "a2"), ("c", 1, "c1")), "t", 0)
    assert held(table.read()) == {"a": "a3", "b": None, "c": "c1"} and table.batches() == {"s": [0], "t": [0]}
    table.append(rows(spark, ("c", 1, "c0")), "t", 0)  # the batch again
    assert held(table.read()) == {"a": "a3", "b": None, "c": "c0"}
    table.append(rows(spark, ("b", 4, "b4")), "s", 1)
    assert table.batches() == {} and table.manifest()["merged"] == {"s": 1, "t": 0}
    want = {"a": "a3", "b": "b4", "c": "c0"}
    snapshot = table.manifest()["snapshot"]
    assert held(table.read()) == want and spark.read.parquet(f"file://{tmp_path}/state/{snapshot}").count() == 3
    table.append(rows(spark, ("a", 9, "late")), "s", 1)  # a batch that the snapshot holds
    assert held(table.read()) == want and table.batches() == {}
    for n in range(2, 8):
        table.append(rows(spark, ("a", 10 + n, f"a{n}"), (f"k{n}", 1, "k")), "s", n)
    assert held(table.read()) == want | {"a": "a7"} | {f"k{n}": "k" for n in range(2, 8)} and table.manifest()["version"] == 3
    assert sum(p.name.startswith("snapshot-") for p in (tmp_path / "state").iterdir()) == 2
    again = snapshots.StateTable(spark, f"file://{tmp_path}/state", keep=3, buckets=4)
    assert held(again.read()) == held(table.read())


def test_lookup_reads_buckets(spark, tmp_path):
    table = snapshots.StateTable(spark, f"file://{tmp_path}/state", keep=1, buckets=16)
    table.append(rows(spark, *[(f"k{n}", 1, f"v{n}") for n in range(50)]), "s", 0)
    table.keep = 9
    table.append(rows(spark, ("k1", 2, "new")), "s", 1)
    keys = spark.createDataFrame([("k1",), ("k2",), ("none",), ("k1",)], "pair_id string")
    found = table.lookup(keys)
    assert held(found) == {"k1": "new", "k2": "v2"}
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (snapshots.StateTable(spark, f"file://{tmp_path}/state", keep=9) for _ in range(2))
    one.append(rows(spark, ("a", 1, "a1")), "s", 0)
    before = two.manifest()
    one.compact()
    monkeypatch.setattr(two, "manifest", lambda: before)
    monkeypatch.setattr(two, "batches", lambda m=None: {"s": [0]})
    monkeypatch.setattr(two, "_rows", lambda m, keys=None: rows(spark, ("a", 1, "other")))
    with pytest.raises(snapshots.Conflict):
        two.compact()
    assert held(one.read()) == {"a": "a1"}


def test_streams_leave_a_row_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = snapshots.StateTable(spark, f"file://{tmp_path}/state", keep=2)

    def put(n, *results):
        lines = [{"pair_id": k, "pair_json": p, "error_json": None if p else "{}", "updated_at": f"2024-01-01T00:00:{s:02d}Z"} for k, s, p in results]
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))

    def run():
        snapshots.ingest(spark, str(tmp_path / "in"), table, str(tmp_path / "check"), files_at_once=1).awaitTermination()

    put(0, ("a", 1, "a1"), ("b", 1, None))
    run()
    put(1, ("a", 2, "a2"))
    put(2, ("b", 3, "b3"), ("c", 1, "c1"))
    run()
    run()
    assert held(table.read()) == {"a": "a2", "b": "b3", "c": "c1"} and table.read().count() == 3
    assert table.manifest()["version"] >= 1 and sum(map(len, table.batches().values())) < 2

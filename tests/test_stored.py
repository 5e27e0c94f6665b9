"""W02-W04 on stored tables: what a load reads, writes and leaves when it breaks."""

import os
import random

import pytest

from souqlytics.sources.stored import StoredTable

SCHEMA = "k string, n bigint, v string"


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"], buckets=8)


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def contents(table):
    return {(r.k, r.n): r.v for r in table.read().collect()}


def test_random_loads_against_a_dict(spark, table):
    rng, want = random.Random(4), {}
    for step in range(7):
        batch = {(rng.choice(["a", "b", None, "é"]), rng.choice([None, *range(6)])): rng.choice(["x", "y", None]) for _ in range(rng.randint(0, 20))}
        df = rows(spark, [(*k, v) for k, v in batch.items()])
        if step % 2:
            table.upsert(df)
            want |= batch
        else:
            table.insert_ignore(df)
            want = batch | want
        if step == 4:
            table.compact()
        assert contents(table) == want


def test_a_repeated_batch_writes_nothing(spark, table):
    df = rows(spark, [("a", 1, "x"), ("b", 2, "y")])
    table.upsert(df)
    for load in (table.upsert, table.insert_ignore):
        load(df)
        newest = max(n for n in os.listdir(table.path) if n.startswith("load-"))
        assert not [f for _, _, names in os.walk(f"{table.path}/{newest}") for f in names if f.endswith(".parquet")]
    assert contents(table) == {("a", 1): "x", ("b", 2): "y"}


def test_a_load_reads_only_its_buckets(spark, table):
    table.insert_ignore(rows(spark, [(f"k{i}", i, "x") for i in range(100)]))
    _, touched = table._incoming(rows(spark, [("k5", 5, "new")]))
    assert len(touched) == 1
    plan = table._rows(table.keys, touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    assert "ReadSchema: struct<k:string,n:bigint>" in plan
    read = table._rows(table.keys, touched)
    assert 0 < read.count() < 100 and len(read.inputFiles()) >= 1


def test_a_broken_load_is_not_seen(spark, table):
    table.upsert(rows(spark, [("a", 1, "x"), ("b", 1, "x")]))
    table.upsert(rows(spark, [("a", 1, "y")]))
    os.remove(f"{table.path}/load-000002/_SUCCESS")  # as if the driver had died before the end
    assert contents(table) == {("a", 1): "x", ("b", 1): "x"}
    table.upsert(rows(spark, [("a", 1, "z")]))
    assert contents(table) == {("a", 1): "z", ("b", 1): "x"}


def test_keys_go_on_from_the_mark(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "keyed"), "id int, name string", ["name"], buckets=4)
    assert t.mark() == 0
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    t.add_keys(names("b", "a", "c", "a"), "id")
    first = {r.name: r.id for r in t.read().collect()}
    assert sorted(first.values()) == [1, 2, 3] and t.mark() == 3
    t.add_keys(names("c", "d", "a"), "id")
    t.compact()
    t.add_keys(names("e"), "id")
    t.add_keys(names("e"), "id")
    last = {r.name: r.id for r in t.read().collect()}
    assert {n: last[n] for n in first} == first and (last["d"], last["e"]) == (4, 5) and t.mark() == 5

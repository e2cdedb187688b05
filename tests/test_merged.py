"""A merged table against a plain dictionary: compaction, retries, crashes between the steps, bounded files."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.streaming.merged import MergedTable

SCHEMA = "k BIGINT, g STRING, pos BIGINT, v BIGINT"


def _table(spark, path, **more):
    return MergedTable(spark, str(path), ["k", "g"], F.col("pos"), **{"buckets": 2, "fan_in": 2, "levels": 2, **more})


def _batches(n, seed=5):
    made, pos = random.Random(seed), 0
    out = []
    for _ in range(n):
        rows = []
        for _ in range(made.randint(0, 6)):
            pos += 1
            rows.append((made.choice([1, 2, 3, None]), made.choice(["a", None]), pos if made.random() < 0.8 else max(1, pos - 9), made.randint(0, 99)))
        # A key has one row at a position, as in a log.
        out.append(list({(k, g, p): (k, g, p, v) for k, g, p, v in rows}.values()))
    return out


def _merge(state, rows):
    for k, g, p, v in rows:
        if (k, g) not in state or p > state[k, g][0]:
            state[k, g] = (p, v)


def _now(table):
    return {(r.k, r.g): (r.pos, r.v) for r in table.read().collect()}


def test_merges_like_a_dictionary_and_stays_small(spark, tmp_path):
    table, state, seen = _table(spark, tmp_path), {}, set()
    for n, rows in enumerate(_batches(14)):
        fresh = [r for r in rows if (r[0], r[1], r[2]) not in seen]
        seen |= {(r[0], r[1], r[2]) for r in fresh}
        _merge(state, fresh)
        table.apply(spark.createDataFrame(fresh, SCHEMA), n)
        # A batch that is delivered again changes nothing.
        if n % 5 == 4:
            table.apply(spark.createDataFrame([(1, "a", 10 ** 6, 7)], SCHEMA), n)
        if n % 3 == 2:
            assert _now(table) == state
    manifest = table.manifest()
    assert len(manifest.runs) <= 2 * table.levels + 1 and manifest.batch_id == 13
    assert _now(table) == state
    # Places are used again: no more folders than places, whatever the number of batches.
    assert len(list((tmp_path / "runs").iterdir())) <= 2 * table.fan_in * (table.levels + 1)
    wanted = spark.createDataFrame([(1, "a")], "k BIGINT, g STRING")
    assert [(r.pos, r.v) for r in table.lookup(wanted).collect()] == [state[1, "a"]]


def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    for n in range(3):
        table.apply(spark.createDataFrame([(n, "a", n, n)], SCHEMA), n)
    before = _now(table)
    batch = spark.createDataFrame([(0, "a", 50, 50), (9, "b", 51, 51)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(MergedTable, "_swap", lambda self, after: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(batch, 3)
    assert _now(table) == before
    table.apply(batch, 3)
    assert _now(table) == {**before, (0, "a"): (50, 50), (9, "b"): (51, 51)}


def test_reader_of_the_manifest_before(spark, tmp_path):
    """What a reader planned before a batch is still there after it, also if runs were merged."""
    table = _table(spark, tmp_path)
    for n in range(4):
        planned = table.read() if n else None
        want = _now(table) if n else None
        table.apply(spark.createDataFrame([(1, "a", n, n)], SCHEMA), n)
        if n:
            assert {(r.k, r.g): (r.pos, r.v) for r in planned.collect()} == want


def test_empty(spark, tmp_path):
    table = _table(spark, tmp_path)
    with pytest.raises(ValueError):
        table.read()
    table.apply(spark.createDataFrame([], SCHEMA), 0)
    assert table.read().count() == 0

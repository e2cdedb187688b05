"""Every registered query against its check query."""

import decimal

import duckdb
import pytest

import __spark_entry__ as contract
from fleetscope.plans.catalog import ENTRIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()
KINDS = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP"}
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _text(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    assert not isinstance(value, decimal.Decimal)
    return str(value)


def _rows(rows, order):
    return sorted(tuple(_text(row[n]) for n in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_and_types(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == types
    expected = _rows(cursor.fetchall(), [columns.index(c) for c in df.columns])
    assert expected, "the check query must return rows"
    assert _rows(df.collect(), range(len(df.columns))) == expected


def test_every_query_has_a_check():
    assert set(ENTRIES) <= set(SQL) <= set(contract.queries())


def test_entry_is_lazy_and_not_empty(spark):
    df = contract.entry(spark)
    assert df.columns == ["host_id", "poll_id", "ts", "qps", "tps", "tps_commit"]
    assert df.count() > 0


# Whole numbers are slices of their own here, times are cut by day as always.
SLICED = ["counter_deltas", "counter_rates", "running_stats", "slow_digest_rank", "fingerprint_digest", "replication_health",
          "change_lag", "daily_growth", "slow_log_ingest", "change_text_decode", "restore_chain", "deadlock_events", "chart_config"]


@pytest.mark.parametrize("name", SLICED)
def test_same_rows_in_small_slices(spark, duck, sf_dir, name, tiny_groups):
    df = contract.queries()[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = _rows(cursor.fetchall(), [columns.index(c) for c in df.columns])
    assert _rows(df.collect(), range(len(df.columns))) == expected

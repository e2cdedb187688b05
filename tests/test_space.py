from datetime import date

from pyspark.sql import functions as F

from fleetscope.functions.format import none_to_null
from fleetscope.operators import hosts as H
from fleetscope.operators import space as P
from fleetscope.sources import sinks

SPACE = ("host_id BIGINT, db_name STRING, table_name STRING, snap_date DATE, table_rows BIGINT, data_length BIGINT, index_length BIGINT,"
         " total_size BIGINT, auto_increment BIGINT, file_size BIGINT, free_size BIGINT")


def _space(spark, *rows):
    return spark.createDataFrame([(h, "d", t, date(2024, 1, day), n, n, n, 2 * n, n, 3 * n, n) for h, t, day, n in rows], SPACE)


def test_growth_needs_yesterday(spark):
    df = _space(spark, (1, "t", 1, 10), (1, "t", 2, 15), (1, "t", 4, 30), (1, "u", 4, 5))
    got = {(r.table_name, r.snap_date.day): r.diff_total_size for r in P.daily_growth(df).collect()}
    assert got == {("t", 1): None, ("t", 2): 10, ("t", 4): None, ("u", 4): None}
    totals = {r.snap_date.day: r.diff_total for r in P.daily_growth_totals(P.space_totals(df)).collect()}
    assert totals == {1: 0, 2: 10, 4: 0}


def test_table_page_filters_by_name(spark):
    df = _space(spark, *[(1, f"t{n:02d}", 1, n) for n in range(30)], (2, "t99", 1, 99), (1, "orders", 1, 50))
    page = P.tables_by_space(df, order_by=7, page=2, name="t", host_id=1).collect()
    assert [r.table_name for r in page] == [f"t{n:02d}" for n in range(10)][::-1]
    assert [r.host_id for r in P.hosts_by_space(P.daily_space_report(P.space_totals(df)), 1).collect()] == [1, 2]


STATS = "host_id BIGINT, table_schema STRING, table_name STRING, index_name STRING, non_unique INT, seq_in_index INT, column_name STRING, index_type STRING"


def _stats(spark, **indexes):
    rows = [(1, "s", "t", name, int(not name.startswith(("PRIMARY", "u_"))), n, c, "BTREE")
            for name, columns in indexes.items() for n, c in enumerate(columns, 1)]
    return spark.createDataFrame(rows, STATS)


def test_duplicate_indexes(spark):
    df = _stats(spark, PRIMARY="i", k_a="a", k_ab="ab", k_ab2="ab", k_b="b", k_i="i", u_a="a", u_c="c", k_c="c", k_cd="cd")
    got = {r.index_name: r.covered_by for r in P.duplicate_indexes(df).collect()}
    # A unique index is kept although a longer one starts with it.
    assert got == {"k_a": "k_ab", "k_ab2": "k_ab", "k_i": "PRIMARY", "k_c": "k_cd"}


def test_no_primary_key_keeps_one_row_per_table(spark):
    tables = spark.createDataFrame([(1, "s", "t", "InnoDB"), (1, "s", "m", "MyISAM"), (1, "s", "ok", "InnoDB"), (1, "mysql", "x", "InnoDB")],
                                   "host_id BIGINT, table_schema STRING, table_name STRING, engine STRING")
    stats = spark.createDataFrame([(1, "s", "t", "ft", 1, 1, "a", "FULLTEXT"), (1, "s", "t", "ft2", 1, 1, "b", "FULLTEXT"),
                                   (1, "s", "m", "PRIMARY", 0, 1, "i", "BTREE"), (1, "s", "ok", "PRIMARY", 0, 1, "i", "BTREE"),
                                   (1, "s", "ok", "PRIMARY", 0, 2, "j", "BTREE")], STATS)
    got = {r.table_name: (r.nopk, r.ftidx) for r in P.no_primary_key(tables, stats).collect()}
    assert got == {"t": ("NOPK", "FULLTEXT"), "m": ("", "")}


def test_catalog_nulls_and_system_schemas(spark):
    df = spark.createDataFrame([("s", "t", None, 5, None), ("sys", "x", 1, 1, 1)],
                               "table_schema STRING, table_name STRING, data_length BIGINT, index_length BIGINT, auto_increment BIGINT")
    row = P.catalog_scan(df).first()
    assert P.catalog_scan(df).count() == 1 and (row.data_length, row.total_size, row.full_name) == (0, 5, "s.t")


def test_size_log_replaces_only_its_hosts_and_days(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.size_log_append(_space(spark, (1, "t", 1, 10), (2, "t", 1, 20), (1, "t", 2, 30)), path)
    sinks.size_log_append(_space(spark, (1, "t", 1, 11), (1, "u", 1, 12)), path)
    got = {(r.host_id, r.table_name, r.date.day): r.rows for r in spark.read.parquet(path).collect()}
    assert got == {(1, "t", 1): 11, (1, "u", 1): 12, (2, "t", 1): 20, (1, "t", 2): 30}


def test_empty_key_list_selects_all(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "host_id BIGINT")
    assert H.hosts_by_keys(df, []).count() == 3
    assert H.hosts_by_keys(df, [2, 9]).count() == 1
    assert H.hosts_by_keys(df, df.where("host_id > 1")).count() == 2


def test_branch_ignores_case_and_none_is_null(spark):
    df = spark.createDataFrame([("MariaDB Server",), ("Percona Server",), ("None",)], "Version_Comment STRING")
    assert [r.branch for r in H.branch_classify(df).collect()] == ["Mariadb", "Percona", "MySQL"]
    assert none_to_null(df).columns == ["version_comment"] and none_to_null(df).where("version_comment IS NULL").count() == 1


def test_null_info_is_not_active(spark):
    df = spark.createDataFrame([(1, "Query", "s", "q", 5), (1, "Query", "s", None, 5), (1, "Sleep", "s", "q", 5), (1, "Query", "", "q", 5)],
                               "host_id BIGINT, command STRING, state STRING, info STRING, time_s BIGINT")
    assert H.active_threads(df).count() == 2
    hosts = spark.createDataFrame([(1,), (2,)], "host_id BIGINT")
    assert {r.host_id: r.thread_waits_count for r in H.long_threads(df, hosts).collect()} == {1: 2, 2: 0}


def test_long_charts_nest_in_blocks(spark):
    charts = spark.createDataFrame([(1, "a", 2, 0), (2, "b", 1, 0), (3, "c", 0, 1)], "chart_id BIGINT, chart_title STRING, weight INT, is_deleted INT")
    lines = spark.range(2500).selectExpr("1L AS chart_id", "id AS line_id", "'n' AS line_name")
    config = H.chart_config(charts, lines)
    assert [(r.chart_id, r.line_no) for r in config.collect()] == [(2, None), *[(1, n) for n in range(1, 2501)]]
    assert [(r.chart_id, len(r.lines)) for r in H.chart_nested(config).collect()] == [(2, 0), (1, 2500)]


def test_a_second_server_changes_nothing_of_the_first(spark, sf_dir):
    from fleetscope.plans.inputs import Inputs

    i = Inputs(spark, sf_dir)
    one = [t.where("host_id = 1") for t in (i.catalog_tables, i.catalog_statistics, i.catalog_columns)]
    both = [t.union(t.withColumn("host_id", F.lit(77).cast("bigint"))) for t in one]
    for run in (lambda t, s, c: P.no_primary_key(t, s), lambda t, s, c: P.duplicate_indexes(s), P.table_detail):
        want, got = run(*one), run(*both).where("host_id = 1")
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_duplicate_indexes_broadcast_nothing(spark):
    """An estimate that is far too low must not send the indexes of a fleet through the driver; equal, unique and null keys as before."""
    rows = [(1, "s", "t", "k_a", 1, 1, "a", "BTREE"), (1, "s", "t", "k_ab", 1, 1, "a", "BTREE"), (1, "s", "t", "k_ab", 1, 2, "b", "BTREE"),
            (None, "s", "t", "k_a", 1, 1, "a", "BTREE"), (None, "s", "t", "k_ab", 1, 1, "a", "BTREE"), (None, "s", "t", "k_ab", 1, 2, "b", "BTREE"),
            (1, "s", "t", "f_a", 1, 1, "a", "FULLTEXT"), (1, "s", "u", "u_1", 0, 1, "c", "BTREE"), (1, "s", "u", "u_2", 0, 1, "c", "BTREE")]
    out = P.duplicate_indexes(spark.createDataFrame(rows, STATS))
    assert {(r.host_id, r.table_name, r.index_name, r.columns, r.covered_by) for r in out.collect()} == {
        (1, "t", "k_a", "a", "k_ab"), (1, "u", "u_2", "c", "u_1")}
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_catalog_joins_broadcast_nothing(spark):
    """Lists of a fleet's tables are larger than an estimate says; tables without lists stay, and so do null keys."""
    key = "host_id BIGINT, table_schema STRING, table_name STRING"
    tables = spark.createDataFrame([(1, "s", "t", "InnoDB"), (1, "s", "bare", "InnoDB"), (None, "s", "t", "InnoDB")], f"{key}, engine STRING")
    columns = spark.createDataFrame([(1, "s", "t", "id", 1, "bigint", "PRI"), (None, "s", "t", "id", 1, "bigint", "PRI")],
                                    f"{key}, column_name STRING, ordinal_position INT, column_type STRING, column_key STRING")
    detail, keyless = P.table_detail(tables, _stats(spark, PRIMARY="i"), columns), P.no_primary_key(tables, _stats(spark, PRIMARY="i"))
    assert {(r.host_id, r.table_name, r.index_infos is None, r.column_infos is None) for r in detail.collect()} == {
        (1, "t", False, False), (1, "bare", True, True), (None, "t", True, True)}
    assert {(r.host_id, r.table_name) for r in keyless.collect()} == {(1, "bare"), (None, "t")}
    for out in (detail, keyless):
        assert "Broadcast" not in out._jdf.queryExecution().toString()

"""Registered queries over catalogs, sizes, hosts, threads and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.constants import SYSTEM_SCHEMAS
from fleetscope.functions import format as fmt
from fleetscope.operators import hosts as H
from fleetscope.operators import space as P
from fleetscope.plans.registry import Entry
from fleetscope.plans.views import with_views

SYSTEM = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS)
SPACE = {
    "files": "SELECT host_id, snap_date, CAST(split_part(line, chr(9), 1) AS BIGINT) AS file_size, split_part(line, '/', 3) AS db_name,"
             " replace(split_part(line, '/', 4), '.ibd', '') AS table_name FROM file_sizes",
    "space": "SELECT t.*, f.file_size, t.data_length + t.index_length AS total_size, f.file_size - (t.data_length + t.index_length) AS free_size"
             " FROM table_sizes t JOIN files f ON t.host_id = f.host_id AND t.snap_date = f.snap_date AND t.db_name = f.db_name AND t.table_name = f.table_name",
}
TOTALS = {**SPACE, "totals": "SELECT host_id, snap_date, count(*) AS table_count, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in {
        "rows_total": "table_rows", "data_total": "data_length", "index_total": "index_length", "file_total": "file_size",
        "free_total": "free_size", "total": "total_size"}.items()) + " FROM space GROUP BY host_id, snap_date"}
LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY snap_date DESC) AS rn FROM totals) x WHERE rn = 1"


def _space(i):
    return P.table_space(i.table_sizes, P.file_size_parse(i.file_sizes))


def _totals(i):
    return P.space_totals(_space(i))


HUMAN = ("CASE WHEN n = 0 THEN '0' WHEN n < 1024 THEN CAST(n AS STRING) || 'B' WHEN n < 1048576 THEN CAST(n // 1024 AS STRING) || 'KB'"
         " WHEN n < 1073741824 THEN CAST(n // 1048576 AS STRING) || 'M'"
         " WHEN n < 1099511627776 THEN CAST(floor(CAST(n AS DOUBLE) / 1073741824 * 100 + 0.5) / 100 AS STRING) || 'G'"
         " WHEN n < 1125899906842624 THEN CAST(floor(CAST(n AS DOUBLE) / 1099511627776 * 100 + 0.5) / 100 AS STRING) || 'T' END")
HUMAN_SHORT = ("CASE WHEN n <= 1024 THEN CAST(n AS STRING) || 'KB' WHEN floor(n / 1024 + 0.5) > 1024"
               " THEN CAST(CAST(floor(floor(n / 1024 + 0.5) / 1024 + 0.5) AS BIGINT) AS STRING) || 'M'"
               " ELSE CAST(CAST(floor(n / 1024 + 0.5) AS BIGINT) AS STRING) || 'K' END")
# Sizes spread over every unit, from zero bytes to beyond the largest one.
SPREAD = "data_length % 1000003 * (auto_increment % 3) * CAST(pow(8, index_length % 12) AS BIGINT)"

DUPLICATES = {
    "idx": "SELECT host_id, table_schema, table_name, index_type, index_name, non_unique, string_agg(column_name, ',' ORDER BY seq_in_index) AS columns,"
           " CASE WHEN index_name = 'PRIMARY' THEN '' ELSE index_name END AS place FROM catalog_statistics GROUP BY ALL",
    "pairs": "SELECT a.host_id, a.table_schema, a.table_name, a.index_name, a.columns, a.non_unique, b.place AS by_place,"
             " CASE WHEN b.columns <> a.columns THEN 1 WHEN b.non_unique = 0 THEN 2 ELSE 3 END AS kind FROM idx a JOIN idx b"
             " ON a.host_id = b.host_id AND a.table_schema = b.table_schema AND a.table_name = b.table_name AND a.index_type = b.index_type AND a.index_name <> b.index_name"
             " AND ((a.non_unique = 1 AND starts_with(b.columns, a.columns || ',')) OR (a.non_unique = 1 AND b.columns = a.columns AND (b.non_unique = 0 OR b.place < a.place))"
             " OR (a.non_unique = 0 AND b.non_unique = 0 AND b.columns = a.columns AND b.place < a.place))",
}


def _detail(i):
    d = P.table_detail(i.catalog_tables.select("host_id", "table_schema", "table_name", "engine"), i.catalog_statistics, i.catalog_columns)
    return d.select(
        "host_id", "table_schema", "table_name", "engine",
        F.array_join(F.transform("index_infos", lambda x: F.concat_ws(":", x["index_name"], x["seq_in_index"], x["column_name"])), ",").alias("index_infos"),
        F.array_join(F.transform("column_infos", lambda x: F.concat_ws(":", x["column_name"], x["column_type"])), ",").alias("column_infos"))


ENTRIES = {
    "catalog_scan": Entry(
        lambda i: P.catalog_scan(i.catalog_tables),
        with_views("SELECT host_id, table_schema, table_name, engine, coalesce(data_length, 0) AS data_length, coalesce(index_length, 0) AS index_length, table_rows,"
                   " coalesce(auto_increment, 0) AS auto_increment, coalesce(data_length, 0) + coalesce(index_length, 0) AS total_size,"
                   f" table_schema || '.' || table_name AS full_name FROM catalog_tables WHERE table_schema NOT IN ({SYSTEM})")),
    "file_size_parse": Entry(lambda i: P.file_size_parse(i.file_sizes), with_views("SELECT * FROM files", SPACE)),
    "table_search": Entry(lambda i: P.table_search(i.catalog_tables, "t1"),
                          with_views("SELECT * FROM catalog_tables WHERE contains(table_name, 't1')")),
    "table_space": Entry(_space, with_views("SELECT * FROM space", SPACE)),
    "space_totals": Entry(_totals, with_views("SELECT * FROM totals", TOTALS)),
    "daily_space_report": Entry(lambda i: P.daily_space_report(_totals(i)), with_views(LATEST, TOTALS)),
    "daily_growth": Entry(
        lambda i: P.daily_growth(_space(i)),
        with_views("SELECT s.*, " + ", ".join(f"s.{c} - y.{c} AS diff_{c}" for c in P.SIZES) + " FROM space s LEFT JOIN space y ON s.host_id = y.host_id"
                   " AND s.db_name = y.db_name AND s.table_name = y.table_name AND y.snap_date = s.snap_date - 1", SPACE)),
    "daily_growth_totals": Entry(
        lambda i: P.daily_growth_totals(_totals(i)),
        with_views("SELECT s.*, " + ", ".join(f"coalesce(s.{c} - y.{c}, 0) AS diff_{c}" for c in P.TOTALS)
                   + " FROM totals s LEFT JOIN totals y ON s.host_id = y.host_id AND y.snap_date = s.snap_date - 1", TOTALS)),
    "hosts_by_space": Entry(lambda i: P.hosts_by_space(P.daily_space_report(_totals(i))), with_views(LATEST, TOTALS)),
    "tables_by_space": Entry(
        lambda i: P.tables_by_space(P.newest_day(_space(i)), order_by=5, name="t", host_id=3),
        with_views("SELECT * FROM space WHERE contains(table_name, 't') AND host_id = 3 AND snap_date = (SELECT max(snap_date) FROM space WHERE host_id = 3)"
                   " ORDER BY file_size DESC, db_name, table_name LIMIT 20", SPACE)),
    "fragmented_top": Entry(
        lambda i: P.fragmented_top(_space(i), 3),
        with_views("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host_id, snap_date ORDER BY free_size DESC, db_name, table_name) AS rn FROM space) x WHERE rn <= 3", SPACE)),
    "no_primary_key": Entry(
        lambda i: P.no_primary_key(i.catalog_tables, i.catalog_statistics),
        with_views("SELECT DISTINCT t.host_id, t.table_schema, t.table_name, t.engine, CASE WHEN p.table_name IS NULL THEN 'NOPK' ELSE '' END AS nopk,"
                   " CASE WHEN f.table_name IS NULL THEN '' ELSE 'FULLTEXT' END AS ftidx, '' AS gisidx FROM catalog_tables t"
                   " LEFT JOIN catalog_statistics p ON t.host_id = p.host_id AND t.table_schema = p.table_schema AND t.table_name = p.table_name AND p.index_name = 'PRIMARY'"
                   " LEFT JOIN catalog_statistics f ON t.host_id = f.host_id AND t.table_schema = f.table_schema AND t.table_name = f.table_name AND f.index_type = 'FULLTEXT'"
                   f" WHERE t.table_schema NOT IN ({SYSTEM}) AND (t.engine <> 'InnoDB' OR p.table_name IS NULL OR f.table_name IS NOT NULL)")),
    "duplicate_indexes": Entry(
        lambda i: P.duplicate_indexes(i.catalog_statistics),
        with_views("SELECT host_id, table_schema, table_name, index_name, columns, CASE WHEN by_place = '' THEN 'PRIMARY' ELSE by_place END AS covered_by FROM"
                   " (SELECT *, row_number() OVER (PARTITION BY host_id, table_schema, table_name, index_name ORDER BY kind, by_place) AS rn FROM pairs) x WHERE rn = 1", DUPLICATES)),
    "table_detail": Entry(
        _detail,
        with_views("SELECT t.host_id, t.table_schema, t.table_name, t.engine, i.index_infos, c.column_infos FROM catalog_tables t"
                   " LEFT JOIN (SELECT host_id, table_schema, table_name, string_agg(index_name || ':' || seq_in_index || ':' || column_name, ',' ORDER BY index_name, seq_in_index) AS index_infos"
                   " FROM catalog_statistics GROUP BY host_id, table_schema, table_name) i ON t.host_id = i.host_id AND t.table_schema = i.table_schema AND t.table_name = i.table_name"
                   " LEFT JOIN (SELECT host_id, table_schema, table_name, string_agg(column_name || ':' || column_type, ',' ORDER BY ordinal_position) AS column_infos"
                   " FROM catalog_columns GROUP BY host_id, table_schema, table_name) c ON t.host_id = c.host_id AND t.table_schema = c.table_schema AND t.table_name = c.table_name")),
    "human_bytes": Entry(
        lambda i: i.table_sizes.selectExpr("host_id", "db_name", "table_name", "snap_date", f"{SPREAD} AS n").withColumn("shown", fmt.human_bytes("n")),
        with_views(f"SELECT *, {HUMAN} AS shown FROM (SELECT host_id, db_name, table_name, snap_date, {SPREAD} AS n FROM table_sizes) x")),
    "human_bytes_short": Entry(
        lambda i: i.table_sizes.selectExpr("host_id", "db_name", "table_name", "snap_date", f"{SPREAD} AS n").withColumn("shown", fmt.human_bytes_short("n")),
        with_views(f"SELECT *, {HUMAN_SHORT} AS shown FROM (SELECT host_id, db_name, table_name, snap_date, {SPREAD} AS n FROM table_sizes) x")),
    "hosts_by_keys": Entry(lambda i: H.hosts_by_keys(i.host_infos, i.slave_hosts),
                           with_views("SELECT * FROM host_infos WHERE host_id IN (SELECT host_id FROM slave_hosts)")),
    "active_hosts": Entry(lambda i: H.active(i.host_infos), with_views("SELECT * FROM host_infos WHERE is_deleted = 0")),
    "branch_classify": Entry(
        lambda i: H.branch_classify(i.host_infos.select("host_id", "version_comment")),
        with_views("SELECT host_id, version_comment, CASE WHEN version_comment ILIKE '%percona%' THEN 'Percona' WHEN version_comment ILIKE '%mariadb%' THEN 'Mariadb' ELSE 'MySQL' END AS branch FROM host_infos")),
    "none_to_null": Entry(lambda i: fmt.none_to_null(i.host_infos.withColumnRenamed("remark", "Remark")),
                          with_views("SELECT * REPLACE (nullif(version_comment, 'None') AS version_comment) FROM host_infos")),
    "json_rows": Entry(
        lambda i: fmt.json_rows(i.host_infos, "host_id", "remark", "server_uuid", "max_connections"),
        with_views("SELECT CAST(to_json({'host_id': host_id, 'remark': remark, 'server_uuid': server_uuid, 'max_connections': max_connections}) AS VARCHAR) AS json FROM host_infos")),
    "active_threads": Entry(lambda i: H.active_threads(i.processlist),
                            with_views("SELECT * FROM processlist WHERE command <> 'Sleep' AND length(info) > 0")),
    "long_threads": Entry(
        lambda i: H.long_threads(i.processlist, i.host_infos),
        with_views("SELECT h.host_id, coalesce(n, 0) AS thread_waits_count FROM host_infos h LEFT JOIN (SELECT host_id, count(*) AS n FROM processlist"
                   " WHERE length(state) > 0 AND length(info) > 0 AND time_s > 1 GROUP BY host_id) p ON h.host_id = p.host_id")),
    "thread_groups": Entry(lambda i: H.thread_groups(i.processlist),
                           with_views("SELECT user_name, command, state, info, count(*) AS threads FROM processlist GROUP BY ALL")),
    "chart_config": Entry(
        lambda i: H.chart_config(i.charts, i.chart_lines),
        with_views("SELECT c.chart_id, c.chart_title, c.weight, l.line_no, l.line_id, l.line_name FROM charts c LEFT JOIN"
                   " (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY line_id) AS line_no FROM chart_lines) l"
                   " ON c.chart_id = l.chart_id WHERE c.is_deleted = 0")),
}

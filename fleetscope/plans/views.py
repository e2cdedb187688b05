"""DuckDB text of the derived inputs, for the check queries."""

from __future__ import annotations

import re

from fleetscope.plans import inputs as I


def _select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _key_values(values: dict[str, str], source: str) -> str:
    branches = [f"SELECT host_id, poll_id, ts, '{n}' AS variable_name, CAST({e} AS STRING) AS value FROM {source}"
                for n, e in values.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(branches)}) u WHERE value IS NOT NULL"


def _numbered_lines(lines: dict[int, str], columns: str, source: str, number: str) -> str:
    branches = [f"SELECT {columns}, {n} AS {number}, {e} AS line FROM {source}" for n, e in lines.items()]
    return " UNION ALL ".join(branches)


VIEWS = {
    "host_infos": _select(I.HOST_INFOS, "supplier"),
    "slave_hosts": _select(I.SLAVE_HOSTS, "supplier") + " WHERE s_suppkey >= 4",
    "counter_base": "SELECT user_id % 10 AS host_id, event_id AS poll_id, ts, "
    + ", ".join(f"CAST(sum({e}) OVER w AS BIGINT) AS {n}" for n, e in I.COUNTER_STEPS.items())
    + " FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "counter_samples": _select(["*", *I.COUNTERS_DERIVED], "counter_base"),
    "status_kv": _key_values(I.STATUS_VALUES, "counter_samples"),
    "status_polls": _select(I.STATUS_POLLS, "counter_samples"),
    "variables_kv": _key_values(I.VARIABLE_VALUES, "counter_samples"),
    "processlist": _select(I.PROCESSLIST, "events"),
    "slow_history": _select(I.SLOW_HISTORY, "lineitem"),
    "slow_review": "SELECT p.p_partkey AS checksum, p.p_name AS fingerprint, p.p_size % 2 AS is_reviewed, l.first_seen, l.last_seen"
    " FROM part p JOIN (SELECT l_partkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY l_partkey) l"
    " ON p.p_partkey = l.l_partkey",
    "review_updates": _select(I.REVIEW_UPDATES, "orders"),
    "table_sizes": _select([*I.TABLE_SIZE_KEYS, *[f"CAST({e} AS BIGINT) AS {n}" for n, e in I.TABLE_SIZE_SUMS.items()]], "events")
    + " GROUP BY user_id % 10, event_id % 2, event_id % 5, CAST(ts AS DATE)",
    "file_sizes": _select(I.FILE_SIZES, "table_sizes") + " WHERE table_name <> 't4'",
    "binlog_base": _select(I.BINLOG_BASE, "orders"),
    "binlog_events": _select(I.BINLOG_IMAGES, "(SELECT *, row_number() OVER w AS rn, lag(amt) OVER w AS prev_amt, lag(note) OVER w AS prev_note"
                             " FROM binlog_base WINDOW w AS (PARTITION BY master_host_id, pk ORDER BY log_pos)) x"),
    "innodb_trx": _select(I.INNODB_TRX, "events"),
    "innodb_locks": _select(I.INNODB_LOCKS, "events") + " UNION ALL "
    + _select(I.INNODB_LOCKS_SECOND, "events") + " WHERE event_type = 'signup'",
    "innodb_lock_waits": _select(I.INNODB_LOCK_WAITS, "events") + f" WHERE {I.LOCK_WAIT_ROWS}",
    "query_log": _select(I.QUERY_LOG, "orders"),
    "slow_log_text": "SELECT 'slow_' || CAST(host_id AS STRING) AS log_file, query_id * 10 + n AS line_no, line FROM ("
    + _numbered_lines(I.SLOW_LOG_LINES, "host_id, query_id", "query_log", "n") + ") x",
    "innodb_status_text": _select(["host_id", "poll_id", "ts", I.STATUS_TEXT], "counter_samples"),
    "backup_log_lines": _select(
        I.BACKUP_LINE,
        "(SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY d) AS line_no FROM ("
        "SELECT *, CAST(day(d) AS BIGINT) AS n FROM (SELECT DISTINCT user_id % 10 AS host_id, CAST(ts AS DATE) AS d FROM events) y) z"
        " WHERE (n + host_id) % 9 <> 4) x"),
    "charts": _select(I.CHARTS, "customer"),
    "chart_lines": _select(I.CHART_LINES, "orders"),
    "slave_status": _select(I.SLAVE_STATUS, "counter_samples"),
    "stopped_replicas": _select(I.STOPPED_REPLICAS, "slave_status") + " WHERE slave_sql_running = 'No'",
    "master_positions": _select(I.MASTER_POSITIONS, "counter_samples"),
    "master_logs": "SELECT log_pos % 10 AS host_id, log_file AS log_name, CAST(count(*) * 1048576 AS BIGINT) AS file_size"
    " FROM binlog_events GROUP BY log_pos % 10, log_file",
    "catalog_tables": _select(I.CATALOG_TABLES, "part"),
    "catalog_statistics": _select(I.STATISTICS, f"part CROSS JOIN (VALUES {_values(I.STATISTICS_ROWS)})"
                                  " AS v(index_name, non_unique, seq_in_index, column_name, index_type)")
    + f" WHERE {I.STATISTICS_FILTER}",
    "catalog_columns": _select(I.CATALOG_COLUMNS, f"part CROSS JOIN (VALUES {_values(I.COLUMN_ROWS)})"
                               " AS v(column_name, ordinal_position, column_type, column_key)") + f" WHERE {I.COLUMNS_FILTER}",
    "os_text": _select(I.OS_TEXT, f"events CROSS JOIN (VALUES {_values(I.OS_LINES)}) AS v(kind, line_no, tpl)"),
    "binlog_text": "SELECT * FROM (" + _numbered_lines(I.BINLOG_TEXT_LINES, "master_host_id, log_file, log_pos", "binlog_events", "line_no")
    + ") x WHERE line IS NOT NULL",
}


def _used(text: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", text)}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the inputs it reads, each before its first use.

    ``extra`` holds further named steps of the query itself, in order.
    """
    extra = extra or {}
    needed: set[str] = set()
    todo = _used(" ".join([sql, *extra.values()]))
    while todo:
        needed |= todo
        todo = set().union(*[_used(VIEWS[n]) - {n} for n in todo]) - needed
    steps = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(steps)} {sql}" if steps else sql

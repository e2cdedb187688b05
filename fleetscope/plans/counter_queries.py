"""Registered queries over counters and key-value polls."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.constants import CHARTS, STATUS_LEVELS, STATUS_NAMES, VARIABLE_NAMES
from fleetscope.operators import counters as C
from fleetscope.plans.inputs import STATUS_VALUES, VARIABLE_VALUES
from fleetscope.plans.registry import Entry
from fleetscope.plans.text_queries import ENTRIES as TEXT_ENTRIES
from fleetscope.plans.views import with_views
from fleetscope.sources import os_text
from fleetscope.sources.status import status_pivot, variables_latest

DELTAS = ["questions", "com_select", "com_insert", "com_update", "com_delete", "com_commit", "com_rollback",
          "bytes_sent", "bytes_received", "connections", "threads_created", "created_tmp_tables",
          "created_tmp_disk_tables", "binlog_cache_use", "binlog_cache_disk_use",
          "buffer_pool_read_requests", "buffer_pool_reads"]
RATES = ["questions", "bytes_sent", "bytes_received"]
BY_HOST = "OVER (PARTITION BY host_id ORDER BY ts, poll_id)"
DELTA_SQL = ", ".join(f"CAST({c} - lag({c}) {BY_HOST} AS BIGINT) AS d_{c}" for c in DELTAS)

NUMBER = "TRY_CAST(CASE value WHEN 'ON' THEN '1' WHEN 'OFF' THEN '0' ELSE value END AS BIGINT)"
PIVOT_USED = [n for n in STATUS_VALUES if n in STATUS_NAMES]
PIVOT_SQL = ("SELECT host_id, poll_id, ts, " + ", ".join(
    f"max(CASE WHEN variable_name = '{n}' THEN {NUMBER} END) AS {n}" for n in PIVOT_USED)
    + " FROM status_kv GROUP BY host_id, poll_id, ts")
ALL_PIVOT_SQL = ("SELECT host_id, poll_id, ts, " + ", ".join(
    f"max(CASE WHEN variable_name = '{n}' THEN {NUMBER} END) AS {n}" for n in STATUS_NAMES)
    + " FROM status_kv GROUP BY host_id, poll_id, ts")


def _pct(part: str, whole: str) -> str:
    return (f"(CASE WHEN {whole} = 0 THEN NULL ELSE floor(CAST({part} AS DOUBLE) * 10000 / CAST({whole} AS DOUBLE) + 0.5) / 100 END)")


def _status(i, *prefixes: str):
    """Only the names a query reads are pivoted."""
    return status_pivot(i.status_kv, [n for n in PIVOT_USED if n.startswith(prefixes)])


def _lag(column: str) -> str:
    return f"({column} - lag({column}) {BY_HOST})"


METRICS_SQL = f"""SELECT host_id, poll_id, ts, {_lag('questions')} AS qps,
 {_lag('com_insert')} + {_lag('com_update')} + {_lag('com_delete')} AS tps,
 {_lag('com_insert')} AS insert_count, {_lag('com_update')} AS update_count, {_lag('com_delete')} AS delete_count,
 threads_connected, threads_running, {_lag('created_tmp_tables')} AS tmp_tables,
 {_lag('created_tmp_disk_tables')} AS tmp_disk_tables, {_lag('com_commit')} + {_lag('com_rollback')} AS trx_count,
 {_lag('com_commit')} AS commit, {_lag('com_rollback')} AS rollback, {_lag('connections')} AS connections,
 {_lag('bytes_sent')} AS send_bytes, {_lag('bytes_received')} AS receive_bytes
 FROM counter_samples"""


def _spin(kind: str, prefix: str) -> str:
    waits, rounds = _lag(f"{prefix}_os_waits"), _lag(f"{prefix}_spin_rounds")
    return f"CASE WHEN {rounds} = 0 THEN 0 ELSE floor(CAST({waits} AS DOUBLE) * 10000 / CAST({rounds} AS DOUBLE) + 0.5) / 100 END AS {kind}_ratio"


def _running_sql() -> str:
    frame = "OVER (PARTITION BY host_id ORDER BY ts, poll_id ROWS UNBOUNDED PRECEDING)"
    cols = []
    for m in C.STATISTICS_METRICS:
        cols += [f"CAST({fn}({m}) {frame} AS BIGINT) AS {m}_{fn}" for fn in ("min", "max", "sum", "count")]
        cols.append(f"CASE WHEN count({m}) {frame} > 0 THEN CAST(sum({m}) {frame} AS DOUBLE) / count({m}) {frame} END AS {m}_avg")
    return with_views(f"SELECT host_id, poll_id, {', '.join(cols)} FROM m", {"m": METRICS_SQL})


# Chart metrics by the frame that has them; the status metrics come first.
CHART_FRAMES = {
    "os_loadavg": ["cpu_1", "cpu_5", "cpu_15"], "os_io": ["io_qps", "io_tps", "io_read", "io_write", "io_util"],
    "os_cpu_process": ["cpu_user", "cpu_system", "cpu_idle", "mysql_cpu", "mysql_memory"],
}


def _charts(i):
    frames = [C.interval_metrics(i.counter_samples), os_text.os_metrics(i.os_text), i.slave_status]
    parts = [C.chart_select(f).drop("ts") for f in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _chart_sql() -> str:
    source = {"seconds_behind_master": "slave_status"}
    source.update({m: f"({TEXT_ENTRIES[name].sql})" for name, metrics in CHART_FRAMES.items() for m in metrics})
    parts = [f"SELECT host_id, poll_id, '{chart}' AS chart, '{line}' AS line, CAST({metric} AS DOUBLE) AS value FROM {source.get(metric, 'm')} c"
             for chart, lines in CHARTS.items() for line, metric in lines]
    return with_views(" UNION ALL ".join(parts), {"m": METRICS_SQL})


SEMI = "Rpl_semi_sync_master_"
NOW = "2024-01-31 00:00:00"

ENTRIES = {
    "counter_deltas": Entry(
        lambda i: C.counter_deltas(i.counter_samples, DELTAS).select("host_id", "poll_id", *[f"d_{c}" for c in DELTAS]),
        with_views(f"SELECT host_id, poll_id, {DELTA_SQL} FROM counter_samples")),
    "status_changes": Entry(
        lambda i: C.status_changes(i.status_polls),
        with_views("SELECT host_id, poll_id, ts, " + ", ".join(
            n if n in STATUS_LEVELS else f"CAST({_lag(n)} AS BIGINT) AS {n}" for n in STATUS_NAMES) + " FROM status_polls")),
    "counter_rates": Entry(
        lambda i: C.counter_rates(i.counter_samples.select("host_id", "poll_id", "ts", *RATES), RATES).select(
            "host_id", "poll_id", "elapsed_us", *[f"{c}_{s}" for c in RATES for s in ("rate", "reset")]),
        with_views(
            "SELECT host_id, poll_id, us AS elapsed_us, " + ", ".join(
                f"CASE WHEN p_{c} IS NULL OR us = 0 THEN NULL ELSE CAST((CASE WHEN {c} < p_{c} THEN {c} ELSE {c} - p_{c} END) * 1000000 AS DOUBLE) / us END AS {c}_rate,"
                f" CASE WHEN {c} < p_{c} THEN 1 ELSE 0 END AS {c}_reset" for c in RATES) + " FROM x",
            {"x": "SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) AS us, "
                  + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in RATES)
                  + " FROM counter_samples WINDOW w AS (PARTITION BY host_id ORDER BY ts, poll_id)"})),
    "qps_tps": Entry(
        lambda i: C.qps_tps(i.counter_samples),
        with_views(f"SELECT host_id, poll_id, ts, {_lag('questions')} AS qps, {_lag('com_insert')} + {_lag('com_update')}"
                   f" + {_lag('com_delete')} AS tps, {_lag('com_commit')} + {_lag('com_rollback')} AS tps_commit FROM counter_samples")),
    "hit_ratios": Entry(
        lambda i: C.hit_ratios(i.counter_samples, i.host_infos),
        with_views(
            "SELECT s.host_id, poll_id, ts,"
            f" coalesce({_pct('(connections - threads_created)', 'connections')}, 0) AS thread_cache_hit,"
            f" coalesce({_pct('(binlog_cache_use - binlog_cache_disk_use)', 'binlog_cache_use')}, 0) AS binlog_cache_hit,"
            f" coalesce({_pct('buffer_pool_read_requests', '(buffer_pool_read_requests + buffer_pool_reads)')}, 0) AS buffer_pool_hit,"
            " threads_connected * 100 // h.max_connections AS connections_usage_rate,"
            f" coalesce({_pct('created_tmp_disk_tables', 'created_tmp_tables')}, 0) AS tmp_disk_share"
            " FROM counter_samples s LEFT JOIN host_infos h ON s.host_id = h.host_id")),
    "status_pivot": Entry(lambda i: status_pivot(i.status_kv, STATUS_NAMES), with_views(ALL_PIVOT_SQL)),
    "variables_latest": Entry(
        lambda i: variables_latest(i.variables_kv, VARIABLE_NAMES),
        with_views("SELECT host_id, " + ", ".join(
            f"max(CASE WHEN variable_name = '{n}' THEN value END) AS {n}" for n in VARIABLE_NAMES)
            + " FROM (SELECT *, row_number() OVER (PARTITION BY host_id, variable_name ORDER BY ts DESC, poll_id DESC) AS rn"
              " FROM variables_kv) x WHERE rn = 1 GROUP BY host_id")),
    "page_usage": Entry(
        lambda i: C.page_usage(_status(i, "Innodb_buffer_pool_pages_")),
        with_views(
            f"SELECT host_id, poll_id, {_pct('Innodb_buffer_pool_pages_dirty', 'Innodb_buffer_pool_pages_total')} AS dirty_page_usage,"
            f" {_pct('(Innodb_buffer_pool_pages_total - Innodb_buffer_pool_pages_free)', 'Innodb_buffer_pool_pages_total')} AS page_usage,"
            f" {_pct('Innodb_buffer_pool_pages_data', 'Innodb_buffer_pool_pages_total')} AS data_page_usage FROM st", {"st": PIVOT_SQL})),
    "spin_ratios": Entry(
        lambda i: C.spin_ratios(_status(i, "Innodb_mutex_", "Innodb_s_lock_", "Innodb_x_lock_")),
        with_views(f"SELECT host_id, poll_id, {_spin('mutex', 'Innodb_mutex')}, {_spin('s', 'Innodb_s_lock')},"
                   f" {_spin('x', 'Innodb_x_lock')} FROM st", {"st": PIVOT_SQL})),
    "write_amplification": Entry(
        lambda i: C.write_amplification(_status(i, "Innodb_dblwr_", "Innodb_page_size", "Uptime")),
        with_views("SELECT host_id, poll_id, CASE WHEN Innodb_dblwr_writes = 0 THEN 0 ELSE"
                   " floor(CAST(Innodb_dblwr_pages_written AS DOUBLE) * 100 / CAST(Innodb_dblwr_writes AS DOUBLE) + 0.5) / 100 END AS pages_per_dblwr,"
                   f" {_lag('Innodb_dblwr_writes')} AS dblwr_writes, {_lag('Innodb_dblwr_pages_written')} AS dblwr_pages_written,"
                   " Innodb_page_size // 1024 AS page_size_kb, greatest(Uptime // 86400, 1) AS uptime_days FROM st", {"st": PIVOT_SQL})),
    "semi_sync": Entry(
        lambda i: C.semi_sync(_status(i, "Rpl_semi_sync_", "Uptime")),
        with_views(f"SELECT host_id, poll_id, CASE WHEN {SEMI}status IS NULL THEN 0 ELSE 1 END AS rpl_semi_sync,"
                   f" CASE {SEMI}status WHEN 1 THEN 'ON' WHEN 0 THEN 'OFF' END AS master_status,"
                   " CASE Rpl_semi_sync_slave_status WHEN 1 THEN 'ON' WHEN 0 THEN 'OFF' END AS slave_status, "
                   + ", ".join(f"coalesce({SEMI}{n}, 0) AS {n}" for n in ("clients", "net_waits", "net_avg_wait_time", "tx_waits", "tx_avg_wait_time", "no_tx", "yes_tx", "no_times", "wait_sessions")) + ", "
                   + ", ".join(f"{_lag(SEMI + n)} AS {n}" for n in ("net_wait_time", "tx_wait_time")) + " FROM st", {"st": PIVOT_SQL})),
    "latest_state": Entry(
        lambda i: C.latest_state(i.counter_samples),
        with_views("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts DESC, poll_id DESC) AS rn"
                   " FROM counter_samples) x WHERE rn = 1")),
    "chart_window": Entry(
        lambda i: C.chart_window(i.counter_samples.select("host_id", "poll_id", "ts", "questions", "threads_running")),
        with_views("SELECT host_id, poll_id, ts, questions, threads_running FROM (SELECT *, row_number() OVER"
                   " (PARTITION BY host_id ORDER BY ts DESC, poll_id DESC) AS rn FROM counter_samples) x WHERE rn <= 200")),
    "running_stats": Entry(lambda i: C.running_stats(C.interval_metrics(i.counter_samples)), _running_sql()),
    "chart_select": Entry(_charts, _chart_sql()),
    "alert_flags": Entry(
        lambda i: C.alert_flags(i.counter_samples, i.slave_status, i.host_infos,
                                F.lit(NOW).cast("timestamp_ntz"), down_seconds=3600),
        with_views(
            "SELECT host_id, ts, 'threads' AS rule, CAST(threads_connected AS STRING) AS value FROM counter_samples WHERE threads_connected > 1000"
            " UNION ALL SELECT host_id, ts, 'threads_running', CAST(threads_running AS STRING) FROM counter_samples WHERE threads_running > 5"
            " UNION ALL SELECT host_id, ts, 'io_state', slave_io_running FROM slave_status WHERE slave_io_running <> 'Yes'"
            " UNION ALL SELECT host_id, ts, 'sql_state', slave_sql_running FROM slave_status WHERE slave_sql_running <> 'Yes'"
            " UNION ALL SELECT h.host_id, s.ts, 'host_down', 'No' FROM host_infos h LEFT JOIN (SELECT host_id, max(ts) AS ts FROM counter_samples GROUP BY host_id) s"
            f" ON h.host_id = s.host_id WHERE h.is_deleted = 0 AND (s.ts IS NULL OR s.ts < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)")),
}

"""Registered queries over replication, locks and backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import backups as B
from fleetscope.operators import replication as R
from fleetscope.operators.counters import latest_state
from fleetscope.plans.registry import Entry
from fleetscope.plans.text_queries import BACKUP_PARSED
from fleetscope.plans.views import with_views
from fleetscope.sources.logs import backup_log_parse

TOPOLOGY = {"topo": "SELECT h.host_id, h.remark, m.master_host_id,"
            " CASE WHEN l.known > 0 OR (l.known IS NULL AND r.host_id IS NULL) THEN 'M' ELSE '' END ||"
            " CASE WHEN m.master_host_id IS NOT NULL OR l.known = 0 OR (l.known IS NULL AND r.host_id IS NOT NULL) THEN 'S' ELSE '' END AS role"
            " FROM host_infos h LEFT JOIN (SELECT host_id, count(slave_uuid) AS known FROM slave_hosts GROUP BY host_id) l ON h.host_id = l.host_id"
            " LEFT JOIN (SELECT slave_uuid, max(host_id) AS master_host_id FROM slave_hosts WHERE slave_uuid IS NOT NULL GROUP BY slave_uuid) m ON h.server_uuid = m.slave_uuid"
            " LEFT JOIN (SELECT DISTINCT host_id FROM slave_status) r ON h.host_id = r.host_id"}
LATEST = {"latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts DESC, poll_id DESC) AS rn FROM slave_status) x WHERE rn = 1"}
LOG = {"log": BACKUP_PARSED}
CHAIN = {
    **LOG,
    "starts": "SELECT host_id, max(line_no) AS full_line FROM log WHERE mode = '1' AND is_ok = 1 GROUP BY host_id",
    "after": "SELECT l.*, sum(CASE WHEN coalesce(is_ok, 0) <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.host_id ORDER BY line_no) AS bad"
             " FROM log l JOIN starts s ON l.host_id = s.host_id WHERE l.line_no >= s.full_line",
    "chain": "SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY line_no) AS apply_order, row_number() OVER (PARTITION BY host_id ORDER BY line_no DESC) AS back"
             " FROM after WHERE bad = 0",
}
SECONDS = r"(epoch(strptime(stop_time, '%Y-%m-%d_%H-%M-%S')) - epoch(strptime(start_time, '%Y-%m-%d_%H-%M-%S')))"


def _log(i):
    return backup_log_parse(i.backup_log_lines)


def _expected(i):
    return R.topology(i.host_infos, i.slave_hosts, i.slave_status).select("host_id", F.col("master_host_id").alias("expected_master"))


LOCK_FIELDS = ("mode", "type", "table", "index")
# A transaction with each lock it holds or asks for; the two ends of a wait are two readings of it.
HOLDINGS = {"holding": "SELECT t.*, k.* EXCLUDE (host_id) FROM innodb_trx t JOIN innodb_locks k ON k.lock_trx_id = t.trx_id AND k.host_id = t.host_id"}


def _end(name: str, alias: str) -> str:
    fields = {"trx_id": "trx_id", "thread": "trx_mysql_thread_id", "state": "trx_state", "query": "trx_query",
              **{f"lock_{f}": f"lock_{f}" for f in LOCK_FIELDS}}
    return ", ".join(f"{alias}.{c} AS {name}_{n}" for n, c in fields.items())


ENTRIES = {
    "topology": Entry(lambda i: R.topology(i.host_infos, i.slave_hosts, i.slave_status), with_views("SELECT * FROM topo", TOPOLOGY)),
    "replication_health": Entry(
        lambda i: R.replication_health(i.slave_status, i.master_positions),
        with_views("SELECT s.host_id, s.poll_id, s.ts, s.master_host_id, slave_io_running, slave_sql_running,"
                   " CASE WHEN master_log_file = relay_master_log_file THEN read_master_log_pos - exec_master_log_pos END AS delay_pos_count,"
                   " coalesce(seconds_behind_master, 0) AS seconds_behind_master, m.log_file AS new_master_log_file, m.log_pos AS new_master_log_pos"
                   " FROM slave_status s ASOF LEFT JOIN master_positions m ON s.master_host_id = m.host_id AND s.ts >= m.ts")),
    "failover_check": Entry(
        lambda i: R.failover_check(latest_state(i.slave_status), _expected(i)),
        with_views("SELECT * FROM (SELECT l.host_id, l.master_host_id, t.master_host_id AS expected_master,"
                   " CASE WHEN l.master_host_id IS DISTINCT FROM t.master_host_id THEN 1 ELSE 0 END AS wrong_source,"
                   " CASE WHEN slave_io_running <> 'Yes' OR slave_sql_running <> 'Yes' THEN 1 ELSE 0 END AS stopped"
                   " FROM latest l LEFT JOIN topo t ON l.host_id = t.host_id) x WHERE wrong_source = 1 OR stopped = 1", {**TOPOLOGY, **LATEST})),
    "gtid_list": Entry(
        lambda i: R.gtid_list(i.slave_status),
        with_views("SELECT host_id, poll_id, gtid, split_part(gtid, ':', 1) AS source, CAST(len(string_split(gtid, ':')) - 1 AS INTEGER) AS ranges,"
                   " CAST(len(string_split(gtid, ':')) - 2 AS INTEGER) AS gaps FROM (SELECT host_id, poll_id,"
                   " unnest(string_split(replace(executed_gtid_set, chr(10), ''), ',')) AS gtid FROM slave_status) x")),
    "binlog_size": Entry(lambda i: R.binlog_size(i.master_logs),
                         with_views("SELECT host_id, CAST(sum(file_size) AS BIGINT) AS binlog_size_total FROM master_logs GROUP BY host_id")),
    "lock_waits": Entry(
        lambda i: R.lock_waits(i.innodb_trx, i.innodb_locks, i.innodb_lock_waits),
        with_views(f"SELECT x.host_id, x.trx_isolation_level, {_end('waiting', 'x')}, {_end('blocking', 'y')} FROM holding x"
                   " JOIN innodb_lock_waits w ON w.requesting_trx_id = x.trx_id AND w.host_id = x.host_id"
                   " JOIN holding y ON y.trx_id = w.blocking_trx_id AND y.host_id = w.host_id", HOLDINGS)),
    "lock_chains": Entry(
        lambda i: R.lock_chains(i.innodb_lock_waits),
        with_views("SELECT c.host_id, c.requesting_trx_id, c.blocking_trx_id, c.root AS root_trx_id, c.depth, 0 AS in_cycle, n.root_waiters FROM ends c"
                   " JOIN (SELECT host_id, root, count(DISTINCT requesting_trx_id) AS root_waiters FROM ends GROUP BY host_id, root) n ON c.root = n.root AND c.host_id = n.host_id",
                   {"walk": "SELECT host_id, requesting_trx_id, blocking_trx_id, blocking_trx_id AS root, CAST(1 AS BIGINT) AS depth FROM innodb_lock_waits"
                            " UNION ALL SELECT k.host_id, k.requesting_trx_id, k.blocking_trx_id, w.blocking_trx_id, k.depth + 1 FROM walk k"
                            " JOIN innodb_lock_waits w ON k.root = w.requesting_trx_id AND k.host_id = w.host_id",
                    "ends": "SELECT * FROM walk WHERE (host_id, root) NOT IN (SELECT (host_id, requesting_trx_id) FROM innodb_lock_waits)"}).replace("WITH ", "WITH RECURSIVE ", 1)),
    "trx_lock_counts": Entry(
        lambda i: R.trx_lock_counts(i.innodb_trx, i.innodb_lock_waits),
        with_views("SELECT host_id, name, CAST(count(*) FILTER (WHERE name = kind) AS BIGINT) AS total FROM (SELECT host_id, 'trx' AS kind FROM innodb_trx"
                   " UNION ALL SELECT host_id, 'lock_waits' FROM innodb_lock_waits) b CROSS JOIN (VALUES ('trx'), ('lock_waits')) n(name) GROUP BY 1, 2")),
    "backup_outcomes": Entry(
        lambda i: B.backup_outcomes(_log(i)),
        with_views("SELECT host_id, mode, count(*) AS backups, CAST(sum(CASE WHEN is_ok <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS failures,"
                   f" CAST(sum({SECONDS}) AS BIGINT) AS seconds, CAST(max({SECONDS}) AS BIGINT) AS longest_seconds FROM log WHERE mode IS NOT NULL GROUP BY host_id, mode", LOG)),
    "restore_chain": Entry(
        lambda i: B.restore_chain(_log(i)),
        with_views("SELECT host_id, apply_order, line_no, mode, backup_dir, CASE WHEN back = 1 AND apply_order > 1 THEN 0 ELSE 1 END AS redo_only FROM chain", CHAIN)),
    "backup_base": Entry(
        lambda i: B.backup_base(_log(i)),
        with_views("SELECT host_id, line_no, backup_dir, CASE WHEN base_dir IS NOT NULL THEN base_line END AS base_line, base_dir,"
                   " CASE WHEN base_dir IS NULL THEN 'full' ELSE 'increment' END AS taken_as FROM (SELECT *, lag(line_no) OVER w AS base_line, lag(backup_dir) OVER w AS base_dir"
                   " FROM log WINDOW w AS (PARTITION BY host_id ORDER BY line_no)) x WHERE mode = '2'", LOG)),
    "backup_policy_audit": Entry(
        lambda i: B.backup_policy_audit(_log(i)),
        with_views("SELECT * FROM (SELECT s.host_id, s.backup_date, CASE WHEN d.host_id IS NULL THEN 'missing' WHEN dayofweek(s.backup_date) = 0 AND d.has_full = 0 THEN 'full expected'"
                   " WHEN dayofweek(s.backup_date) <> 0 AND d.has_increment = 0 THEN 'increment expected' END AS problem FROM spine s"
                   " LEFT JOIN days d ON s.host_id = d.host_id AND s.backup_date = d.backup_date) x WHERE problem IS NOT NULL",
                   {**LOG, "days": "SELECT host_id, backup_date, max(CASE WHEN mode = '1' THEN 1 ELSE 0 END) AS has_full, max(CASE WHEN mode = '2' THEN 1 ELSE 0 END) AS has_increment"
                                   " FROM log WHERE backup_date IS NOT NULL GROUP BY host_id, backup_date",
                    "spine": "SELECT host_id, CAST(unnest(generate_series(min(backup_date), max(backup_date), INTERVAL 1 DAY)) AS DATE) AS backup_date FROM days GROUP BY host_id"})),
    "expired_backups": Entry(
        lambda i: B.expired_backups(_log(i), F.lit("2024-01-31").cast("date")),
        with_views("SELECT host_id, line_no, backup_dir, backup_date, CAST(DATE '2024-01-31' - backup_date AS INTEGER) AS age_days FROM log"
                   " WHERE backup_date IS NOT NULL AND DATE '2024-01-31' - backup_date > 14", LOG)),
}

"""Telemetry inputs derived from the given tables.

The column expressions are written in the SQL dialect Spark and DuckDB share, so the
check queries in ``views.py`` use the same text. Anything that needs an ordered pass
(cumulative counters, change images) is built with the operators in
``operators.ordered`` here and with plain windows there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.constants import STATUS_LEVELS, STATUS_NAMES
from fleetscope.operators.ordered import numbered, previous, running

HOST_INFOS = [
    "s_suppkey AS host_id", "s_name AS remark",
    "'uuid-' || CAST(s_suppkey AS STRING) AS server_uuid",
    "CASE WHEN s_suppkey % 7 = 3 THEN 1 ELSE 0 END AS is_deleted",
    "CASE WHEN s_suppkey % 4 = 0 THEN 'Percona Server (GPL)' WHEN s_suppkey % 4 = 1 THEN 'mariadb.org binary'"
    " WHEN s_suppkey % 4 = 2 THEN 'MySQL Community Server' ELSE 'None' END AS version_comment",
    "CAST(151 + s_suppkey % 5 AS BIGINT) AS max_connections",
    "CAST(s_suppkey % 4 * 2000 AS BIGINT) AS innodb_log_buffer_size",
    "CAST(s_suppkey % 6 * 3000 AS BIGINT) AS innodb_log_file_size",
]

SLAVE_HOSTS = [
    "CAST(floor(s_suppkey / 4) AS BIGINT) AS host_id",
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'uuid-' || CAST(s_suppkey AS STRING) END AS slave_uuid",
]

# Change of every cumulative counter at one poll; the counters are the running sums.
COUNTER_STEPS = {
    "questions": "1",
    "com_select": "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END",
    "com_insert": "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END",
    "com_update": "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END",
    "com_delete": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "com_commit": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
    "com_rollback": "CASE WHEN event_type = 'error' AND value < 10 THEN 1 ELSE 0 END",
    "bytes_total": "CAST(round(value * 100) AS BIGINT)",
    "bytes_received": "50 + event_id % 1000",
    "connections": "1 + event_id % 3",
    "threads_created": "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END",
    "created_tmp_tables": "event_id % 4",
    "created_tmp_disk_tables": "CASE WHEN event_id % 5 = 3 THEN 1 ELSE 0 END",
}

# bytes_sent wraps on purpose: it is the counter-reset case.
COUNTERS_DERIVED = [
    "bytes_total % 100000 AS bytes_sent",
    "com_insert + com_update + com_delete AS binlog_cache_use", "com_delete AS binlog_cache_disk_use",
    "questions * 100 AS buffer_pool_read_requests", "com_select AS buffer_pool_reads",
    "CAST(1 + poll_id % 1100 AS BIGINT) AS threads_connected", "CAST(poll_id % 9 AS BIGINT) AS threads_running",
]

STATUS_VALUES = {
    "Questions": "questions", "Com_insert": "com_insert", "Com_update": "com_update", "Com_delete": "com_delete",
    "Com_commit": "com_commit", "Com_rollback": "com_rollback",
    "Threads_connected": "threads_connected", "Threads_running": "threads_running",
    "Uptime": "80000 + poll_id * 10", "Ssl_accepts": "1",
    "Innodb_page_size": "16384", "Innodb_dblwr_writes": "com_insert",
    "Innodb_dblwr_pages_written": "com_insert * 7 + com_update",
    "Innodb_buffer_pool_pages_total": "8192", "Innodb_buffer_pool_pages_data": "4000 + poll_id % 3000",
    "Innodb_buffer_pool_pages_dirty": "poll_id % 300", "Innodb_buffer_pool_pages_free": "poll_id % 900",
    "Innodb_mutex_os_waits": "questions * 2", "Innodb_mutex_spin_rounds": "questions * 30",
    "Innodb_s_lock_os_waits": "com_select", "Innodb_s_lock_spin_rounds": "com_select * 20",
    "Innodb_x_lock_os_waits": "com_update", "Innodb_x_lock_spin_rounds": "com_insert * 10",
    "Rpl_semi_sync_master_status": "CASE WHEN host_id % 2 = 0 THEN CASE WHEN poll_id % 5 = 0 THEN 'OFF' ELSE 'ON' END END",
    "Rpl_semi_sync_slave_status": "CASE WHEN host_id % 2 = 0 THEN CASE WHEN poll_id % 7 = 0 THEN 'ON' ELSE 'OFF' END END",
    "Rpl_semi_sync_master_clients": "CASE WHEN host_id % 2 = 0 THEN 2 END",
    "Rpl_semi_sync_master_net_waits": "CASE WHEN host_id % 2 = 0 THEN com_commit END",
    "Rpl_semi_sync_master_net_wait_time": "CASE WHEN host_id % 2 = 0 THEN com_commit * 13 END",
    "Rpl_semi_sync_master_tx_waits": "CASE WHEN host_id % 2 = 0 THEN com_insert END",
    "Rpl_semi_sync_master_tx_wait_time": "CASE WHEN host_id % 2 = 0 THEN com_insert * 17 END",
    "Rpl_semi_sync_master_net_avg_wait_time": "CASE WHEN host_id % 2 = 0 THEN 13 END",
    "Rpl_semi_sync_master_tx_avg_wait_time": "CASE WHEN host_id % 2 = 0 THEN 17 END",
    "Rpl_semi_sync_master_no_times": "CASE WHEN host_id % 2 = 0 THEN com_rollback END",
    "Rpl_semi_sync_master_wait_sessions": "CASE WHEN host_id % 2 = 0 THEN threads_running END",
    "Rpl_semi_sync_master_no_tx": "CASE WHEN host_id % 2 = 0 THEN com_delete END",
    "Rpl_semi_sync_master_yes_tx": "CASE WHEN host_id % 2 = 0 THEN com_update END",
}

# Wide polls with every status name: those above, and by a rule for the others sums of counters, or levels that come and go.
STATUS_FLAGS = ["Rpl_semi_sync_master_status", "Rpl_semi_sync_slave_status"]
STATUS_POLLS = [
    "host_id", "poll_id", "ts",
    *[f"CAST({(None if n in STATUS_FLAGS else STATUS_VALUES.get(n)) or (f'poll_id % {50 + k}' if n in STATUS_LEVELS else f'questions * {1 + k % 17} + com_insert * {k % 5} + {k}')} AS BIGINT) AS {n}"
      for k, n in enumerate(STATUS_NAMES)],
]

VARIABLE_VALUES = {
    "version": "'8.0.' || CAST(poll_id % 5 AS STRING)",
    "version_comment": "CASE WHEN host_id % 2 = 0 THEN 'Percona Server' ELSE 'MariaDB Server' END",
    "max_connections": "CAST(151 + poll_id % 7 AS STRING)",
    "innodb_log_file_size": "CAST(50331648 + poll_id % 3 AS STRING)",
    "innodb_log_buffer_size": "CASE WHEN poll_id % 3 = 0 THEN '16777216' ELSE '16M' END",
    "read_only": "CASE WHEN poll_id % 2 = 0 THEN 'ON' ELSE 'OFF' END",
    "server_uuid": "'uuid-' || CAST(host_id AS STRING)",
    "time_zone": "'SYSTEM'",
}

PROCESSLIST = [
    "event_id AS id", "'u' || CAST(user_id % 12 AS STRING) AS user_name", "user_id % 10 AS host_id",
    "'db' || CAST(event_id % 3 AS STRING) AS db",
    "CASE WHEN event_type = 'view' THEN 'Sleep' ELSE 'Query' END AS command",
    "CAST(floor(value / 10) AS BIGINT) AS time_s", "CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS state",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS info", "ts",
]

SLOW_HISTORY = [
    "l_partkey AS checksum", "l_suppkey % 10 AS serverid_max", "'db' || CAST(l_suppkey % 3 AS STRING) AS db_max",
    "'u' || CAST(l_linenumber AS STRING) AS user_max", "l_shipdate AS ts_min", "l_shipdate AS ts_max",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS ts_cnt",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS query_time_sum",
    "CAST(floor(l_extendedprice / 100) AS DECIMAL(18,2)) AS query_time_max",
    "CAST(l_discount AS DECIMAL(18,2)) AS query_time_min",
    "CAST(floor(l_extendedprice / 200) AS DECIMAL(18,2)) AS query_time_pct_95",
    "CAST(l_tax AS DECIMAL(18,2)) AS lock_time_sum", "CAST(l_tax AS DECIMAL(18,2)) AS lock_time_max",
    "CAST(l_discount AS DECIMAL(18,2)) AS lock_time_min", "CAST(l_tax AS DECIMAL(18,2)) AS lock_time_pct_95",
    "CAST(l_quantity AS BIGINT) AS rows_sent_sum", "CAST(l_quantity AS BIGINT) AS rows_sent_max",
    "CAST(l_linenumber AS BIGINT) AS rows_sent_min", "CAST(l_quantity AS BIGINT) AS rows_sent_pct_95",
    "CAST(l_quantity * 10 AS BIGINT) AS rows_examined_sum", "CAST(l_quantity * 5 AS BIGINT) AS rows_examined_max",
    "CAST(l_linenumber * 2 AS BIGINT) AS rows_examined_min", "CAST(l_quantity * 4 AS BIGINT) AS rows_examined_pct_95",
    "'select ' || l_returnflag || l_linestatus || ' from t' || CAST(l_partkey AS STRING) AS sample",
]

REVIEW_UPDATES = [
    "o_orderkey AS update_id", "o_orderkey % 2000 AS checksum", "o_orderdate AS reviewed_on",
    "o_custkey AS reviewed_id", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS comments",
]

TABLE_SIZE_KEYS = [
    "user_id % 10 AS host_id", "'db' || CAST(event_id % 2 AS STRING) AS db_name",
    "'t' || CAST(event_id % 5 AS STRING) AS table_name", "CAST(ts AS DATE) AS snap_date",
]
TABLE_SIZE_SUMS = {
    "table_rows": "count(*)", "data_length": "sum(CAST(round(value * 100) AS BIGINT))",
    "index_length": "sum(event_id % 50)", "auto_increment": "max(event_id)",
}

FILE_SIZES = [
    "host_id", "snap_date",
    "CAST(data_length + index_length + 4096 AS STRING) || chr(9) || '/data/' || db_name || '/' || table_name || '.ibd' AS line",
]

# Two masters that share file, schema and table names. Twelve digits hold any file number.
BINLOG_BASE = [
    "CAST(o_orderkey % 2 AS BIGINT) AS master_host_id",
    "'bin.' || lpad(CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING), 12, '0') AS log_file",
    "o_orderkey AS log_pos", "o_orderdate AS ts", "'db' || CAST(o_custkey % 3 AS STRING) AS schema_name",
    "'accounts' AS table_name", "o_custkey AS pk", "CAST(round(o_totalprice * 100) AS BIGINT) AS amt",
    "o_orderpriority AS note",
]
BINLOG_IMAGES = [
    "master_host_id", "log_file", "log_pos", "ts", "schema_name", "table_name", "pk",
    "CASE WHEN rn % 4 = 1 THEN 'insert' WHEN rn % 4 = 0 THEN 'delete' ELSE 'update' END AS op",
    "CASE WHEN rn % 4 = 1 THEN NULL ELSE prev_amt END AS before_amt",
    "CASE WHEN rn % 4 = 0 THEN NULL ELSE amt END AS after_amt",
    "CASE WHEN rn % 4 = 1 THEN NULL ELSE prev_note END AS before_note",
    "CASE WHEN rn % 4 = 0 THEN NULL WHEN note = '5-LOW' THEN NULL ELSE note END AS after_note",
]

# Two servers with the same transaction numbers.
TRX = "CAST(floor(event_id / 2) AS BIGINT)"
INNODB_TRX = [
    "event_id % 2 AS host_id", f"{TRX} AS trx_id", "CASE WHEN event_type = 'error' THEN 'LOCK WAIT' ELSE 'RUNNING' END AS trx_state",
    "'REPEATABLE READ' AS trx_isolation_level", "user_id AS trx_mysql_thread_id", "props AS trx_query",
]
INNODB_LOCKS = [
    "event_id % 2 AS host_id", f"{TRX} AS lock_trx_id", "'X' AS lock_mode", "'RECORD' AS lock_type",
    "'t' || CAST(event_id % 5 AS STRING) AS lock_table", "'PRIMARY' AS lock_index",
]
INNODB_LOCKS_SECOND = [
    "event_id % 2 AS host_id", f"{TRX} AS lock_trx_id", "'S' AS lock_mode", "'RECORD' AS lock_type",
    "'t' || CAST(event_id % 5 AS STRING) AS lock_table", "'idx_a' AS lock_index",
]
INNODB_LOCK_WAITS = ["event_id % 2 AS host_id", f"{TRX} AS requesting_trx_id", f"{TRX} - 1 - event_id % 3 AS blocking_trx_id"]
# Only some transactions wait: the fixture is a wait graph, not all pairs of neighbours.
LOCK_WAIT_ROWS = "event_type = 'error' AND event_id > 7"

QUERY_LOG = [
    "o_orderkey AS query_id", "o_custkey % 10 AS host_id", "'db' || CAST(o_custkey % 3 AS STRING) AS default_db",
    "CASE o_orderkey % 4"
    " WHEN 0 THEN 'SELECT * FROM `shop`.`orders` o JOIN customers c ON o.cid = c.id WHERE o.id = ' || CAST(o_orderkey AS STRING)"
    " WHEN 1 THEN 'update t' || CAST(o_custkey % 50 AS STRING) || ' set amt = ' || CAST(o_custkey AS STRING) || ' where id in (1, 2, ' || CAST(o_orderkey AS STRING) || ')'"
    " WHEN 2 THEN 'insert into audit.log (id, msg) values (' || CAST(o_orderkey AS STRING) || ', ''' || o_orderpriority || ''')'"
    " ELSE 'select 1 from dual' END AS sql_text",
    "o_orderdate AS ts", "CAST(o_totalprice AS DECIMAL(18,2)) AS query_time",
    "CAST(o_orderkey % 9 AS BIGINT) AS lock_time", "CAST(o_orderkey % 50 AS BIGINT) AS rows_sent",
    "CAST(o_orderkey % 5000 AS BIGINT) AS rows_examined", "'u' || CAST(o_custkey % 10 AS STRING) AS user_name",
]

SLOW_LOG_LINES = {
    1: "'# User@Host: ' || CASE WHEN host_id = 9 THEN 'serverdev' ELSE 'u' END || CAST(host_id AS STRING) || '[u] @ app [10.0.0.1]'",
    2: "'# Query_time: ' || CAST(query_time AS STRING) || '  Lock_time: 0.' || CAST(lock_time AS STRING) || '  Rows_sent: '"
       " || CAST(rows_sent AS STRING) || '  Rows_examined: ' || CAST(rows_examined AS STRING)",
    3: "'use ' || default_db || ';'",
    4: "'SET timestamp=' || CAST(1700000000 + query_id AS STRING) || ';'",
    5: "sql_text || ';'",
}

STATUS_TEXT = (
    "replace('header|SEMAPHORES|----------|OS WAIT ARRAY INFO: reservation count 5|OS WAIT ARRAY INFO: signal count 6|'"
    " || 'Mutex spin waits ' || CAST(questions * 5 AS STRING) || ', rounds ' || CAST(questions * 30 AS STRING) || ', OS waits ' || CAST(questions * 2 AS STRING) || '|'"
    " || 'RW-shared spins ' || CAST(questions * 3 AS STRING) || ', rounds ' || CAST(questions * 20 AS STRING) || ', OS waits ' || CAST(questions AS STRING) || '|'"
    " || 'RW-excl spins ' || CAST(com_insert AS STRING) || ', rounds ' || CAST(com_insert * 10 AS STRING) || ', OS waits ' || CAST(com_update AS STRING) || '|'"
    " || 'LATEST DETECTED DEADLOCK|------------------------|'"
    " || CASE WHEN poll_id % 10 < 3 THEN '*** (1) TRANSACTION:|TRANSACTION ' || CAST(poll_id - poll_id % 100 AS STRING)"
    " || '|*** (2) TRANSACTION:|TRANSACTION 7|*** WE ROLL BACK TRANSACTION (1)|' ELSE '' END"
    " || 'TRANSACTIONS|------------|Trx id counter ' || CAST(1000 + questions AS STRING) || '|History list length ' || CAST(threads_running * 7 AS STRING) || '|'"
    " || CASE WHEN poll_id % 7 = 0 THEN 'LOG|---|stale|' ELSE '' END"
    " || 'INSERT BUFFER AND ADAPTIVE HASH INDEX|-------------------------------------|'"
    " || 'Ibuf: size 1, free list len ' || CAST(poll_id % 50 AS STRING) || ', seg size 52, ' || CAST(com_delete * 4 AS STRING) || ' merges|merged operations:|'"
    " || ' insert ' || CAST(com_insert * 3 AS STRING) || ', delete mark ' || CAST(com_update AS STRING) || ', delete ' || CAST(com_delete AS STRING) || '||'"
    " || CAST(poll_id % 40 AS STRING) || '.00 hash searches/s, ' || CAST(poll_id % 8 AS STRING) || '.00 non-hash searches/s|---|'"
    " || 'LOG|---|Log sequence number ' || CAST(500000 + questions * 10 AS STRING) || '|Log flushed up to   ' || CAST(500000 + questions * 9 AS STRING)"
    " || '|Pages flushed up to ' || CAST(500000 + questions * 8 AS STRING) || '|Last checkpoint at  ' || CAST(500000 + questions * 7 AS STRING) || '|'"
    " || 'INDIVIDUAL BUFFER POOL INFO|----------------------|---BUFFER POOL 0|Buffer pool size   8192|Free buffers       ' || CAST(poll_id % 900 AS STRING)"
    " || '|Database pages     7000|Old database pages 2500|Modified db pages  ' || CAST(poll_id % 300 AS STRING) || '|Pending reads 3|Buffer pool hit rate 99' || CAST(poll_id % 10 AS STRING)"
    " || ' / 1000, young-making rate 0 / 1000|---BUFFER POOL 1|Buffer pool size   4096|Free buffers       ' || CAST(poll_id % 400 AS STRING)"
    " || '|Database pages     3000|Old database pages 1100|Modified db pages  9|Pending reads 0|END OF INNODB MONITOR OUTPUT', '|', chr(10)) AS status"
)

BACKUP_LINE = [
    "host_id", "d AS backup_date", "line_no",
    "CASE WHEN n % 7 = 0 THEN '1' ELSE '2' END || ':/backup/' || CAST(d AS STRING) || ':'"
    " || CASE WHEN n % 5 = 1 THEN 'data_' || CAST(d AS STRING) || '.tar:' ELSE '' END || '/backup/log_' || CAST(d AS STRING) || ':'"
    " || CAST(d AS STRING) || '_03-30-00:' || CAST(d AS STRING) || '_04-' || lpad(CAST(host_id AS STRING), 2, '0') || '-00:'"
    " || CAST(d AS STRING) || ':' || CASE WHEN (n + host_id) % 11 = 5 THEN '0' ELSE '1' END"
    " || CASE WHEN n % 5 = 1 THEN ':1:0' WHEN (n + host_id) % 17 = 3 THEN ':x:y' ELSE ':dir_' || CAST(d AS STRING) END AS line",
]

SLAVE_STATUS = [
    "host_id", "poll_id", "ts", "CASE WHEN poll_id % 13 = 0 THEN 'No' ELSE 'Yes' END AS slave_io_running",
    "CASE WHEN poll_id % 17 = 0 THEN 'No' ELSE 'Yes' END AS slave_sql_running",
    "CASE WHEN poll_id % 34 = 0 THEN 1062 WHEN poll_id % 17 = 0 THEN 1032 ELSE 0 END AS last_sql_errno",
    "'bin.' || CAST(1 + questions % 3 AS STRING) AS master_log_file", "questions * 100 AS read_master_log_pos",
    "'bin.' || CAST(1 + (questions - threads_running % 2) % 3 AS STRING) AS relay_master_log_file",
    "questions * 100 - threads_running * 10 AS exec_master_log_pos",
    "CASE WHEN poll_id % 17 = 0 THEN NULL ELSE threads_running END AS seconds_behind_master",
    "'u1:1-' || CAST(questions AS STRING) || ',' || chr(10) || 'u2:1-9:11-' || CAST(20 + threads_running AS STRING) AS executed_gtid_set",
    "CASE WHEN host_id < 5 THEN NULL ELSE host_id - 5 END AS master_host_id",
]

# Replicas whose SQL thread stopped; the error text ends with the position of the failing event.
STOPPED_REPLICAS = [
    "host_id", "poll_id", "slave_sql_running", "last_sql_errno",
    "CAST(host_id % 2 AS BIGINT) AS master_host_id",
    "'bin.' || lpad(CAST(CAST(floor(poll_id / 1000) AS BIGINT) AS STRING), 12, '0') AS relay_master_log_file",
    "poll_id AS exec_master_log_pos",
    "'Could not execute rows event on table accounts; end_log_pos ' || CAST(poll_id + 1 + poll_id % 3 AS STRING) AS last_sql_error",
]
MASTER_POSITIONS = [
    "host_id", "poll_id", "ts", "'bin.' || CAST(1 + questions % 3 AS STRING) AS log_file", "questions * 100 AS log_pos",
]

# Ten servers whose schemas and tables have the same names.
CATALOG_NUMBER = "CAST(floor(p_partkey / 10) AS BIGINT)"
CATALOG_KEY = [
    "p_partkey % 10 AS host_id",
    f"CASE WHEN {CATALOG_NUMBER} % 10 = 9 THEN 'mysql' ELSE 'db' || CAST({CATALOG_NUMBER} % 3 AS STRING) END AS table_schema",
    f"'t' || CAST({CATALOG_NUMBER} AS STRING) AS table_name",
]
CATALOG_TABLES = [
    *CATALOG_KEY, "CASE WHEN p_size % 11 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine",
    "CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 65536 END AS data_length",
    "CAST(p_size AS BIGINT) * 4096 AS index_length", "CAST(p_size AS BIGINT) * 10 AS table_rows",
    "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey * 3 END AS auto_increment",
]

STATISTICS_ROWS = [
    ("PRIMARY", 0, 1, "id", "BTREE"), ("idx_a", 1, 1, "a", "BTREE"), ("idx_ab", 1, 1, "a", "BTREE"),
    ("idx_ab", 1, 2, "b", "BTREE"), ("idx_c", 1, 1, "c", "BTREE"), ("idx_c2", 1, 1, "c", "BTREE"),
    ("ft_d", 1, 1, "d", "FULLTEXT"),
]
STATISTICS_FILTER = (
    "NOT (index_name = 'PRIMARY' AND p_size % 5 = 0) AND NOT (index_name = 'idx_a' AND p_size % 2 = 0)"
    " AND NOT (index_name = 'idx_c2' AND p_size % 3 = 0) AND NOT (index_name = 'ft_d' AND p_size % 8 <> 0)"
)
STATISTICS = [
    *CATALOG_KEY, "index_name", "non_unique", "seq_in_index", "column_name", "index_type",
]

COLUMN_ROWS = [("id", 1, "bigint", "PRI"), ("a", 2, "int", "MUL"), ("b", 3, "int", ""), ("c", 4, "varchar(20)", "MUL"),
               ("d", 5, "text", "")]
COLUMNS_FILTER = "NOT (column_name = 'd' AND p_size % 8 <> 0)"
CATALOG_COLUMNS = [
    *CATALOG_KEY, "column_name", "ordinal_position", "column_type", "column_key",
]

OS_LINES = [
    ("loadavg", 1, "0.# 0.40 0.30 1/200 12345"),
    ("meminfo", 1, "MemTotal:       16#000 kB"), ("meminfo", 2, "MemFree:         1#000 kB"),
    ("meminfo", 3, "Buffers:           #000 kB"), ("meminfo", 4, "Cached:          2#000 kB"),
    ("meminfo", 5, "SwapTotal:       4000000 kB"), ("meminfo", 6, "SwapFree:        3#0000 kB"),
    ("meminfo", 7, "SwapCached:      7 kB"),
    ("df", 1, "Filesystem 1K-blocks Used Available Use% Mounted on"), ("df", 2, "/dev/sda1 104857600 5000 6000 #% /"),
    ("df", 3, "/dev/sdb1 209715200 5000 6000 55% /data"), ("df", 4, "tmpfs 909715200 0 6000 99% /run"),
    ("df", 5, "52428800 5000 6000 40% /long"),
    ("sar", 1, "Average: IFACE rxpck/s txpck/s rxkB/s txkB/s"), ("sar", 2, "Average: eth0 #.00 11.00 #.50 22.25"),
    ("sar", 3, "Average: lo 1.00 1.00 0.50 0.50"),
    ("iostat", 1, "Device: r/s w/s rkB/s wkB/s await svctm %util"), ("iostat", 2, "sda #.00 20.00 100.00 200.00 1.50 0.50 #.00"),
    ("iostat", 3, "sdb 5.00 6.00 7.00 8.00 0.50 0.25 1.00"),
    ("cpu", 1, "avg-cpu:  %user   %nice %system %iowait  %steal   %idle"),
    ("cpu", 2, "           5.#    0.00    2.00    0.50    0.00   90.00"),
    ("pid", 1, "4242"), ("top", 1, "4242 mysql 20 0 9g 2g 10m S #.5 12.5 10:00 mysqld"),
    ("top", 2, "4243 mysql 20 0 9g 2g 10m S 1.0 0.5 10:00 mysqld_safe"),
]
OS_TEXT = [
    "user_id % 10 AS host_id", "event_id AS poll_id", "ts", "kind", "line_no",
    "replace(tpl, '#', CAST(event_id % 90 + 10 AS STRING)) AS line",
]

BINLOG_TEXT_LINES = {
    1: "'### ' || CASE op WHEN 'insert' THEN 'INSERT INTO ' WHEN 'delete' THEN 'DELETE FROM ' ELSE 'UPDATE ' END || '`' || schema_name || '`.`' || table_name || '`'",
    2: "CASE op WHEN 'insert' THEN '### SET' ELSE '### WHERE' END",
    3: "'###   @1=' || CAST(pk AS STRING)",
    4: "'###   @2=' || CAST(CASE op WHEN 'insert' THEN after_amt ELSE before_amt END AS STRING)",
    5: "CASE WHEN op = 'update' THEN '### SET' END",
    6: "CASE WHEN op = 'update' THEN '###   @1=' || CAST(pk AS STRING) END",
    7: "CASE WHEN op = 'update' THEN '###   @2=' || CAST(after_amt AS STRING) END",
}

CHARTS = ["c_custkey AS chart_id", "c_name AS chart_title", "c_nationkey AS weight",
          "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_deleted"]
CHART_LINES = ["o_custkey AS chart_id", "o_orderkey AS line_id", "o_orderpriority AS line_name"]


class Inputs:
    """Lazily built inputs over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def host_infos(self) -> DataFrame:
        return self.table("supplier").selectExpr(*HOST_INFOS)

    @cached_property
    def slave_hosts(self) -> DataFrame:
        # The first servers have no replica rows, so the topology has hosts without a known role.
        return self.table("supplier").where("s_suppkey >= 4").selectExpr(*SLAVE_HOSTS)

    @cached_property
    def counter_samples(self) -> DataFrame:
        steps = self.table("events").selectExpr(
            "user_id % 10 AS host_id", "event_id AS poll_id", "ts",
            *[f"CAST({expr} AS BIGINT) AS d_{name}" for name, expr in COUNTER_STEPS.items()])
        sums = {name: ("sum", f"d_{name}") for name in COUNTER_STEPS}
        return (running(steps, ["host_id"], ["ts", "poll_id"], sums)
                .selectExpr("host_id", "poll_id", "ts", *COUNTER_STEPS, *COUNTERS_DERIVED))

    @cached_property
    def status_polls(self) -> DataFrame:
        return self.counter_samples.selectExpr(*STATUS_POLLS)

    def _key_values(self, values: dict[str, str]) -> DataFrame:
        pairs = ", ".join(f"struct('{n}' AS variable_name, CAST({e} AS STRING) AS value)"
                          for n, e in values.items())
        return (self.counter_samples
                .selectExpr("host_id", "poll_id", "ts", f"inline(array({pairs}))")
                .where("value IS NOT NULL"))

    @cached_property
    def status_kv(self) -> DataFrame:
        return self._key_values(STATUS_VALUES)

    @cached_property
    def variables_kv(self) -> DataFrame:
        pairs = ", ".join(f"struct('{n}' AS variable_name, {e} AS value)" for n, e in VARIABLE_VALUES.items())
        return (self.table("events")
                .selectExpr("user_id % 10 AS host_id", "event_id AS poll_id", "ts")
                .selectExpr("*", f"inline(array({pairs}))"))

    @cached_property
    def processlist(self) -> DataFrame:
        return self.table("events").selectExpr(*PROCESSLIST)

    @cached_property
    def slow_history(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*SLOW_HISTORY)

    @cached_property
    def slow_review(self) -> DataFrame:
        seen = self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
        return (self.table("part").join(seen, "p_partkey")
                .selectExpr("p_partkey AS checksum", "p_name AS fingerprint", "p_size % 2 AS is_reviewed",
                            "first_seen", "last_seen"))

    @cached_property
    def review_updates(self) -> DataFrame:
        return self.table("orders").selectExpr(*REVIEW_UPDATES)

    @cached_property
    def table_sizes(self) -> DataFrame:
        keyed = self.table("events").selectExpr(*TABLE_SIZE_KEYS, "event_id", "value")
        return keyed.groupBy("host_id", "db_name", "table_name", "snap_date").agg(
            *[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in TABLE_SIZE_SUMS.items()])

    @cached_property
    def file_sizes(self) -> DataFrame:
        # One table has no file, so that the join with the sizes has rows without a match.
        return self.table_sizes.where("table_name <> 't4'").selectExpr(*FILE_SIZES)

    @cached_property
    def binlog_events(self) -> DataFrame:
        base = self.table("orders").selectExpr(*BINLOG_BASE)
        lagged = previous(base, ["master_host_id", "pk"], ["log_pos"], {"prev_amt": "amt", "prev_note": "note"})
        return numbered(lagged, ["master_host_id", "pk"], ["log_pos"], "rn").selectExpr(*BINLOG_IMAGES)

    @cached_property
    def innodb_trx(self) -> DataFrame:
        return self.table("events").selectExpr(*INNODB_TRX)

    @cached_property
    def innodb_locks(self) -> DataFrame:
        events = self.table("events")
        second = events.where("event_type = 'signup'").selectExpr(*INNODB_LOCKS_SECOND)
        return events.selectExpr(*INNODB_LOCKS).unionByName(second)

    @cached_property
    def innodb_lock_waits(self) -> DataFrame:
        return self.table("events").where(LOCK_WAIT_ROWS).selectExpr(*INNODB_LOCK_WAITS)

    @cached_property
    def query_log(self) -> DataFrame:
        return self.table("orders").selectExpr(*QUERY_LOG)

    @cached_property
    def slow_log_text(self) -> DataFrame:
        lines = ", ".join(f"struct({n} AS n, {e} AS line)" for n, e in SLOW_LOG_LINES.items())
        return (self.query_log
                .selectExpr("host_id", "query_id", f"inline(array({lines}))")
                .selectExpr("'slow_' || CAST(host_id AS STRING) AS log_file", "query_id * 10 + n AS line_no", "line"))

    @cached_property
    def innodb_status_text(self) -> DataFrame:
        # Texts arrive spread over the cluster, not gathered by host like the counters.
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.counter_samples.repartition(spread, "poll_id").selectExpr("host_id", "poll_id", "ts", STATUS_TEXT)

    @cached_property
    def backup_log_lines(self) -> DataFrame:
        days = (self.table("events")
                .selectExpr("user_id % 10 AS host_id", "CAST(ts AS DATE) AS d").distinct()
                .selectExpr("*", "CAST(day(d) AS BIGINT) AS n"))
        # Some days have no backup, which the audit must find.
        days = days.where("(n + host_id) % 9 <> 4")
        return numbered(days, ["host_id"], ["d"], "line_no").selectExpr(*BACKUP_LINE)

    @cached_property
    def charts(self) -> DataFrame:
        return self.table("customer").selectExpr(*CHARTS)

    @cached_property
    def chart_lines(self) -> DataFrame:
        return self.table("orders").selectExpr(*CHART_LINES)

    @cached_property
    def slave_status(self) -> DataFrame:
        return self.counter_samples.selectExpr(*SLAVE_STATUS)

    @cached_property
    def stopped_replicas(self) -> DataFrame:
        return self.slave_status.where("slave_sql_running = 'No'").selectExpr(*STOPPED_REPLICAS)

    @cached_property
    def master_positions(self) -> DataFrame:
        return self.counter_samples.selectExpr(*MASTER_POSITIONS)

    @cached_property
    def master_logs(self) -> DataFrame:
        return (self.binlog_events
                .groupBy((F.col("log_pos") % 10).alias("host_id"), F.col("log_file").alias("log_name"))
                .agg((F.count("*") * 1048576).alias("file_size")))

    @cached_property
    def catalog_tables(self) -> DataFrame:
        return self.table("part").selectExpr(*CATALOG_TABLES)

    @cached_property
    def catalog_statistics(self) -> DataFrame:
        rows = ", ".join(f"struct('{i}' AS index_name, {u} AS non_unique, {s} AS seq_in_index, '{c}' AS column_name, '{t}' AS index_type)"
                         for i, u, s, c, t in STATISTICS_ROWS)
        return (self.table("part").selectExpr("p_partkey", "p_size", f"inline(array({rows}))")
                .where(STATISTICS_FILTER).selectExpr(*STATISTICS))

    @cached_property
    def catalog_columns(self) -> DataFrame:
        rows = ", ".join(f"struct('{c}' AS column_name, {n} AS ordinal_position, '{t}' AS column_type, '{k}' AS column_key)"
                         for c, n, t, k in COLUMN_ROWS)
        return (self.table("part").selectExpr("p_partkey", "p_size", f"inline(array({rows}))")
                .where(COLUMNS_FILTER).selectExpr(*CATALOG_COLUMNS))

    @cached_property
    def os_text(self) -> DataFrame:
        rows = ", ".join(f"struct('{k}' AS kind, {n} AS line_no, '{t}' AS tpl)" for k, n, t in OS_LINES)
        # Polls are spread over the cluster before each becomes many lines: a file may have few row groups.
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (self.table("events").select("user_id", "event_id", "ts").repartition(spread).selectExpr("user_id", "event_id", "ts", f"inline(array({rows}))")
                .selectExpr(*OS_TEXT))

    @cached_property
    def binlog_text(self) -> DataFrame:
        lines = ", ".join(f"struct({n} AS line_no, {e} AS line)" for n, e in BINLOG_TEXT_LINES.items())
        return (self.binlog_events
                .selectExpr("master_host_id", "log_file", "log_pos", f"inline(array({lines}))").where("line IS NOT NULL"))

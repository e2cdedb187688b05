"""Names the monitored servers report, and thresholds."""

# Status counters that are polled (122 distinct names).
STATUS_NAMES = """
Uptime Open_files Opened_files Bytes_sent Bytes_received Questions
Com_select Com_insert Com_update Com_delete Com_commit Com_rollback Innodb_max_trx_id
Connections Threads_created Threads_connected Threads_running Aborted_clients Aborted_connects
Binlog_cache_use Binlog_cache_disk_use
Handler_commit Handler_rollback Handler_read_first Handler_read_key Handler_read_next Handler_read_last
Handler_read_rnd Handler_read_rnd_next Handler_update Handler_write Handler_delete
table_open_cache table_open_cache_instances Open_tables Opened_tables
Table_open_cache_hits Table_open_cache_misses Table_open_cache_overflows
Created_tmp_files Created_tmp_tables Created_tmp_disk_tables Table_locks_immediate Table_locks_waited
Select_full_join Select_scan Select_full_range_join Select_range_check Select_range
Sort_merge_passes Sort_range Sort_scan
Innodb_deadlocks Innodb_history_list_length Innodb_current_row_locks Innodb_row_lock_current_waits
Innodb_log_writes Innodb_log_write_requests Innodb_os_log_pending_fsyncs Innodb_os_log_pending_writes
Innodb_os_log_written Innodb_log_waits Innodb_buffer_pool_wait_free
Innodb_row_lock_waits Innodb_row_lock_time Innodb_row_lock_time_avg Innodb_row_lock_time_max
Innodb_buffer_pool_pages_data Innodb_buffer_pool_pages_dirty Innodb_buffer_pool_pages_free
Innodb_buffer_pool_pages_total Innodb_buffer_pool_pages_flushed
Innodb_rows_read Innodb_rows_updated Innodb_rows_deleted Innodb_rows_inserted
Innodb_buffer_pool_reads Innodb_buffer_pool_write_requests Innodb_buffer_pool_read_requests
Innodb_data_read Innodb_data_reads Innodb_data_writes Innodb_data_written Innodb_data_fsyncs
Innodb_data_pending_fsyncs Innodb_data_pending_reads Innodb_data_pending_writes
Innodb_page_size Innodb_pages_read Innodb_pages_created Innodb_pages_written
Innodb_ibuf_free_list Innodb_ibuf_size Innodb_ibuf_merges Innodb_ibuf_merged_inserts
Innodb_ibuf_merged_deletes Innodb_ibuf_merged_delete_marks
Rpl_semi_sync_master_status Rpl_semi_sync_slave_status Rpl_semi_sync_master_clients
Rpl_semi_sync_master_net_waits Rpl_semi_sync_master_net_wait_time Rpl_semi_sync_master_net_avg_wait_time
Rpl_semi_sync_master_tx_waits Rpl_semi_sync_master_tx_wait_time Rpl_semi_sync_master_tx_avg_wait_time
Rpl_semi_sync_master_no_tx Rpl_semi_sync_master_yes_tx Rpl_semi_sync_master_no_times
Rpl_semi_sync_master_wait_sessions
Innodb_mutex_os_waits Innodb_mutex_spin_rounds Innodb_mutex_spin_waits
Innodb_s_lock_os_waits Innodb_s_lock_spin_rounds Innodb_s_lock_spin_waits
Innodb_x_lock_os_waits Innodb_x_lock_spin_rounds Innodb_x_lock_spin_waits
Slow_queries Innodb_dblwr_writes Innodb_dblwr_pages_written
""".split()

# Names above that are reported as they are; every other one is
# cumulative and reported as its change between two polls.
STATUS_LEVELS = """
Uptime Open_files Connections Threads_created Threads_connected Threads_running
Binlog_cache_use Binlog_cache_disk_use table_open_cache table_open_cache_instances Open_tables
Innodb_history_list_length Innodb_current_row_locks Innodb_row_lock_current_waits
Innodb_os_log_pending_fsyncs Innodb_os_log_pending_writes Innodb_log_waits Innodb_buffer_pool_wait_free
Innodb_row_lock_time_avg Innodb_row_lock_time_max
Innodb_buffer_pool_pages_data Innodb_buffer_pool_pages_dirty Innodb_buffer_pool_pages_free
Innodb_buffer_pool_pages_total
Innodb_data_pending_fsyncs Innodb_data_pending_reads Innodb_data_pending_writes Innodb_page_size
Innodb_ibuf_free_list Innodb_ibuf_size
Rpl_semi_sync_master_status Rpl_semi_sync_slave_status Rpl_semi_sync_master_clients
Rpl_semi_sync_master_net_waits Rpl_semi_sync_master_net_avg_wait_time
Rpl_semi_sync_master_tx_waits Rpl_semi_sync_master_tx_avg_wait_time
Rpl_semi_sync_master_no_tx Rpl_semi_sync_master_yes_tx Rpl_semi_sync_master_no_times
Rpl_semi_sync_master_wait_sessions
""".split()
STATUS_COUNTERS = [name for name in STATUS_NAMES if name not in STATUS_LEVELS]

# Settings that are polled.
VARIABLE_NAMES = """
version version_comment server_uuid datadir pid_file log_bin log_bin_basename max_connections
table_open_cache table_open_cache_instances innodb_buffer_pool_size read_only
innodb_spin_wait_delay innodb_sync_spin_loops query_cache_type query_cache_size
innodb_log_file_size innodb_log_buffer_size
""".split()

# Section headers of the engine status text.
STATUS_SECTIONS = [
    "BACKGROUND THREAD", "SEMAPHORES", "LATEST DETECTED DEADLOCK", "TRANSACTIONS", "FILE I/O",
    "INSERT BUFFER AND ADAPTIVE HASH INDEX", "LOG", "BUFFER POOL AND MEMORY",
    "INDIVIDUAL BUFFER POOL INFO", "ROW OPERATIONS", "END OF INNODB MONITOR OUTPUT",
]

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = ["mysql", "information_schema", "performance_schema", "sys"]

# Chart title -> (line name, metric) pairs.
CHARTS = {
    "QPS": [("qps", "qps")],
    "TPS": [("tps", "tps")],
    "Trxs": [("trxs", "trx_count")],
    "Thread": [("connected", "threads_connected"), ("running", "threads_running")],
    "DML": [("insert", "insert_count"), ("update", "update_count"), ("delete", "delete_count")],
    "CPU Load": [("CPU_1", "cpu_1"), ("CPU_5", "cpu_5"), ("CPU_15", "cpu_15")],
    "CPU": [("user", "cpu_user"), ("sys", "cpu_system"), ("idle", "cpu_idle")],
    "IO Q/T": [("qps", "io_qps"), ("tps", "io_tps")],
    "IO R/W": [("read", "io_read"), ("write", "io_write")],
    "IO Util": [("util", "io_util")],
    "Repl Delay": [("delay", "seconds_behind_master")],
    "MySQL CPU": [("cpu", "mysql_cpu")],
    "MySQL Mem": [("memory", "mysql_memory")],
}

# Alert thresholds, page sizes and retention.
MAX_THREADS = 1000
MAX_THREADS_RUNNING = 5
SLOW_ALERT_COUNT = 10
GENERAL_ALERT_COUNT = 100
THREAD_ALERT_SECONDS = 1
DIGEST_PAGE_ROWS = 15
TABLE_PAGE_ROWS = 20
CHART_POINTS = 200
BACKUP_KEEP_DAYS = 14
UNDO_PAGE_BYTES = 16 * 1024

"""Registered queries over sinks, stacked metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import changes, counters, space
from fleetscope.plans.change_queries import FORWARD, KEYS
from fleetscope.plans.counter_queries import ENTRIES as COUNTER_ENTRIES
from fleetscope.plans.counter_queries import METRICS_SQL, _lag
from fleetscope.plans.inputs import QUERY_LOG, Inputs
from fleetscope.operators.slowlog import DIGEST_MEASURES
from fleetscope.plans.registry import Entry
from fleetscope.plans.slowlog_queries import PRINTED
from fleetscope.plans.space_queries import SPACE, TOTALS
from fleetscope.plans.text_queries import ENTRIES as TEXT_ENTRIES
from fleetscope.plans.text_queries import GAPS
from fleetscope.plans.views import with_views
from fleetscope.session import scratch_path
from fleetscope.sources import engine_text, os_text, sinks
from fleetscope.streaming import streams

RATES = ["questions", "bytes_sent", "bytes_received"]
STATS = ["qps", "tps", "threads_connected"]
STATUS_METRICS = ["qps", "tps", "insert_count", "update_count", "delete_count", "commit", "rollback", "connections", "threads_connected",
                  "threads_running", "tmp_tables", "tmp_disk_tables", "send_bytes", "receive_bytes", "trx_count"]
REPLICATION_METRICS = ["seconds_behind_master", "read_master_log_pos", "exec_master_log_pos"]
OS_FAMILIES = {
    "loadavg": os_text.LOAD, "memory": [*os_text.MEMORY.values(), "memory_free_total"], "disk": ["disk_value", "total_disk_value"],
    "network": list(os_text.NETWORK), "io": ["io_qps", "io_tps", "io_read", "io_write", "io_util", "io_await", "io_svctm"],
    "cpu_process": ["cpu_user", "cpu_nice", "cpu_system", "cpu_iowait", "cpu_steal", "cpu_idle", "mysql_cpu", "mysql_memory"],
}
ENGINE_METRICS = ["log_flush_diff", "page_flush_diff", "checkpoint_diff"]


def _space(i: Inputs):
    return space.table_space(i.table_sizes, space.file_size_parse(i.file_sizes))


def _written(i: Inputs, name: str, write) -> tuple:
    path = scratch_path(i.spark, name)
    write(path)
    return i.spark, path


def _status_log(i: Inputs):
    spark, path = _written(i, "status_log", lambda p: sinks.status_log_append(counters.interval_metrics(i.counter_samples), p))
    return spark.read.parquet(path)


def _os_log(i: Inputs):
    rows = sinks.os_log_rows(os_text.os_metrics(i.os_text), space.space_totals(_space(i)))
    spark, path = _written(i, "os_log", lambda p: sinks.os_log_append(rows, p))
    return spark.read.parquet(path)


def _size_log(i: Inputs):
    def write(path: str) -> None:
        sinks.size_log_append(_space(i), path)
        sinks.size_log_append(_space(i), path)  # a second run must change nothing

    spark, path = _written(i, "size_log", write)
    return spark.read.parquet(path)


def _report(i: Inputs):
    spark, path = _written(i, "report", lambda p: sinks.report_tsv(_space(i), p))
    schema = ("host_id BIGINT, snap_date DATE, db_name STRING, table_name STRING, table_rows BIGINT, data_length BIGINT,"
              " index_length BIGINT, total_size BIGINT, file_size BIGINT, free_size BIGINT")
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def _script(i: Inputs):
    spark, path = _written(i, "script", lambda p: sinks.sql_script_sink(changes.change_to_sql(i.binlog_events, KEYS), p))
    return spark.read.text(path).withColumnRenamed("value", "sql")


def _snapshots(i: Inputs):
    start, stop = F.lit("2024-01-05 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 18:00:00").cast("timestamp_ntz")
    spark, path = _written(i, "snapshots", lambda p: sinks.snapshot_collect(i.processlist, p, start, stop))
    return spark.read.parquet(path).withColumn("host_id", F.col("host_id").cast("bigint"))


def _fleet_metrics(i: Inputs):
    return counters.fleet_metrics_long([
        (counters.interval_metrics(i.counter_samples), {"status": STATUS_METRICS}),
        (i.slave_status, {"replication": REPLICATION_METRICS}),
        (engine_text.lsn_gaps(i.innodb_status_text), {"engine": ENGINE_METRICS}),
        (os_text.os_metrics(i.os_text), OS_FAMILIES)])


def _long(source: str, family: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT host_id, poll_id, ts, '{family}' AS family, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}"
                              for m in metrics)


def _paths(i: Inputs, name: str, n: int) -> list[str]:
    return [scratch_path(i.spark, f"{name}-{k}") for k in range(n)]


def _stream_rates(i: Inputs):
    out, state, checkpoint = _paths(i, "rates", 3)
    samples = streams.land(i.counter_samples.select("host_id", "poll_id", "ts", *RATES), "samples")
    streams.stream_counter_rates(samples, RATES, out, state, checkpoint).awaitTermination()
    return i.spark.read.parquet(out).select("host_id", "poll_id", "elapsed_us", *[f"{c}_{s}" for c in RATES for s in ("rate", "reset")])


def _stream_latest(i: Inputs):
    out, checkpoint = _paths(i, "latest", 2)
    samples = streams.land(i.counter_samples, "samples")
    streams.stream_latest(samples, out, checkpoint).awaitTermination()
    return streams.read_upserts(i.spark, out, ["host_id"])


def _stream_stats(i: Inputs):
    out, checkpoint = _paths(i, "stats", 2)
    metrics = streams.land(counters.interval_metrics(i.counter_samples).select("host_id", *STATS), "metrics")
    streams.stream_running_stats(metrics, STATS, out, checkpoint).awaitTermination()
    return streams.read_upserts(i.spark, out, ["host_id"])


def _stream_digest(i: Inputs):
    out, checkpoint = _paths(i, "digest", 2)
    queries = streams.table_stream(i.spark, i.sf_dir, "orders").selectExpr(*QUERY_LOG)
    # The statements are not in time order, but they are read in one micro-batch, in which none is late.
    streams.stream_slow_digest(queries, out, checkpoint).awaitTermination()
    return streams.read_upserts(i.spark, out, ["window_start", "checksum"])


def _late_rows(i: Inputs):
    # Read in one micro-batch, in which none is late; tests/test_streaming.py has rows that are.
    digest, checkpoint, counts, checkpoint_counts = _paths(i, "late", 4)
    queries = streams.table_stream(i.spark, i.sf_dir, "orders").selectExpr(*QUERY_LOG)
    streams.stream_slow_digest(queries, digest, checkpoint).awaitTermination()
    streams.stream_row_counts(queries, counts, checkpoint_counts).awaitTermination()
    return streams.late_rows(i.spark, digest, counts)


# Silences of this length occur at every size of the given tables.
DOWN_SECONDS = 6 * 3600


def _stream_alerts(i: Inputs):
    out, checkpoint, silent, checkpoint_silent = _paths(i, "alerts", 4)
    samples = streams.land(i.counter_samples.select("host_id", "ts", "threads_connected", "threads_running"), "samples")
    replicas = streams.land(i.slave_status.select("host_id", "ts", "slave_io_running", "slave_sql_running"), "replicas")
    streams.stream_alerts(samples, out, checkpoint, replicas=replicas).awaitTermination()
    streams.stream_host_down(samples, silent, checkpoint_silent, DOWN_SECONDS).awaitTermination()
    return i.spark.read.parquet(out).unionByName(i.spark.read.parquet(silent)).select("host_id", "rule", F.col("since").cast("timestamp_ntz").alias("since"))


def _sync(i: Inputs):
    target, checkpoint = _paths(i, "sync", 2)
    pairs = i.host_infos.selectExpr("'db' || CAST(host_id % 2 AS STRING) AS schema_name", "'accounts' AS table_name")
    streams.sync_apply(streams.land(i.binlog_events, "changes"), pairs, target, checkpoint, KEYS).awaitTermination()
    return streams.read_synced(i.spark, target, KEYS)


ENTRIES = {
    "fleet_metrics_long": Entry(_fleet_metrics, with_views(" UNION ALL ".join([
        _long("m", "status", STATUS_METRICS),
        _long("slave_status", "replication", REPLICATION_METRICS),
        _long("gaps", "engine", ENGINE_METRICS),
        *[_long(f"o_{family}", family, metrics) for family, metrics in OS_FAMILIES.items()]]),
        {**GAPS, "m": METRICS_SQL, "times": "SELECT host_id, poll_id, max(ts) AS ts FROM os_text GROUP BY host_id, poll_id",
         **{f"o_{family}": f"SELECT o.*, t.ts FROM ({TEXT_ENTRIES['os_' + family].sql}) o JOIN times t ON o.host_id = t.host_id AND o.poll_id = t.poll_id"
            for family in OS_FAMILIES}})),
    "status_log_append": Entry(_status_log, with_views(
        f"SELECT host_id, {_lag('questions')} AS qps, {_lag('com_insert')} + {_lag('com_update')} + {_lag('com_delete')} AS tps,"
        f" {_lag('com_commit')} AS commit, {_lag('com_rollback')} AS rollback, {_lag('connections')} AS connections,"
        f" threads_connected AS thread_count, threads_running AS thread_running_count, {_lag('created_tmp_tables')} AS tmp_tables,"
        f" {_lag('created_tmp_disk_tables')} AS tmp_disk_tables, {_lag('bytes_sent')} AS send_bytes, {_lag('bytes_received')} AS receive_bytes,"
        f" {_lag('com_commit')} + {_lag('com_rollback')} AS trxs, ts, CAST(ts AS DATE) AS date FROM counter_samples")),
    "os_log_append": Entry(_os_log, with_views(
        "SELECT l.host_id, CAST(split_part(l.line, ' ', 1) AS DOUBLE) AS cpu1, CAST(split_part(l.line, ' ', 2) AS DOUBLE) AS cpu5,"
        " CAST(split_part(l.line, ' ', 3) AS DOUBLE) AS cpu15, CAST(c.f[1] AS DOUBLE) AS cpu_user, CAST(c.f[3] AS DOUBLE) AS cpu_sys,"
        " CAST(c.f[4] AS DOUBLE) AS cpu_iowait, CAST(t.f[9] AS DOUBLE) AS mysql_cpu, CAST(t.f[10] AS DOUBLE) AS mysql_memory, s.file_total AS mysql_size,"
        " d.io_qps, d.io_tps, d.io_read, d.io_write, d.io_util, l.ts, CAST(l.ts AS DATE) AS date FROM os_text l"
        " JOIN f c ON c.kind = 'cpu' AND c.line_no = 2 AND c.host_id = l.host_id AND c.poll_id = l.poll_id"
        " JOIN f p ON p.kind = 'pid' AND p.host_id = l.host_id AND p.poll_id = l.poll_id"
        " LEFT JOIN f t ON t.kind = 'top' AND t.host_id = l.host_id AND t.poll_id = l.poll_id AND t.f[1] = p.f[1]"
        " JOIN (SELECT host_id, poll_id, CAST(floor(sum(TRY_CAST(f[2] AS DECIMAL(18,2)))) AS BIGINT) AS io_qps, CAST(floor(sum(TRY_CAST(f[3] AS DECIMAL(18,2)))) AS BIGINT) AS io_tps,"
        " CAST(floor(sum(TRY_CAST(f[4] AS DECIMAL(18,2)))) AS BIGINT) AS io_read, CAST(floor(sum(TRY_CAST(f[5] AS DECIMAL(18,2)))) AS BIGINT) AS io_write,"
        " CAST(sum(TRY_CAST(f[8] AS DECIMAL(18,2))) AS DOUBLE) AS io_util FROM f WHERE kind = 'iostat' AND line_no > 1 GROUP BY host_id, poll_id) d"
        " ON d.host_id = l.host_id AND d.poll_id = l.poll_id"
        " LEFT JOIN totals s ON s.host_id = l.host_id AND s.snap_date = CAST(l.ts AS DATE) WHERE l.kind = 'loadavg'",
        {**TOTALS, "f": r"SELECT *, regexp_split_to_array(trim(line), '\s+') AS f FROM os_text"})),
    "size_log_append": Entry(_size_log, with_views(
        'SELECT host_id, db_name AS "schema", table_name, data_length AS data_size, total_size, index_length AS index_size, table_rows AS rows,'
        " auto_increment, file_size, free_size, snap_date AS date FROM space", SPACE)),
    "report_tsv": Entry(_report, with_views(
        "SELECT host_id, snap_date, db_name, table_name, table_rows, data_length, index_length, total_size, file_size, free_size FROM space", SPACE)),
    "sql_script_sink": Entry(_script, with_views(f"SELECT {FORWARD} FROM binlog_events")),
    "snapshot_collect": Entry(_snapshots, with_views(
        "SELECT * FROM processlist WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-20 18:00:00'")),
    "stream_counter_rates": Entry(_stream_rates, COUNTER_ENTRIES["counter_rates"].sql),
    "stream_latest": Entry(_stream_latest, COUNTER_ENTRIES["latest_state"].sql),
    "stream_running_stats": Entry(_stream_stats, with_views(
        "SELECT host_id, " + ", ".join(
            f"min({m}) AS {m}_min, max({m}) AS {m}_max, CAST(sum({m}) AS BIGINT) AS {m}_sum, count({m}) AS {m}_count,"
            f" CASE WHEN count({m}) > 0 THEN CAST(sum({m}) AS DOUBLE) / count({m}) END AS {m}_avg" for m in STATS) + " FROM m GROUP BY host_id",
        {"m": METRICS_SQL})),
    "stream_slow_digest": Entry(_stream_digest, with_views(
        "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, checksum, max(fingerprint) AS fingerprint, count(*) AS ts_cnt,"
        " min(ts) AS first_seen, max(ts) AS last_seen, max(default_db) AS db_max, max(user_name) AS user_max, max(host_id) AS serverid_max,"
        " arg_max(sql_text, (query_time, -query_id)) AS sample, " + ", ".join(
            f"CAST(sum({m}) AS DOUBLE) AS {m}_sum, CAST(min({m}) AS DOUBLE) AS {m}_min, CAST(max({m}) AS DOUBLE) AS {m}_max,"
            f" CAST(list_sort(list({m}))[CAST(ceil(0.95 * count({m})) AS BIGINT)] AS DOUBLE) AS {m}_pct_95" for m in DIGEST_MEASURES)
        + " FROM fp GROUP BY 1, 2", PRINTED)),
    "stream_late_rows": Entry(_late_rows, with_views(
        "SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows, count(*) AS n_in_windows, CAST(0 AS BIGINT) AS n_late FROM query_log GROUP BY 1")),
    "stream_alerts": Entry(_stream_alerts, with_views(
        "SELECT DISTINCT host_id, rule, time_bucket(INTERVAL 10 MINUTE, ts) AS since FROM"
        " (SELECT host_id, ts, 'threads' AS rule FROM counter_samples WHERE threads_connected > 1000"
        " UNION ALL SELECT host_id, ts, 'threads_running' FROM counter_samples WHERE threads_running > 5"
        " UNION ALL SELECT host_id, ts, 'io_state' FROM slave_status WHERE slave_io_running <> 'Yes'"
        " UNION ALL SELECT host_id, ts, 'sql_state' FROM slave_status WHERE slave_sql_running <> 'Yes') a"
        " UNION ALL SELECT host_id, 'host_down', time_bucket(INTERVAL 10 MINUTE, ts + down) FROM (SELECT host_id, ts, max(ts) OVER () AS newest,"
        f" INTERVAL {DOWN_SECONDS} SECOND AS down, lead(ts) OVER (PARTITION BY host_id ORDER BY ts) AS following FROM counter_samples) s"
        " WHERE following > ts + down OR (following IS NULL AND ts + down < newest - INTERVAL 10 MINUTE)")),
    "sync_apply": Entry(_sync, with_views(
        "SELECT master_host_id, schema_name, table_name, pk, after_amt AS amt, after_note AS note FROM (SELECT *, row_number() OVER"
        " (PARTITION BY master_host_id, schema_name, table_name, pk ORDER BY log_file DESC, log_pos DESC) AS rn FROM binlog_events"
        " WHERE (schema_name, table_name) IN (SELECT ('db' || CAST(host_id % 2 AS STRING), 'accounts') FROM host_infos)) x"
        " WHERE rn = 1 AND op <> 'delete'")),
}

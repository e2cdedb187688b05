"""History tables, reports, scripts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetscope.session import pin

DAY = "date"


def _write_by_day(df: DataFrame, path: str, mode: str, *spread: str) -> None:
    """Write one folder per day.

    Rows are range-partitioned on (day, spread): a task holds few days, so few files are
    written, and a day with most of the rows is split between tasks.
    """
    (df.repartitionByRange(DAY, *spread).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path))


def status_log_rows(metrics: DataFrame) -> DataFrame:
    """The 13 status columns of the history table, with time and day."""
    return metrics.select(
        "host_id", "qps", "tps", "commit", "rollback", "connections", F.col("threads_connected").alias("thread_count"),
        F.col("threads_running").alias("thread_running_count"), "tmp_tables", "tmp_disk_tables", "send_bytes",
        "receive_bytes", F.col("trx_count").alias("trxs"), "ts", F.col("ts").cast("date").alias(DAY))


def status_log_append(metrics: DataFrame, path: str) -> None:
    """Append interval metrics to the status history."""
    _write_by_day(status_log_rows(metrics), path, "append", "ts")


def os_log_rows(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    """The 15 operating-system columns of the history table, with time and day.

    ``metrics`` holds all metrics of a poll, ``sizes`` the data size per host and ``snap_date``. A poll without load is left out.
    """
    polls = metrics.where("cpu_1 IS NOT NULL").withColumn(DAY, F.col("ts").cast("date"))
    size = sizes.select("host_id", F.col("snap_date").alias(DAY), F.col("file_total").alias("mysql_size"))
    return polls.join(size, ["host_id", DAY], "left").select(
        "host_id", F.col("cpu_1").alias("cpu1"), F.col("cpu_5").alias("cpu5"), F.col("cpu_15").alias("cpu15"),
        "cpu_user", F.col("cpu_system").alias("cpu_sys"), "cpu_iowait", "mysql_cpu", "mysql_memory", "mysql_size",
        "io_qps", "io_tps", "io_read", "io_write", "io_util", "ts", DAY)


def os_log_append(rows: DataFrame, path: str) -> None:
    """Append operating-system samples to their history."""
    _write_by_day(rows, path, "append", "ts")


def size_log_append(space: DataFrame, path: str) -> None:
    """Write daily table sizes; running it again for a (host, day) replaces those rows.

    Only the days in ``space`` are rewritten. Rows of other hosts on those days are kept:
    they are checkpointed first, since their folder is then overwritten.
    """
    rows = space.select(
        "host_id", F.col("db_name").alias("schema"), "table_name", F.col("data_length").alias("data_size"), "total_size",
        F.col("index_length").alias("index_size"), F.col("table_rows").alias("rows"), "auto_increment", "file_size",
        "free_size", F.col("snap_date").alias(DAY))
    try:
        stored = space.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        replaced = rows.select("host_id", DAY).distinct()
        kept = (stored.join(rows.select(DAY).distinct(), DAY, "left_semi")
                .join(replaced, ["host_id", DAY], "left_anti"))
        rows = rows.unionByName(pin(kept))
    _write_by_day(rows, path, "overwrite", "host_id", "schema", "table_name")


def report_tsv(space: DataFrame, path: str) -> None:
    """Fragmentation report as tab-separated text with a header, most free space first."""
    (space.select("host_id", "snap_date", "db_name", "table_name", "table_rows", "data_length", "index_length", "total_size",
                  "file_size", "free_size")
     .orderBy(F.col("free_size").desc(), "host_id", "snap_date", "db_name", "table_name")
     .write.mode("overwrite").option("sep", "\t").option("header", True).csv(path))


def sql_script_sink(statements: DataFrame, path: str) -> None:
    """Statements as text, one per line, in log order over the numbered part files; a longer file name is later."""
    place = ["master_host_id", F.length("log_file"), "log_file", "log_pos"]
    (statements.repartitionByRange(*place).sortWithinPartitions(*place)
     .select("sql").write.mode("overwrite").text(path))


def snapshot_collect(rows: DataFrame, path: str, start: Column, stop: Column) -> None:
    """Rows between two instants, one folder per host; a busy host is split between tasks."""
    (rows.where((F.col("ts") >= start) & (F.col("ts") <= stop))
     .repartitionByRange("host_id", "ts").write.mode("overwrite").partitionBy("host_id").parquet(path))

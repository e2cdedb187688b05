"""Hosts, threads and chart configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ordered import numbered


def hosts_by_keys(hosts: DataFrame, keys: Sequence[int] | DataFrame) -> DataFrame:
    """Hosts in a key list or key table (column ``host_id``); an empty list selects all."""
    if isinstance(keys, DataFrame):
        return hosts.join(keys.select("host_id").distinct(), "host_id", "left_semi")
    return hosts.where(F.col("host_id").isin(list(keys))) if len(keys) else hosts


def active(rows: DataFrame) -> DataFrame:
    """Hosts or users that are not soft-deleted."""
    return rows.where("is_deleted = 0")


def branch_classify(hosts: DataFrame) -> DataFrame:
    """Server flavour from the version comment; anything unknown is MySQL."""
    comment = F.lower("version_comment")
    return hosts.withColumn("branch", F.when(comment.contains("percona"), "Percona")
                            .when(comment.contains("mariadb"), "Mariadb").otherwise("MySQL"))


def active_threads(threads: DataFrame) -> DataFrame:
    """Threads that run a statement."""
    return threads.where("command <> 'Sleep' AND length(info) > 0")


def long_threads(threads: DataFrame, hosts: DataFrame) -> DataFrame:
    """Threads running for more than a second per host; hosts without any keep 0."""
    counted = (threads.where("length(state) > 0 AND length(info) > 0 AND time_s > 1")
               .groupBy("host_id").agg(F.count("*").alias("thread_waits_count")))
    return (hosts.select("host_id").join(counted, "host_id", "left")
            .withColumn("thread_waits_count", F.coalesce("thread_waits_count", F.lit(0))))


def thread_groups(threads: DataFrame) -> DataFrame:
    """Threads by user, command, state and statement."""
    return threads.groupBy("user_name", "command", "state", "info").agg(F.count("*").alias("threads"))


def chart_config(charts: DataFrame, lines: DataFrame) -> DataFrame:
    """Charts in display order, a row for each line with its position; a chart without lines has one row."""
    placed = numbered(lines, ["chart_id"], ["line_id"], "line_no")
    return (charts.where("is_deleted = 0").join(placed, "chart_id", "left")
            .select("chart_id", "chart_title", "weight", "line_no", "line_id", "line_name")
            .orderBy("weight", "chart_id", "line_no"))


def chart_nested(config: DataFrame) -> DataFrame:
    """One row a chart with its lines in a list, for charts of a page: the list is as long as the chart."""
    line = F.when(F.col("line_no").isNotNull(), F.struct("line_no", "line_id", "line_name"))
    return (config.groupBy("chart_id", "chart_title", "weight").agg(F.array_sort(F.collect_list(line)).alias("lines"))
            .orderBy("weight", "chart_id"))

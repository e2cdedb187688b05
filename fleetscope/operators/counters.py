"""Cumulative counters to deltas, rates, ratios, running statistics and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.constants import CHART_POINTS, CHARTS, MAX_THREADS, MAX_THREADS_RUNNING, STATUS_LEVELS, STATUS_NAMES
from fleetscope.functions.ratios import percent2, ratio2, zero_if_null
from fleetscope.operators.ordered import previous, running, top_per_key

HOST = ["host_id"]
POLL = ["ts", "poll_id"]


def counter_deltas(df: DataFrame, counters: Sequence[str], keys: Sequence[str] = HOST,
                   order: Sequence[str] = POLL, prefix: str = "d_") -> DataFrame:
    """Add ``new - old`` per key for every counter; null on the first sample."""
    out = previous(df, keys, order, {f"__p_{c}": c for c in counters})
    return (out.withColumns({f"{prefix}{c}": F.col(c) - F.col(f"__p_{c}") for c in counters})
            .drop(*[f"__p_{c}" for c in counters]))


def counter_rates(df: DataFrame, counters: Sequence[str], keys: Sequence[str] = HOST,
                  order: Sequence[str] = POLL, time: str = "ts") -> DataFrame:
    """Per-second rates. A counter that went down was reset: its value counts from zero."""
    before = previous(df, keys, order, {"__p_time": time, **{f"__p_{c}": c for c in counters}})
    out = before.withColumn("elapsed_us", F.expr(f"timestampdiff(MICROSECOND, __p_time, {time})"))
    for c in counters:
        old = F.col(f"__p_{c}")
        reset = F.col(c) < old
        step = F.when(reset, F.col(c)).otherwise(F.col(c) - old)
        out = (out.withColumn(f"{c}_reset", F.coalesce(reset.cast("int"), F.lit(0)))
               .withColumn(f"{c}_rate", F.try_divide((step * 1000000).cast("double"),
                                                     F.col("elapsed_us").cast("double"))))
    return out.drop("__p_time", *[f"__p_{c}" for c in counters])


def qps_tps(df: DataFrame) -> DataFrame:
    """Queries and both transaction counts per interval: row changes, and commits."""
    used = ["questions", "com_insert", "com_update", "com_delete", "com_commit", "com_rollback"]
    d = counter_deltas(df.select("host_id", "poll_id", "ts", *used), used)
    return d.select(
        "host_id", "poll_id", "ts", F.col("d_questions").alias("qps"),
        (F.col("d_com_insert") + F.col("d_com_update") + F.col("d_com_delete")).alias("tps"),
        (F.col("d_com_commit") + F.col("d_com_rollback")).alias("tps_commit"))


def hit_ratios(samples: DataFrame, hosts: DataFrame) -> DataFrame:
    """Cache hit ratios in percent, connection use and share of temporary tables on disk."""
    limits = hosts.select("host_id", "max_connections")
    return samples.join(limits, "host_id", "left").select(
        "host_id", "poll_id", "ts",
        zero_if_null(percent2(F.col("connections") - F.col("threads_created"), "connections")).alias("thread_cache_hit"),
        zero_if_null(percent2(F.col("binlog_cache_use") - F.col("binlog_cache_disk_use"), "binlog_cache_use"))
        .alias("binlog_cache_hit"),
        zero_if_null(percent2("buffer_pool_read_requests",
                              F.col("buffer_pool_read_requests") + F.col("buffer_pool_reads"))).alias("buffer_pool_hit"),
        F.expr("CASE WHEN max_connections > 0 THEN threads_connected * 100 div max_connections END")
        .alias("connections_usage_rate"),
        zero_if_null(percent2("created_tmp_disk_tables", "created_tmp_tables")).alias("tmp_disk_share"))


def page_usage(status: DataFrame) -> DataFrame:
    """Buffer pool pages in percent of the total."""
    total = F.col("Innodb_buffer_pool_pages_total")
    return status.select(
        "host_id", "poll_id",
        percent2("Innodb_buffer_pool_pages_dirty", total).alias("dirty_page_usage"),
        percent2(total - F.col("Innodb_buffer_pool_pages_free"), total).alias("page_usage"),
        percent2("Innodb_buffer_pool_pages_data", total).alias("data_page_usage"))


def spin_ratios(status: DataFrame) -> DataFrame:
    """Waits per spin round and interval in percent; 0 when nothing spun."""
    kinds = {"mutex": "Innodb_mutex", "s": "Innodb_s_lock", "x": "Innodb_x_lock"}
    counters = [f"{p}_{m}" for p in kinds.values() for m in ("os_waits", "spin_rounds")]
    d = counter_deltas(status.select("host_id", "poll_id", "ts", *counters), counters)

    def one(prefix: str) -> Column:
        waits, rounds = F.col(f"d_{prefix}_os_waits"), F.col(f"d_{prefix}_spin_rounds")
        return F.when(rounds == 0, F.lit(0.0)).otherwise(percent2(waits, rounds))

    return d.select("host_id", "poll_id", *[one(p).alias(f"{k}_ratio") for k, p in kinds.items()])


def write_amplification(status: DataFrame) -> DataFrame:
    """Pages per double-write call, both as changes too, page size in KB and uptime in whole days (at least 1)."""
    calls = ["Innodb_dblwr_writes", "Innodb_dblwr_pages_written"]
    d = counter_deltas(status.select("host_id", "poll_id", "ts", *calls, "Innodb_page_size", "Uptime"), calls)
    return d.select(
        "host_id", "poll_id",
        zero_if_null(ratio2("Innodb_dblwr_pages_written", "Innodb_dblwr_writes")).alias("pages_per_dblwr"),
        *[F.col(f"d_{c}").alias(c.removeprefix("Innodb_")) for c in calls],
        F.expr("Innodb_page_size div 1024").alias("page_size_kb"),
        F.expr("greatest(Uptime div 86400, 1L)").alias("uptime_days"))


def semi_sync(status: DataFrame) -> DataFrame:
    """Semi-synchronous replication: whether it is installed, the two status flags, levels and the two wait-time deltas.

    It is installed where the server reports the master's status at all, be it ON or OFF.
    """
    def state(name: str) -> Column:
        return F.when(F.col(name) == 1, "ON").when(F.col(name) == 0, "OFF")

    p = "Rpl_semi_sync_master_"
    levels = ["clients", "net_waits", "net_avg_wait_time", "tx_waits", "tx_avg_wait_time", "no_tx", "yes_tx", "no_times", "wait_sessions"]
    times = ["net_wait_time", "tx_wait_time"]
    flags = [f"{p}status", "Rpl_semi_sync_slave_status"]
    d = counter_deltas(status.select("host_id", "poll_id", "ts", *flags, *[p + n for n in levels + times]),
                       [p + n for n in times])
    return d.select(
        "host_id", "poll_id", F.col(flags[0]).isNotNull().cast("int").alias("rpl_semi_sync"),
        state(flags[0]).alias("master_status"), state(flags[1]).alias("slave_status"),
        *[F.coalesce(F.col(p + n), F.lit(0)).alias(n) for n in levels],
        *[F.col(f"d_{p}{n}").alias(n) for n in times])


def latest_state(df: DataFrame, keys: Sequence[str] = HOST, order: Sequence[str] = POLL) -> DataFrame:
    """Newest row per key, as one aggregate with a map-side part."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return newest.select(*keys, "s.*")


def chart_window(df: DataFrame, points: int = CHART_POINTS) -> DataFrame:
    """Last ``points`` samples of every host."""
    return top_per_key(df, HOST, [F.col("ts").desc(), F.col("poll_id").desc()], points)


def interval_metrics(df: DataFrame) -> DataFrame:
    """The per-interval metrics the charts, statistics and history tables share."""
    used = ["questions", "com_insert", "com_update", "com_delete", "com_commit", "com_rollback", "connections",
            "created_tmp_tables", "created_tmp_disk_tables", "bytes_sent", "bytes_received"]
    d = counter_deltas(df.select("host_id", "poll_id", "ts", "threads_connected", "threads_running", *used), used)
    return d.select(
        "host_id", "poll_id", "ts", F.col("d_questions").alias("qps"),
        (F.col("d_com_insert") + F.col("d_com_update") + F.col("d_com_delete")).alias("tps"),
        F.col("d_com_insert").alias("insert_count"), F.col("d_com_update").alias("update_count"),
        F.col("d_com_delete").alias("delete_count"), F.col("d_com_commit").alias("commit"),
        F.col("d_com_rollback").alias("rollback"), F.col("d_connections").alias("connections"),
        F.col("threads_connected").alias("threads_connected"), "threads_running",
        F.col("d_created_tmp_tables").alias("tmp_tables"), F.col("d_created_tmp_disk_tables").alias("tmp_disk_tables"),
        F.col("d_bytes_sent").alias("send_bytes"), F.col("d_bytes_received").alias("receive_bytes"),
        (F.col("d_com_commit") + F.col("d_com_rollback")).alias("trx_count"))


STATISTICS_METRICS = ["qps", "tps", "threads_connected", "tmp_tables", "tmp_disk_tables"]


def running_stats(metrics: DataFrame, names: Sequence[str] = STATISTICS_METRICS) -> DataFrame:
    """Running min, max, sum, count and average of every metric per host."""
    aggregates: dict[str, tuple[str, str]] = {}
    for m in names:
        for fn in ("min", "max", "sum", "count"):
            aggregates[f"{m}_{fn}"] = (fn, m)
    out = running(metrics.select("host_id", "poll_id", "ts", *names), HOST, POLL, aggregates)
    averages = [F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_count").cast("double")).alias(f"{m}_avg")
                for m in names]
    return out.select("host_id", "poll_id", *aggregates, *averages)


def status_changes(status: DataFrame, names: Sequence[str] = STATUS_NAMES, levels: Sequence[str] = STATUS_LEVELS) -> DataFrame:
    """A status poll as it is reported: levels as they are, every other counter as its change since the poll before.

    All counters share one ordered pass. The first poll of a host has no changes.
    """
    counters = [n for n in names if n not in levels]
    d = counter_deltas(status.select("host_id", "poll_id", "ts", *names), counters)
    return d.select("host_id", "poll_id", "ts", *[F.col(f"d_{n}").alias(n) if n in counters else n for n in names])


def chart_select(df: DataFrame, charts: Mapping[str, Sequence[tuple[str, str]]] = CHARTS) -> DataFrame:
    """Long chart points (chart, line, value) of the charts whose metrics ``df`` has."""
    keys = [c for c in ("host_id", "poll_id", "ts") if c in df.columns]
    points = [F.struct(F.lit(chart).alias("chart"), F.lit(line).alias("line"), F.col(metric).cast("double").alias("value"))
              for chart, lines in charts.items() for line, metric in lines if metric in df.columns]
    return df.select(*keys, F.explode(F.array(*points)).alias("p")).select(*keys, "p.chart", "p.line", "p.value")


def metrics_long(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Metric columns of one frame to (host, poll, ts, family, metric, value): all families in one pass over it."""
    points = [F.struct(F.lit(family).alias("family"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
              for family, metrics in families.items() for m in metrics]
    return df.select("host_id", "poll_id", "ts", F.inline(F.array(*points)))


def fleet_metrics_long(frames: Sequence[tuple[DataFrame, Mapping[str, Sequence[str]]]]) -> DataFrame:
    """Stack the metrics of several frames; a frame that holds many families is read once for all of them."""
    return reduce(DataFrame.unionByName, [metrics_long(df, families) for df, families in frames])


def _flag(condition: Column, rule: str, value: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")))


def _flagged(df: DataFrame, *flags: Column) -> DataFrame:
    return (df.select("host_id", "ts", F.explode(F.array_compact(F.array(*flags))).alias("a"))
            .select("host_id", "ts", "a.rule", "a.value"))


def load_alerts(samples: DataFrame, max_threads: int = MAX_THREADS, max_running: int = MAX_THREADS_RUNNING) -> DataFrame:
    """Samples over a thread threshold; stateless, so it also runs on a stream."""
    return _flagged(samples,
                    _flag(F.col("threads_connected") > max_threads, "threads", F.col("threads_connected")),
                    _flag(F.col("threads_running") > max_running, "threads_running", F.col("threads_running")))


def replica_alerts(replicas: DataFrame) -> DataFrame:
    """Replicas whose IO or SQL thread does not run; stateless."""
    return _flagged(replicas,
                    _flag(F.col("slave_io_running") != "Yes", "io_state", F.col("slave_io_running")),
                    _flag(F.col("slave_sql_running") != "Yes", "sql_state", F.col("slave_sql_running")))


def alert_flags(samples: DataFrame, replicas: DataFrame, hosts: DataFrame, now: Column, down_seconds: int) -> DataFrame:
    """Rows (host, ts, rule, value) for every broken threshold, and one per silent host."""
    seen = samples.groupBy("host_id").agg(F.max("ts").alias("ts"))
    limit = now - F.make_dt_interval(secs=F.lit(down_seconds))
    down = (hosts.where("is_deleted = 0").select("host_id").join(seen, "host_id", "left")
            .where(F.col("ts").isNull() | (F.col("ts") < limit))
            .select("host_id", "ts", F.lit("host_down").alias("rule"), F.lit("No").alias("value")))
    return load_alerts(samples).unionByName(replica_alerts(replicas)).unionByName(down)

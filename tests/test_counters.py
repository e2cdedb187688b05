from datetime import datetime

from pyspark.sql import functions as F

from fleetscope.constants import STATUS_COUNTERS, STATUS_NAMES, VARIABLE_NAMES
from fleetscope.operators import counters as C
from fleetscope.plans.inputs import Inputs
from fleetscope.sources.status import status_pivot, variables_latest

T0 = datetime(2024, 1, 1)
SCHEMA = "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, c BIGINT"


def _samples(spark, *rows):
    return spark.createDataFrame([(h, p, datetime(2024, 1, 1, 0, 0, s), c) for h, p, s, c in rows], SCHEMA)


def test_first_sample_is_null_and_reset_counts_from_zero(spark):
    df = _samples(spark, (1, 1, 0, 100), (1, 2, 4, 140), (1, 3, 8, 20), (2, 4, 0, 7))
    rows = {r.poll_id: r for r in C.counter_rates(df, ["c"]).collect()}
    assert rows[1].c_rate is None and rows[4].c_rate is None
    assert (rows[2].c_rate, rows[2].c_reset) == (10.0, 0)
    assert (rows[3].c_rate, rows[3].c_reset) == (5.0, 1)
    raw = {r.poll_id: r.d_c for r in C.counter_deltas(df, ["c"]).collect()}
    assert raw == {1: None, 2: 40, 3: -120, 4: None}


def test_no_elapsed_time_gives_no_rate(spark):
    df = _samples(spark, (1, 1, 0, 1), (1, 2, 0, 5))
    assert {r.poll_id: r.c_rate for r in C.counter_rates(df, ["c"]).collect()} == {1: None, 2: None}


def test_deltas_add_up_without_resets(spark, sf_dir):
    samples = Inputs(spark, sf_dir).counter_samples
    deltas = C.counter_deltas(samples, ["questions"]).groupBy("host_id").agg(F.sum("d_questions").alias("d"))
    ends = samples.groupBy("host_id").agg((F.max("questions") - F.min("questions")).alias("e"))
    assert deltas.join(ends, "host_id").where("d <> e").count() == 0


def test_fixed_names():
    assert len(STATUS_NAMES) == len(set(STATUS_NAMES)) == 122
    assert len(VARIABLE_NAMES) == 18
    assert len(STATUS_COUNTERS) > 75 and "Questions" in STATUS_COUNTERS


def test_pivot_then_deltas_over_all_counters(spark):
    kv = [(1, p, datetime(2024, 1, 1, 0, 0, p), n, str(k * p)) for p in (1, 2) for k, n in enumerate(STATUS_NAMES)]
    kv.append((1, 1, datetime(2024, 1, 1, 0, 0, 1), "Unlisted", "9"))
    kv.append((1, 3, datetime(2024, 1, 1, 0, 0, 3), "Questions", "not a number"))
    df = spark.createDataFrame(kv, "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, variable_name STRING, value STRING")
    wide = status_pivot(df, STATUS_NAMES)
    assert "Unlisted" not in wide.columns and wide.where("poll_id = 3").first()["Questions"] is None
    row = C.counter_deltas(wide, STATUS_COUNTERS).where("poll_id = 2").first()
    assert all(row[f"d_{n}"] == STATUS_NAMES.index(n) for n in STATUS_COUNTERS)


def test_latest_setting_wins(spark):
    df = spark.createDataFrame([(1, 1, T0, "version", "5.6"), (1, 2, T0, "version", "8.0"), (2, 1, T0, "read_only", "ON")],
                               "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, variable_name STRING, value STRING")
    got = {r.host_id: (r.version, r.read_only) for r in variables_latest(df, VARIABLE_NAMES).collect()}
    assert got == {1: ("8.0", None), 2: (None, "ON")}


def test_ratios_without_denominator(spark):
    row = (1, 1, T0) + (0,) * 9
    names = ["connections", "threads_created", "binlog_cache_use", "binlog_cache_disk_use", "buffer_pool_read_requests",
             "buffer_pool_reads", "created_tmp_tables", "created_tmp_disk_tables", "threads_connected"]
    samples = spark.createDataFrame([row], "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, " + ", ".join(f"{n} BIGINT" for n in names))
    hosts = spark.createDataFrame([(1, 0)], "host_id BIGINT, max_connections BIGINT")
    got = C.hit_ratios(samples, hosts).first()
    assert (got.thread_cache_hit, got.binlog_cache_hit, got.buffer_pool_hit, got.tmp_disk_share) == (0, 0, 0, 0)
    assert got.connections_usage_rate is None


def test_long_metrics_lose_no_value(spark, sf_dir):
    m = C.interval_metrics(Inputs(spark, sf_dir).counter_samples)
    long = C.fleet_metrics_long([(m, {"status": ["qps", "tps"]})])
    assert long.count() == 2 * m.count()
    assert long.where("metric = 'qps'").agg(F.sum("value")).first()[0] == m.agg(F.sum("qps")).first()[0]


def test_silent_host_is_down(spark):
    samples = spark.createDataFrame([(1, T0, 5, 1)], "host_id BIGINT, ts TIMESTAMP_NTZ, threads_connected BIGINT, threads_running BIGINT")
    replicas = spark.createDataFrame([(1, T0, "Yes", "Connecting")], "host_id BIGINT, ts TIMESTAMP_NTZ, slave_io_running STRING, slave_sql_running STRING")
    hosts = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "host_id BIGINT, is_deleted INT")
    got = C.alert_flags(samples, replicas, hosts, F.lit("2024-01-01 00:00:30").cast("timestamp_ntz"), 60)
    assert {(r.host_id, r.rule) for r in got.collect()} == {(1, "sql_state"), (2, "host_down")}

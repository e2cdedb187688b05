"""Streams over several micro-batches give the batch results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetscope.operators import changes
from fleetscope.operators.counters import counter_rates, latest_state
from fleetscope.plans.inputs import Inputs
from fleetscope.streaming import streams

T0 = datetime(2024, 1, 1)
SCHEMA = "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, c BIGINT"


def _poll(host, n, c):
    return (host, n, T0 + timedelta(seconds=4 * n), c)


def _feed(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_rates_carry_state_between_runs_and_drop_late_samples(spark, tmp_path):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    parts = [[_poll(1, 1, 10), _poll(1, 2, 30), _poll(2, 1, 5)], [_poll(1, 4, 50), _poll(1, 2, 999)],
             [_poll(2, 5, 45)], [_poll(1, 5, 8), _poll(2, 6, 49), _poll(3, 6, 1)]]
    for part in parts:
        _feed(spark, source, part)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streams.stream_counter_rates(stream, ["c"], out, state, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    kept = [r for part in parts for r in part if r[3] != 999]
    want = counter_rates(spark.createDataFrame(kept, SCHEMA), ["c"])
    columns = ["host_id", "poll_id", "c_rate", "c_reset", "elapsed_us"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_latest_and_running_stats_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = []
    for part in ([_poll(1, 3, 7), _poll(2, 1, 5)], [_poll(1, 2, 1)], [_poll(2, 9, 6), _poll(1, 4, 2)]):
        rows += part
        _feed(spark, source, part)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streams.stream_latest(stream, str(tmp_path / "latest"), str(tmp_path / "c1")).awaitTermination()
        streams.stream_running_stats(stream, ["c"], str(tmp_path / "stats"), str(tmp_path / "c2")).awaitTermination()
    got = streams.read_upserts(spark, str(tmp_path / "latest"), ["host_id"])
    assert sorted(got.select(*SCHEMA.split()[::2]).collect()) == sorted(
        latest_state(spark.createDataFrame(rows, SCHEMA)).select(*SCHEMA.split()[::2]).collect())
    stats = {r.host_id: (r.c_min, r.c_max, r.c_sum, r.c_count, r.c_avg)
             for r in streams.read_upserts(spark, str(tmp_path / "stats"), ["host_id"]).collect()}
    assert stats == {1: (1, 7, 10, 3, 10 / 3), 2: (5, 6, 11, 2, 5.5)}


def test_digest_updates_open_windows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = ("ts TIMESTAMP_NTZ, sql_text STRING, query_time DECIMAL(18,2), lock_time BIGINT, rows_sent BIGINT, rows_examined BIGINT, default_db STRING,"
              " user_name STRING, host_id BIGINT, query_id BIGINT")
    for n in range(2):
        _feed(spark, source, [(T0 + timedelta(seconds=60 * k), f"select {n + k}", None, k, 10 * n + k, 7, f"db{n}", "u", n, 10 * n + k) for k in range(6)], schema)
        streams.stream_slow_digest(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
    got = {r.window_start: r for r in streams.read_upserts(spark, out, ["window_start", "checksum"]).collect()}
    assert {w: r.ts_cnt for w, r in got.items()} == {T0: 10, T0 + timedelta(minutes=5): 2}
    first = got[T0]
    assert (first.first_seen, first.last_seen, first.db_max, first.serverid_max) == (T0, T0 + timedelta(minutes=4), "db1", 1)
    assert (first.rows_sent_min, first.rows_sent_max, first.rows_sent_sum, first.rows_sent_pct_95) == (0, 14, 70, 14)
    assert first.query_time_sum is None and first.query_time_pct_95 is None and first.rows_examined_pct_95 == 7


def test_alerts_are_not_repeated(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "host_id BIGINT, ts TIMESTAMP_NTZ, threads_connected BIGINT, threads_running BIGINT"
    for n in range(3):
        _feed(spark, source, [(1, T0 + timedelta(seconds=60 * n + k), 2000, 1) for k in range(3)]
              + [(2, T0 + timedelta(seconds=60 * n), 1, 1)], schema)
        streams.stream_alerts(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
    assert [(r.host_id, r.rule) for r in spark.read.parquet(out).collect()] == [(1, "threads")]


def test_stopped_threads_are_alerts_too(spark, tmp_path):
    loads = "host_id BIGINT, ts TIMESTAMP_NTZ, threads_connected BIGINT, threads_running BIGINT"
    states = "host_id BIGINT, ts TIMESTAMP_NTZ, slave_io_running STRING, slave_sql_running STRING"
    for n in range(2):
        _feed(spark, str(tmp_path / "load"), [(1, T0 + timedelta(seconds=n), 1, 6)], loads)
        _feed(spark, str(tmp_path / "replica"), [(2, T0 + timedelta(seconds=n), "No", "Yes"), (3, T0 + timedelta(minutes=30 * n), "Yes", "No")], states)
        streams.stream_alerts(spark.readStream.schema(loads).parquet(str(tmp_path / "load")), str(tmp_path / "out"), str(tmp_path / "check"),
                              replicas=spark.readStream.schema(states).parquet(str(tmp_path / "replica"))).awaitTermination()
    got = sorted((r.host_id, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "threads_running"), (2, "io_state"), (3, "sql_state"), (3, "sql_state")]


def test_silent_hosts_over_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "host_id BIGINT, ts TIMESTAMP_NTZ"

    def minute(host, m):
        return (host, T0 + timedelta(minutes=m))

    # Host 1 always answers. Host 2 falls silent for good, host 3 comes back in a later batch, host 4 within one; host 5 is silent for less.
    parts = [[minute(1, m) for m in range(30)] + [minute(2, 5), minute(3, 1), minute(4, 0), minute(4, 25), minute(5, 20)],
             [minute(1, m) for m in range(30, 60)] + [minute(5, 29)], [minute(1, m) for m in range(60, 90)] + [minute(3, 85), minute(4, 30)]]
    for part in parts:
        _feed(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_host_down(stream, out, checkpoint, 600, delay="2 minutes").awaitTermination()
    got = sorted((r.host_id, (r.ts - datetime(2024, 1, 1)).total_seconds() / 60) for r in spark.read.parquet(out).selectExpr("host_id", "cast(ts as timestamp_ntz) ts").collect())
    assert got == [(2, 15), (3, 11), (4, 10), (4, 35), (5, 39)]


def test_sync_is_idempotent_and_keeps_its_position(spark, tmp_path, sf_dir):
    events = Inputs(spark, sf_dir).binlog_events
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "target", "check"))
    pairs = spark.createDataFrame([("db1", "accounts")], "schema_name STRING, table_name STRING")
    for part in ("log_pos < 500", "log_pos >= 500 AND log_pos < 900", "log_pos >= 880"):  # the last one repeats some
        events.where(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        streams.sync_apply(stream, pairs, target, checkpoint, ["pk"]).awaitTermination()
    synced = streams.read_synced(spark, target, ["pk"])
    want = changes.table_as_of(events.where("schema_name = 'db1'"), ["pk"], F.lit(True))
    assert synced.count() == want.count() > 0
    assert synced.select(want.columns).exceptAll(want).count() == 0
    last = events.where("schema_name = 'db1'").groupBy("master_host_id").agg(F.max("log_pos").alias("p"))
    assert {(r.master_host_id, r.log_pos) for r in streams.sync_position(spark, target, ["pk"]).collect()} == {(r.master_host_id, r.p) for r in last.collect()}


def test_table_stream_reads_a_file_and_a_folder_of_files(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    counts = []
    for n, source in enumerate((sf_dir, str(tmp_path))):
        out = str(tmp_path / f"out{n}")
        stream = streams.table_stream(spark, source, "orders").select("o_orderkey")
        streams.start(stream, "append", streams.batch_sink(out), str(tmp_path / f"check{n}"), {"availableNow": True}).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts[0] == counts[1] > 0


def test_late_rows_are_counted(spark, tmp_path):
    """What comes after its window is closed is in no window, and counted; a restart counts nothing twice."""
    source, digest, counts, c1, c2 = (str(tmp_path / n) for n in ("in", "digest", "counts", "c1", "c2"))
    schema = ("ts TIMESTAMP_NTZ, sql_text STRING, query_time DECIMAL(18,2), lock_time BIGINT, rows_sent BIGINT, rows_examined BIGINT, default_db STRING,"
              " user_name STRING, host_id BIGINT, query_id BIGINT")

    def row(minutes, n):
        return (None if minutes is None else T0 + timedelta(minutes=minutes), "select 1", None, 1, 1, 1, "d", "u", 1, n)

    # The third part is two hours late, on the day before and on the same day; the watermark has passed it by then.
    for part in ([row(0, 1), row(180, 2)], [row(181, 3), row(None, 4)], [row(-60, 5), row(60, 6), row(62, 7), row(182, 8)]):
        _feed(spark, source, part, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        for _ in range(2):
            streams.stream_slow_digest(stream, digest, c1).awaitTermination()
            streams.stream_row_counts(stream, counts, c2).awaitTermination()
    got = {str(r.day): (r.n_rows, r.n_in_windows, r.n_late) for r in streams.late_rows(spark, digest, counts).collect()}
    assert got == {"2024-01-01": (6, 4, 2), "2023-12-31": (1, 0, 1), "None": (1, 0, 1)}

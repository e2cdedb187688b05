from datetime import date, datetime

from pyspark.sql import functions as F

from fleetscope.operators import backups as B
from fleetscope.operators import replication as R


def test_roles(spark):
    hosts = spark.createDataFrame([(n, f"h{n}", f"u{n}") for n in range(1, 7)], "host_id BIGINT, remark STRING, server_uuid STRING")
    listed = spark.createDataFrame([(1, "u2"), (1, None), (2, "u3"), (4, None), (5, "gone")], "host_id BIGINT, slave_uuid STRING")
    replicas = spark.createDataFrame([(2,), (3,), (6,)], "host_id BIGINT")
    got = {r.host_id: (r.role, r.master_host_id) for r in R.topology(hosts, listed, replicas).collect()}
    assert got == {1: ("M", None), 2: ("MS", 1), 3: ("S", 2), 4: ("S", None), 5: ("M", None), 6: ("S", None)}


REPLICA = ("host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, master_host_id BIGINT, slave_io_running STRING, slave_sql_running STRING,"
           " master_log_file STRING, relay_master_log_file STRING, read_master_log_pos BIGINT, exec_master_log_pos BIGINT, seconds_behind_master BIGINT")


def test_health_takes_the_nearest_earlier_master_poll(spark):
    def at(s):
        return datetime(2024, 1, 1, 0, 0, s)

    replicas = spark.createDataFrame([(2, 1, at(5), 1, "Yes", "Yes", "a", "a", 100, 90, None), (2, 2, at(10), 1, "Yes", "Yes", "b", "a", 5, 90, 3),
                                      (3, 1, at(5), 1, "Yes", "Yes", "a", "a", 7, 7, 0), (4, 1, at(5), None, "Yes", "Yes", "a", "a", 7, 7, 0),
                                      (2, 0, at(1), 1, "Yes", "Yes", "a", "a", 9, 9, 0)], REPLICA)
    positions = spark.createDataFrame([(1, 1, at(2), "a", 50), (1, 2, at(5), "a", 60), (1, 3, at(11), "b", 70), (9, 1, at(4), "z", 1)],
                                      "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, log_file STRING, log_pos BIGINT")
    got = {(r.host_id, r.poll_id): (r.delay_pos_count, r.seconds_behind_master, r.new_master_log_pos)
           for r in R.replication_health(replicas, positions).collect()}
    assert got == {(2, 0): (0, 0, None), (2, 1): (10, 0, 60), (2, 2): (None, 3, 60), (3, 1): (0, 0, 60), (4, 1): (0, 0, None)}


def test_failover(spark):
    replicas = spark.createDataFrame([(1, 9, "Yes", "Yes"), (2, 8, "Yes", "Yes"), (3, 9, "Yes", "No"), (4, None, "Yes", "Yes")],
                                     "host_id BIGINT, master_host_id BIGINT, slave_io_running STRING, slave_sql_running STRING")
    expected = spark.createDataFrame([(n, 9) for n in range(1, 5)], "host_id BIGINT, expected_master BIGINT")
    got = {r.host_id: (r.wrong_source, r.stopped) for r in R.failover_check(replicas, expected).collect()}
    assert got == {2: (1, 0), 3: (0, 1), 4: (1, 0)}


def test_several_locks_fan_out(spark):
    trx = spark.createDataFrame([(h, n, state, "RR", 10 * h + n, q) for h in (1, 2) for n, state, q in ((1, "RUNNING", "a"), (2, "LOCK WAIT", "b"))],
                                "host_id BIGINT, trx_id BIGINT, trx_state STRING, trx_isolation_level STRING, trx_mysql_thread_id BIGINT, trx_query STRING")
    locks = spark.createDataFrame([(1, 1, "X", "RECORD", "t", "PRIMARY"), (1, 1, "X", "RECORD", "t", "PRIMARY"), (1, 2, "S", "RECORD", "t", "PRIMARY"), (2, 1, "X", "RECORD", "u", "i")],
                                  "host_id BIGINT, lock_trx_id BIGINT, lock_mode STRING, lock_type STRING, lock_table STRING, lock_index STRING")
    waits = spark.createDataFrame([(1, 2, 1)], "host_id BIGINT, requesting_trx_id BIGINT, blocking_trx_id BIGINT")
    # Transaction 1 of the other server has the same number and nobody waits for it.
    assert [(r.host_id, r.blocking_thread, r.blocking_lock_table) for r in R.lock_waits(trx, locks, waits).collect()] == [(1, 11, "t")] * 2
    assert R.lock_waits(trx, locks, waits, distinct=True).count() == 1
    assert {(r.host_id, r.name, r.total) for r in R.trx_lock_counts(trx, waits).collect()} == {(1, "trx", 2), (1, "lock_waits", 1), (2, "trx", 2), (2, "lock_waits", 0)}


def test_chains_long_shared_and_cyclic(spark):
    chain = [(1, n, n - 1) for n in range(2, 40)]
    more = [(1, 100, 5), (1, 100, 7), (1, 201, 202), (1, 202, 203), (1, 203, 201), (1, 204, 203)]
    # On another server the same numbers form a shorter chain, and no cycle.
    other = [(2, 3, 2), (2, 201, 3)]
    waits = spark.createDataFrame(chain + more + other, "host_id BIGINT, requesting_trx_id BIGINT, blocking_trx_id BIGINT")
    got = {(r.host_id, r.requesting_trx_id, r.blocking_trx_id): r for r in R.lock_chains(waits).collect()}
    assert len(got) == len(chain) + 8
    assert all((got[1, n, n - 1].root_trx_id, got[1, n, n - 1].depth, got[1, n, n - 1].in_cycle) == (1, n - 1, 0) for _, n, _ in chain)
    assert (got[1, 100, 7].root_trx_id, got[1, 100, 7].depth, got[1, 100, 5].depth) == (1, 7, 5)
    assert got[1, 39, 38].root_waiters == 39
    for edge in ((201, 202), (202, 203), (203, 201), (204, 203)):
        assert got[1, *edge].in_cycle == 1 and got[1, *edge].root_trx_id is None and got[1, *edge].depth is None
    assert [(r.root_trx_id, r.depth, r.root_waiters) for r in (got[2, 3, 2], got[2, 201, 3])] == [(2, 1, 2), (2, 2, 2)]


def test_gtid_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a:1-5,\nb:1-3:5-9:11"), (2, 1, "")], "host_id BIGINT, poll_id BIGINT, executed_gtid_set STRING")
    assert {(r.source, r.ranges, r.gaps) for r in R.gtid_list(df).collect()} == {("a", 1, 0), ("b", 3, 2)}


LOG = "host_id BIGINT, line_no BIGINT, mode STRING, is_ok INT, backup_dir STRING, backup_date DATE, start_time STRING, stop_time STRING"


def _log(spark, host, *entries):
    return spark.createDataFrame([(host, n, m, ok, f"/{n}" if m else None, date(2024, 1, n) if m else None, "2024-01-01_03-00-00", "2024-01-01_03-10-00")
                                  for n, (m, ok) in enumerate(entries, 1)], LOG)


def _chain(spark, *entries):
    return [(r.line_no, r.apply_order, r.redo_only) for r in B.restore_chain(_log(spark, 1, *entries)).orderBy("apply_order").collect()]


def test_restore_chain(spark):
    full, inc = ("1", 1), ("2", 1)
    assert _chain(spark, inc, full, inc, full, inc, inc) == [(4, 1, 1), (5, 2, 1), (6, 3, 0)]
    assert _chain(spark, full) == [(1, 1, 1)]
    assert _chain(spark, full, inc, ("2", 0), inc) == [(1, 1, 1), (2, 2, 0)]
    assert _chain(spark, full, inc, ("1", 0), inc) == [(1, 1, 1), (2, 2, 0)]
    assert _chain(spark, full, (None, None), inc) == [(1, 1, 1)]
    assert _chain(spark, ("1", 0), inc) == []


def test_increment_without_an_entry_before_it_is_full(spark):
    got = {r.line_no: (r.base_dir, r.taken_as) for r in B.backup_base(_log(spark, 1, ("2", 1), ("2", 0), (None, None), ("2", 1))).collect()}
    assert got == {1: (None, "full"), 2: ("/1", "increment"), 4: (None, "full")}


def test_policy_outcomes_and_retention(spark):
    # 2024-01-07 is a Sunday.
    log = _log(spark, 1, *[("2", 1)] * 5, (None, None), ("2", 1), ("1", 0))
    got = {r.backup_date.day: r.problem for r in B.backup_policy_audit(log).collect()}
    assert got == {6: "missing", 7: "full expected", 8: "increment expected"}
    outcome = {r["mode"]: (r.backups, r.failures, r.seconds) for r in B.backup_outcomes(log).collect()}
    assert outcome == {"1": (1, 1, 600), "2": (6, 0, 3600)}
    old = B.expired_backups(log, F.lit("2024-01-17").cast("date"))
    assert {r.backup_date.day: r.age_days for r in old.collect()} == {1: 16, 2: 15}

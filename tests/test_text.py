import re
from datetime import datetime

from pyspark.sql import functions as F

from fleetscope.plans.inputs import Inputs
from fleetscope.sources import engine_text, logs, os_text
from fleetscope.sources.status import status_pivot
from fleetscope.streaming import streams

T0 = datetime(2024, 1, 1)
STATUS = "host_id BIGINT, poll_id BIGINT, ts TIMESTAMP_NTZ, status STRING"


def _status(spark, *texts):
    return spark.createDataFrame([(1, n, T0.replace(minute=n), t) for n, t in enumerate(texts)], STATUS)


def test_sections_restart_and_drop_blank_and_leading_lines(spark):
    text = "intro\nLOG\nold\n\nSEMAPHORES\nTRANSACTIONS\na\n\n\nb\nLOG\nnew\nnot a header LOG\n"
    got = {(r.section, r.line_no): r.line for r in engine_text.status_sections(_status(spark, text)).collect()}
    assert got == {("TRANSACTIONS", 0): "a", ("TRANSACTIONS", 1): "b", ("LOG", 0): "new", ("LOG", 1): "not a header LOG"}


def test_restarted_section_may_be_empty(spark):
    text = "LOG\nLog sequence number 10\nROW OPERATIONS\nx\nLOG\nEND OF INNODB MONITOR OUTPUT"
    assert {r.section for r in engine_text.status_sections(_status(spark, text)).collect()} == {"ROW OPERATIONS"}
    assert engine_text.lsn_gaps(_status(spark, text)).first().log_lsn is None


def test_sections_cut_the_text_once(spark):
    """One pattern finds the headers, and no filter moved below an exchange repeats the cut (F9, round 3)."""
    texts = _status(spark, "x\nLOG\n\na\r\n\n\nLOG\r\nb\n \nSEMAPHORES", "LOG", "\nLOG\n\n", None).repartition(2, "poll_id")
    found = engine_text.status_sections(texts)
    assert [(r.section, r.line_no, r.line) for r in found.orderBy("line_no").collect()] == [("LOG", 0, "a\r"), ("LOG", 1, "LOG\r"), ("LOG", 2, "b"), ("LOG", 3, " ")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_numbers_in_text(spark):
    # Sample lines in the forms the servers print.
    first = ("SEMAPHORES\nx\nMutex spin waits 1200034, rounds 8800210, OS waits 410020\n"
             "RW-shared spins 730011, rounds 9120044, OS waits 65011\n"
             "RW-excl spins 220017, rounds 4410023, OS waits 31007\n"
             "INSERT BUFFER AND ADAPTIVE HASH INDEX\nIbuf: size 1, free list len 7001, seg size 7003, 90210 merges\n"
             "merged operations:\n insert 51022, delete mark 33105, delete 4077\n"
             "320.00 hash searches/s, 80.00 non-hash searches/s\n---\n")
    second = first.replace("410020", "410030").replace("90210", "90216").replace("33105", "33198")
    df = _status(spark, first, second)
    rows = engine_text.engine_text_deltas(df).orderBy("poll_id").collect()
    assert rows[0].mutex_os_waits is None
    assert (rows[1].mutex_os_waits, rows[1].ibuf_merges, rows[1].ibuf_merged_delete_marks, rows[1].trx_id) == (10, 6, 93, None)
    assert engine_text.hash_search_ratio(df).first().hash_search_ratio == 80.0


def test_hash_ratio_of_nothing_is_zero(spark):
    text = "INSERT BUFFER AND ADAPTIVE HASH INDEX\n0.00 hash searches/s, 0.00 non-hash searches/s\n---\n"
    assert engine_text.hash_search_ratio(_status(spark, text)).first().hash_search_ratio == 0


def test_deadlock_shown_again_is_no_new_event(spark):
    def shown(name):
        return "LATEST DETECTED DEADLOCK\n---\n" + "\n".join(f"{name}{n}" for n in range(6)) + "\nTRANSACTIONS\nx"

    quiet = "LATEST DETECTED DEADLOCK\n---\nTRANSACTIONS\nx"
    got = engine_text.deadlock_events(_status(spark, quiet, shown("a"), shown("a"), shown("b"), quiet, shown("b"), shown("a")))
    assert sorted(r.poll_id for r in got.collect()) == [1, 3, 6]


def test_device_columns_by_name_in_the_last_report(spark):
    lines = ["Device: %util r/s", "sda 99 99", "Device: r/s w/s await %util", "sda 1.5 2 0.5 10", "sdb 2.5 3 0.5 1.25"]
    df = spark.createDataFrame([(1, 1, "iostat", n, t) for n, t in enumerate(lines)],
                               "host_id BIGINT, poll_id BIGINT, kind STRING, line_no INT, line STRING")
    r = os_text.os_io(df).first()
    assert (r.io_qps, r.io_tps, r.io_util, r.io_await, r.io_svctm, r.io_read) == (4, 5, 11.25, 1.0, 0.0, 0)


def test_all_os_metrics_in_one_row_a_poll(spark):
    """One reading gives what the single parsers give; missing commands are null, a repeated command counts by its last line."""
    full = [("loadavg", "0.1 0.2 0.3 1/2 3"), ("loadavg", "0.4 0.5 0.6 1/2 3"), ("meminfo", "MemFree: 2 kB"), ("meminfo", "Cached: x kB"), ("df", "head"),
            ("df", "/dev/a 3145728 1 2 40% /"), ("df", "tmpfs 9999999 1 2 99% /run"), ("sar", "Average: eth0 1.5 2 3 4"), ("iostat", "Device: %util r/s"),
            ("iostat", "sda 99 99"), ("iostat", "Device: r/s %util"), ("iostat", "sda 1.5 10"), ("iostat", None), ("cpu", "avg-cpu: %user"), ("cpu", "7 0 2 1 0 90"),
            ("pid", "42"), ("top", "42 m 20 0 9g 2g 1m S 3.5 4.5"), ("top", "43 m 20 0 9g 2g 1m S 9 9"), ("other", "1 2 3")]
    rows = [(1, 1, k, n, t) for n, (k, t) in enumerate(full)] + [(1, 2, "pid", 1, "42"), (2, 1, "top", 1, "42 m 20 0 9g 2g 1m S 3.5 4.5"), (None, 3, "iostat", 5, "sda 1 2")]
    df = spark.createDataFrame([(h, p, n, t, k) for h, p, k, n, t in rows], "host_id BIGINT, poll_id BIGINT, line_no INT, line STRING, kind STRING")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("pid", F.lit("clash"))
    out = os_text.os_metrics(df)
    got = {(r.host_id, r.poll_id): r.asDict() for r in out.collect()}
    assert len(got) == out.count() == 4
    r = got[1, 1]
    assert (r["cpu_1"], r["cpu_15"], r["memory_free"], r["memory_free_total"], r["memory_total"]) == (0.4, 0.6, 2048, 2048, None)
    assert (r["disk_value"], r["total_disk_value"], r["net_receive_packet"], r["net_send_byte"]) == (40, 3, 1.5, 4096.0)
    assert (r["io_qps"], r["io_util"], r["io_tps"], r["cpu_user"], r["cpu_idle"], r["mysql_cpu"], r["mysql_memory"]) == (1, 10.0, 0, 7.0, 90.0, 3.5, 4.5)
    for key in [(1, 2), (2, 1), (None, 3)]:
        assert all(v is None for c, v in got[key].items() if c not in ("host_id", "poll_id", "ts"))
    single = os_text.os_cpu_process(df).unionByName(os_text.os_cpu_process(df.limit(0)))
    assert [(s.host_id, s.poll_id, s.mysql_cpu) for s in single.collect()] == [(1, 1, 3.5)]
    assert os_text.os_metrics(df.limit(0)).count() == 0


def test_os_metrics_need_one_exchange(spark, sf_dir):
    plan = os_text.os_metrics(Inputs(spark, sf_dir).os_text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("FileScan") == 1


def test_os_lines_are_spread_and_exchanged_unsplit(spark, sf_dir):
    """Polls are dealt out before each becomes many lines, and lines are split behind the exchange (F3 and F10, round 3)."""
    text = Inputs(spark, sf_dir).os_text
    plan = os_text.os_metrics(text)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    lines = below[:below.index("Generate")]
    assert "AS f#" not in lines and "RoundRobinPartitioning" in below[below.index("Generate"):]
    assert text.count() == 24 * spark.read.parquet(f"{sf_dir}/events.parquet").count()


SLOW_LOG = """/usr/sbin/mysqld, Version: 8.0
# Time: 2024-01-01T00:00:01
# User@Host: app[app] @ web [10.0.0.1]
# Query_time: 2.5  Lock_time: 0.1  Rows_sent: 3  Rows_examined: 400
use shop;
SET timestamp=1704067201;
select *
from orders
where note = 'a;b';
# Time: 2024-01-01T00:00:05
# User@Host: serverdev_x[x] @ web []
# Query_time: 9.0  Lock_time: 0.0  Rows_sent: 0  Rows_examined: 0
SET timestamp=1704067205;
select 1;
# User@Host: batch[batch] @ web []
# Query_time: 3.0  Lock_time: 0.0  Rows_sent: 1  Rows_examined: 1
SET timestamp=1704067206;
update t set a = 1;
"""


def _check_slow_rows(df):
    rows = {r.user_name: r for r in df.collect()}
    assert set(rows) == {"app", "batch"}
    r = rows["app"]
    assert r.sql_text == "select *\nfrom orders\nwhere note = 'a;b'"
    assert (r.db, r.epoch, r.query_time, r.lock_time, r.rows_sent, r.rows_examined) == ("shop", 1704067201, 2.5, 0.1, 3, 400)
    assert rows["batch"].db is None and rows["batch"].sql_text == "update t set a = 1"


def test_slow_log_files(spark, tmp_path):
    (tmp_path / "a.slow").write_text(SLOW_LOG)
    _check_slow_rows(logs.slow_log_ingest(logs.read_slow_log(spark, str(tmp_path))))


def test_slow_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.slow").write_text(SLOW_LOG)
    rows = logs.slow_log_ingest(logs.read_slow_log(spark, str(tmp_path / "in"), stream=True))
    streams.start(rows, "append", streams.batch_sink(str(tmp_path / "out")), str(tmp_path / "check")).awaitTermination()
    _check_slow_rows(spark.read.parquet(str(tmp_path / "out")))


def test_slow_log_lines(spark, tiny_groups):
    rows = [("a.slow", n, t) for n, t in enumerate(SLOW_LOG.splitlines())]
    lines = spark.createDataFrame(rows, "log_file STRING, line_no BIGINT, line STRING").repartition(5)
    _check_slow_rows(logs.slow_log_ingest(logs.slow_log_records(lines)))


def test_change_text(spark):
    text = ["# at 4", "### UPDATE `s`.`t`", "### WHERE", "###   @1=1", "###   @2='it is' /* VARSTRING(20) */", "### SET",
            "###   @1=1", "###   @2=NULL", "### DELETE FROM `s`.`t`", "### WHERE", "###   @1=7"]
    lines = spark.createDataFrame([(0, "f", 10, n, t) for n, t in enumerate(text)], "master_host_id BIGINT, log_file STRING, log_pos BIGINT, line_no INT, line STRING")
    update, delete = sorted(logs.change_text_decode(lines).collect(), key=lambda r: r.op, reverse=True)
    assert (update.op, update.before, update.after) == ("update", {1: "1", 2: "it is"}, {1: "1", 2: None})
    assert (delete.op, delete.before, delete.after, delete.table_name) == ("delete", {1: "7"}, None, "t")


def test_change_log_files(spark, tmp_path):
    """Positions, times and servers come from the text; files are cut inside events; preambles and other events give nothing."""
    def event(pos, *rows):
        return f"# at {pos}\n#240105  9:30:0{pos % 10} server id 3  end_log_pos {pos + 90} CRC32 0x1 \tUpdate_rows: table id 8\n" + "".join(rows)

    def insert(k):
        return f"### INSERT INTO `s`.`t`\n### SET\n###   @1={k} /* INT meta=0 */\n###   @2='# at {k} \\x0a'\n"

    update = "### UPDATE `s`.`u`\r\n### WHERE\r\n###   @1=1\r\n### SET\r\n###   @1=NULL\r\n"
    for n, name in enumerate(["log.000001", "log.000002"]):
        body = "".join(event(100 * k, insert(k), insert(-k)) for k in range(1, 200)) + event(50_000, update) + "# at 50100\n#240105 server id 3 Xid\nCOMMIT/*!*/;\n"
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes((("DELIMITER /*!*/;\n" if n else "") + body).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        got = logs.read_change_log(spark, str(tmp_path / "in"))
        assert got.rdd.getNumPartitions() > 20
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(f, 100 * k, r, v) for f in ("log.000001", "log.000002") for k in range(1, 200) for r, v in ((0, str(k)), (1, str(-k)))}
    assert {(r.log_file, r.log_pos, r.row_no, r.after[1]) for r in rows if r.op == "insert"} == want and len(rows) == len(want) + 2
    assert all(r.after[2].startswith("# at ") for r in rows if r.op == "insert")
    last = [r for r in rows if r.op == "update"]
    assert [(r.master_host_id, r.log_pos, str(r.ts), r.before, r.after, r.table_name) for r in last] == [(3, 50_000, "2024-01-05 09:30:00", {1: "1"}, {1: None}, "u")] * 2
    query = (logs.read_change_log(spark, str(tmp_path / "in"), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_backup_lines(spark):
    lines = spark.createDataFrame([
        (1, 1, "1:/d:/l:s:e:2024-01-01:1:full"), (1, 2, "2:/d:f:l:s:e:2024-01-02:0:1:0"), (1, 3, "garbage"), (1, 4, "1:/d:/l:s:e:someday:1:x")],
        "host_id BIGINT, line_no BIGINT, line STRING")
    a, b, c, d = logs.backup_log_parse(lines).orderBy("line_no").collect()
    assert (a.mode, a.is_ok, a.dir_name, a.backup_file) == ("1", 1, "full", None)
    assert (b.mode, b.is_ok, b.backup_file, b.stream, b.compress, b.dir_name) == ("2", 0, "f", "1", "0", None)
    assert c.bad_record == "garbage" and c.mode is None and c.is_ok is None
    assert d.backup_date is None and d.bad_record is None
    assert logs.backup_log_parse(lines).where(F.col("bad_record").isNotNull()).count() == 1


def test_cpu_lines_are_exchanged_as_numbers(spark):
    """The last pid counts, a pid that cannot be read names no process, polls without a CPU line go; texts are not shuffled."""
    cpu, top = "  5.5 0.0 2.0 0.5 0.0 90.0", "{} m 20 0 9g 2g 10m S {} 12.5 10:00 mysqld"
    rows = [(1, 1, "cpu", 1, "avg-cpu: %user"), (1, 1, "cpu", 2, cpu), (1, 1, "pid", 1, "7"), (1, 1, "pid", 2, "8"), (1, 1, "top", 1, top.format(7, 1.0)),
            (1, 1, "top", 2, top.format(8, 2.0)), (1, 1, "top", 3, top.format(8, 3.0)), (1, 2, "cpu", 2, cpu), (1, 2, "pid", 1, "x"),
            (1, 2, "top", 1, top.format("x", 4.0)), (1, 3, "pid", 1, "7"), (1, 3, "top", 1, top.format(7, 1.0)), (None, 1, "cpu", 2, cpu)]
    out = os_text.os_cpu_process(spark.createDataFrame(rows, "host_id BIGINT, poll_id BIGINT, kind STRING, line_no INT, line STRING"))
    assert {(r.host_id, r.poll_id): (r.cpu_user, r.cpu_idle, r.mysql_cpu) for r in out.collect()} == {
        (1, 1): (5.5, 90.0, 3.0), (1, 2): (5.5, 90.0, None), (None, 1): (5.5, 90.0, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffled = plan[plan.index("Exchange"):].split("Project", 1)[1].splitlines()[0].split("]")[0]
    assert "split_line#" in shuffled and not re.search(r"\b(line|f)#", shuffled)


def test_poll_lines_become_one_row_before_they_are_shuffled(spark):
    kv = spark.createDataFrame([(1, 1, 1, "a", "5"), (1, 1, 1, "a", "7"), (1, 1, 1, "b", "ON"), (1, 1, 1, "c", "1"), (None, 2, 1, "b", "x")],
                               "host_id BIGINT, poll_id BIGINT, ts BIGINT, variable_name STRING, value STRING")
    out = status_pivot(kv, ["a", "b", "gone"])
    assert {(r.host_id, r.poll_id, r.a, r.b, r.gone) for r in out.collect()} == {(1, 1, 7, 1, None), (None, 2, None, None, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and plan.index("Exchange") < plan.rindex("HashAggregate")

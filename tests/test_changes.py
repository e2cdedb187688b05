import re
from datetime import datetime

from pyspark.sql import functions as F

from fleetscope.operators import changes as C
from fleetscope.plans.inputs import Inputs

EVENTS = ("master_host_id BIGINT, log_file STRING, log_pos BIGINT, ts TIMESTAMP_NTZ, schema_name STRING, table_name STRING, pk BIGINT, op STRING,"
          " before_note STRING, after_note STRING")

STOPPED = ("host_id BIGINT, poll_id BIGINT, master_host_id BIGINT, slave_sql_running STRING, last_sql_errno INT, relay_master_log_file STRING,"
           " exec_master_log_pos BIGINT, last_sql_error STRING")


def _events(spark, *rows):
    return spark.createDataFrame([(0, "f", p, datetime(2024, 1, 1, 0, 0, p), "s", "t", k, op, b, a) for p, k, op, b, a in rows], EVENTS)


def test_statements_quote_and_use_is_null(spark):
    df = _events(spark, (1, 1, "insert", None, "it's \\ 5"), (2, 1, "update", "it's", None), (3, 1, "delete", None, None))
    forward = [r.sql for r in C.change_to_sql(df, ["pk"]).orderBy("log_pos").collect()]
    assert forward == ["INSERT INTO `s`.`t` (`pk`, `note`) VALUES (1, 'it''s \\\\ 5');",
                       "UPDATE `s`.`t` SET `pk`=1, `note`=NULL WHERE `pk`=1 AND `note`='it''s';",
                       "DELETE FROM `s`.`t` WHERE `pk`=1 AND `note` IS NULL;"]
    back = [r.sql for r in C.flashback_sql(df, ["pk"]).collect()]
    assert back == ["INSERT INTO `s`.`t` (`pk`, `note`) VALUES (1, NULL);",
                    "UPDATE `s`.`t` SET `pk`=1, `note`='it''s' WHERE `pk`=1 AND `note` IS NULL;",
                    "DELETE FROM `s`.`t` WHERE `pk`=1 AND `note`='it''s \\\\ 5';"]


def _apply(table, statements):
    """Replay statements of the form this module writes on a dict; only for tests."""
    for sql in statements:
        pk = int(re.search(r"VALUES \((\d+)|WHERE `pk`=(\d+)", sql).group(1) or re.search(r"WHERE `pk`=(\d+)", sql).group(1))
        if sql.startswith("DELETE"):
            del table[pk]
        else:
            value = re.search(r"VALUES \(\d+, (.*)\);$", sql) or re.search(r"SET `pk`=\d+, `note`=(.*) WHERE", sql)
            table[pk] = value.group(1)
    return table


def test_flashback_after_forward_restores_the_start(spark):
    df = _events(spark, (1, 1, "insert", None, "a"), (2, 2, "insert", None, "b"), (3, 1, "update", "a", "c"), (4, 2, "delete", "b", None),
                 (5, 1, "update", "c", "d"), (6, 3, "insert", None, "e"))
    forward = [r.sql for r in C.change_to_sql(df, ["pk"]).orderBy("log_pos").collect()]
    end = _apply({}, forward)
    assert end == {1: "'d'", 3: "'e'"}
    assert _apply(end, [r.sql for r in C.flashback_sql(df, ["pk"]).collect()]) == {}


def test_as_of_and_rewind_agree(spark, sf_dir):
    events = Inputs(spark, sf_dir).binlog_events
    at = F.expr("log_pos <= 700")
    then = {(r.master_host_id, r.pk): r.amt for r in C.table_as_of(events, ["pk"], at).collect()}
    now = {(r.master_host_id, r.pk): r.amt for r in C.table_as_of(events, ["pk"], F.lit(True)).collect()}
    for r in C.table_rewind(events, ["pk"], ~at).collect():
        if r.op == "delete":
            now.pop((r.master_host_id, r.pk), None)
        else:
            now[r.master_host_id, r.pk] = r.amt
    assert now == then


def test_end_state_is_the_last_change_that_is_no_delete(spark, sf_dir):
    events = Inputs(spark, sf_dir).binlog_events
    last = {}
    for r in events.orderBy("log_pos").collect():
        last[r.master_host_id, r.pk] = (r.op, r.after_amt)
    assert {(r.master_host_id, r.pk): r.amt for r in C.table_as_of(events, ["pk"], F.lit(True)).collect()} == {
        k: amt for k, (op, amt) in last.items() if op != "delete"}


def test_repair_takes_the_range_of_the_error_over_bucket_borders(spark):
    events = _events(spark, *[(p, p, "insert", None, "x") for p in range(1, 8)]).withColumn("log_pos", F.col("log_pos") + C.POSITIONS_PER_BUCKET - 4)
    at = C.POSITIONS_PER_BUCKET
    stopped = spark.createDataFrame(
        [(1, 1, 0, "No", 1062, "f", at - 2, f"failed; end_log_pos {at + 1}"), (2, 1, 0, "No", 1045, "f", at - 2, f"denied; end_log_pos {at + 1}"),
         (3, 1, 0, "Yes", 1032, "f", at - 2, f"old {at + 1}"), (4, 1, 0, "No", 1032, "g", at - 2, f"other file {at + 1}"),
         (5, 1, 7, "No", 1032, "f", at - 2, f"other master {at + 1}")], STOPPED)
    got = C.repair_sql(stopped, events, ["pk"]).collect()
    assert sorted((r.host_id, r.log_pos) for r in got) == [(1, at - 1), (1, at), (1, at + 1)]
    assert got[0].sql.startswith("DELETE FROM `s`.`t` WHERE `pk`=")


def test_repair_inserts_the_before_image_of_an_update(spark):
    events = _events(spark, (2, 5, "update", "old", "new"))
    stopped = spark.createDataFrame([(1, 1, 0, "No", 1032, "f", 1, "x 2")], STOPPED)
    assert C.repair_sql(stopped, events, ["pk"]).first().sql == "INSERT INTO `s`.`t` (`pk`, `note`) VALUES (5, 'old');"


def test_slice_bounds_are_optional(spark):
    df = _events(spark, *[(p, 1, "update", "a", "b") for p in range(1, 6)])
    assert C.change_slice(df).count() == 5
    assert C.change_slice(df, "f", 3, start=F.lit("2024-01-01 00:00:02").cast("timestamp_ntz")).count() == 2
    assert C.change_slice(df, "other").count() == 0
    assert [r.log_pos for r in C.change_slice(df, "f", 4, start_pos=2).orderBy("log_pos").collect()] == [2, 3, 4]
    assert C.change_slice(df, master=1).count() == 0


def test_files_are_in_the_order_of_their_numbers(spark):
    df = _events(spark, *[(p, 1, "update", str(p), str(p + 1)) for p in range(1, 3)])
    df = df.withColumn("log_file", F.when(F.col("log_pos") == 1, "bin.999999").otherwise("bin.1000000"))
    assert C.table_as_of(df, ["pk"], F.lit(True)).first().note == "3"
    assert C.table_as_of(df, ["pk"], C.reached("bin.999999", 5)).first().note == "2"
    assert C.change_slice(df, "bin.999999", stop_file="bin.1000000").count() == 2
    assert [r.log_pos for r in C.flashback_sql(df, ["pk"]).collect()] == [2, 1]
    assert C.change_lag(df).where("position_gap = 1").first().log_file == "bin.1000000"


def test_a_second_master_changes_nothing_of_the_first(spark, sf_dir):
    one = Inputs(spark, sf_dir).binlog_events.where("master_host_id = 1")
    both = one.union(one.withColumn("master_host_id", F.lit(5).cast("bigint")))
    for run in (lambda e: C.table_as_of(e, ["pk"], F.lit(True)), lambda e: C.table_rewind(e, ["pk"], ~C.reached("bin.000000000000", 300)),
                lambda e: C.change_stats(e, ["pk"]), C.change_lag, lambda e: C.flashback_sql(e, ["pk"])):
        want = run(one)
        got = run(both).where("master_host_id = 1")
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0

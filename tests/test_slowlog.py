from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import format as fmt
from fleetscope.functions.sql_text import sql_fingerprint, sql_tables
from fleetscope.operators import slowlog as S

TABLES = [
    ("select * from a, b x, `s`.`c` as y where 1", ["d.a", "d.b", "s.c"]),
    ("SELECT * FROM (select id from inner_t) t JOIN t2 ON 1", ["d.inner_t", "d.t2"]),
    ("insert into audit.log (a) values ('from fake')", ["audit.log"]),
    ("update T set a = 1;", ["d.t"]),
    ("select 1 from dual", []),
    ("insert into t values (1) on duplicate key update n = 2", ["d.t"]),
    ("select * from t; ", ["d.t"]),
    ("select * from (select * from t)", ["d.t"]),
    ("select 1", []),
    ("select \"from x\", 'it\"s from y' from t", ["d.t"]),
]


@pytest.mark.parametrize("text,names", TABLES)
def test_tables_of_a_statement(spark, text, names):
    df = spark.createDataFrame([(text,)], "q STRING").select(sql_tables("q", F.lit("d")).alias("t"))
    assert sorted(df.first().t) == sorted(names)


@pytest.mark.parametrize("text,fingerprint", [
    ("select /* it's */ a -- b\nfrom t # c\nwhere x = 0xFF and y = 1.5e-3", "select a from t where x = ? and y = ?"),
    ("select '/* no */ -- x', \"#\" from t where a = -5 and b in (-1, +2)", "select ?, ? from t where a = ? and b in (?+)"),
    ("select a-1 from t where c = x'0F'", "select a-? from t where c = ?"),
    ("SELECT  *\nFROM t WHERE a = 12 AND b = 'x''y' AND c IN (1, 2,3)", "select * from t where a = ? and b = ? and c in (?+)"),
    ("insert into t values (1, 'a\\'b'), (2, \"c\")", "insert into t values (?+), (?+)"),
    ("select \"it's\", 'say \"no\"' from t -- 7", "select ?, ? from t"),
    ("select t1.c from t1 limit 5", "select t1.c from t1 limit ?"),
])
def test_fingerprint(spark, text, fingerprint):
    assert spark.createDataFrame([(text,)], "q STRING").select(sql_fingerprint("q")).first()[0] == fingerprint


def test_statements_of_any_length(spark):
    values = ", ".join(str(n) for n in range(200_000))
    literal = "x''\\'y" * 100_000
    names = ", ".join(f"t{n} a{n}" for n in range(20_000))
    df = spark.createDataFrame([(f"select 1 from t where a in ({values}) and b = '{literal}'", f"select 1 from {names} where 1")], "q STRING, p STRING")
    r = df.select(sql_fingerprint("q").alias("f"), sql_tables("q", F.lit("d")).alias("t"), F.size(sql_tables("p", F.lit("d"))).alias("n")).first()
    assert r.f == "select ? from t where a in (?+) and b = ?" and r.t == ["d.t"] and r.n == 20_000


BYTES = [(0, "0"), (5, "5B"), (1023, "1023B"), (1024, "1KB"), (2047, "1KB"), (1048576, "1M"), (1073741824, "1.0G"),
         (1610612736, "1.5G"), (1099511627776, "1.0T"), (1125899906842624, None), (None, None)]


def _format(spark, fn, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "n BIGINT").select(fn("n")).collect()]


def test_human_bytes(spark):
    assert _format(spark, fmt.human_bytes, [n for n, _ in BYTES]) == [t for _, t in BYTES]


def test_human_bytes_short(spark):
    assert _format(spark, fmt.human_bytes_short, [0, 1024, 1025, 1536, 1048576, 1049600, 5 * 1048576]) == [
        "0KB", "1024KB", "1K", "2K", "1024K", "1M", "5M"]


def test_human_count(spark):
    assert _format(spark, fmt.human_count, [5, 1000, 1001, 1250, 10000, 10001, 25999]) == ["5", "1000", "1.0k", "1.3k", "10.0k", "10k", "25k"]


def test_fixed5_and_prefix(spark):
    df = spark.createDataFrame([(1.5, "é" * 40), (None, "short")], "x DOUBLE, s STRING")
    rows = df.select(fmt.fixed5("x").alias("x"), fmt.fingerprint_prefix("s").alias("s")).collect()
    assert [(r.x, r.s) for r in rows] == [("1.50000", "é" * 35), ("0", "short")]


HISTORY = ("checksum BIGINT, serverid_max BIGINT, db_max STRING, user_max STRING, ts_min DATE, ts_max DATE, ts_cnt BIGINT,"
           " query_time_sum DECIMAL(18,2), query_time_max DECIMAL(18,2), query_time_min DECIMAL(18,2),"
           " lock_time_sum DECIMAL(18,2), lock_time_max DECIMAL(18,2), lock_time_min DECIMAL(18,2)")


def _history(spark, *rows):
    day = datetime(2024, 1, 1).date()
    one = Decimal("1")
    return spark.createDataFrame([(c, h, "d", "u", day, day, n, Decimal(q), one, one, one, one, one) for c, h, n, q in rows], HISTORY)


def test_missing_count_counts_once_but_not_in_the_average(spark):
    review = spark.createDataFrame([(1, "fp")], "checksum BIGINT, fingerprint STRING")
    r = S.slow_rollup(review, _history(spark, (1, 1, None, "10"), (1, 1, 4, "30"), (1, 2, 7, "70"), (2, 1, 1, "1")), host_id=1).first()
    assert (r.ts_cnt, r.query_time_sum, r.query_time_avg) == (5, 40.0, 10.0)


def test_page_and_filter(spark):
    rows = [(c, "fp", datetime(2024, 1, c + 1), c % 2) for c in range(20)]
    review = spark.createDataFrame(rows, "checksum BIGINT, fingerprint STRING, last_seen TIMESTAMP_NTZ, is_reviewed INT")
    assert [r.checksum for r in S.slow_page(review, 1, 2).collect()] == [4, 3, 2, 1, 0]
    assert S.slow_filter(review, start=F.lit("2024-01-05").cast("timestamp_ntz"), status=1).count() == 8
    assert S.slow_filter(review).count() == 20


def test_latest_review_update_wins(spark):
    review = spark.createDataFrame([(1, 0), (2, 0)], "checksum BIGINT, is_reviewed INT")
    updates = spark.createDataFrame([(1, 1, datetime(2024, 1, 2), 9, None), (2, 1, datetime(2024, 1, 1), 8, "old")],
                                    "update_id BIGINT, checksum BIGINT, reviewed_on TIMESTAMP_NTZ, reviewed_id BIGINT, comments STRING")
    got = {r.checksum: (r.is_reviewed, r.comments, r.reviewed_id) for r in S.review_overlay(review, updates).collect()}
    assert got == {1: (1, "", 9), 2: (0, "", None)}

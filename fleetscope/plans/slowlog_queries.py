"""Registered queries over slow and general query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import format as fmt
from fleetscope.functions import sql_text as X
from fleetscope.operators import slowlog as S
from fleetscope.plans.registry import Entry
from fleetscope.plans.views import with_views


def _quote(pattern: str) -> str:
    """Pattern as a DuckDB literal; its matcher has no possessive repeats and needs none."""
    pattern = pattern.replace("*+", "*").replace("++", "+")
    return "'" + pattern.replace("'", "''") + "'"


FP = "lower(sql_text)"
for _pattern, _new in X.FINGERPRINT_RULES:
    _new = _new.replace("$", "\\")
    FP = f"regexp_replace({FP}, {_quote(_pattern)}, '{_new}', 'g')"
PRINTED = {"fp": f"SELECT *, trim({FP}) AS fingerprint, substr(md5(trim({FP})), 17, 16) AS checksum FROM query_log"}

MEASURES = ("CAST(sum(coalesce(ts_cnt, 1)) AS BIGINT) AS ts_cnt, " + ", ".join(
    f"CAST(sum({m}_sum) AS DOUBLE) / CAST(sum(ts_cnt) AS DOUBLE) AS {m}_avg, CAST(max({m}_max) AS DOUBLE) AS {m}_max,"
    f" CAST(min({m}_min) AS DOUBLE) AS {m}_min, CAST(sum({m}_sum) AS DOUBLE) AS {m}_sum" for m in ("query_time", "lock_time")))


def _rollup(keys: str) -> dict[str, str]:
    columns = ", ".join(f"h.{k.strip()}" for k in keys.split(",") if k.strip() != "checksum")
    return {
        "totals": f"SELECT {keys}, max(db_max) AS db_max, max(user_max) AS user_max, min(ts_min) AS ts_min, max(ts_max) AS ts_max,"
                  f" {MEASURES} FROM slow_history GROUP BY {keys}",
        "rolled": "SELECT r.*, h.* EXCLUDE (checksum) FROM slow_review r JOIN totals h ON r.checksum = h.checksum"}


def _p95(m: str) -> str:
    return f"CAST(min(CASE WHEN rn_{m} * 100 >= n * 95 THEN {m} END) AS DOUBLE) AS {m}_pct_95"


TABLES = {
    "masked": f"SELECT *, regexp_replace(upper(sql_text), {_quote(X.QUOTED)}, '?', 'g') AS q FROM query_log",
    "names": f"SELECT DISTINCT query_id, host_id, CAST(ts AS DATE) AS day, CASE WHEN contains(t, '.') THEN lower(t) ELSE default_db || '.' || lower(t) END AS full_name"
             " FROM (SELECT *, replace(trim(unnest(flatten([string_split(x, ',') FOR x IN"
             f" regexp_extract_all(q, {_quote(X.TABLE_LIST)}, 1)]))), '`', '') AS t FROM masked) y WHERE t <> 'DUAL'",
}
DETAIL = ", ".join(
    f"CAST(sum({m}_sum) AS {t}) AS {m}_sum, CAST(min({m}_min) AS {t}) AS {m}_min, CAST(max({m}_max) AS {t}) AS {m}_max,"
    f" CAST(max({m}_pct_95) AS {t}) AS {m}_pct_95"
    for m, t in (("query_time", "DOUBLE"), ("lock_time", "DOUBLE"), ("rows_sent", "BIGINT"), ("rows_examined", "BIGINT")))


def _reviewed(i):
    # The statements of one database stand for those that were reviewed, so there are marked and unmarked digests.
    return S.with_fingerprint(i.query_log.where("default_db = 'db0'").select("sql_text"))


def _general(i):
    return S.general_digest(i.query_log, _reviewed(i))


GENERAL = {**PRINTED,
           "general": "SELECT checksum, max(fingerprint) AS fingerprint, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS ts_cnt,"
                      " max(CASE WHEN default_db = 'db0' THEN 1 ELSE 0 END) AS is_reviewed FROM fp GROUP BY checksum"}
RANKS = ", ".join(f"row_number() OVER (PARTITION BY serverid_max ORDER BY {k} DESC, checksum) AS rank_{k}" for k in S.ORDER_KEYS.values())

ENTRIES = {
    "slow_filter": Entry(
        lambda i: S.slow_filter(i.slow_review, F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("2001-06-30").cast("timestamp_ntz"), 0),
        with_views("SELECT * FROM slow_review WHERE last_seen >= TIMESTAMP '1998-01-01' AND last_seen <= TIMESTAMP '2001-06-30' AND is_reviewed = 0")),
    "slow_rollup": Entry(lambda i: S.slow_rollup(i.slow_review, i.slow_history),
                         with_views("SELECT * FROM rolled", _rollup("checksum"))),
    "slow_digest_rank": Entry(lambda i: S.slow_digest_rank(i.slow_review, i.slow_history),
                              with_views(f"SELECT *, {RANKS} FROM rolled", _rollup("serverid_max, checksum"))),
    "slow_page": Entry(lambda i: S.slow_page(S.slow_rollup(i.slow_review, i.slow_history), 2, 3),
                       with_views("SELECT * FROM rolled ORDER BY query_time_sum DESC, checksum LIMIT 15 OFFSET 30", _rollup("checksum"))),
    "slow_detail": Entry(
        lambda i: S.slow_detail(i.slow_review.withColumn("serverid_max", F.col("checksum") % 10), i.slow_history),
        with_views("SELECT r.*, r.checksum % 10 AS serverid_max, h.* EXCLUDE (checksum, serverid_max) FROM slow_review r"
                   " LEFT JOIN agg h ON r.checksum = h.checksum AND r.checksum % 10 = h.serverid_max",
                   {"agg": "SELECT checksum, serverid_max, max(db_max) AS db_max, max(user_max) AS user_max, min(sample) AS sample,"
                           f" CAST(sum(coalesce(ts_cnt, 1)) AS BIGINT) AS ts_cnt, {DETAIL} FROM slow_history GROUP BY checksum, serverid_max"})),
    "sql_fingerprint": Entry(
        lambda i: S.with_fingerprint(i.query_log.select("query_id", "sql_text")).drop("sql_text"),
        with_views("SELECT query_id, fingerprint, checksum FROM fp", PRINTED)),
    "fingerprint_digest": Entry(
        lambda i: S.fingerprint_digest(i.query_log),
        with_views("SELECT checksum, max(fingerprint) AS fingerprint, count(*) AS ts_cnt, min(ts) AS first_seen, max(ts) AS last_seen,"
                   " max(default_db) AS db_max, max(user_name) AS user_max, max(host_id) AS serverid_max,"
                   " max(CASE WHEN rn_s = 1 THEN sql_text END) AS sample, " + ", ".join(
                       f"CAST(sum({m}) AS DOUBLE) AS {m}_sum, CAST(min({m}) AS DOUBLE) AS {m}_min, CAST(max({m}) AS DOUBLE) AS {m}_max, {_p95(m)}"
                       for m in S.DIGEST_MEASURES) + " FROM ranks GROUP BY checksum",
                   {**PRINTED,
                    "ranks": "SELECT *, count(*) OVER (PARTITION BY checksum) AS n, row_number() OVER (PARTITION BY checksum ORDER BY query_time DESC, query_id) AS rn_s, "
                             + ", ".join(f"row_number() OVER (PARTITION BY checksum ORDER BY {m}) AS rn_{m}" for m in S.DIGEST_MEASURES) + " FROM fp"})),
    "general_digest": Entry(_general, with_views("SELECT * FROM general", GENERAL)),
    "review_overlay": Entry(
        lambda i: S.review_overlay(i.slow_review, i.review_updates),
        with_views("SELECT r.checksum, CASE WHEN u.checksum IS NULL THEN r.is_reviewed ELSE 1 END AS is_reviewed,"
                   " coalesce(u.comments, '') AS comments, u.reviewed_id, u.reviewed_on FROM slow_review r LEFT JOIN"
                   " (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY reviewed_on DESC, update_id DESC) AS rn FROM review_updates) u"
                   " ON r.checksum = u.checksum AND u.rn = 1")),
    "alert_queries": Entry(
        lambda i: S.alert_queries(i.slow_history, _general(i), i.processlist),
        with_views("SELECT 'slow_digest' AS kind, CAST(checksum AS STRING) AS item, CAST(sum(coalesce(ts_cnt, 1)) AS BIGINT) AS value"
                   " FROM slow_history GROUP BY checksum HAVING sum(coalesce(ts_cnt, 1)) > 10"
                   " UNION ALL SELECT 'general_digest', checksum, ts_cnt FROM general WHERE ts_cnt > 100"
                   " UNION ALL SELECT 'thread', CAST(id AS STRING), time_s FROM processlist WHERE time_s >= 1", GENERAL)),
    "sql_tables": Entry(lambda i: S.table_usage(i.query_log),
                        with_views("SELECT host_id, day, full_name AS table_name, count(*) AS queries FROM names GROUP BY host_id, day, full_name", TABLES)),
    "query_tables": Entry(
        lambda i: S.query_tables(i.query_log, i.catalog_tables, i.catalog_statistics),
        with_views("SELECT u.*, c.engine, c.table_rows, coalesce(c.data_length, 0) + coalesce(c.index_length, 0) AS total_size, coalesce(x.indexes, 0) AS indexes"
                   " FROM (SELECT host_id, full_name, count(*) AS queries FROM names GROUP BY host_id, full_name) u"
                   " JOIN catalog_tables c ON u.host_id = c.host_id AND u.full_name = lower(c.table_schema || '.' || c.table_name)"
                   " LEFT JOIN (SELECT host_id, lower(table_schema || '.' || table_name) AS full_name, count(DISTINCT index_name) AS indexes FROM catalog_statistics GROUP BY 1, 2) x"
                   " ON u.host_id = x.host_id AND u.full_name = x.full_name", TABLES)),
    "human_count": Entry(
        lambda i: i.slow_history.select("ts_cnt", "rows_examined_sum").groupBy("rows_examined_sum").agg(F.sum("ts_cnt").alias("n"))
        .select("rows_examined_sum", fmt.human_count("n").alias("shown")),
        with_views("SELECT rows_examined_sum, CASE WHEN n <= 1000 THEN CAST(n AS STRING) WHEN n <= 10000 THEN"
                   " CAST(floor(CAST(n AS DOUBLE) / 100 + 0.5) / 10 AS STRING) || 'k' ELSE CAST(n // 1000 AS STRING) || 'k' END AS shown"
                   " FROM (SELECT rows_examined_sum, CAST(sum(ts_cnt) AS BIGINT) AS n FROM slow_history GROUP BY rows_examined_sum) x")),
    "fixed5": Entry(
        lambda i: i.slow_history.select("checksum", "serverid_max", fmt.fixed5(
            F.when(F.col("ts_cnt").isNotNull(), F.col("query_time_sum").cast("double"))).alias("shown")),
        with_views("SELECT checksum, serverid_max, CASE WHEN ts_cnt IS NULL THEN '0' ELSE printf('%.5f', CAST(query_time_sum AS DOUBLE)) END AS shown FROM slow_history")),
    "fingerprint_prefix": Entry(
        lambda i: S.with_fingerprint(i.query_log).select("query_id", fmt.fingerprint_prefix("fingerprint").alias("short")),
        with_views("SELECT query_id, substr(fingerprint, 1, 35) AS short FROM fp", PRINTED)),
}

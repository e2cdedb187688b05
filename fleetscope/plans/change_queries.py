"""Registered queries over row-change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import changes as C
from fleetscope.plans.registry import Entry
from fleetscope.plans.views import with_views

KEYS = ["pk"]
AS_OF = "1998-06-30 00:00:00"
THEN = "1996-06-30 00:00:00"
FILE = "bin.000000000000"
UNTIL = f"ts <= TIMESTAMP_NTZ '{THEN}'"
REACHED = f"(log_file < '{FILE}' OR (log_file = '{FILE}' AND log_pos <= 700))"


def _lit(name: str, image: str) -> str:
    if name == "pk":
        return "CAST(pk AS STRING)"
    if name == "amt":
        return f"coalesce(CAST({image}_amt AS STRING), 'NULL')"
    return f"coalesce('''' || replace({image}_note, '''', '''''') || '''', 'NULL')"


def _match(name: str, image: str) -> str:
    column = "pk" if name == "pk" else f"{image}_{name}"
    return f"CASE WHEN {column} IS NULL THEN '`{name}` IS NULL' ELSE '`{name}`=' || {_lit(name, image)} END"


NAMES = ["pk", "amt", "note"]
TARGET = "'`' || schema_name || '`.`' || table_name || '`'"


def _insert(image: str) -> str:
    return f"'INSERT INTO ' || {TARGET} || ' (`pk`, `amt`, `note`) VALUES (' || " + " || ', ' || ".join(_lit(n, image) for n in NAMES) + " || ');'"


def _where(image: str) -> str:
    return " || ' AND ' || ".join(_match(n, image) for n in NAMES)


def _delete(image: str) -> str:
    return f"'DELETE FROM ' || {TARGET} || ' WHERE ' || {_where(image)} || ';'"


def _update(to: str, at: str) -> str:
    return (f"'UPDATE ' || {TARGET} || ' SET ' || " + " || ', ' || ".join(f"'`{n}`=' || {_lit(n, to)}" for n in NAMES)
            + f" || ' WHERE ' || {_where(at)} || ';'")


def _sql(insert: str, delete: str, update: str) -> str:
    return f"CASE op WHEN 'insert' THEN {insert} WHEN 'delete' THEN {delete} ELSE {update} END AS sql"


FORWARD = _sql(_insert("after"), _delete("before"), _update("after", "before"))
INVERSE = _sql(_delete("after"), _insert("before"), _update("before", "after"))
REPAIR = _sql(_delete("after"), _insert("before"), _insert("before"))


def _pairs(i):
    return i.host_infos.selectExpr("'db' || CAST(host_id % 2 AS STRING) AS schema_name", "'accounts' AS table_name")


ENTRIES = {
    "change_slice": Entry(
        lambda i: C.change_slice(i.binlog_events, FILE, 900, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit(AS_OF).cast("timestamp_ntz"),
                                 start_pos=100, master=1),
        with_views(f"SELECT * FROM binlog_events WHERE master_host_id = 1 AND log_file = '{FILE}' AND log_pos BETWEEN 100 AND 900 AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '{AS_OF}'")),
    "change_tables": Entry(
        lambda i: C.change_tables(i.binlog_events, _pairs(i)),
        with_views("SELECT * FROM binlog_events WHERE (schema_name, table_name) IN (SELECT ('db' || CAST(host_id % 2 AS STRING), 'accounts') FROM host_infos)")),
    "change_to_sql": Entry(lambda i: C.change_to_sql(i.binlog_events, KEYS),
                           with_views(f"SELECT master_host_id, log_file, log_pos, {FORWARD} FROM binlog_events")),
    "flashback_sql": Entry(lambda i: C.flashback_sql(i.binlog_events, KEYS),
                           with_views(f"SELECT master_host_id, log_file, log_pos, {INVERSE} FROM binlog_events")),
    "repair_sql": Entry(
        lambda i: C.repair_sql(i.stopped_replicas, i.binlog_events, KEYS),
        with_views("SELECT s.host_id, s.poll_id, e.master_host_id, e.log_file, e.log_pos, e.sql FROM stopped_replicas s JOIN inverse e ON e.master_host_id = s.master_host_id AND e.log_file = s.relay_master_log_file"
                   r" AND e.log_pos > s.exec_master_log_pos AND e.log_pos <= CAST(regexp_extract(s.last_sql_error, '(\d+)$', 1) AS BIGINT)"
                   " WHERE s.last_sql_errno IN (1032, 1062)", {"inverse": f"SELECT master_host_id, log_file, log_pos, {REPAIR} FROM binlog_events"})),
    "table_as_of": Entry(
        lambda i: C.table_as_of(i.binlog_events, KEYS, F.expr(UNTIL)),
        with_views("SELECT master_host_id, schema_name, table_name, pk, after_amt AS amt, after_note AS note FROM (SELECT *, row_number() OVER"
                   f" (PARTITION BY master_host_id, schema_name, table_name, pk ORDER BY log_file DESC, log_pos DESC) AS rn FROM binlog_events WHERE ts <= TIMESTAMP '{THEN}') x WHERE rn = 1 AND op <> 'delete'")),
    "table_rewind": Entry(
        lambda i: C.table_rewind(i.binlog_events, KEYS, ~C.reached(FILE, 700)),
        with_views("SELECT master_host_id, schema_name, table_name, pk, CASE WHEN op = 'insert' THEN 'delete' ELSE 'put' END AS op, before_amt AS amt, before_note AS note FROM"
                   " (SELECT *, row_number() OVER (PARTITION BY master_host_id, schema_name, table_name, pk ORDER BY log_file, log_pos) AS rn FROM binlog_events"
                   f" WHERE NOT {REACHED}) x WHERE rn = 1")),
    "change_stats": Entry(
        lambda i: C.change_stats(i.binlog_events, KEYS),
        with_views("SELECT master_host_id, schema_name, table_name, op, date_trunc('hour', ts) AS hour, count(*) AS events, count(DISTINCT pk) AS rows"
                   " FROM binlog_events GROUP BY ALL")),
    "change_lag": Entry(
        lambda i: C.change_lag(i.binlog_events),
        with_views("SELECT master_host_id, log_file, log_pos, schema_name, table_name, log_pos - lag(log_pos) OVER w AS position_gap,"
                   " date_diff('second', lag(ts) OVER w, ts) AS seconds_gap FROM binlog_events"
                   " WINDOW w AS (PARTITION BY master_host_id, schema_name, table_name ORDER BY log_file, log_pos)")),
}

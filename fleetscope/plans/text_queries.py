"""Registered queries over status text, operating-system text and log text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.constants import STATUS_SECTIONS
from fleetscope.plans.inputs import BINLOG_TEXT_LINES, Inputs
from fleetscope.plans.registry import Entry
from fleetscope.plans.views import with_views
from fleetscope.session import scratch_path
from fleetscope.sources import engine_text as T
from fleetscope.sources import logs as L
from fleetscope.sources import os_text as O

HEADERS = ", ".join(f"'{s}'" for s in STATUS_SECTIONS)

# Lines with the last header at or before them; a header that comes again wins.
SECTION_STEPS = {
    "raw": "SELECT host_id, poll_id, ts, p AS pos, l[p] AS line FROM (SELECT *, string_split(status, chr(10)) AS l FROM innodb_status_text) s,"
           " unnest(range(1, len(l) + 1)) AS u(p)",
    "headed": f"SELECT *, max(CASE WHEN line IN ({HEADERS}) THEN pos END) OVER (PARTITION BY host_id, poll_id ORDER BY pos) AS head FROM raw",
    "newest": f"SELECT host_id, poll_id, line AS section, max(pos) AS head FROM raw WHERE line IN ({HEADERS}) GROUP BY host_id, poll_id, line",
    "section_lines": "SELECT h.host_id, h.poll_id, h.ts, n.section, CAST(row_number() OVER (PARTITION BY h.host_id, h.poll_id, n.section ORDER BY pos) - 1 AS INTEGER) AS line_no, h.line"
                     " FROM headed h JOIN newest n ON h.host_id = n.host_id AND h.poll_id = n.poll_id AND h.head = n.head"
                     " WHERE h.pos > h.head AND h.line <> ''",
}


def _value(section: str, pattern: str, group: int = 1) -> str:
    return f"max(CASE WHEN section = '{section}' THEN TRY_CAST(regexp_extract(line, '{pattern}', {group}) AS BIGINT) END)"


GAPS = {
    **SECTION_STEPS,
    "lsn": "SELECT host_id, poll_id, max(ts) AS ts, " + ", ".join(
        f"{_value('LOG', p)} AS {c}" for c, p in {
            "log_lsn": r"Log sequence number\s+(\d+)", "flushed": r"Log flushed up to\s+(\d+)",
            "pages": r"Pages flushed up to\s+(\d+)", "checkpoint": r"Last checkpoint at\s+(\d+)"}.items())
           + " FROM section_lines GROUP BY host_id, poll_id",
    "gaps": "SELECT host_id, poll_id, ts, log_lsn, log_lsn - flushed AS log_flush_diff, log_lsn - pages AS page_flush_diff, log_lsn - checkpoint AS checkpoint_diff FROM lsn",
}
SECTION_OF = {"t0": "TRANSACTIONS", "t1": "INSERT BUFFER AND ADAPTIVE HASH INDEX", "t2": "SEMAPHORES"}
POOLS = {
    **SECTION_STEPS,
    "pool_lines": "SELECT *, max(CASE WHEN line LIKE '---BUFFER POOL %' THEN line_no END) OVER (PARTITION BY host_id, poll_id ORDER BY line_no) AS head"
                  " FROM section_lines WHERE section = 'INDIVIDUAL BUFFER POOL INFO'",
    "pools": "SELECT host_id, poll_id, max(TRY_CAST(regexp_extract(line, '---BUFFER POOL (\\d+)', 1) AS BIGINT)) AS instance, "
             + ", ".join(f"max(TRY_CAST(regexp_extract(line, '{p}', 1) AS BIGINT)) AS {c}" for c, p in T.POOL_VALUES.items())
             + ", max(CASE WHEN line LIKE 'Buffer pool hit rate%' THEN floor(CAST(regexp_extract(line, 'rate (\\d+) / (\\d+)', 1) AS DOUBLE) * 10000"
               " / CAST(regexp_extract(line, 'rate (\\d+) / (\\d+)', 2) AS DOUBLE) + 0.5) / 100 END) AS hit_rate"
               " FROM pool_lines WHERE head IS NOT NULL GROUP BY host_id, poll_id, head",
}


def _os(kind: str, columns: str, tail: str = "") -> str:
    return with_views(f"SELECT host_id, poll_id, {columns} FROM l {tail}",
                      {"l": rf"SELECT *, regexp_split_to_array(trim(line), '\s+') AS f FROM os_text WHERE kind = '{kind}'"})


def _num(n: int, t: str = "DECIMAL(18,2)") -> str:
    return f"TRY_CAST(f[{n}] AS {t})"


MEM = r"TRY_CAST(regexp_extract(line, ':\s+(\d+)', 1) AS BIGINT) * 1024"
NAME = r"regexp_extract(line, '^(\w+):', 1)"

DECODED = {
    "flagged": "SELECT *, sum(CASE WHEN regexp_matches(line, '^### (INSERT|UPDATE|DELETE) ') THEN 1 ELSE 0 END)"
               " OVER (PARTITION BY master_host_id, log_file ORDER BY log_pos, line_no) AS rec FROM binlog_text",
    "imaged": "SELECT *, max(CASE WHEN line IN ('### SET', '### WHERE') THEN line_no END) OVER (PARTITION BY master_host_id, log_file, rec ORDER BY log_pos, line_no) AS part_line FROM flagged",
    "parts": "SELECT i.*, p.line AS part FROM imaged i LEFT JOIN binlog_text p ON i.master_host_id = p.master_host_id AND i.log_file = p.log_file AND i.log_pos = p.log_pos AND i.part_line = p.line_no",
}


def _image(part: str, key: int, name: str) -> str:
    return f"max(CASE WHEN part = '### {part}' AND line LIKE '###   @{key}=%' THEN substr(line, 10) END) AS {name}"


def _backup(v1: int | None, v2: int | None) -> str:
    cases = (f" WHEN n = 8 THEN f[{v1 + 1}]" if v1 is not None else "") + (f" WHEN n = 10 THEN f[{v2 + 1}]" if v2 is not None else "")
    return f"CASE{cases} END"


BACKUP_PARSED = (
    f"SELECT host_id, line_no, {_backup(0, 0)} AS mode, {_backup(1, 1)} AS backup_dir, {_backup(None, 2)} AS backup_file, {_backup(2, 3)} AS log_path,"
    f" {_backup(3, 4)} AS start_time, {_backup(4, 5)} AS stop_time, TRY_CAST({_backup(5, 6)} AS DATE) AS backup_date,"
    f" CASE WHEN n IN (8, 10) THEN CASE {_backup(6, 7)} WHEN '1' THEN 1 ELSE 0 END END AS is_ok, {_backup(None, 8)} AS stream, {_backup(None, 9)} AS compress,"
    f" {_backup(7, None)} AS dir_name, CASE WHEN n NOT IN (8, 10) THEN line END AS bad_record"
    " FROM (SELECT *, string_split(line, ':') AS f, len(string_split(line, ':')) AS n FROM backup_log_lines) x")

CHANGE_ROWS = with_views(
    "SELECT master_host_id, log_file, min(log_pos) AS log_pos, lower(max(regexp_extract(line, '^### (INSERT|UPDATE|DELETE) ', 1))) AS op,"
    " max(regexp_extract(line, '`([^`]+)`\\.`([^`]+)`', 1)) AS schema_name, max(regexp_extract(line, '`([^`]+)`\\.`([^`]+)`', 2)) AS table_name, "
    + ", ".join([_image("WHERE", 1, "before_1"), _image("WHERE", 2, "before_2"), _image("SET", 1, "after_1"), _image("SET", 2, "after_2")])
    + " FROM parts GROUP BY master_host_id, log_file, rec", DECODED)


def _change_columns(rows: DataFrame) -> DataFrame:
    return rows.select("master_host_id", "log_file", "log_pos", "op", "schema_name", "table_name",
                       *[F.col(m).getItem(k).alias(f"{m}_{k}") for m in ("before", "after") for k in (1, 2)])


def _decoded_files(i: Inputs) -> str:
    """The folder of a decoded change log: text files as the server's tool writes them, a folder a log."""
    header = F.format_string("# at %d\n#240101  0:00:00 server id %d  end_log_pos %d", "log_pos", "master_host_id", "log_pos")
    lines = [F.expr(e) for e in BINLOG_TEXT_LINES.values()]
    path = scratch_path(i.spark, "decoded-change-log")
    # A log holds a thousand positions, so no folder is large; each is written by one task.
    i.binlog_events.select("log_file", F.concat_ws("\n", header, *lines).alias("value")).repartition("log_file").write.partitionBy("log_file").text(path)
    return path


ENTRIES = {
    "status_sections": Entry(
        lambda i: T.status_sections(i.innodb_status_text),
        with_views("SELECT host_id, poll_id, section, line_no, line FROM section_lines", SECTION_STEPS)),
    "lsn_gaps": Entry(lambda i: T.lsn_gaps(i.innodb_status_text), with_views("SELECT * FROM gaps", GAPS)),
    "redo_pressure": Entry(
        lambda i: T.redo_pressure(T.lsn_gaps(i.innodb_status_text), i.host_infos),
        with_views("SELECT * FROM (SELECT g.host_id, poll_id, log_flush_diff, page_flush_diff,"
                   " CASE WHEN log_flush_diff > innodb_log_buffer_size THEN 1 ELSE 0 END AS log_buffer_small,"
                   " CASE WHEN page_flush_diff > innodb_log_file_size THEN 1 ELSE 0 END AS log_file_small"
                   " FROM gaps g JOIN host_infos h ON g.host_id = h.host_id) x WHERE log_buffer_small = 1 OR log_file_small = 1", GAPS)),
    "undo_size": Entry(
        lambda i: T.undo_size(i.innodb_status_text),
        with_views("SELECT host_id, poll_id, " + _value("TRANSACTIONS", r"History list length\s+(\d+)")
                   + " AS history_list_length, 16384 * " + _value("TRANSACTIONS", r"History list length\s+(\d+)")
                   + " AS undo_bytes FROM section_lines GROUP BY host_id, poll_id", SECTION_STEPS)),
    "hash_search_ratio": Entry(
        lambda i: T.hash_search_ratio(i.innodb_status_text),
        with_views("SELECT *, CASE WHEN hash_searches + non_hash_searches = 0 THEN 0 ELSE"
                   " floor(hash_searches * 10000 / (hash_searches + non_hash_searches) + 0.5) / 100 END AS hash_search_ratio FROM hs",
                   {**SECTION_STEPS,
                    "hs": "SELECT host_id, poll_id, CAST(regexp_extract(line, '([0-9.]+) hash searches/s, ([0-9.]+) non', 1) AS DOUBLE) AS hash_searches,"
                          " CAST(regexp_extract(line, '([0-9.]+) hash searches/s, ([0-9.]+) non', 2) AS DOUBLE) AS non_hash_searches"
                          " FROM section_lines WHERE section = 'INSERT BUFFER AND ADAPTIVE HASH INDEX' AND line LIKE '%hash searches/s%'"})),
    "engine_text_deltas": Entry(
        lambda i: T.engine_text_deltas(i.innodb_status_text),
        with_views("SELECT host_id, poll_id, " + ", ".join(
            f"{c} - lag({c}) OVER (PARTITION BY host_id ORDER BY ts, poll_id) AS {c}" for c in T.TEXT_COUNTERS) + " FROM nums",
            {**SECTION_STEPS,
             "nums": "SELECT host_id, poll_id, ts, " + ", ".join(
                 f"{_value(SECTION_OF[t], p, g)} AS {c}" for c, (t, p, g) in T.TEXT_COUNTERS.items())
                 + " FROM section_lines GROUP BY host_id, poll_id, ts"})),
    "deadlock_events": Entry(
        lambda i: T.deadlock_events(i.innodb_status_text),
        with_views("SELECT host_id, poll_id, ts, line_count, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY host_id ORDER BY ts, poll_id) AS before FROM dl) x"
                   " WHERE before IS NULL OR before <> digest",
                   {**SECTION_STEPS,
                    "dl": "SELECT host_id, poll_id, ts, CAST(count(*) AS INTEGER) AS line_count, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest"
                          " FROM section_lines WHERE section = 'LATEST DETECTED DEADLOCK' GROUP BY host_id, poll_id, ts HAVING count(*) > 5"})),
    "buffer_pool_instances": Entry(
        lambda i: T.buffer_pool_instances(i.innodb_status_text), with_views("SELECT * FROM pools", POOLS)),
    "buffer_pool_totals": Entry(
        lambda i: T.buffer_pool_totals(T.buffer_pool_instances(i.innodb_status_text)),
        with_views("SELECT host_id, poll_id, count(*) AS instances, " + ", ".join(
            f"CAST(sum({c}) AS BIGINT) AS {c}" for c in T.POOL_VALUES) + " FROM pools GROUP BY host_id, poll_id", POOLS)),
    "os_loadavg": Entry(
        lambda i: O.os_loadavg(i.os_text),
        _os("loadavg", f"{_num(1, 'DOUBLE')} AS cpu_1, {_num(2, 'DOUBLE')} AS cpu_5, {_num(3, 'DOUBLE')} AS cpu_15")),
    "os_memory": Entry(
        lambda i: O.os_memory(i.os_text),
        _os("meminfo", ", ".join(f"CAST(sum(CASE WHEN {NAME} = '{n}' THEN {MEM} END) AS BIGINT) AS {c}" for n, c in {
            "MemTotal": "memory_total", "MemFree": "memory_free", "Buffers": "memory_buffers", "Cached": "memory_cache",
            "SwapTotal": "swap_total", "SwapFree": "swap_free"}.items())
            + f", CAST(sum(CASE WHEN {NAME} IN ('MemFree', 'Buffers', 'Cached') THEN {MEM} END) AS BIGINT) AS memory_free_total",
            "GROUP BY host_id, poll_id")),
    "os_disk": Entry(
        lambda i: O.os_disk(i.os_text),
        _os("df", r"max(TRY_CAST(regexp_extract(line, '(\d+)%', 1) AS BIGINT)) AS disk_value,"
                  f" CAST(sum(CASE len(f) WHEN 6 THEN {_num(2, 'BIGINT')} WHEN 5 THEN {_num(1, 'BIGINT')} END) AS BIGINT) // 1048576 AS total_disk_value",
            "WHERE line_no > 1 AND line NOT LIKE '%tmpfs%' GROUP BY host_id, poll_id")),
    "os_network": Entry(
        lambda i: O.os_network(i.os_text),
        _os("sar", f"CAST(sum({_num(3)}) AS DOUBLE) AS net_receive_packet, CAST(sum({_num(4)}) AS DOUBLE) AS net_send_packet,"
                   f" CAST(sum({_num(5)}) * 1024 AS DOUBLE) AS net_receive_byte, CAST(sum({_num(6)}) * 1024 AS DOUBLE) AS net_send_byte",
            "WHERE line LIKE 'Average%' AND line NOT LIKE '%IFACE%' GROUP BY host_id, poll_id")),
    "os_io": Entry(
        lambda i: O.os_io(i.os_text),
        _os("iostat", f"CAST(floor(sum({_num(2)})) AS BIGINT) AS io_qps, CAST(floor(sum({_num(3)})) AS BIGINT) AS io_tps,"
                      f" CAST(floor(sum({_num(4)})) AS BIGINT) AS io_read, CAST(floor(sum({_num(5)})) AS BIGINT) AS io_write,"
                      f" CAST(sum({_num(8)}) AS DOUBLE) AS io_util, CAST(sum({_num(6)}) AS DOUBLE) AS io_await, CAST(sum({_num(7)}) AS DOUBLE) AS io_svctm",
            "WHERE line_no > 1 GROUP BY host_id, poll_id")),
    "os_cpu_process": Entry(
        lambda i: O.os_cpu_process(i.os_text),
        with_views("SELECT c.host_id, c.poll_id, " + ", ".join(
            f"CAST(c.f[{n}] AS DOUBLE) AS {c}" for n, c in enumerate(
                ["cpu_user", "cpu_nice", "cpu_system", "cpu_iowait", "cpu_steal", "cpu_idle"], 1))
            + ", CAST(t.f[9] AS DOUBLE) AS mysql_cpu, CAST(t.f[10] AS DOUBLE) AS mysql_memory FROM l c"
              " JOIN l p ON p.kind = 'pid' AND p.host_id = c.host_id AND p.poll_id = c.poll_id"
              " LEFT JOIN l t ON t.kind = 'top' AND t.host_id = c.host_id AND t.poll_id = c.poll_id AND t.f[1] = p.f[1]"
              " WHERE c.kind = 'cpu' AND c.line_no = 2",
            {"l": r"SELECT *, regexp_split_to_array(trim(line), '\s+') AS f FROM os_text WHERE kind IN ('cpu', 'pid', 'top')"})),
    "slow_log_ingest": Entry(
        lambda i: L.slow_log_ingest(L.slow_log_records(i.slow_log_text)),
        with_views(
            r"SELECT log_file, max(regexp_extract(line, '^# User@Host: ([^\[]+)\[', 1)) AS user_name,"
            " max(CASE WHEN line LIKE 'use %' THEN regexp_extract(line, '^use ([^;]+);', 1) END) AS db,"
            r" max(TRY_CAST(regexp_extract(line, '^SET timestamp=(\d+);', 1) AS BIGINT)) AS epoch,"
            " max(TRY_CAST(regexp_extract(line, 'Query_time: ([0-9.]+)', 1) AS DOUBLE)) AS query_time,"
            " max(TRY_CAST(regexp_extract(line, 'Lock_time: ([0-9.]+)', 1) AS DOUBLE)) AS lock_time,"
            r" max(TRY_CAST(regexp_extract(line, 'Rows_sent: (\d+)', 1) AS BIGINT)) AS rows_sent,"
            r" max(TRY_CAST(regexp_extract(line, 'Rows_examined: (\d+)', 1) AS BIGINT)) AS rows_examined,"
            " max(CASE WHEN line NOT LIKE '#%' AND line NOT LIKE 'use %' AND line NOT LIKE 'SET timestamp%' THEN rtrim(line, ';') END) AS sql_text"
            " FROM r GROUP BY log_file, rec HAVING NOT max(regexp_extract(line, '^# User@Host: ([^\\[]+)\\[', 1)) LIKE 'serverdev%'",
            {"r": "SELECT *, sum(CASE WHEN line LIKE '# User@Host:%' THEN 1 ELSE 0 END) OVER (PARTITION BY log_file ORDER BY line_no) AS rec FROM slow_log_text"})),
    "change_text_decode": Entry(lambda i: _change_columns(L.change_text_decode(i.binlog_text)), CHANGE_ROWS),
    "change_log_files": Entry(lambda i: _change_columns(L.read_change_log(i.spark, _decoded_files(i))), CHANGE_ROWS),
    "backup_log_parse": Entry(lambda i: L.backup_log_parse(i.backup_log_lines), with_views(BACKUP_PARSED)),
}

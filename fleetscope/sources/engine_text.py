"""Engine status text (one multi-line string per poll) to sections and metrics.

Everything here is a projection of the row that holds the text: no shuffle is needed
until values of different polls are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.constants import STATUS_SECTIONS, UNDO_PAGE_BYTES
from fleetscope.functions.ratios import percent2
from fleetscope.operators.counters import HOST, POLL, counter_deltas
from fleetscope.operators.ordered import previous


MARK = "\u0001"


def _marked(status: Column) -> Column:
    """The text with :data:`MARK` before every section header, a line that is a section's name.

    One pass finds all headers, with only the newline as the end of a line.
    """
    names = "|".join(re.escape(name) for name in STATUS_SECTIONS)
    return F.regexp_replace(F.concat(status, F.lit("\n")), f"(?md)^({names})$", f"{MARK}$1")


def _body(name: str) -> Column:
    """Non-blank lines of a section up to the next header; null if it is absent.

    A header that comes again restarts its section, so the text after the last one counts.
    """
    head = f"{MARK}{name}\n"
    text = F.substring_index(F.substring_index("__marked", head, -1), MARK, 1)
    lines = F.regexp_replace(F.trim(text, F.lit("\n")), r"\n{2,}", "\n")
    return F.when(F.contains("__marked", F.lit(head)), lines)


def status_sections(df: DataFrame) -> DataFrame:
    """One row per line of a section: (host_id, poll_id, section, line_no, line).

    Blank lines and lines before the first header are dropped. The text is cut at its headers once.
    """
    parts = F.split(_marked(F.col("status")), MARK)
    # What is before the first header is no section. Generators take expressions: for a column, a filter on it would
    # be moved below the cut and repeat it.
    named = (df.select("host_id", "poll_id", parts.alias("__parts"))
             .withColumn("__parts", F.slice("__parts", 2, F.size("__parts")))
             .withColumn("__names", F.transform("__parts", lambda p: F.substring_index(p, "\n", 1))))
    sections = (named.select("host_id", "poll_id", "__names", F.posexplode(F.coalesce("__parts", F.array())).alias("__n", "__part"))
                .withColumn("section", F.col("__names")[F.col("__n")]))
    # A header that comes again restarts its section.
    again = F.array_contains(F.slice("__names", F.col("__n") + 2, F.size("__names")), F.col("section"))
    body = F.trim(F.substr("__part", F.length("section") + 1), F.lit("\n"))
    return (sections.select("host_id", "poll_id", "section", F.when(F.col("section").isin(STATUS_SECTIONS) & ~again, body).alias("__body"))
            .select("host_id", "poll_id", "section",
                    F.posexplode(F.when(F.col("__body") != "", F.split("__body", "\n+"))).alias("line_no", "line")))


def _section_text(df: DataFrame, *names: str) -> DataFrame:
    """Add the text of each named section as column ``t0``, ``t1``, ... ('' if absent)."""
    rest = [c for c in df.columns if c != "status"]
    texts = [F.coalesce(_body(name), F.lit("")).alias(f"t{n}") for n, name in enumerate(names)]
    return df.select(*rest, _marked(F.col("status")).alias("__marked")).select(*rest, *texts)


def _number(text: str, pattern: str, group: int = 1) -> Column:
    return F.expr(f"try_cast(regexp_extract({text}, r'{pattern}', {group}) AS BIGINT)")


def lsn_gaps(df: DataFrame) -> DataFrame:
    """Distance of the log position to the flushed, page-flushed and checkpoint positions."""
    t = _section_text(df, "LOG").select(
        "host_id", "poll_id", "ts",
        _number("t0", r"Log sequence number\s+(\d+)").alias("log_lsn"),
        _number("t0", r"Log flushed up to\s+(\d+)").alias("flushed"),
        _number("t0", r"Pages flushed up to\s+(\d+)").alias("pages"),
        _number("t0", r"Last checkpoint at\s+(\d+)").alias("checkpoint"))
    return t.select("host_id", "poll_id", "ts", "log_lsn", (F.col("log_lsn") - F.col("flushed")).alias("log_flush_diff"),
                    (F.col("log_lsn") - F.col("pages")).alias("page_flush_diff"),
                    (F.col("log_lsn") - F.col("checkpoint")).alias("checkpoint_diff"))


def redo_pressure(gaps: DataFrame, hosts: DataFrame) -> DataFrame:
    """Polls whose unflushed log exceeds the log buffer or whose dirty log exceeds the log file."""
    sizes = hosts.select("host_id", "innodb_log_buffer_size", "innodb_log_file_size")
    return (gaps.join(sizes, "host_id")
            .select("host_id", "poll_id", "log_flush_diff", "page_flush_diff",
                    (F.col("log_flush_diff") > F.col("innodb_log_buffer_size")).cast("int").alias("log_buffer_small"),
                    (F.col("page_flush_diff") > F.col("innodb_log_file_size")).cast("int").alias("log_file_small"))
            .where("log_buffer_small = 1 OR log_file_small = 1"))


def undo_size(df: DataFrame) -> DataFrame:
    """Bytes held by undo history."""
    return (_section_text(df, "TRANSACTIONS")
            .select("host_id", "poll_id", _number("t0", r"History list length\s+(\d+)").alias("history_list_length"))
            .withColumn("undo_bytes", F.col("history_list_length") * UNDO_PAGE_BYTES))


def hash_search_ratio(df: DataFrame) -> DataFrame:
    """Share of adaptive-hash searches in percent; 0 when nothing was searched."""
    pattern = r"([0-9.]+) hash searches/s, ([0-9.]+) non-hash searches/s"
    t = _section_text(df, "INSERT BUFFER AND ADAPTIVE HASH INDEX").select(
        "host_id", "poll_id",
        F.expr(f"try_cast(regexp_extract(t0, r'{pattern}', 1) AS DOUBLE)").alias("hash_searches"),
        F.expr(f"try_cast(regexp_extract(t0, r'{pattern}', 2) AS DOUBLE)").alias("non_hash_searches"))
    both = F.col("hash_searches") + F.col("non_hash_searches")
    return t.withColumn("hash_search_ratio", F.when(both == 0, F.lit(0.0)).otherwise(percent2("hash_searches", both)))


TEXT_COUNTERS = {
    "trx_id": ("t0", r"Trx id counter (\d+)", 1),
    "ibuf_merges": ("t1", r"seg size \d+, (\d+) merges", 1),
    "ibuf_merged_inserts": ("t1", r"insert (\d+), delete mark (\d+), delete (\d+)", 1),
    "ibuf_merged_delete_marks": ("t1", r"insert (\d+), delete mark (\d+), delete (\d+)", 2),
    "ibuf_merged_deletes": ("t1", r"insert (\d+), delete mark (\d+), delete (\d+)", 3),
    "mutex_spin_waits": ("t2", r"Mutex spin waits (\d+), rounds (\d+), OS waits (\d+)", 1),
    "mutex_spin_rounds": ("t2", r"Mutex spin waits (\d+), rounds (\d+), OS waits (\d+)", 2),
    "mutex_os_waits": ("t2", r"Mutex spin waits (\d+), rounds (\d+), OS waits (\d+)", 3),
    "s_lock_spin_waits": ("t2", r"RW-shared spins (\d+), rounds (\d+), OS waits (\d+)", 1),
    "s_lock_spin_rounds": ("t2", r"RW-shared spins (\d+), rounds (\d+), OS waits (\d+)", 2),
    "s_lock_os_waits": ("t2", r"RW-shared spins (\d+), rounds (\d+), OS waits (\d+)", 3),
    "x_lock_spin_waits": ("t2", r"RW-excl spins (\d+), rounds (\d+), OS waits (\d+)", 1),
    "x_lock_spin_rounds": ("t2", r"RW-excl spins (\d+), rounds (\d+), OS waits (\d+)", 2),
    "x_lock_os_waits": ("t2", r"RW-excl spins (\d+), rounds (\d+), OS waits (\d+)", 3),
}


def engine_counters(df: DataFrame) -> DataFrame:
    """Cumulative numbers found in the text, one row per poll."""
    parsed = _section_text(df, "TRANSACTIONS", "INSERT BUFFER AND ADAPTIVE HASH INDEX", "SEMAPHORES")
    return parsed.select("host_id", "poll_id", "ts",
                         *[_number(t, p, g).alias(name) for name, (t, p, g) in TEXT_COUNTERS.items()])


def engine_text_deltas(df: DataFrame) -> DataFrame:
    """Poll-to-poll change of every number in :data:`TEXT_COUNTERS`; first poll null."""
    d = counter_deltas(engine_counters(df), list(TEXT_COUNTERS))
    return d.select("host_id", "poll_id", *[F.col(f"d_{c}").alias(c) for c in TEXT_COUNTERS])


def deadlock_events(df: DataFrame) -> DataFrame:
    """Polls that show a deadlock (more than five lines) not already shown before."""
    count = F.size(F.split("t0", "\n"))
    # Kept as a generator: a filter would be moved below the parse and repeat it.
    shown = F.explode(F.when(count > 5, F.array(F.struct(count.alias("line_count"), F.md5("t0").alias("digest")))))
    polls = (_section_text(df, "LATEST DETECTED DEADLOCK").select("host_id", "poll_id", "ts", shown.alias("d"))
             .select("host_id", "poll_id", "ts", "d.line_count", "d.digest"))
    return (previous(polls, HOST, POLL, {"__before": "digest"})
            .where("__before IS NULL OR __before <> digest").drop("__before"))


POOL_VALUES = {
    "total_pages": r"Buffer pool size\s+(\d+)", "free_pages": r"Free buffers\s+(\d+)",
    "lru_pages": r"Database pages\s+(\d+)", "old_pages": r"Old database pages\s+(\d+)",
    "dirty_pages": r"Modified db pages\s+(\d+)", "pending_reads": r"Pending reads\s+(\d+)",
}


def buffer_pool_instances(df: DataFrame) -> DataFrame:
    """One row per buffer pool instance and poll, with page counts and hit rate in percent."""
    rate = r"Buffer pool hit rate (\d+) / (\d+)"
    parts = (_section_text(df, "INDIVIDUAL BUFFER POOL INFO")
             .select("host_id", "poll_id", F.posexplode(F.split("t0", "---BUFFER POOL ")).alias("n", "t0"))
             .where("n > 0"))
    return parts.select(
        "host_id", "poll_id", _number("t0", r"^(\d+)").alias("instance"),
        *[_number("t0", p).alias(c) for c, p in POOL_VALUES.items()],
        percent2(_number("t0", rate, 1), _number("t0", rate, 2)).alias("hit_rate"))


def buffer_pool_totals(instances: DataFrame) -> DataFrame:
    """Instance page counts summed per host and poll."""
    return instances.groupBy("host_id", "poll_id").agg(
        F.count("*").alias("instances"), *[F.sum(c).alias(c) for c in POOL_VALUES])

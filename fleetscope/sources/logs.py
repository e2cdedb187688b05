"""Slow-query logs, decoded change logs and backup logs to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.ordered import running

SLOW_HEADER = "# User@Host:"
# Each event of a decoded change log begins with a line of its position.
EVENT_HEADER = "# at "


def _records(lines: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Group the lines of a file into records; ``starts`` marks the first line of one.

    The record number is a running count over the file, sliced if a file is too large for
    one task. Only the lines of one record are put together.
    """
    flagged = lines.withColumn("__start", starts.cast("bigint"))
    counted = running(flagged, keys, order, {"rec": ("sum", "__start")}).where("rec > 0")
    parts = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return (counted.groupBy(*keys, "rec")
            .agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"),
                 F.min(F.struct(*order)).alias("at")))


def read_slow_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Slow-log files as one row per record, in batch or as a stream of arriving files.

    The record header is the line separator, so Spark splits large files between tasks
    and no ordered pass is needed.
    """
    reader = spark.readStream if stream else spark.read
    return (reader.option("lineSep", "\n" + SLOW_HEADER).text(path)
            .select(F.input_file_name().alias("log_file"),
                    F.when(F.col("value").startswith(SLOW_HEADER), F.col("value"))
                    .otherwise(F.concat(F.lit(SLOW_HEADER), "value")).alias("text"))
            .where(F.col("text").rlike(r"Query_time: ")))


def slow_log_records(lines: DataFrame) -> DataFrame:
    """Line rows (log_file, line_no, line) to one row per record."""
    return _records(lines, ["log_file"], ["line_no"], F.col("line").startswith(SLOW_HEADER)).drop("at")


def slow_log_ingest(records: DataFrame) -> DataFrame:
    """Record text to columns; internal users (name starts with ``serverdev``) are dropped."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))

    statement = F.regexp_replace("text", r"(?m)^(?:#.*|use [^;]*;|SET timestamp=\d+;)(?:\n|$)", "")
    own = records.where(~F.col("text").rlike(rf"(?i)^{SLOW_HEADER}\s*serverdev"))
    return (own.select(
        "log_file", found(r"^# User@Host: ([^\[\s]+)\[").alias("user_name"), found(r"(?m)^use ([^;]+);").alias("db"),
        found(r"SET timestamp=(\d+);").try_cast("bigint").alias("epoch"),
        found(r"Query_time: ([0-9.]+)").try_cast("double").alias("query_time"),
        found(r"Lock_time: ([0-9.]+)").try_cast("double").alias("lock_time"),
        found(r"Rows_sent: (\d+)").try_cast("bigint").alias("rows_sent"),
        found(r"Rows_examined: (\d+)").try_cast("bigint").alias("rows_examined"),
        F.regexp_replace(statement, r";?\s*$", "").alias("sql_text"))
        .where("sql_text <> ''"))


def read_change_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Decoded change-log files as one row per changed row, in batch or as a stream of arriving files.

    The position line is the line separator, so Spark splits large files between tasks, an event is read whole
    by one of them, and no ordered pass is needed. Position, time and server are those the event states;
    ``row_no`` counts the rows of an event, whose size the server bounds. What precedes the first event is left out.
    The log is named by the file, or by a ``log_file=`` folder.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.option("lineSep", "\n" + EVENT_HEADER).text(path)
    name = F.col("log_file") if "log_file" in files.columns else F.col("_metadata.file_name")
    whole = F.regexp_replace(F.translate("value", "\r", ""), f"^{EVENT_HEADER}", "")
    header = r"^\d+\n#(\d{6}\s+\d{1,2}:\d\d:\d\d)\s+server id\s+(\d+)"
    events = files.select(name.alias("log_file"), whole.alias("event")).select(
        F.regexp_extract("event", header, 2).try_cast("bigint").alias("master_host_id"), "log_file",
        F.regexp_extract("event", r"^(\d+)\s*(?:\n|$)", 1).try_cast("bigint").alias("log_pos"),
        F.try_to_timestamp(F.regexp_replace(F.regexp_extract("event", header, 1), r"\s+", " "), F.lit("yyMMdd H:mm:ss")).alias("ts"),
        F.posexplode(F.slice(F.split("event", r"(?m)^(?=### (?:INSERT|UPDATE|DELETE) )"), 2, 1 << 30)).alias("row_no", "text"))
    return change_rows(events.where("log_pos IS NOT NULL"))


def change_text_decode(lines: DataFrame) -> DataFrame:
    """Decoded change-log lines that carry their positions to changed rows."""
    events = _records(lines.where(F.col("line").startswith("###")), ["master_host_id", "log_file"], ["log_pos", "line_no"],
                      F.col("line").rlike("^### (INSERT|UPDATE|DELETE) "))
    return change_rows(events.select("master_host_id", "log_file", F.col("at.log_pos").alias("log_pos"), "text"))


def change_rows(events: DataFrame) -> DataFrame:
    """The text of one changed row each to (op, schema, table, before map, after map), after the other columns.

    Values are kept as text without quotes; ``NULL`` becomes null.
    """
    def image(part: str) -> Column:
        block = F.regexp_extract("text", rf"(?s)### {part}\n(.*?)(?:\n### (?:SET|WHERE)\b|$)", 1)
        rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^###\s+@\d+="))

        def pair(line: Column) -> Column:
            raw = F.regexp_replace(F.regexp_extract(line, r"@\d+=(.*)$", 1), r" /\*.*\*/$", "")
            value = F.when(raw != "NULL", F.regexp_replace(raw, "^'(.*)'$", "$1"))
            return F.struct(F.regexp_extract(line, r"@(\d+)=", 1).cast("int").alias("k"), value.alias("v"))

        return F.when(F.size(rows) > 0, F.map_from_entries(F.transform(rows, pair)))

    op = F.lower(F.regexp_extract("text", r"^### (\w+)", 1))
    return events.select(
        *[c for c in events.columns if c != "text"], op.alias("op"),
        F.regexp_extract("text", r"^### [A-Z ]+`([^`]+)`\.`([^`]+)`", 1).alias("schema_name"),
        F.regexp_extract("text", r"^### [A-Z ]+`([^`]+)`\.`([^`]+)`", 2).alias("table_name"),
        image("WHERE").alias("before"), image("SET").alias("after"))


def backup_log_parse(lines: DataFrame) -> DataFrame:
    """Backup log lines of 8 or 10 fields to columns; any other line is a ``bad_record``."""
    f = F.split("line", ":")
    v1, v2 = F.size(f) == 8, F.size(f) == 10
    known = v1 | v2

    def at(first: int | None, second: int | None) -> Column:
        out = F.lit(None).cast("string")
        if first is not None:
            out = F.when(v1, f.getItem(first))
        if second is not None:
            out = out.when(v2, f.getItem(second)) if first is not None else F.when(v2, f.getItem(second))
        return out

    return lines.select(
        "host_id", "line_no", at(0, 0).alias("mode"), at(1, 1).alias("backup_dir"), at(None, 2).alias("backup_file"),
        at(2, 3).alias("log_path"), at(3, 4).alias("start_time"), at(4, 5).alias("stop_time"),
        at(5, 6).try_cast("date").alias("backup_date"), (at(6, 7) == "1").cast("int").alias("is_ok"),
        at(None, 8).alias("stream"), at(None, 9).alias("compress"), at(7, None).alias("dir_name"),
        F.when(~known, F.col("line")).alias("bad_record"))

"""Row-change log: slice, render as SQL, invert, replay, rewind and count.

An event has ``master_host_id``, ``log_file``, ``log_pos``, ``ts``, ``schema_name``,
``table_name``, ``op`` (insert, update, delete), the key columns, and a ``before_x`` and
``after_x`` column for every other column ``x``. Servers use the same file and table names, so
the master is part of every key. Files are in the order of their numbers: a longer name is later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ordered import previous

POSITION = ["master_host_id", "log_file", "log_pos"]
MASTER = ["master_host_id"]
TABLE = ["schema_name", "table_name"]
# A log file of 1 GiB, the usual limit, has 4096 buckets.
POSITIONS_PER_BUCKET = 1 << 18
REPAIRED_ERRORS = [1032, 1062]  # fixed values: row not found, duplicate key


def log_order(log_file: Column, log_pos: Column) -> Column:
    """Place of an event in the log of its master."""
    return F.struct(F.length(log_file), log_file, log_pos)


def reached(log_file: str, log_pos: int) -> Column:
    """Whether an event lies at or before a position."""
    return log_order(F.col("log_file"), F.col("log_pos")) <= log_order(F.lit(log_file), F.lit(log_pos).cast("bigint"))


def change_slice(events: DataFrame, log_file: str | None = None, stop_pos: int | None = None,
                 start: Column | None = None, stop: Column | None = None, start_pos: int | None = None,
                 stop_file: str | None = None, master: int | None = None) -> DataFrame:
    """Events of one master, file (or files up to ``stop_file``), position and time range; every bound is optional."""
    if master is not None:
        events = events.where(F.col("master_host_id") == master)
    if log_file is not None:
        last = stop_file or log_file
        files = F.struct(F.length("log_file"), "log_file")
        events = events.where(files.between(*[F.struct(F.length(F.lit(f)), F.lit(f)) for f in (log_file, last)]))
        if start_pos is not None:
            events = events.where((F.col("log_file") != log_file) | (F.col("log_pos") >= start_pos))
        if stop_pos is not None:
            events = events.where((F.col("log_file") != last) | (F.col("log_pos") <= stop_pos))
    if start is not None:
        events = events.where(F.col("ts") >= start)
    if stop is not None:
        events = events.where(F.col("ts") <= stop)
    return events


def change_tables(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events of the listed (schema_name, table_name) pairs, of one master each if the pairs name it."""
    keys = [c for c in [*MASTER, *TABLE] if c in pairs.columns]
    return events.join(pairs.select(*keys).distinct(), keys, "left_semi")


def _value_columns(events: DataFrame) -> list[str]:
    return [c.removeprefix("before_") for c in events.columns if c.startswith("before_")]


def _literal(events: DataFrame, column: str) -> Column:
    """SQL literal: numbers bare, everything else quoted with quotes and backslashes escaped."""
    kind = events.schema[column].dataType.typeName()
    text = F.col(column).cast("string")
    if kind not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
        text = F.concat(F.lit("'"), escaped, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _statements(events: DataFrame, keys: Sequence[str]) -> dict[str, dict[str, Column]]:
    """Statement builders over either image: ``insert``, ``match`` (WHERE) and ``assign`` (SET)."""
    names = [*keys, *_value_columns(events)]
    target = F.concat(F.lit("`"), F.col("schema_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    out: dict[str, dict[str, Column]] = {}
    for image in ("before", "after"):
        source = {n: n if n in keys else f"{image}_{n}" for n in names}
        literal = {n: _literal(events, c) for n, c in source.items()}
        match = [F.when(F.col(source[n]).isNull(), F.lit(f"`{n}` IS NULL"))
                 .otherwise(F.concat(F.lit(f"`{n}`="), literal[n])) for n in names]
        where = F.concat_ws(" AND ", *match)
        out[image] = {
            "insert": F.concat(F.lit("INSERT INTO "), target, F.lit(" (" + ", ".join(f"`{n}`" for n in names) + ") VALUES ("),
                               F.concat_ws(", ", *literal.values()), F.lit(");")),
            "delete": F.concat(F.lit("DELETE FROM "), target, F.lit(" WHERE "), where, F.lit(";")),
            "assign": F.concat_ws(", ", *[F.concat(F.lit(f"`{n}`="), literal[n]) for n in names]),
            "where": where,
        }
    out["target"] = {"name": target}
    return out


def _update(s: dict[str, dict[str, Column]], to: str, at: str) -> Column:
    return F.concat(F.lit("UPDATE "), s["target"]["name"], F.lit(" SET "), s[to]["assign"],
                    F.lit(" WHERE "), s[at]["where"], F.lit(";"))


def change_to_sql(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The statement that repeats each change."""
    s = _statements(events, keys)
    sql = (F.when(F.col("op") == "insert", s["after"]["insert"]).when(F.col("op") == "delete", s["before"]["delete"])
           .otherwise(_update(s, "after", "before")))
    return events.select(*POSITION, sql.alias("sql"))


def flashback_sql(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The statement that undoes each change, newest change first."""
    s = _statements(events, keys)
    sql = (F.when(F.col("op") == "insert", s["after"]["delete"]).when(F.col("op") == "delete", s["before"]["insert"])
           .otherwise(_update(s, "before", "after")))
    return (events.select(*POSITION, sql.alias("sql"))
            .orderBy("master_host_id", log_order(F.col("log_file"), F.col("log_pos")).desc()))


def repair_sql(stopped: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undo statements for replicas stopped by a missing row or duplicate key.

    The events between the executed position and the position the error names are
    undone; an update is undone by inserting its before image. Ranges and events meet in
    buckets of positions, so a busy log file is not compared with all its errors.
    """
    s = _statements(events, keys)
    sql = (F.when(F.col("op") == "insert", s["after"]["delete"]).otherwise(s["before"]["insert"]))
    undo = events.select(*POSITION, sql.alias("sql"), F.floor(F.col("log_pos") / POSITIONS_PER_BUCKET).alias("bucket"))
    errors = (stopped.where(F.col("slave_sql_running") == "No")
              .where(F.col("last_sql_errno").isin(REPAIRED_ERRORS))
              .select("host_id", "poll_id", "master_host_id", F.col("relay_master_log_file").alias("log_file"),
                      F.col("exec_master_log_pos").alias("start_pos"),
                      F.regexp_extract("last_sql_error", r"(\d+)$", 1).try_cast("bigint").alias("end_pos"))
              .where("end_pos > start_pos"))
    ranges = errors.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start_pos") / POSITIONS_PER_BUCKET), F.floor(F.col("end_pos") / POSITIONS_PER_BUCKET))))
    return (undo.join(ranges, ["master_host_id", "log_file", "bucket"])
            .where("log_pos > start_pos AND log_pos <= end_pos")
            .select("host_id", "poll_id", *POSITION, "sql"))


def table_as_of(events: DataFrame, keys: Sequence[str], until: Column) -> DataFrame:
    """Rows of the tables after the last event that satisfies ``until``."""
    values = _value_columns(events)
    image = F.struct("op", *[F.col(f"after_{v}").alias(v) for v in values])
    state = (events.where(until).groupBy(*MASTER, *TABLE, *keys)
             .agg(F.max_by(image, log_order(F.col("log_file"), F.col("log_pos"))).alias("s")))
    return state.where("s.op <> 'delete'").select(*MASTER, *TABLE, *keys, *[F.col(f"s.{v}").alias(v) for v in values])


def table_rewind(events: DataFrame, keys: Sequence[str], after: Column) -> DataFrame:
    """What to write to take the tables back before the events that satisfy ``after``.

    The first such event of a row knows the earlier image: a row it inserted goes
    (``delete``), any other row gets its before image (``put``).
    """
    values = _value_columns(events)
    image = F.struct("op", *[F.col(f"before_{v}").alias(v) for v in values])
    first = (events.where(after).groupBy(*MASTER, *TABLE, *keys)
             .agg(F.min_by(image, log_order(F.col("log_file"), F.col("log_pos"))).alias("s")))
    op = F.when(F.col("s.op") == "insert", "delete").otherwise("put")
    return first.select(*MASTER, *TABLE, *keys, op.alias("op"), *[F.col(f"s.{v}").alias(v) for v in values])


def change_stats(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events and rows touched per master, table, operation and hour."""
    return (events.groupBy(*MASTER, *TABLE, "op", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
            .agg(F.count("*").alias("events"), F.countDistinct(F.struct(*keys)).alias("rows")))


def change_lag(events: DataFrame) -> DataFrame:
    """Positions and seconds since the previous change of the same table on the same master."""
    rows = events.select(*POSITION, "ts", *TABLE, F.length("log_file").alias("__digits"))
    # A slice is a mebibyte of a file.
    part = F.struct("__digits", "log_file", F.shiftright("log_pos", 20).alias("part"))
    before = previous(rows, [*MASTER, *TABLE], ["__digits", "log_file", "log_pos"], {"__pos": "log_pos", "__ts": "ts"}, part)
    return before.select(*POSITION, *TABLE, (F.col("log_pos") - F.col("__pos")).alias("position_gap"),
                         F.expr("timestampdiff(SECOND, __ts, ts)").alias("seconds_gap"))

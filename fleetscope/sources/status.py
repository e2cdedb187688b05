"""Key-value polls to typed rows, and the appended history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_pivot(kv: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide bigint row per (host, poll); unlisted names dropped, absent names null, ``ON`` and ``OFF`` are 1 and 0.

    One conditional maximum a name: the map side makes one row of a poll's lines where they lie together,
    so neither lines nor names are shuffled, and a task holds one row a poll.
    """
    number = F.expr("try_cast(CASE value WHEN 'ON' THEN '1' WHEN 'OFF' THEN '0' ELSE value END AS BIGINT)")
    return (kv.where(F.col("variable_name").isin(list(names)))
            .groupBy("host_id", "poll_id", "ts")
            .agg(*[F.max(F.when(F.col("variable_name") == n, number)).alias(n) for n in names]))


def variables_latest(kv: DataFrame, names: Sequence[str]) -> DataFrame:
    """Newest value of every listed setting per host, one column each.

    The newest value per (host, name) is an aggregate with a map-side part, so a host
    with many polls sends one row per task and name.
    """
    newest = (kv.where(F.col("variable_name").isin(list(names)))
              .groupBy("host_id", "variable_name")
              .agg(F.max_by("value", F.struct("ts", "poll_id")).alias("value")))
    return newest.groupBy("host_id").pivot("variable_name", list(names)).agg(F.max("value"))

"""Backup log: outcomes, restore chains, increments' bases, policy and retention.

Input is the parsed backup log: mode '1' is a full backup, '2' an increment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.constants import BACKUP_KEEP_DAYS
from fleetscope.operators.ordered import numbered, previous

FULL, INCREMENT = "1", "2"


def _moment(column: str) -> Column:
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd_HH-mm-ss"))


def backup_outcomes(log: DataFrame) -> DataFrame:
    """Backups, failures and seconds spent per host and mode."""
    seconds = F.unix_timestamp(_moment("stop_time")) - F.unix_timestamp(_moment("start_time"))
    return (log.where("mode IS NOT NULL").groupBy("host_id", "mode")
            .agg(F.count("*").alias("backups"), F.sum((F.col("is_ok") != 1).cast("bigint")).alias("failures"),
                 F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest_seconds")))


def restore_chain(log: DataFrame) -> DataFrame:
    """What to restore per host: the newest good full backup and the good increments right after it.

    The chain ends before the first entry that failed or cannot be read. Only the last
    increment is applied without redo-only.
    """
    good_full = (F.col("mode") == FULL) & (F.col("is_ok") == 1)
    starts = log.groupBy("host_id").agg(F.max(F.when(good_full, F.col("line_no"))).alias("full_line"))
    after = log.join(starts, "host_id").where("line_no >= full_line")
    bad = ~F.coalesce((F.col("is_ok") == 1), F.lit(False))
    ends = after.groupBy("host_id").agg(F.min(F.when(bad, F.col("line_no"))).alias("cut_line"))
    chain = after.join(ends, "host_id").where("cut_line IS NULL OR line_no < cut_line")
    last = chain.groupBy("host_id").agg(F.max("line_no").alias("last_line"), F.count("*").alias("links"))
    return (numbered(chain, ["host_id"], ["line_no"], "apply_order").join(last, "host_id")
            .select("host_id", "apply_order", "line_no", "mode", "backup_dir",
                    F.when((F.col("line_no") == F.col("last_line")) & (F.col("links") > 1), 0).otherwise(1).alias("redo_only")))


def backup_base(log: DataFrame) -> DataFrame:
    """For each increment the entry it builds on; without one it is taken as a full backup."""
    before = previous(log, ["host_id"], ["line_no"], {"base_line": "line_no", "base_dir": "backup_dir"})
    return (before.where(F.col("mode") == INCREMENT)
            .select("host_id", "line_no", "backup_dir",
                    F.when(F.col("base_dir").isNotNull(), F.col("base_line")).alias("base_line"), "base_dir",
                    F.when(F.col("base_dir").isNull(), "full").otherwise("increment").alias("taken_as")))


def backup_policy_audit(log: DataFrame) -> DataFrame:
    """Days without a backup, and days whose backup is not full on Sunday or an increment else."""
    days = (log.where("backup_date IS NOT NULL").groupBy("host_id", "backup_date")
            .agg(F.max((F.col("mode") == FULL).cast("int")).alias("has_full"),
                 F.max((F.col("mode") == INCREMENT).cast("int")).alias("has_increment")))
    span = days.groupBy("host_id").agg(F.min("backup_date").alias("first"), F.max("backup_date").alias("last"))
    spine = span.select("host_id", F.explode(F.sequence("first", "last")).alias("backup_date"))
    sunday = F.dayofweek("backup_date") == 1
    problem = (F.when(F.col("has_full").isNull(), "missing")
               .when(sunday & (F.col("has_full") == 0), "full expected")
               .when(~sunday & (F.col("has_increment") == 0), "increment expected"))
    return (spine.join(days, ["host_id", "backup_date"], "left")
            .select("host_id", "backup_date", problem.alias("problem")).where("problem IS NOT NULL"))


def expired_backups(log: DataFrame, today: Column, keep_days: int = BACKUP_KEEP_DAYS) -> DataFrame:
    """Backups older than the retention, in whole days. Reports only."""
    return (log.where("backup_date IS NOT NULL")
            .select("host_id", "line_no", "backup_dir", "backup_date", F.date_diff(today, F.col("backup_date")).alias("age_days"))
            .where(F.col("age_days") > keep_days))

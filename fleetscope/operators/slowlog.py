"""Slow-query digests: aggregate, rank, page, review, and the tables queries use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.constants import DIGEST_PAGE_ROWS, GENERAL_ALERT_COUNT, SLOW_ALERT_COUNT, THREAD_ALERT_SECONDS
from fleetscope.functions.sql_text import sql_checksum, sql_fingerprint, sql_tables
from fleetscope.operators.ordered import nearest_rank, ranked

ORDER_KEYS = {1: "last_seen", 2: "query_time_sum", 3: "ts_cnt", 4: "lock_time_sum"}


def _measures() -> list[Column]:
    # The count treats a missing ts_cnt as 1 while the averages leave it out.
    out = [F.sum(F.coalesce("ts_cnt", F.lit(1))).alias("ts_cnt")]
    for m in ("query_time", "lock_time"):
        out += [F.try_divide(F.sum(f"{m}_sum").cast("double"), F.sum("ts_cnt").cast("double")).alias(f"{m}_avg"),
                F.max(f"{m}_max").cast("double").alias(f"{m}_max"), F.min(f"{m}_min").cast("double").alias(f"{m}_min"),
                F.sum(f"{m}_sum").cast("double").alias(f"{m}_sum")]
    return out


def slow_filter(review: DataFrame, start: Column | None = None, stop: Column | None = None,
                status: int = 2) -> DataFrame:
    """Digests last seen in [start, stop]; ``status`` 0 or 1 selects by review state, 2 any."""
    if start is not None:
        review = review.where(F.col("last_seen") >= start)
    if stop is not None:
        review = review.where(F.col("last_seen") <= stop)
    if status < 2:
        review = review.where(F.col("is_reviewed") == status)
    return review


def slow_rollup(review: DataFrame, history: DataFrame, host_id: int | None = None,
                keys: Sequence[str] = ("checksum",)) -> DataFrame:
    """Digest with its history measures. History is aggregated before the join."""
    if host_id is not None:
        history = history.where(F.col("serverid_max") == host_id)
    totals = history.groupBy(*keys).agg(
        F.max("db_max").alias("db_max"), F.max("user_max").alias("user_max"),
        F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), *_measures())
    return review.join(totals, "checksum")


def slow_digest_rank(review: DataFrame, history: DataFrame) -> DataFrame:
    """Rollup per (host, digest) with its rank within the host by every order key."""
    rolled = slow_rollup(review, history, keys=("serverid_max", "checksum"))
    return ranked(rolled, ["serverid_max"], "checksum", {f"rank_{k}": f"-{k}" for k in ORDER_KEYS.values()})


def slow_page(rollup: DataFrame, order_by: int = 1, page: int = 1) -> DataFrame:
    """One report page of 15 digests, highest first."""
    return (rollup.orderBy(F.col(ORDER_KEYS[order_by]).desc(), "checksum")
            .offset((page - 1) * DIGEST_PAGE_ROWS).limit(DIGEST_PAGE_ROWS))


def slow_detail(review: DataFrame, history: DataFrame) -> DataFrame:
    """Each (checksum, serverid_max) of ``review`` with its history on that host, if any."""
    aggs = [F.max("db_max").alias("db_max"), F.max("user_max").alias("user_max"), F.min("sample").alias("sample"),
            F.sum(F.coalesce("ts_cnt", F.lit(1))).alias("ts_cnt")]
    for m, kind in (("query_time", "double"), ("lock_time", "double"), ("rows_sent", "bigint"), ("rows_examined", "bigint")):
        aggs += [F.sum(f"{m}_sum").cast(kind).alias(f"{m}_sum"), F.min(f"{m}_min").cast(kind).alias(f"{m}_min"),
                 F.max(f"{m}_max").cast(kind).alias(f"{m}_max"), F.max(f"{m}_pct_95").cast(kind).alias(f"{m}_pct_95")]
    keys = ["checksum", "serverid_max"]
    return review.join(history.groupBy(*keys).agg(*aggs), keys, "left")


def with_fingerprint(queries: DataFrame, text: str = "sql_text") -> DataFrame:
    """Add ``fingerprint`` and ``checksum``."""
    return (queries.withColumn("fingerprint", sql_fingerprint(text))
            .withColumn("checksum", sql_checksum("fingerprint")))


DIGEST_MEASURES = ["query_time", "lock_time", "rows_sent", "rows_examined"]


def fingerprint_digest(queries: DataFrame) -> DataFrame:
    """Statements to one row per fingerprint: counts, sums, extremes, 95th percentile, a sample."""
    printed = with_fingerprint(queries)
    # The text is a key beside its checksum: as a maximum it would be an aggregate that Spark sorts for.
    aggs = [F.count("*").alias("ts_cnt"),
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
            F.max("default_db").alias("db_max"), F.max("user_name").alias("user_max"), F.max("host_id").alias("serverid_max"),
            F.max_by("sql_text", F.struct("query_time", F.negate("query_id"))).alias("sample")]
    for m in DIGEST_MEASURES:
        aggs += [F.sum(m).cast("double").alias(f"{m}_sum"), F.min(m).cast("double").alias(f"{m}_min"),
                 F.max(m).cast("double").alias(f"{m}_max")]
    tails = nearest_rank(printed, ["checksum"], DIGEST_MEASURES, 95, "_pct_95")
    tails = tails.select("checksum", *[F.col(f"{m}_pct_95").cast("double").alias(f"{m}_pct_95") for m in DIGEST_MEASURES])
    return printed.groupBy("checksum", "fingerprint").agg(*aggs).join(tails, "checksum")


def general_digest(queries: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Fingerprints with first and last seen, count and whether ``reviewed`` lists the checksum."""
    digests = with_fingerprint(queries).groupBy("checksum", "fingerprint").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("ts_cnt"))
    marks = reviewed.select("checksum").distinct().withColumn("is_reviewed", F.lit(1))
    return digests.join(marks, "checksum", "left").withColumn("is_reviewed", F.coalesce("is_reviewed", F.lit(0)))


def review_overlay(review: DataFrame, updates: DataFrame) -> DataFrame:
    """Newest comment, reviewer and time per digest; an updated digest is reviewed."""
    newest = (updates.groupBy("checksum")
              .agg(F.max_by(F.struct("comments", "reviewed_id", "reviewed_on"),
                            F.struct("reviewed_on", "update_id")).alias("u")))
    return review.join(newest, "checksum", "left").select(
        "checksum", F.when(F.col("u").isNotNull(), F.lit(1)).otherwise(F.col("is_reviewed")).alias("is_reviewed"),
        F.coalesce("u.comments", F.lit("")).alias("comments"), F.col("u.reviewed_id").alias("reviewed_id"),
        F.col("u.reviewed_on").alias("reviewed_on"))


def alert_queries(history: DataFrame, general: DataFrame, threads: DataFrame) -> DataFrame:
    """Digests and threads over their alert threshold: (kind, item, value)."""
    slow = (history.groupBy("checksum").agg(F.sum(F.coalesce("ts_cnt", F.lit(1))).alias("value"))
            .where(F.col("value") > SLOW_ALERT_COUNT)
            .select(F.lit("slow_digest").alias("kind"), F.col("checksum").cast("string").alias("item"), "value"))
    often = general.where(F.col("ts_cnt") > GENERAL_ALERT_COUNT).select(
        F.lit("general_digest").alias("kind"), F.col("checksum").alias("item"), F.col("ts_cnt").alias("value"))
    long = threads.where(F.col("time_s") >= THREAD_ALERT_SECONDS).select(
        F.lit("thread").alias("kind"), F.col("id").cast("string").alias("item"), F.col("time_s").alias("value"))
    return slow.unionByName(often).unionByName(long)


def table_usage(queries: DataFrame) -> DataFrame:
    """Statements per host, day and table they name."""
    return (queries.select("host_id", F.col("ts").cast("date").alias("day"),
                           F.explode(sql_tables("sql_text", "default_db")).alias("table_name"))
            .groupBy("host_id", "day", "table_name").agg(F.count("*").alias("queries")))


def query_tables(queries: DataFrame, tables: DataFrame, statistics: DataFrame) -> DataFrame:
    """Tables used per host with their size and number of indexes, where the catalog knows them."""
    used = (queries.select("host_id", F.explode(sql_tables("sql_text", "default_db")).alias("full_name"))
            .groupBy("host_id", "full_name").agg(F.count("*").alias("queries")))
    name = F.lower(F.concat_ws(".", "table_schema", "table_name"))
    sizes = tables.select("host_id", name.alias("full_name"), "engine", "table_rows",
                          (F.coalesce("data_length", F.lit(0)) + F.coalesce("index_length", F.lit(0))).alias("total_size"))
    indexes = (statistics.where("seq_in_index = 1").groupBy("host_id", name.alias("full_name"))
               .agg(F.count("*").alias("indexes")))
    return used.join(sizes, ["host_id", "full_name"]).join(indexes, ["host_id", "full_name"], "left").withColumn(
        "indexes", F.coalesce("indexes", F.lit(0)))

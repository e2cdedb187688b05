"""Structured Streaming versions of the operators.

Results go to files under the shared folder. Rows that stay as they are go to a folder
``batch_id=n`` for each micro-batch, overwritten when it is retried; rows that are updated go to a merged
table (:mod:`fleetscope.streaming.merged`). So restarts do not duplicate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetscope.functions.sql_text import sql_checksum, sql_fingerprint
from fleetscope.operators.changes import MASTER, TABLE, change_tables, log_order, table_as_of
from fleetscope.operators.counters import HOST, POLL, counter_rates, latest_state, load_alerts, replica_alerts
from fleetscope.operators.slowlog import DIGEST_MEASURES
from fleetscope.session import scratch_path
from fleetscope.streaming.merged import MergedTable

BATCH = "batch_id"
DIGEST_KEYS = ["window_start", "checksum"]
SKETCH = 10_000


def start(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str,
          trigger: dict | None = None) -> StreamingQuery:
    """Run over everything that is available, then stop; restart with the same checkpoint to go on.

    ``trigger`` holds other arguments of Spark's trigger, such as ``processingTime`` to run on.
    """
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start())


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Store each micro-batch under its id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def upserts(spark: SparkSession, path: str, keys: Sequence[str]) -> MergedTable:
    """The merged table of an update-mode query: the row of the latest micro-batch counts."""
    return MergedTable(spark, path, keys, F.col(BATCH))


def upsert_sink(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Apply each micro-batch of updates to the table of :func:`upserts`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upserts(batch.sparkSession, path, keys).apply(batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")), batch_id)

    return write


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key over all batches of an update-mode query."""
    return upserts(spark, path, keys).read().drop(BATCH)


def stream_counter_rates(stream: DataFrame, counters: Sequence[str], out: str, state: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rates per interval over a stream of samples.

    The state is the newest sample of every host, in one of two folders by turns: a
    micro-batch reads the one its predecessor wrote and overwrites the other. A
    sample that is not newer than it is late and dropped. A micro-batch is an ordinary
    DataFrame, so a host with most of its rows is sliced as in the batch operator.
    """
    columns = ["host_id", *POLL, *counters]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(*columns).persist()
        rows = batch.withColumn("__old", F.lit(False))
        if batch_id > 0:
            known = spark.read.schema(batch.schema).parquet(f"{state}/{(batch_id - 1) % 2}")
            newest = known.select("host_id", F.struct(*POLL).alias("__at"))
            fresh = (batch.join(newest, "host_id", "left")
                     .where(F.col("__at").isNull() | (F.struct(*POLL) > F.col("__at"))).drop("__at"))
            rows = (fresh.withColumn("__old", F.lit(False))
                    .unionByName(known.withColumn("__old", F.lit(True))))
        rates = counter_rates(rows, counters).where("NOT __old").drop("__old")
        rates.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
        latest_state(rows.drop("__old")).select(*columns).write.mode("overwrite").parquet(f"{state}/{batch_id % 2}")
        batch.unpersist()

    return start(stream, "append", process, checkpoint, trigger)


def stream_latest(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Newest sample per host, kept as aggregation state; read with :func:`read_upserts`."""
    rest = [c for c in stream.columns if c not in HOST]
    newest = (stream.groupBy(*HOST).agg(F.max_by(F.struct(*rest), F.struct(*POLL)).alias("s"))
              .select(*HOST, "s.*"))
    return start(newest, "update", upsert_sink(out, HOST), checkpoint, trigger)


def stream_running_stats(stream: DataFrame, metrics: Sequence[str], out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Min, max, sum, count and average so far per host."""
    aggs = [fn(m).alias(f"{m}_{name}") for m in metrics
            for name, fn in (("min", F.min), ("max", F.max), ("sum", F.sum), ("count", F.count))]
    totals = stream.groupBy(*HOST).agg(*aggs)
    averages = {f"{m}_avg": F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_count").cast("double"))
                for m in metrics}
    return start(totals.withColumns(averages), "update", upsert_sink(out, HOST), checkpoint, trigger)


def stream_slow_digest(stream: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Digest per fingerprint and five-minute window; open windows are updated, not held back.

    The measures are those of the batch digest. The 95th percentile is a mergeable sketch: off by
    one in ``SKETCH`` ranks of a window at most, and exact in windows of fewer statements.
    """
    printed = (stream.withColumn("ts", F.col("ts").cast("timestamp"))
               .withColumn("fingerprint", sql_fingerprint("sql_text"))
               .withColumn("checksum", sql_checksum("fingerprint")))
    measures = {"sum": F.sum, "min": F.min, "max": F.max, "pct_95": lambda m: F.percentile_approx(m, 0.95, SKETCH)}
    digest = (printed.withWatermark("ts", delay)
              .groupBy(F.window("ts", "5 minutes").alias("w"), "checksum")
              .agg(F.count("*").alias("ts_cnt"), F.max("fingerprint").alias("fingerprint"),
                   F.min("ts").cast("timestamp_ntz").alias("first_seen"), F.max("ts").cast("timestamp_ntz").alias("last_seen"),
                   F.max("default_db").alias("db_max"), F.max("user_name").alias("user_max"), F.max("host_id").alias("serverid_max"),
                   F.max_by("sql_text", F.struct("query_time", F.negate("query_id"))).alias("sample"),
                   *[fn(m).cast("double").alias(f"{m}_{name}") for m in DIGEST_MEASURES for name, fn in measures.items()]))
    digest = digest.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in digest.columns if c != "w"])
    return start(digest, "update", upsert_sink(out, DIGEST_KEYS), checkpoint, trigger)


def stream_row_counts(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows of every day that a source delivered, late or not; the state is one number a day."""
    days = stream.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n_rows"))
    return start(days, "update", upsert_sink(out, ["day"]), checkpoint, trigger)


def late_rows(spark: SparkSession, digest: str, counts: str) -> DataFrame:
    """(day, n_rows, n_in_windows, n_late): what the windows of :func:`stream_slow_digest` have of a day's rows, and what came too late.

    Exact when both streams have read the same files. Rows without a time are in no window; their day is null.
    """
    windows = (read_upserts(spark, digest, DIGEST_KEYS).groupBy(F.col("window_start").cast("date").alias("of_day"))
               .agg(F.sum("ts_cnt").alias("n")))
    late = read_upserts(spark, counts, ["day"]).join(windows, F.col("day") == F.col("of_day"), "left")
    n = F.coalesce("n", F.lit(0))
    return late.select("day", "n_rows", n.alias("n_in_windows"), (F.col("n_rows") - n).alias("n_late"))


def stream_alerts(stream: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", trigger: dict | None = None,
                  replicas: DataFrame | None = None) -> StreamingQuery:
    """Threshold alerts, and those of stopped threads if a stream of replica states is given; one per host, rule and ten minutes."""
    def timed(df: DataFrame) -> DataFrame:
        return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    alerts = load_alerts(timed(stream))
    if replicas is not None:
        alerts = alerts.unionByName(replica_alerts(timed(replicas)))
    alerts = (alerts
              .withColumn("since", F.window("ts", "10 minutes")["start"])
              .dropDuplicatesWithinWatermark(["host_id", "rule", "since"]))
    return start(alerts, "append", batch_sink(out), checkpoint, trigger)


def stream_host_down(stream: DataFrame, out: str, checkpoint: str, down_seconds: int, delay: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """One alert for every silence of a host longer than ``down_seconds``, dated when the host counted as down.

    The state of a host is its newest sample; its timer fires when event time, less ``delay``, has passed
    the limit and nothing came. A silence that ends within a micro-batch is seen when it ends. A sample
    that comes late into a silence already reported withdraws nothing.
    """
    limit = down_seconds * 1_000_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down: list[int] = []
        if state.hasTimedOut:
            down.append(state.get[0] + limit)
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for at in np.sort(np.concatenate([b["at"].to_numpy(np.int64) for b in batches])).tolist():
                if last is not None and at - last > limit:
                    down.append(last + limit)
                last = at if last is None else max(last, at)
            state.update((last,))
            state.setTimeoutTimestamp(max((last + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"host_id": np.full(len(down), key[0]), "at": np.array(down, np.int64)})

    samples = (stream.select("host_id", F.col("ts").cast("timestamp").alias("ts")).where("host_id IS NOT NULL AND ts IS NOT NULL")
               .withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")))
    silent = samples.groupBy("host_id").applyInPandasWithState(watch, "host_id BIGINT, at BIGINT", "last BIGINT", "append", GroupStateTimeout.EventTimeTimeout)
    alerts = silent.select("host_id", F.timestamp_micros("at").alias("ts"), F.lit("host_down").alias("rule"), F.lit("No").alias("value"),
                           F.window(F.timestamp_micros("at"), "10 minutes")["start"].alias("since"))
    return start(alerts, "append", batch_sink(out), checkpoint, trigger)


def synced(spark: SparkSession, target: str, keys: Sequence[str]) -> MergedTable:
    """The merged table that :func:`sync_apply` keeps: the newest event of every row, deletions included."""
    return MergedTable(spark, target, [*MASTER, *TABLE, *keys], log_order(F.col("log_file"), F.col("log_pos")))


def sync_apply(stream: DataFrame, pairs: DataFrame, target: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None) -> StreamingQuery:
    """Copy the changes of the listed tables to ``target``; the checkpoint holds the position.

    A micro-batch costs as much as the batch, and its share of the merges. Rows are merged by key and
    position, so a repeated event is harmless, in whatever batch it comes.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        synced(batch.sparkSession, target, keys).apply(change_tables(batch, pairs), batch_id)

    return start(stream, "append", process, checkpoint, trigger)


def read_synced(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The rows of the copied tables as they are now."""
    return table_as_of(synced(spark, target, keys).read(), keys, F.lit(True))


def sync_position(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Newest applied log position of each master: that of the newest event of some row."""
    return (synced(spark, target, keys).read().groupBy(*MASTER).agg(F.max(log_order(F.col("log_file"), F.col("log_pos"))).alias("p"))
            .select(*MASTER, "p.log_file", "p.log_pos"))


def land(df: DataFrame, name: str) -> DataFrame:
    """Write rows below the shared folder and open them as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table as a stream, be it a file or a folder of files.

    A stream reads folders, so a single file is read as the only match in its folder.
    """
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)

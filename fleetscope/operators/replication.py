"""Replication topology, lag and health, lock waits and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ordered import filled
from fleetscope.session import pin


def topology(hosts: DataFrame, slave_hosts: DataFrame, replicas: DataFrame) -> DataFrame:
    """Master and role of every host: ``M``, ``S`` or ``MS``.

    A host that lists a replica with a known id is a master, one that lists only unknown
    ids a slave. A host that lists none is a slave if it reports replica status, else a
    master. A host some master lists is a slave.
    """
    listed = slave_hosts.groupBy("host_id").agg(F.count("slave_uuid").alias("known_replicas"))
    master_of = (slave_hosts.where("slave_uuid IS NOT NULL")
                 .groupBy(F.col("slave_uuid").alias("server_uuid")).agg(F.max("host_id").alias("master_host_id")))
    reporting = replicas.select("host_id").distinct().withColumn("reports", F.lit(1))
    roles = (hosts.join(listed, "host_id", "left").join(master_of, "server_uuid", "left")
             .join(reporting, "host_id", "left"))
    lists_none = F.col("known_replicas").isNull()
    is_master = (F.col("known_replicas") > 0) | (lists_none & F.col("reports").isNull())
    is_slave = (F.col("master_host_id").isNotNull() | (lists_none & F.col("reports").isNotNull())
                | (F.col("known_replicas") == 0))
    return roles.select("host_id", "remark", "master_host_id", F.concat(
        F.when(F.coalesce(is_master, F.lit(False)), "M").otherwise(""),
        F.when(F.coalesce(is_slave, F.lit(False)), "S").otherwise("")).alias("role"))


def replication_health(replicas: DataFrame, positions: DataFrame) -> DataFrame:
    """Position gap, lag and thread state, with the master's position at the nearest earlier poll.

    The as-of lookup puts both sides on one time line per master and carries the last
    master position forward, so no pairs of polls are formed.
    """
    state = replicas.select(
        "host_id", "poll_id", "ts", "master_host_id", "slave_io_running", "slave_sql_running",
        F.when(F.col("master_log_file") == F.col("relay_master_log_file"),
               F.col("read_master_log_pos") - F.col("exec_master_log_pos")).alias("delay_pos_count"),
        F.coalesce("seconds_behind_master", F.lit(0)).alias("seconds_behind_master"))
    at = F.struct("log_file", "log_pos")
    master_rows = positions.select(F.col("host_id").alias("master_host_id"), "ts", F.lit(0).alias("side"), "poll_id",
                                   at.alias("at"))
    own = state.where("master_host_id IS NOT NULL").withColumn("side", F.lit(1))
    line = master_rows.unionByName(own, allowMissingColumns=True)
    # Two replicas of one master may poll at the same instant, so the host id is part of the order.
    asof = (filled(line, ["master_host_id"], ["ts", "side", "poll_id", "host_id"], {"seen": "at"})
            .where("side = 1").select(*state.columns, F.col("seen.log_file").alias("new_master_log_file"),
                                      F.col("seen.log_pos").alias("new_master_log_pos")))
    return asof.unionByName(state.where("master_host_id IS NULL"), allowMissingColumns=True)


def failover_check(replicas: DataFrame, expected: DataFrame) -> DataFrame:
    """Replicas that do not follow the expected master (host_id, expected_master) or are stopped."""
    joined = replicas.join(expected, "host_id", "left")
    return joined.select(
        "host_id", "master_host_id", "expected_master",
        (~F.col("master_host_id").eqNullSafe(F.col("expected_master"))).cast("int").alias("wrong_source"),
        ((F.col("slave_io_running") != "Yes") | (F.col("slave_sql_running") != "Yes")).cast("int").alias("stopped"),
    ).where("wrong_source = 1 OR stopped = 1")


def gtid_list(replicas: DataFrame) -> DataFrame:
    """One row per source of the executed set: number of ranges and gaps between them."""
    entry = F.explode(F.split(F.regexp_replace("executed_gtid_set", r"\s+", ""), ","))
    parts = replicas.select("host_id", "poll_id", entry.alias("gtid")).where("gtid <> ''")
    ranges = F.size(F.split("gtid", ":")) - 1
    return parts.select("host_id", "poll_id", "gtid", F.split_part("gtid", F.lit(":"), F.lit(1)).alias("source"),
                        ranges.alias("ranges"), (ranges - 1).alias("gaps"))


def binlog_size(logs: DataFrame) -> DataFrame:
    """Total log bytes per host."""
    return logs.groupBy("host_id").agg(F.sum("file_size").alias("binlog_size_total"))


def lock_waits(trx: DataFrame, locks: DataFrame, waits: DataFrame, distinct: bool = False) -> DataFrame:
    """Who waits for whom on each server: both transactions and their locks.

    Servers number their transactions from one, so the server is part of every key. A transaction with several locks gives several rows, as locks are found by
    transaction only. Joins are left to the optimizer: sides that measure small are
    broadcast, a blocker many wait for is a skewed partition that is split.
    """
    def side(name: str) -> DataFrame:
        t = trx.select("host_id", F.col("trx_id").alias(f"{name}_trx_id"), F.col("trx_mysql_thread_id").alias(f"{name}_thread"),
                       F.col("trx_state").alias(f"{name}_state"), F.col("trx_query").alias(f"{name}_query"),
                       *([F.col("trx_isolation_level")] if name == "waiting" else []))
        k = locks.select("host_id", F.col("lock_trx_id").alias(f"{name}_trx_id"), *[
            F.col(f"lock_{c}").alias(f"{name}_lock_{c}") for c in ("mode", "type", "table", "index")])
        return t.join(k, ["host_id", f"{name}_trx_id"])

    out = (waits.select("host_id", F.col("requesting_trx_id").alias("waiting_trx_id"), "blocking_trx_id")
           .join(side("waiting"), ["host_id", "waiting_trx_id"]).join(side("blocking"), ["host_id", "blocking_trx_id"]))
    return out.distinct() if distinct else out


def trx_lock_counts(trx: DataFrame, waits: DataFrame) -> DataFrame:
    """Number of transactions and of lock waits of each server, one row each."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select("host_id", *[F.lit(int(n == name)).cast("bigint").alias(n) for n in ("trx", "lock_waits")])

    both = one(trx, "trx").unionByName(one(waits, "lock_waits")).groupBy("host_id").agg(F.sum("trx").alias("trx"), F.sum("lock_waits").alias("lock_waits"))
    return both.unpivot(["host_id"], ["trx", "lock_waits"], "name", "total")


def lock_chains(waits: DataFrame) -> DataFrame:
    """Root blocker, depth and number of waiters behind that root, for every wait of every server.

    A transaction that waits for several others follows the oldest one. Pointers are
    doubled, so a chain of length n takes log2(n) rounds; each round is checkpointed. A
    round that resolves nothing more leaves only cycles: their root is null.
    """
    state = pin(waits.groupBy("host_id", F.col("requesting_trx_id").alias("node")).agg(F.min("blocking_trx_id").alias("ptr"))
                .select("host_id", "node", "ptr", F.lit(1).cast("bigint").alias("dist"), F.lit(False).alias("done")))
    open_rows = state.count()
    while open_rows:
        step = state.select("host_id", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"))
        moved = (state.where("NOT done").join(step, ["host_id", "ptr"], "left")
                 .select("host_id", "node", F.coalesce("next", "ptr").alias("ptr"),
                         (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNull().alias("done")))
        state = pin(state.where("done").unionByName(moved))
        remaining = state.where("NOT done").count()
        if remaining == open_rows:
            break
        open_rows = remaining
    found = state.select("host_id", F.col("node").alias("blocking_trx_id"), "ptr", "dist", "done")
    chains = waits.join(found, ["host_id", "blocking_trx_id"], "left").select(
        "host_id", "requesting_trx_id", "blocking_trx_id",
        F.when(F.col("done").isNull(), F.col("blocking_trx_id")).when(F.col("done"), F.col("ptr")).alias("root_trx_id"),
        F.when(F.coalesce("done", F.lit(True)), F.coalesce("dist", F.lit(0)) + 1).alias("depth"),
        (~F.coalesce("done", F.lit(True))).cast("int").alias("in_cycle"))
    # A transaction may have several waits with one root; distinct pairs are shuffled by pair first.
    sizes = (chains.select("host_id", "root_trx_id", "requesting_trx_id").distinct()
             .groupBy("host_id", "root_trx_id").agg(F.count("*").alias("root_waiters")))
    return chains.join(sizes, ["host_id", "root_trx_id"], "left")
